"""Exam-question analytics on Spark: DataFrame -> DataFrame operators."""
