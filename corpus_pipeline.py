"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import line_dedup, mixing, ngram_join, sentencepiece, toxicity
from quizlake.llm.common import keyed_rows, one_a_key, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (learned from ``labels``, held-out ids aside) rejects go.

    Null and empty texts get the model's bias, which is clean; repeated rows are judged alike and all stay or go;
    an empty table stays empty, and without labels nothing goes.
    """
    model = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    rows = keyed_rows(docs).select("row", "text")
    return toxicity.score_toxicity(rows, model).where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; ``n_chars`` follows the text. A document left without a line goes."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that copies and links connect, the one with the smallest id stays (null last, then the smallest digest of id and text); documents linked to nothing all stay.

    Of rows that repeat an id and text one stays, the first by a digest of its other columns.
    """
    rows = keyed_rows(docs)
    near = ngram_join.ngram_join(rows.select(F.col("row_key").alias("doc_id"), "text")).where((F.col("n_links") > 0) | (F.col("n_copies") > 1))
    near = near.select(F.col("doc_id").alias("row_key"), "class_id").distinct().join(rows.select("row_key", "doc_id").distinct(), "row_key")
    near = written(near, "near-classes")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    stays = written(near.groupBy("class_id").agg(F.min(place)["row_key"].alias("stays")), "near-stays")
    goes = near.join(stays, "class_id").where(F.col("row_key") != F.col("stays")).select("row_key")
    return one_a_key(rows.join(goes, "row_key", "left_anti")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a document stands as often as the mix takes it; what is not taken goes.

    Null sources are a source of their own. Documents without words have nothing to take and go. Of rows that repeat an id
    and text one stands for all, the first by a digest of its other columns. An empty table stays empty.
    """
    rows = keyed_rows(docs)
    taken = mixing.mix_sources(rows.select(F.col("row_key").alias("doc_id"), "source", "text")).where("taken > 0")
    times = taken.groupBy(F.col("doc_id").alias("row_key")).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("times"))
    out = one_a_key(rows).join(times, "row_key")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids; null and empty texts have none, repeated rows all stay, an empty table stays empty."""
    return sentencepiece.encode_pieces(docs, sentencepiece.load_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", one_of_near),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: The stages train a model and search near copies, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
