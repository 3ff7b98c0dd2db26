"""Training-data operators: thirteen DataFrame -> DataFrame operators and their queries.

Nothing outside this subpackage imports it.
"""
