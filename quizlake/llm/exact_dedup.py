"""Operator 5, exact deduplication.

Rows are grouped by the 128-bit MD5 of their normalised text and, inside a hash group, by the text's
bytes themselves, so two texts that share a hash are never taken for one. The grouping combines on the map
side: a group of copies leaves each task as one row, however large it is. The text is shuffled once; all
later joins carry only ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_of, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space becomes one space; a null text counts
    as empty. Of equal texts the row with the smallest id stays. Rows that repeat an id and text: exactly one
    stays. Null ids sort last (they stay only where a group has no other id; then ``keep_id`` is null). Extra
    columns are ignored; an empty table gives an empty result.
    """
    base = text_of(docs.withColumnRenamed(id_col, "doc_id"), "doc_id", "text").withColumn("norm", F.regexp_replace("text", SPACES, " "))
    key = [F.md5(F.col("norm").cast("binary")).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")]
    slim = written(base.select("doc_id", *key, F.monotonically_increasing_id().alias("uid")), "dedup-slim")
    classes = (
        base.select("doc_id", "norm", key[0])
        .groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", key[1], "keep_id", "group_size")
    )
    first = slim.groupBy("h", "sha", F.col("doc_id").alias("f_id")).agg(F.min("uid").alias("keep_uid"))
    classes = classes.alias("c").join(first.alias("f"), (F.col("c.h") == F.col("f.h")) & (F.col("c.sha") == F.col("f.sha")) & F.col("c.keep_id").eqNullSafe(F.col("f.f_id"))).select("c.*", "keep_uid")
    return slim.join(classes, ["h", "sha"]).select("doc_id", "keep_id", F.col("group_size").cast("long"), (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))
