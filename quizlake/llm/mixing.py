"""Operator 7, mixing sources to target weights.

Efraimidis-Spirakis sampling: every document gets the exponential key ``-ln(u) / weight`` with ``u`` from a
hash of its id, so reruns agree. A source whose target is above its size is first taken whole, as many times as
fits; what remains is filled in key order. The order's prefix sums are taken over range partitions of
(source, key), so a hot source is spread over many tasks: sums per (partition, source) come first, then the
running sum inside each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, parts, text_of, written


def quality_weight(text) -> F.Column:
    """A weight from 0.5 to 1.5: plain prose (many letters a character) is likelier to be drawn."""
    n = F.length(text)
    share = F.when(n > 0, F.length(F.translate(text, "0123456789|#*$%&<>{}[]=+_~^\\/", "")) / n).otherwise(F.lit(0.0))
    return F.lit(0.5) + share


def source_targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn and share the whole size. A target stops at
    ``cap`` times its source's size and the excess is reshared by weight until none is above: the level of
    ``target = min(cap * size, level * weight)`` is found by one ordered pass over the sources: the first that
    isn't capped at the level of what the ones before it leave. Works on one row
    per source, so the single ordered partition is as long as the list of sources.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("ratio", cap * F.col("source_size") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.when(level <= F.col("ratio"), level))
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", F.coalesce(F.first("level", ignorenulls=True).over(ordered), F.lit(0.0)))
    return s.select("source", "source_size", F.least(cap * F.col("source_size"), F.col("level") * F.col("w")).cast("double").alias("target"))


def mix_sources(docs: DataFrame, weight=None, seed: int = 7, cap: float = 3.0, source_weights: tuple[float, ...] = (1.0, 2.0, 3.0), keep_uid: bool = False) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``size`` is the number of words; ``taken`` the words the mix takes, repeats counted: complete epochs of the
    source first, then whole documents in key order while they fit, then one more document of the source, the
    unpicked one whose size is nearest to what remains, where that brings the sum nearer. No document is cut.
    ``weight`` is a column of non-negative weights (null or 0: drawn last); default ``quality_weight``. Null
    text has size 0 and is never taken; a null source is a source of its own; rows that repeat an id are drawn
    one by one, in the order of their texts' digests. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "source", F.coalesce(F.col("text"), F.lit("")).alias("text"), (quality_weight(F.coalesce(F.col("text"), F.lit(""))) if weight is None else F.coalesce(weight, F.lit(0.0))).alias("w"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"))), 1, 12), 16, 10).cast("double") + 1) / float(2**48 + 1)
    key = F.when(F.col("w") > 0, -F.log(u) / F.col("w")).otherwise(F.lit(float("inf")))
    slim = written(d.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("uid")), "mix-slim")

    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = source_targets(sizes, cap, source_weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = written(t.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")

    order = ["key", "doc_id", "digest", "uid"]
    dealt = written(slim.repartitionByRange(parts(spark), "source", *order).withColumn("pid", F.spark_partition_id()), "mix-dealt")
    offsets = dealt.groupBy("source", "pid").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    at = offsets.alias("o").join(t.alias("t"), same("o", "t")).select("o.source", "o.pid", "o.offset", "t.source_size", "t.target", "t.epochs", "t.rest")
    run = F.sum("size").over(Window.partitionBy("d.source", "d.pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    picked = (
        dealt.alias("d").join(at.alias("a"), same("d", "a") & (F.col("d.pid") == F.col("a.pid")))
        .select("doc_id", "d.source", "size", "key", "digest", "uid", "source_size", "target", "epochs", "rest", (run + F.col("offset")).alias("upto"))
        .withColumn("picked", F.col("upto") <= F.col("rest"))
    )
    picked = written(picked, "mix-picked")
    gap = picked.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0))).alias("gap"))
    far = F.abs(F.col("size") - F.col("gap"))
    closing = (
        picked.alias("p").join(gap.alias("g"), same("p", "g")).where(~F.col("picked") & (far < F.col("gap")))
        .groupBy("p.source").agg(F.min(F.struct(far.alias("far"), *order))["uid"].alias("last_uid"))
    )
    out = picked.alias("p").join(closing.alias("c"), same("p", "c"), "left")
    taken = F.col("epochs") * F.col("size") + F.when(F.col("picked") | F.coalesce(F.col("uid") == F.col("last_uid"), F.lit(False)), F.col("size")).otherwise(0)
    return out.select("doc_id", "size", F.col("source_size").cast("long"), "target", taken.cast("long").alias("taken"), *(["uid"] if keep_uid else []))
