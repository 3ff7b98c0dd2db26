"""Operator 12, audit of how far the sources of a language diverge in their words.

A group is a language's source. Its kept terms are numbered, and its counts are arrays sorted by term number, cut
into slices of a bounded length. For each slice and each unordered pair of blocks of groups the arrays of both
blocks are co-grouped into one task, which merges every unordered pair: the terms of the shorter array are looked up
in the longer one, so that overlaps, one-sided terms and the terms that both lack are priced once, for both ways.
Slices of a pair are summed by Spark.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import with_index
from .common import forget, written

#: By byte of UTF-8: A-Z to lower case, other letters and everything beyond ASCII as they are, the rest to a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Divergence:
    """Parameters. A term is kept in a language if ``documents`` of its documents have it; ``slice`` terms and 2 * ``block`` groups meet in a task."""

    documents: int = 10
    scale: int = 1_000_000_000
    add: int = 2
    top: int = 10
    slice: int = 4096
    block: int = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group.

    Texts are dealt by group, a large group over many tasks, so that a task meets few groups and its own counts
    combine nearly all of their rows before Spark adds them up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        docs_with: dict[tuple, Counter] = defaultdict(Counter)  # with the same terms, in the same order

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                columns = [pa.repeat(lang, len(own)), pa.repeat(source, len(own)), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array(list(docs_with[lang, source].values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            n.clear(), docs_with.clear()

        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"], strict=True):
                own = Counter(text.as_buffer().to_pybytes().translate(_TERMS).split())
                n[lang, source].update(own)
                docs_with[lang, source].update(own.keys())
            if sum(map(len, n.values())) > 600_000:
                yield from flush()
        yield from flush()

    dealt = docs.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("lang", "source", "at").drop("at")
    made = dealt.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def prices(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), exact: neither value goes beyond a billion and one."""
    d = p - q
    return d * d // (p + q)


def shares(count: np.ndarray, total: int, d: Divergence) -> np.ndarray:
    """1 + floor(scale * (count + add) / total), exact at any count."""
    if len(count) and int(count.max()) + d.add >= (1 << 62) // d.scale:
        return np.array([1 + d.scale * (int(c) + d.add) // total for c in count], dtype=np.int64)
    return 1 + d.scale * (count + d.add) // total


def merged(a: tuple, b: tuple, kept: int) -> int:
    """The price of all ``kept`` terms of a slice for two groups, each (sorted term numbers, their shares, the share of a term it lacks)."""
    short, long = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.searchsorted(long[0], short[0])  # of each term its place in the longer array
    hit = np.zeros(len(at), dtype=bool)
    inside = at < len(long[0])
    hit[inside] = long[0][at[inside]] == short[0][inside]
    both = at[hit]
    one_sided = np.ones(len(long[0]), dtype=bool)
    one_sided[both] = False
    out = int(prices(short[1][hit], long[1][both]).sum()) + int(prices(short[1][~hit], long[2]).sum()) + int(prices(long[1][one_sided], short[2]).sum())
    absent = kept - len(short[0]) - len(long[0]) + len(both)
    return out + absent * ((a[2] - b[2]) ** 2 // (a[2] + b[2]))


def _div(over: Column, under: Column, d: Divergence) -> Column:
    """1 + floor(scale * (over + add) / under) in decimals of 38 digits."""
    wide = F.lit(d.scale).cast("decimal(18,0)") * (over + d.add).cast("decimal(19,0)")
    return F.call_function("div", wide.cast("decimal(38,0)"), under.cast("decimal(20,0)")) + 1


def _pair_values(arrays: DataFrame, d: Divergence) -> DataFrame:
    """``lang, a, b, value`` of each unordered pair of groups, summed over slices. ``arrays``: lang, slice, kept, no, total, vocabulary, blocks, ids, counts."""
    own = (F.col("no") % F.col("blocks")).cast("int")
    dealt = arrays.withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    dealt = written(dealt, "audit-arrays")
    key = ["lang", "slice", "i", "j"]
    fields = [*key, "kept", "no", "total", "vocabulary", "ids", "counts"]
    left = dealt.where("mine = i").select(*fields)
    right = dealt.where("mine = j and i <> j").select(*[F.col(c).alias(c) for c in fields])  # a block with itself needs one side

    def read(t: pa.Table) -> list[tuple]:
        out = []
        for no, total, v, ids, counts in zip(*(t[c].to_pylist() for c in ("no", "total", "vocabulary")), *(t[c] for c in ("ids", "counts")), strict=True):
            under = total + d.add * v
            ids, counts = (x.values.to_numpy() if x.values is not None else np.empty(0, np.int64) for x in (ids, counts))
            out.append((no, ids, shares(counts, under, d), 1 + d.scale * d.add // under))
        return sorted(out, key=lambda g: g[0])

    def price(x: pa.Table, y: pa.Table) -> pa.Table:
        lang, kept = (x if len(x) else y)["lang"][0].as_py(), (x if len(x) else y)["kept"][0].as_py()
        a, b = read(x), read(y)
        pairs = [(g, h) for k, g in enumerate(a) for h in (b if len(y) else a[k + 1 :])]
        values = [merged(g[1:], h[1:], kept) for g, h in pairs]
        ends = [sorted((g[0], h[0])) for g, h in pairs]
        return pa.table({"lang": pa.array([lang] * len(pairs), pa.string()), "a": pa.array([e[0] for e in ends], pa.int32()), "b": pa.array([e[1] for e in ends], pa.int32()), "value": pa.array(values, pa.int64())})

    made = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(price, "lang string, a int, b int, value long")
    return made.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, d: Divergence = Divergence()) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` prices every other source of the language, part ``term`` the ``top`` terms that a group overuses.

    Null texts, languages and sources count as ''. Terms are runs of letters and of everything beyond ASCII, A-Z in
    lower case. A language keeps the V terms that ``documents`` of its documents have. With N the occurrences of kept
    terms, a group's share of a term is p = 1 + floor(scale * (count + add) / (N + add * V)), and so is the
    language's; two shares cost floor((p - q)^2 / (p + q)). A pair's value is summed over all kept terms (0 without
    any); terms are those the group has with a share above its language's. Ranks go by value, then by item.
    Repeated rows all count; other columns are ignored; an empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = docs.select(text("lang"), text("source"), text("text"))
    counts = written(term_counts(base), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= d.documents).drop("docs")
    terms = written(with_index(kept, ["lang", "term"], "id"), "audit-terms")
    own = written(counts.join(terms, ["lang", "term"]).drop("docs"), "audit-own")
    forget(counts)

    # a row a group; sources are numbered inside their language
    groups = base.select("lang", "source").distinct().join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    groups = groups.join(langs, "lang", "left").na.fill(0, ["total", "vocabulary", "lang_total"])
    numbers = Window.partitionBy("lang").orderBy("source")
    groups = groups.withColumn("no", (F.row_number().over(numbers) - 1).cast("int")).withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / d.block).cast("int"))
    groups = written(groups, "audit-groups")

    # every group has an array in every slice of its language, empty where it has none of the terms
    cut = terms.groupBy("lang", F.floor(F.col("id") / d.slice).alias("slice")).agg(F.count(F.lit(1)).alias("kept"))
    pieces = own.groupBy("lang", "source", F.floor(F.col("id") / d.slice).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("x"))
    slots = groups.join(cut, "lang")
    none = F.array().cast("array<bigint>")
    arrays = slots.join(pieces, ["lang", "source", "slice"], "left").select("lang", "slice", "kept", "no", "total", "vocabulary", "blocks", F.coalesce("x.id", none).alias("ids"), F.coalesce("x.n", none).alias("counts"))
    values = written(_pair_values(arrays, d), "audit-pairs")
    both = values.select("lang", F.col("a").alias("no"), F.col("b").alias("other"), "value").union(values.select("lang", "b", "a", "value"))
    names = groups.select("lang", "source", "no")
    every = names.join(names.select("lang", F.col("source").alias("item"), F.col("no").alias("other")), "lang").where("no <> other")
    pairs = every.join(both, ["lang", "no", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    g = groups.select("lang", "source", (F.col("total") + d.add * F.col("vocabulary")).alias("under"), (F.col("lang_total") + d.add * F.col("vocabulary")).alias("lang_under"))
    over = own.join(g, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _div(F.col("n"), F.col("under"), d).alias("p"), _div(F.col("lang_n"), F.col("lang_under"), d).alias("q")).where("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    over = over.withColumn("rank", rank).where(F.col("rank") <= d.top)
    return pairs.withColumn("rank", rank).unionByName(over)
