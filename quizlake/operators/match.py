"""Fuzzy matching of questions against a reference bank.

The score is the Indel ratio 2 * LCS / (len a + len b). At a threshold t a pair must satisfy, without loss:
lengths within min / max >= t / (2 - t); at least t * (a + b) / 2 common letters; and at least
(1.5 t - 1) * (a + b) - 1 common bigrams. For t >= 0.85 that makes an equi-join on the rarest bigrams of each text
(prefix join); below, the filters are too weak for one and blocks of pairs are compared, letter bags first, each score
only as far as it can still reach t.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import encoded, indel_ratio, lcs_lengths, nonempty, normalize_text, percent, ratio, tier
from ..sources.scratch import written


def match_text(text: Column, *options: Column, correct: Column | None = None) -> Column:
    """Normalised text and options joined by spaces, blanks left out; with ``correct`` for full mode."""
    parts = [normalize_text(c) for c in (text, *options, *([correct] if correct is not None else []))]
    return F.array_join(F.array_compact(F.array(*[nonempty(p) for p in parts])), " ")


def _grams(rows: DataFrame) -> DataFrame:
    """``id, t, gram``: bigrams with their number of earlier occurrences, so that bags are compared as sets."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))
    g = rows.select("id", "t", F.posexplode(pairs).alias("pos", "g"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("id", "g").orderBy("pos"))).select("id", "t", F.concat_ws("#", "g", "k").alias("gram"))


def _prefix_pairs(source: DataFrame, ref: DataFrame, t: float) -> DataFrame:
    """Pairs that can reach ``t`` by their rare bigrams."""
    alike = (1.5 * t - 1) * 2 / (2 - t)  # of a, common bigrams at least, with the shortest partner allowed
    both = _grams(source).withColumn("side", F.lit(0)).union(_grams(ref).withColumn("side", F.lit(1)))
    common = both.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = both.join(common, "gram").withColumn("rn", F.row_number().over(Window.partitionBy("side", "id").orderBy("n", "gram")))
    prefix = F.greatest(F.lit(1), (F.length("t") - 1) - F.ceil(alike * F.length("t") - 1) + 1)
    kept = ranked.where(F.col("rn") <= prefix)
    a, b = (kept.where(F.col("side") == k).select(F.col("id").alias(i), F.length("t").alias(n), "gram") for k, i, n in ((0, "source_id", "la"), (1, "ref_id", "lb")))
    near = F.least("la", "lb") >= t / (2 - t) * F.greatest("la", "lb")
    return a.join(b, "gram").where(near).select("source_id", "ref_id").distinct()


def _cut(rows: DataFrame, size: int) -> int:
    """Into how many blocks of about ``size`` rows."""
    return max(1, -(-rows.count() // size))


def _bags(codes: np.ndarray, most: int) -> np.ndarray:
    """How often each character occurs in each text."""
    at = np.arange(len(codes))[:, None] * (most + 1) + codes
    return np.bincount(at.ravel(), minlength=len(codes) * (most + 1)).reshape(len(codes), most + 1)[:, 1:].astype(np.int32)


def _by_band(rows: DataFrame, width: float, size: int) -> tuple[DataFrame, dict[int, int]]:
    """(rows with their length band, blocks of about ``size`` rows of each band). A band a factor of length: a few dozen at most."""
    banded = rows.withColumn("band", F.floor(F.log(F.length("t")) / width).cast("int"))
    return banded, {r["band"]: -(-r["count"] // size) for r in banded.groupBy("band").count().collect()}


def _block_pairs(source: DataFrame, ref: DataFrame, t: float, block: tuple[int, int] = (512, 4096)) -> DataFrame:
    """All pairs within the length band, scored in blocks: lengths share a band of texts, a band is cut into blocks by its own count.

    N x M comparisons stay N x M; they are spread over (band, block, band, block) groups of a bounded size.
    """
    width = math.log(max(1.0001, (2 - t) / t))
    (s, n), (r, m) = _by_band(source, width, block[0]), _by_band(ref, width, block[1])
    meet = [(a, b) for a in n for b in m if abs(a - b) <= 1]
    if not meet:
        return source.select(F.col("id").alias("source_id"), F.col("id").alias("ref_id"), F.lit(0.0).alias("similarity")).limit(0)
    pairs = source.sparkSession.createDataFrame([(a, b, n[a], m[b]) for a, b in meet], "a int, b int, n int, m int")
    s = s.join(F.broadcast(pairs), F.col("band") == F.col("a")).withColumn("i", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    s = s.select("id", "t", "a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    r = r.join(F.broadcast(pairs), F.col("band") == F.col("b")).withColumn("j", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    r = r.select("id", "t", F.col("a").alias("a"), F.col("b").alias("b"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "j")
    id_type = dict(source.dtypes)["id"]

    def compare(left, right):
        ia, ib = left["id"].to_numpy(zero_copy_only=False), right["id"].to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        if len(ia) and len(ib):
            right = right.take(np.argsort(pc.utf8_length(right["t"]).to_numpy(), kind="stable"))
            ib = right["id"].to_numpy(zero_copy_only=False)
            (a, la), (b, lb) = encoded(left["t"].to_pylist(), right["t"].to_pylist())
            most = int(max(a.max(initial=0), b.max(initial=0)))
            x, y = _bags(a, most), _bags(b, most)
            for p in range(len(a)):
                both = np.minimum(x[p], y).sum(axis=1)
                near = np.flatnonzero(2 * both >= t * (la[p] + lb) - 1e-9)
                for at in range(0, len(near), 1024):  # by length, so that few steps are taken for short texts beside long ones
                    q = near[at : at + 1024]
                    need = np.ceil(t * (la[p] + lb[q]) / 2 - 1e-9)
                    score = 2 * lcs_lengths(a[p, : la[p]], b[q, : lb[q].max()], most, need) / (la[p] + lb[q])
                    good = score >= t
                    out.append((np.repeat(ia[p], good.sum()), ib[q[good]], score[good]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table({"source_id": pa.array(columns[0], left["id"].type), "ref_id": pa.array(columns[1], left["id"].type), "similarity": pa.array(columns[2], pa.float64())})

    return s.groupBy("a", "b", "i", "j").cogroup(r.groupBy("a", "b", "i", "j")).applyInArrow(compare, f"source_id {id_type}, ref_id {id_type}, similarity double")


def similar_pairs(source: DataFrame, ref: DataFrame, t: float = 0.75, prefix_from: float = 0.85) -> DataFrame:
    """``source_id, ref_id, similarity`` of all pairs of normalised texts (``id, t``) with ratio >= ``t``.

    Texts shorter than 5 characters match nothing. Equal texts are one text: they are compared once and expanded
    at the end.
    """
    def classes(x: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = x.where(F.length("t") >= 5)
        own = written(own.select("id", "t"), "match-texts")
        return written(own.groupBy("t").agg(F.min("id").alias("id")), "match-classes"), own

    (s, s_all), (r, r_all) = classes(source), classes(ref)
    if t >= prefix_from:
        pairs = _prefix_pairs(s, r, t).join(s.select(F.col("id").alias("source_id"), F.col("t").alias("a")), "source_id").join(r.select(F.col("id").alias("ref_id"), F.col("t").alias("b")), "ref_id")
        pairs = pairs.withColumn("similarity", indel_ratio("a", "b")).where(F.col("similarity") >= t).select("source_id", "ref_id", "similarity")
    else:
        pairs = _block_pairs(s, r, t)
    sa = s.withColumnRenamed("id", "source_id").join(s_all.withColumnRenamed("id", "own"), "t").select("source_id", F.col("own").alias("_s"))
    ra = r.withColumnRenamed("id", "ref_id").join(r_all.withColumnRenamed("id", "own"), "t").select("ref_id", F.col("own").alias("_r"))
    return pairs.join(sa, "source_id").join(ra, "ref_id").select(F.col("_s").alias("source_id"), F.col("_r").alias("ref_id"), "similarity")


def approximate_pairs(source: DataFrame, ref: DataFrame, t: float = 0.75, tables: int = 12, features: int = 1 << 16) -> DataFrame:
    """``similar_pairs`` by MinHash LSH over bigrams: faster on large banks, and misses some pairs. Never the default."""
    from pyspark.ml.feature import HashingTF, MinHashLSH

    def vectors(x: DataFrame) -> DataFrame:
        grams = F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))
        return HashingTF(inputCol="grams", outputCol="v", numFeatures=features, binary=True).transform(x.where(F.length("t") >= 5).withColumn("grams", grams)).drop("grams")

    a, b = vectors(source), vectors(ref)
    model = MinHashLSH(inputCol="v", outputCol="h", numHashTables=tables, seed=1).fit(b)
    near = model.approxSimilarityJoin(a, b, 0.8, "far").select(F.col("datasetA.id").alias("source_id"), F.col("datasetB.id").alias("ref_id"), F.col("datasetA.t").alias("a"), F.col("datasetB.t").alias("b"))
    return near.withColumn("similarity", indel_ratio("a", "b")).where(F.col("similarity") >= t).select("source_id", "ref_id", "similarity")


def top_candidates(pairs: DataFrame, k: int = 5, score: str = "similarity") -> DataFrame:
    """The ``k`` best references of each source, ties to the lower reference."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc(score), "ref_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def fuzzy_match(source: DataFrame, ref: DataFrame, t: float = 0.75, k: int = 5, extra: Column | None = None) -> DataFrame:
    """One row per source: best reference and score (0 and null where none), all ``k`` candidates, a stable id and the tier.

    ``extra`` is a further condition on (source_id, ref_id), applied before the ranking.
    """
    pairs = similar_pairs(source, ref, t)
    pairs = pairs.where(extra) if extra is not None else pairs
    best = top_candidates(pairs, k).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "similarity"))).alias("c"))
    out = source.select(F.col("id").alias("source_id")).join(best, "source_id", "left")
    out = out.select("source_id", F.md5(F.col("source_id").cast("string")).alias("qcm_id"), F.col("c")[0]["ref_id"].alias("ref_id"), F.coalesce(F.col("c")[0]["similarity"], F.lit(0.0)).alias("similarity"), F.transform("c", lambda x: F.struct(x["ref_id"].alias("ref_id"), x["similarity"].alias("similarity"))).alias("candidates"))
    return out.withColumn("tier", tier(F.col("similarity")))


def best_by_bound(text: np.ndarray, bag: np.ndarray, others: np.ndarray, lengths: np.ndarray, bags: np.ndarray, place: np.ndarray, most: int, first: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of the ``first`` best of ``others`` with a ratio of at least ``least``, their ratios, how many were scored).

    No ratio exceeds what lengths and letter bags allow. Others are scored in the order of that bound, more at a time as
    the search goes on, until the next bound is below the last of the best so far; ties go to the smaller ``place``.
    """
    n = len(text)
    bound = 2 * np.minimum(bag, bags).sum(axis=1) / np.maximum(n + lengths, 1)
    order = np.lexsort((place, -bound))
    best, score, at, step, limit = np.empty(0, int), np.empty(0), 0, 4 * first, least
    while at < len(order) and bound[order[at]] >= limit - 1e-12:
        q = order[at : at + step]
        q = q[bound[q] >= limit - 1e-12]
        at, step = at + len(q), 2 * step
        got = lcs_lengths(text, others[q, : max(1, lengths[q].max())], most, np.ceil(limit * (n + lengths[q]) / 2 - 1e-9))
        best, score = np.concatenate([best, q]), np.concatenate([score, 2 * got / (n + lengths[q])])
        keep = np.lexsort((place[best], -score))[:first]
        keep = keep[score[keep] >= least]
        best, score = best[keep], score[keep]
        if len(best) == first:
            limit = max(least, score[-1])
    return best, score, at


def weighted_match(source: DataFrame, ref: DataFrame, t: float = 0.75, text_weight: float = 0.7, first: int = 20, k: int = 5, block: int = 2048) -> DataFrame:
    """``source_id, ref_id, similarity, text_similarity, corr_similarity, rank``: the ``first`` best by text, then by the weighted sum.

    ``source, ref``: ``id, t, c`` (normalised text and answer). The answer score is 0 where either answer is
    blank. The text score has no lower bound among the ``first``, but a pair whose text score can't reach ``t`` with a full
    answer score is left out at the end in any case, and takes nobody's place; so only references whose bound
    (lengths, letter bags) reaches that score and the worst of the best so far are scored. Both sides are cut into blocks
    of about ``block`` rows, each pair of blocks keeps its own best ``first``, and only those are merged.
    """
    n, m = _cut(source, block), _cut(ref, block)
    s = source.where(F.length("t") >= 5).select("id", "t", "c", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"))
    r = ref.select("id", F.coalesce("t", F.lit("")).alias("t"), "c", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    kind = dict(source.dtypes)["id"]
    least = max(0.0, (t - (1 - text_weight)) / text_weight - 1e-9) if text_weight > 0 else 0.0

    def best(left, right):
        names, answers = right["id"].to_numpy(zero_copy_only=False), right["c"].to_pylist()
        out: list[tuple] = []
        if len(left) and len(right):
            (a, la), (b, lb) = encoded(left["t"].to_pylist(), right["t"].to_pylist())
            most, place = int(max(a.max(initial=0), b.max(initial=0))), np.unique(names, return_inverse=True)[1]
            x, y = _bags(a, most), _bags(b, most)
            for p, (i, ca) in enumerate(zip(left["id"].to_pylist(), left["c"].to_pylist(), strict=True)):
                top, score, _ = best_by_bound(a[p, : la[p]], x[p], b, lb, y, place, most, first, least)
                out += [(i, names[q], v, ratio(ca, answers[q]) if ca and answers[q] else 0.0) for q, v in zip(top.tolist(), score.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"source_id": pa.array(columns[0], left["id"].type), "ref_id": pa.array(columns[1], left["id"].type), "text_similarity": pa.array(columns[2], pa.float64()), "corr_similarity": pa.array(columns[3], pa.float64())})

    pairs = s.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInArrow(best, f"source_id {kind}, ref_id {kind}, text_similarity double, corr_similarity double")
    pairs = top_candidates(pairs, first, "text_similarity").drop("rank")
    pairs = pairs.withColumn("similarity", text_weight * F.col("text_similarity") + (1 - text_weight) * F.col("corr_similarity")).where(F.col("similarity") >= t)
    return top_candidates(pairs, k)


def match_summary(matches: DataFrame) -> DataFrame:
    """Number of matches above 0, mean score (4 digits) and tiers."""
    m = matches.where("similarity > 0").withColumn("tier", tier(F.col("similarity")))
    return m.agg(F.count(F.lit(1)).alias("matched"), F.round(F.avg("similarity"), 4).alias("mean_similarity"), *[F.count_if(F.col("tier") == x).alias(x) for x in ("green", "yellow", "red")])


#: Fields of a short record, columns of the report and of the full export.
SLIM = ("Num", "Text", "A", "B", "C", "D", "E", "Correct", "Year", "subcategoryName", "categoryName", "Tag", "Source")
_OWN = (("Num", "num"), ("Text", "question"), ("Correct", "correct"), ("Year", "year"), ("subcategoryName", "sub"))
EXPORT = (
    ("Num", "Num"), ("Text", "Question"), ("A", "A"), ("B", "B"), ("C", "C"), ("D", "D"), ("E", "E"), ("Correct", "Correct"), ("Year", "Year"),
    ("categoryName", "Category"), ("subcategoryName", "Subcategory"), ("Tag", "Tag"), ("Source", "Source"),
)
EXPORT_REF = (("Num", "Ref #"), ("Text", "Ref Question"), ("Correct", "Ref Correct"), ("Year", "Ref Year"))


def slim(rows: DataFrame, fields: tuple[str, ...] = SLIM) -> Column:
    """A record of ``fields`` as text; one that is missing or null is taken from the name in lower case, else empty."""
    have = {f.name for f in rows.schema.fields}
    pick = lambda n: F.coalesce(*[F.col(f"`{c}`").cast("string") for c in (n, n.lower()) if c in have], F.lit(""))
    return F.struct(*[pick(n).alias(n) for n in fields])


def full(rows: DataFrame, tags: str = "Tag") -> Column:
    """A record of all columns, a list of tags as joined text."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ", ")
    return F.struct(*[(joined(n) if n == tags and t.startswith("array") else F.col(f"`{n}`")).alias(n) for n, t in rows.dtypes])


def order_matches(matches: DataFrame) -> DataFrame:
    """Best first, unmatched last, ties by source."""
    return matches.orderBy(F.desc_nulls_last("similarity"), "source_id")


def _text(record: str, field: str, have: set[str]) -> Column:
    return F.coalesce(F.col(f"{record}.{field}").cast("string"), F.lit("")) if field in have else F.lit("")


def _fields(rows: DataFrame, record: str) -> set[str]:
    return set(rows.schema[record].dataType.names)


def match_report(matches: DataFrame, mode: str = "text_only") -> DataFrame:
    """The 14 columns of the report and the colour band, best first, ties by the source's number.

    ``matches``: ``similarity, text_similarity, corr_similarity`` and structs ``source, ref`` of template columns.
    """
    score = lambda c: F.when(F.col(c).isNotNull(), percent(F.col(c))).otherwise("")
    pick = lambda side: [_text(side, c, _fields(matches, side)).alias(f"{side}_{n}") for c, n in _OWN]
    columns = [*pick("source"), *[score(c).alias(n) for c, n in (("similarity", "match_score"), ("text_similarity", "text_score"), ("corr_similarity", "corr_score"))], F.lit(mode).alias("mode"), *pick("ref")]
    return matches.where("similarity > 0").orderBy(F.desc("similarity"), "source.Num").select(*columns, tier(F.col("similarity")).alias("band"))


def match_export(matches: DataFrame, low: float = 0.0, high: float = 0.6, ids: DataFrame | None = None) -> DataFrame:
    """Matches with ``low`` <= similarity <= ``high``, or those of ``ids`` (``qcm_id``), labelled; ``No match`` at 0."""
    chosen = matches.where(F.col("similarity").between(low, high)) if ids is None else matches.join(ids.select("qcm_id").distinct(), "qcm_id", "left_semi")
    return chosen.withColumn("label", F.when(F.col("similarity") == 0, "No match").otherwise(percent(F.col("similarity"))))


def export_sheet(matches: DataFrame) -> DataFrame:
    """The 19 columns of the full export and the colour band (grey without a match), from ``match_export``."""
    own, ref = _fields(matches, "source"), _fields(matches, "ref")
    band = F.when(F.col("similarity") == 0, "grey").otherwise(tier(F.col("similarity")))
    return matches.select(F.col("qcm_id").alias("ID"), *[_text("source", c, own).alias(n) for c, n in EXPORT], F.col("label").alias("Similarity"), *[_text("ref", c, ref).alias(n) for c, n in EXPORT_REF], band.alias("band"))
