"""Operator 6, approximate nearest neighbours by inner product.

Vectors are extended by one component so that the nearest by distance are those of the largest inner product,
rotated at random, and dealt to the lists of a k-means index. In each probed list distances are summed over
blocks of columns; after every block a hypothesis test compares a candidate's partial distance, scaled to
all columns, with the query's threshold, and abandons it early. What is left is scored exactly, in double
precision, on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class AnnIndex:
    """Parameters. About sqrt(n) lists, at most ``lists``; the index is fitted on ``sample`` rows, or ten a list where that is
    more; every row is indexed. As many lists are probed as hold the share ``recall`` of the sample's true neighbours.
    A task searches at most ``rows`` candidates of a list for at most ``asked`` queries."""

    k: int = 20
    sample: int = 20_000
    lists: int = 16_384
    recall: float = 0.97
    columns: int = 16
    significance: float = 2.1
    rows: int = 4096
    asked: int = 8192
    seed: int = 17


def _usable(v: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    inf = float("inf")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest_list(x, c)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def _nearest_list(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(half - x[a : a + 1024] @ c.T).argmin(axis=1) for a in range(0, len(x), 1024)]) if len(x) else np.empty(0, int)


def scan_block(q: np.ndarray, v: np.ndarray, k: int, columns: int, significance: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places that are left of all pairs after the adaptive scan of a list.

    The threshold of a query is the k-th distance among the candidates that look nearest after the first block.
    A candidate is abandoned once sqrt(partial * D / d) exceeds threshold * (1 + significance / sqrt(d)).
    """
    full, n = q.shape[1], min(2 * k, len(v))
    part, limit = np.zeros((len(q), len(v)), dtype=np.float32), np.full(len(q), np.inf)
    qi = None
    for a in range(0, full, columns):
        b = min(a + columns, full)
        slack = (1 + (significance / np.sqrt(b) if b < full else 0)) ** 2 * (b / full)
        if qi is None:  # most candidates are alive: a product for the whole block of columns
            x, y = q[:, a:b], v[:, a:b]
            part += (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
            if a == 0 and len(v) >= k:
                looks = np.argpartition(part, n - 1, axis=1)[:, :n] if n < len(v) else np.broadcast_to(np.arange(len(v)), (len(q), n))
                exact = ((q[:, None, :] - v[looks]) ** 2).sum(axis=2)
                limit = np.sort(exact, axis=1)[:, k - 1] * (1 + 1e-4) + 1e-6
            alive = part <= (limit * slack)[:, None]
            if b == full or alive.mean() < 0.2:
                qi, vi = np.nonzero(alive)
                some = part[qi, vi]
        else:
            some = some + ((q[qi, a:b] - v[vi, a:b]) ** 2).sum(axis=1)
            stay = some <= limit[qi] * slack
            qi, vi, some = qi[stay], vi[stay], some[stay]
    return qi, vi


def probes_for(x: np.ndarray, y: np.ndarray, raw: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """How many lists hold the share ``recall`` of the true neighbours, measured on the sample: ``x`` as candidates, ``y`` as queries."""
    n = min(queries, len(raw))
    if len(raw) < 2:
        return len(centres)
    near = _nearest_list(x, centres)
    score = raw[:n] @ raw.T
    score[np.arange(n), np.arange(n)] = -np.inf
    top = np.argsort(-score, axis=1)[:, : min(k, len(raw) - 1)]
    order = np.argsort((centres * centres).sum(axis=1)[None] / 2 - y[:n] @ centres.T, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    return int(np.quantile(np.take_along_axis(place, near[top], axis=1), recall)) + 1


def nearest(vectors: DataFrame, is_query: Column, p: AnnIndex = AnnIndex()) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest of all other rows, ties to the smaller id.

    ``vectors``: ``vec_id, embedding``. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do null ids or vectors of another length than most have. Rows that repeat an id count once (the
    smallest vector). A query with fewer candidates in its lists than ``k`` gets those of all lists. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    v = v.where(_usable(F.col("embedding")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("is_query").alias("is_query"))
    v = written(v.withColumn("dim", F.size("embedding")), "ann-vectors")
    most = v.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return spark.createDataFrame([], out)
    dim, total = most["dim"], most["count"]
    v = v.where(F.col("dim") == dim).drop("dim")
    top = v.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()[0]

    rng = np.random.default_rng(p.seed)
    turn = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0]
    k_lists = max(1, min(p.lists, round(total**0.5)))
    seen = v.orderBy(F.xxhash64("vec_id")).limit(max(p.sample, 10 * k_lists)).select("embedding").toArrow()
    seen = seen["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dim)

    def lifted(x: np.ndarray, query: bool) -> np.ndarray:
        """Extended so that distance orders as inner product, scaled to the longest vector, rotated."""
        scale = top**0.5
        x = x / scale
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return (np.concatenate([x, last[:, None]], axis=1) @ turn).astype(np.float32)

    centres = _kmeans(lifted(seen, False), min(k_lists, len(seen)), rng)
    probes = probes_for(lifted(seen, False), lifted(seen, True), seen, centres, p.k, p.recall)
    kept = spark.sparkContext.broadcast((centres, turn))  # at most ``lists`` centres

    def deal(batches):
        c = kept.value[0]
        for b in batches:
            x = b["embedding"].flatten().to_numpy().reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["embedding"], b["is_query"], pa.array(_nearest_list(lifted(x, False), c), pa.int32())], ["vec_id", "embedding", "is_query", "list"])

    def probe(batches):
        c = kept.value[0]
        for b in batches:
            x = b["embedding"].flatten().to_numpy().reshape(-1, dim)
            far = (c * c).sum(axis=1)[None] / 2 - lifted(x, True) @ c.T
            best = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < len(c) else np.broadcast_to(np.arange(len(c)), far.shape)
            of = pa.array(np.repeat(np.arange(len(x)), best.shape[1]))
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(of), b["embedding"].take(of), pa.array(best.ravel().astype(np.int32))], ["query_id", "embedding", "list"])

    dealt = written(v.mapInArrow(deal, "vec_id long, embedding array<double>, is_query boolean, list int"), "ann-lists")
    pieces = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / p.rows).cast("int").alias("pieces"))  # a row a list

    def search(left, right):
        rows: list[tuple] = []
        if len(left) and len(right):
            ids, names = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
            x, y = (t["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dim) for t in (left, right))
            xs, ys = lifted(x, False), lifted(y, True)
            for a in range(0, len(y), 256):
                qi, vi = scan_block(ys[a : a + 256], xs, p.k + 1, p.columns, p.significance)
                other = ids[vi] != names[a + qi]
                qi, vi = qi[other], vi[other]
                score = np.einsum("ij,ij->i", y[a + qi], x[vi])
                order = np.lexsort((ids[vi], -score, qi))
                qi, vi, score = qi[order], vi[order], score[order]
                begin = np.searchsorted(qi, np.arange(qi.max() + 1 if len(qi) else 0))
                keep = np.arange(len(qi)) - begin[qi] < p.k if len(qi) else np.zeros(0, bool)
                rows.append((names[a + qi[keep]], ids[vi[keep]], score[keep]))
        q, i, s = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    def run(asked: DataFrame) -> DataFrame:
        """A list is cut into pieces by its candidates and into parts by the queries that probe it: a candidate is copied once for every ``asked`` of those."""
        asked = written(asked, "ann-asked")
        grid = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / p.asked).cast("int").alias("parts")).join(pieces, "list")
        grid = written(grid, "ann-grid")  # a row a list
        cands = dealt.join(F.broadcast(grid), "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "embedding")
        asked = asked.join(F.broadcast(grid), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "embedding")
        found = cands.groupBy("list", "piece", "part").cogroup(asked.groupBy("list", "piece", "part")).applyInArrow(search, "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")

    queries = v.where("is_query")
    found = written(run(queries.mapInArrow(probe, "query_id long, embedding array<double>, list int")), "ann-found")
    full = found.groupBy("query_id").count().where(F.col("count") >= min(p.k, total - 1)).select("query_id")
    short = written(queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti").select(F.col("vec_id").alias("query_id"), "embedding"), "ann-short")
    if short.isEmpty():
        return found
    again = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(centres) - 1))))  # every list
    return found.join(short.select("query_id"), "query_id", "left_anti").select(*found.columns).union(run(again.select("query_id", "embedding", "list")))
