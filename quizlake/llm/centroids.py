"""Operator 11, centroid clustering in exact integers with an incremental distance matrix.

Every vector keeps its integer dot products with all centroids. A round changes few components of few centroids,
so a vector's products are updated by the changed components only, and the nearest centroid is the argmin of
|c|^2 - 2 vc over the updated row. Nothing is ever rounded, so the order of rows and tasks can't change a result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Components beyond this have squared distances that a long can't hold.
MOST = 1 << 26


@dataclass(frozen=True)
class Clustering:
    """Parameters. Components are floor(``scale`` * x); ``seed`` is hashed with an id to choose the first centroids."""

    k: int = 40
    rounds: int = 5
    dim: int = 64
    scale: int = 256
    seed: int = 2


def quantised(v: Column, p: Clustering) -> Column:
    """The integer components of a vector that takes part; null for one that doesn't."""
    inf, x = float("inf"), v.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf))
    whole = F.transform(x, lambda c: F.floor(c * p.scale))
    return F.when(v.isNotNull() & (F.size(v) == p.dim) & fine & F.forall(x, lambda c: F.abs(c * p.scale) <= MOST), whole.cast("array<int>"))


def products(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of ``v`` and ``c``: in doubles while every sum stays below 2**53, else in 64-bit integers."""
    if not v.size or not c.size:
        return np.zeros((len(v), len(c)), dtype=np.int64)
    if int(np.abs(v).max()) * int(np.abs(c).max()) * v.shape[1] < 1 << 53:
        return (v.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return v @ c.T


def centroid_digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def _updated(state: DataFrame, old: np.ndarray | None, new: np.ndarray, p: Clustering) -> DataFrame:
    """``state`` (``vec_id, v, dots``) with the products brought from the centroids ``old`` to ``new``, and ``cluster, distance``.

    Of a centroid of which less than half of the components changed only those are multiplied; the others that
    changed are taken together; without ``old`` all are.
    """
    delta = new if old is None else new - old
    changes, norms, k = (delta != 0).sum(axis=1), (new * new).sum(axis=1), len(new)
    few = [(int(j), np.flatnonzero(delta[j])) for j in np.flatnonzero((changes > 0) & (2 * changes < p.dim))]
    many = np.flatnonzero(2 * changes >= p.dim)

    def run(batches):
        for b in batches:
            n = len(b)
            v = b["v"].flatten().to_numpy().reshape(n, p.dim).astype(np.int64)
            dots = np.zeros((n, k), dtype=np.int64) if old is None else b["dots"].flatten().to_numpy().reshape(n, k).copy()
            dots[:, many] += products(v, delta[many])
            for j, at in few:
                dots[:, j] += products(v[:, at], delta[j : j + 1, at])[:, 0]
            far = norms[None] - 2 * dots
            near = far.argmin(axis=1)  # the first of equal ones
            distance = far[np.arange(n), near] + (v * v).sum(axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(dots.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], flat, pa.array(near.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "dots", "cluster", "distance"])

    kind = dict(state.dtypes)["vec_id"]
    return state.mapInArrow(run, f"vec_id {kind}, v array<int>, dots array<long>, cluster int, distance long")


def _means(state: DataFrame, old: np.ndarray, p: Clustering) -> np.ndarray:
    """Centroids as the exact componentwise floor of their vectors' means; empty ones stay. At most ``k`` rows come to the driver."""
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(p.dim)]).alias("s"))
    new = old.copy()
    for r in sums.collect():
        new[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return new


def cluster_vectors(vectors: DataFrame, p: Clustering = Clustering()) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, cluster, distance`` of every vector that takes part, the final centroids).

    ``vectors``: ``vec_id, embedding``. Vectors that are null, have another length than ``dim``, hold a null or
    non-finite component, or one beyond ``MOST`` take no part. The ``k`` vectors whose ids have the smallest
    sha256 are the first centroids (null ids last; equal ids by their components); with fewer vectors there are
    fewer centroids. Rows that repeat an id all count and all get a row. Ties go to the smaller centroid. Other
    columns are ignored; an empty table gives an empty result. Sums are longs: 2**37 vectors at the largest components.
    """
    kept = vectors.select("vec_id", quantised(F.col("embedding"), p).alias("v")).where("v is not null")
    kept = written(kept, "centroid-vectors")
    order = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "v").limit(p.k).select("v").collect()
    now = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), p.dim)
    if not len(now):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    state, before = written(_updated(kept, None, now, p), "centroid-state"), None
    forget(kept)
    for _ in range(p.rounds):
        before, now = now, _means(state, now, p)
        if (before == now).all():
            break  # nothing changes any more
        then, state = state, written(_updated(state, before, now, p), "centroid-state")
        forget(then)
    return state.select("vec_id", "cluster", "distance"), now


def cluster_digest(vectors: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """``cluster_vectors`` with ``cluster_inertia, inertia`` (distances summed over the cluster, over all) and ``centroid_sha256``."""
    rows, centroids = cluster_vectors(vectors, p)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most ``k`` rows
    facts = [(c, s, sum(sums.values()), centroid_digest(centroids[c])) for c, s in sorted(sums.items())]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
