"""Operator 10, n-gram Jaccard join.

A MinHash LSH forest: each of ``trees`` gives a text a label of ``depth`` MinHash values. Sorted labels are a
prefix trie: what a label shares with its neighbours in the order is the longest prefix it shares with any.
Texts that meet at the full depth are compared first; then the prefixes are shortened, to the depth at which the
links found so far, each weighed by its chance to be found, say that ``recall`` is reached. Candidates are
verified by exact Jaccard of their word shingles, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, parts, text_of, written
from .linking import Union, by_unit, components, in_blocks, shared_buckets
from .shingles import WordHashes, mix, signatures, word_shingles

#: Bins of Jaccard, from the threshold to 1, in which links are counted.
_BINS = 20


@dataclass(frozen=True)
class Forest:
    """Parameters. ``recall`` is the share of links, as measured while prefixes are shortened, at which shortening ends."""

    words: int = 5
    least: float = 0.8
    trees: int = 14
    depth: int = 8
    recall: float = 0.999
    block: int = 512
    seed: int = 23

    def found(self, jaccard: float | np.ndarray, depth: int) -> float | np.ndarray:
        """The chance that a pair shares a prefix of ``depth`` values in some tree."""
        return 1 - (1 - jaccard**depth) ** self.trees

    def measured(self, links: np.ndarray, at: int, depth: int) -> float:
        """Recall at ``depth``, from the ``links`` of each bin found at ``at``: what a bin must hold in all is what was found over the chance to find it."""
        low = self.least + (1 - self.least) * np.arange(_BINS) / _BINS
        if not links.sum():
            return float(self.found(self.least, depth))
        every = links / self.found(low, at)
        return float((every * self.found(low, depth)).sum() / every.sum())

    @property
    def shortest(self) -> int:
        """The depth at which even a pair at the threshold is found with ``recall``: no prefix has to be shorter."""
        return max((d for d in range(1, self.depth + 1) if self.found(self.least, d) >= self.recall), default=1)

    def next_depth(self, links: np.ndarray, at: int) -> int:
        """The longest prefix shorter than ``at`` with which ``recall`` should be reached; ``at`` when it is reached already."""
        if self.measured(links, at, at) >= self.recall or at <= self.shortest:
            return at
        return max(d for d in range(self.shortest, at) if d == self.shortest or self.measured(links, at, d) >= self.recall)


#: Word hashes of a worker process.
_words = WordHashes()


def _tokens(text: str, hashes: WordHashes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def _labels(sig: np.ndarray, p: Forest) -> list[list[bytes]]:
    """For each signature its label in each tree: the tree's number, then two bytes a value."""
    values = np.ascontiguousarray(mix(sig.astype(np.uint64)).astype(">u2")).reshape(len(sig), p.trees, p.depth)
    raw = np.empty((len(sig), p.trees, 1 + 2 * p.depth), dtype=np.uint8)
    raw[:, :, 0] = np.arange(p.trees)
    raw[:, :, 1:] = values.view(np.uint8).reshape(len(sig), p.trees, 2 * p.depth)
    return [[t.tobytes() for t in row] for row in raw]


def shingle_sets(docs: DataFrame, p: Forest) -> DataFrame:
    """``uid, doc_id, text_hash, h1, h2, n, labels``: a digest of each document's shingle set, its size and its labels in the trees."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, len(whole), 100):
                b = whole.slice(at, 100)
                sets = [word_shingles(_tokens(t, _words), p.words) for t in b["text"].to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                labels: list = [[]] * len(sets)
                if full:
                    starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])])[:-1]
                    sig = signatures(np.concatenate([sets[k] for k in full]), starts, p.trees * p.depth, p.seed)
                    for k, row in zip(full, _labels(sig, p), strict=True):
                        labels[k] = row
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], b["text_hash"], *(pa.array([int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests], pa.int64()) for k in (0, 8)), pa.array([len(s) for s in sets], pa.int64()), pa.array(labels, pa.list_(pa.binary()))],
                    ["doc_id", "text_hash", "h1", "h2", "n", "labels"],
                )

    d = text_of(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    made = d.mapInArrow(run, f"doc_id {kind}, text_hash long, h1 long, h2 long, n long, labels array<binary>")
    return made.withColumn("uid", F.monotonically_increasing_id())


def sorted_tries(labels: DataFrame, p: Forest) -> DataFrame:
    """``label, id, shared`` from ``label, id``: how many values a label has in common with the nearer of its neighbours in the order.

    Range partitions keep the order of labels, equal ones by id, so one label may spread over many tasks. Where a
    partition begins or ends the neighbour is the last or first label beside it, a row a partition.
    """
    order = ["label", "id"]
    dealt = written(labels.repartitionByRange(parts(labels.sparkSession), *order).withColumn("pid", F.spark_partition_id()), "join-sorted")
    edges = dealt.groupBy("pid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    beside = Window.orderBy("pid")  # a row a partition
    edges = edges.select("pid", F.lag("high").over(beside).alias("before"), F.lead("low").over(beside).alias("after"))
    w = Window.partitionBy("pid").orderBy(*order)
    rows = dealt.withColumn("prev", F.lag("label").over(w)).withColumn("next", F.lead("label").over(w)).join(F.broadcast(edges), "pid")

    def common(other: Column) -> Column:
        out = F.lit(0)
        for d in range(1, p.depth + 1):
            out = F.when(_prefix(F.col("label"), d) == _prefix(other, d), d).otherwise(out)
        return out

    return rows.select(*order, F.greatest(common(F.coalesce("prev", "before")), common(F.coalesce("next", "after"))).alias("shared"))


def _prefix(label: Column, depth: int) -> Column:
    return F.substring(label, 1, 1 + 2 * depth)


def _pairs(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of indicator matrices over slices of the common shingles."""
    flat = np.concatenate([*sets_a, *sets_b])
    owner = np.repeat(np.arange(len(sets_a) + len(sets_b)), [len(s) for s in (*sets_a, *sets_b)])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    several = count > 1
    column = np.where(several, np.cumsum(several) - 1, -1)[place]
    use = column >= 0
    column, owner = column[use], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets_a), len(sets_b)), dtype=np.float64)
    for low in range(0, int(several.sum()), 4096):
        s, e = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((len(sets_a) + len(sets_b), 4096), dtype=np.float32)
        m[owner[s:e], column[s:e] - low] = 1
        out += m[: len(sets_a)] @ m[len(sets_a) :].T
    return out


def ngram_join(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_copies``.

    Shingles are runs of ``words`` words split at white space, as written; a shorter text is one shingle; texts
    without words (null, empty) have none and are linked to nothing. Two documents with different shingle sets
    are linked when the sets' exact Jaccard is at least ``least``. ``n_links`` counts the different shingle sets a
    document is linked to, ``n_copies`` the rows with its own set, itself included. ``class_id`` is the smallest
    doc_id that copies and links connect it to (its own where none; null ids don't count). Repeated rows are
    copies; other columns are ignored; an empty table gives an empty result.

    Copies are one text throughout. A link that several trees or depths find is counted in the first bucket that
    both ends share: longer prefixes come first, then smaller names. A bucket whose members have met at a longer
    prefix already isn't compared again.
    """
    sets = written(shingle_sets(docs, p), "join-sets")
    classes = written(sets.where("n > 0").groupBy("h1", "h2").agg(F.min("uid").alias("id"), F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("n_copies")), "join-classes")
    reps = sets.join(classes.select(F.col("id").alias("uid")), "uid")
    tries = sorted_tries(reps.select(F.col("uid").alias("id"), F.explode("labels").alias("label")), p)
    near = written(tries.where(F.col("shared") >= p.shortest), "join-tries")
    wanted = near.select("id").distinct().join(sets.select(F.col("uid").alias("id"), "doc_id", "text_hash"), "id")
    texts = text_of(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    texts = written(texts.alias("t").join(wanted.alias("w"), (F.col("t.text_hash") == F.col("w.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))).select("id", "text"), "join-texts")

    met, found, links, depth = [], [], np.zeros(_BINS), p.depth
    while True:
        keys = near.where(F.col("shared") >= depth).select(F.xxhash64(_prefix(F.col("label"), depth)).alias("key"), "id")
        name = F.col("bucket").bitwiseAND((1 << 59) - 1)
        buckets = shared_buckets(keys)
        members = buckets.withColumn("bucket", name + F.lit(p.depth - depth) * F.lit(1 << 59))
        for earlier in met:
            members = members.join(earlier.select(name.alias("_seen")).distinct(), name == F.col("_seen"), "left_anti")
        met.append(written(members, "join-buckets"))
        forget(buckets)
        every = met[0]
        for m in met[1:]:
            every = every.unionByName(m)
        own = every.groupBy("id").agg(F.collect_list("bucket").alias("all"))  # at most one for each tree and depth
        units = in_blocks(met[-1], p.block).join(texts.join(own, "id"), "id").select("unit", "bucket", "mine", "i", "j", "id", "text", "all")
        found.append(written(verified(units, p), "join-links"))
        got = found[-1].where("id is null").agg(*[F.sum(F.col("hist")[k]) for k in range(_BINS)]).first()
        links += np.array([x or 0 for x in got], dtype=float)
        shorter = p.next_depth(links, depth)
        if shorter == depth:
            break
        depth = shorter

    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    pairs = pairs.where("id is not null")
    roots = components(pairs.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = pairs.groupBy("id").agg(F.sum("links").alias("n_links"))
    per = classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    per = written(per.select("h1", "h2", "low_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "id").alias("root")), "join-roots")
    forget(near, texts, *met, *found, classes)
    low = written(per.groupBy("root").agg(F.min("low_id").alias("class_id")), "join-low")
    per = written(per.join(low, "root").drop("root", "low_id"), "join-per")
    out = sets.select("doc_id", "h1", "h2").where("n > 0").join(per, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "n_copies")
    return out.unionByName(sets.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))


def verified(units: DataFrame, p: Forest) -> DataFrame:
    """``id, links, root, hist`` from units of texts: new links and the unit's root of every linked text, and a row without id with the unit's new links by Jaccard."""

    def verify(unit: int, rows: list[dict]) -> list[tuple]:
        rows = list({r["id"]: r for r in rows}.values())  # a repeated row brings its text twice
        n, bucket = len(rows), rows[0]["bucket"]
        if n < 2:
            return []
        got = [word_shingles(_tokens(r["text"], _words), p.words) for r in rows]
        sizes = np.array([len(s) for s in got])
        inter = _pairs(got, got)
        both = sizes[:, None] + sizes[None, :] - inter
        linked = inter >= p.least * both - 1e-9
        np.fill_diagonal(linked, False)
        side = np.array([r["mine"] for r in rows])
        if rows[0]["i"] != rows[0]["j"]:
            linked &= side[:, None] != side[None, :]
        smaller: dict[int, int] = {}
        marks = [(k, smaller.setdefault(b, len(smaller))) for k, r in enumerate(rows) for b in r["all"] if b < bucket]
        if marks:
            m = np.zeros((n, len(smaller)), dtype=np.float32)
            m[tuple(np.array(marks).T)] = 1
            first = (m @ m.T) == 0
        else:
            first = np.ones((n, n), dtype=bool)
        new = linked & first
        links = new.sum(axis=1)
        a, b = np.nonzero(np.triu(new))
        bins = np.clip(((inter[a, b] / both[a, b] - p.least) / (1 - p.least) * _BINS).astype(int), 0, _BINS - 1) if len(a) else np.empty(0, int)
        u = Union(n)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            u.join(x, y)
        out = [(r["id"], int(k), rows[u.find(x)]["id"], None) for x, (r, k) in enumerate(zip(rows, links, strict=True)) if k]
        return [*out, (None, None, None, np.bincount(bins, minlength=_BINS).tolist())] if len(a) else out

    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("hist", pa.list_(pa.int64()))])
    return by_unit(units, verify, schema, "id long, links long, root long, hist array<long>")
