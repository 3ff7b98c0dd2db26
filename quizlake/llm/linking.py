"""What the operators on near copies share: bucket membership, bounded blocks for verification, union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, giving_back, parts, written

#: Rows of a hash table that a join may build in a task, on average.
_BUILT = 2_000_000


def built(side: DataFrame) -> DataFrame:
    """A written table as a side of a join: hashed by the tasks while it has few rows for each, so that the other side needn't be sorted; beyond that both are sorted."""
    return side.hint("shuffle_hash") if side.count() <= _BUILT * parts(side.sparkSession) else side


def shared_buckets(keys: DataFrame, once: bool = False, together: int = 0, bound: int = 0) -> DataFrame:
    """``bucket, n, id`` of the buckets with several members, from ``key, id`` rows; ``once`` says that no row is repeated.

    Bands that hold the very same members are one bucket (its name is a digest of the members), so a set of near
    copies that meets in many bands is verified once. Buckets of at most ``together`` members with the same smallest
    member are one bucket too, whose ``n`` is given as ``bound``, as many as such buckets may hold together: a row is
    in most of them, and stands there once. Repeated rows don't count. What is known of a key is
    combined on the map side, written, and joined back, so that a key with very many members can be split.
    """
    met = F.count(F.lit(1)) > 1 if once else F.min("id") < F.max("id")
    shared = written(keys.groupBy("key").agg(met.alias("met")).where("met").select("key"), "bucket-keys")
    rows = keys.join(built(shared), "key", "left_semi")
    rows = written(rows if once else rows.distinct(), "bucket-rows")
    forget(shared)
    sums = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).bitwiseAND(0xFFFFFFFF)).alias("s"), F.min("id").alias("low"))
    few = F.col("n") <= together
    n, bucket = (F.when(few, a).otherwise(b).alias(c) for a, b, c in ((F.lit(bound).cast("long"), F.col("n"), "n"), (F.xxhash64("low", F.lit(3)), F.xxhash64("n", "x", "s"), "bucket")))
    named = written(sums.select("key", n, bucket), "bucket-names")
    members = written(rows.join(named, "key").select("bucket", "n", "id").distinct(), "buckets")
    forget(rows, named)
    return members


def in_blocks(members: DataFrame, size: int) -> DataFrame:
    """``unit, mine, i, j, id``: a bucket of more than ``size`` members is cut into blocks by a hash of the id, and each
    pair of blocks is a unit; so every pair of members meets in exactly one unit (inside a block: in the unit
    of the block with itself), and a unit holds about 2 * ``size`` rows at most, whatever the bucket."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    return m.select(F.xxhash64("bucket", i, j).alias("unit"), "bucket", "mine", i.alias("i"), j.alias("j"), "id", *[c for c in members.columns if c not in ("bucket", "n", "id")])


def by_unit(rows: DataFrame, work: Callable[[int, list[dict]], list[tuple]], schema: pa.Schema, ddl: str, made_of: Callable[[list], list] | None = None, column: str = "") -> DataFrame:
    """Call ``work(unit, its rows)`` for each unit and return the tuples it gives.

    Rows are dealt by unit and sorted, and a task walks its partition as a stream, so it holds one unit at a time.
    ``made_of`` turns the values of ``column`` into others, many at once.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        made: list[tuple] = []

        def flush() -> pa.RecordBatch:
            values = list(zip(*made, strict=True)) if made else [[]] * len(schema)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(values, schema.types, strict=True)], schema=schema)
            made.clear()
            return out

        for b in (whole.slice(at, 2000) for whole in batches for at in range(0, len(whole), 2000)):
            columns = {c: b[c].to_pylist() for c in names}
            if made_of:
                columns[column] = made_of(columns[column])
            for values in zip(*(columns[c] for c in names), strict=True):
                row = dict(zip(names, values, strict=True))
                if held and held[0]["unit"] != row["unit"]:
                    made += work(held[0]["unit"], held)
                    held = []
                held.append(row)
            if len(made) > 10_000:
                yield flush()
        if held:
            made += work(held[0]["unit"], held)
        yield flush()

    return rows.repartition("unit").sortWithinPartitions("unit", "id").mapInArrow(giving_back(run), ddl)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b`` (longs); root is the component's smallest node.

    Distributed union-find by alternating stars: each node's larger neighbours are linked to its smallest one
    (large star), then its smaller neighbours too (small star), until nothing changes: every link then goes from
    a node to its root. Neighbourhoods are only ever reduced to their minimum, which combines on the map side.
    The minima are written before they are joined back: both sides of the join then are plain scans, and adaptive
    execution can split the links of a node that has very many. The rounds are deleted, the result is a written table.
    """
    nodes = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = written(nodes, "links"), None
    while True:
        both = now.union(now.select("v", "u"))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # of a node's smaller neighbours, few after the large star
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then, now = now, written(small, "links")
        forget(then, low)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v", F.lit(1)).bitwiseAND(0xFFFFFFFF))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    roots = written(roots, "roots")
    forget(now)
    return roots


class Union:
    """Union-find over a unit's places; the smaller place is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
