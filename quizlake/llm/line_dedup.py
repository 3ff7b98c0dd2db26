"""Operator 9, fuzzy line deduplication.

Lines get MinHash signatures of their character shingles; bands of the signatures put them in buckets, sketches
take those out that meet by chance; inside the buckets exact Jaccard decides; distributed union-find makes components of the links, and of each
component the first line stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, giving_back, keyed_rows, one_a_key, parts, row_key, text_of, written
from .linking import Union, built, by_unit, components, in_blocks, shared_buckets
from .near_lines import DEALT, dealt_keys, line_signatures, most_apart, near_buckets, ranges_of
from .shingles import mix


@dataclass(frozen=True)
class LineDedup:
    """Parameters. Lines at Jaccard 0.8 meet in a band with probability 1 - (1 - 0.8**rows)**bands: 0.994 at the defaults.

    Short shingles are common, so unrelated lines share some: ``rows`` is such that lines at Jaccard 0.1 meet once in ten thousand.
    A changed character costs at most ``chars`` shingles, so with 5 lines from 49 characters bear one in their middle.
    """

    chars: int = 5
    least: float = 0.8
    bands: int = 13
    rows: int = 5
    block: int = 512
    seed: int = 31


#: Lines whose shingles are made at once: what a few hundred lines give stays in a core's cache.
_AT_ONCE = 200
#: Bytes of whole texts that go to Python at once.
_BATCH = "4m"


def char_shingles(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` code points: runs of powers of two by doubling, then joined."""
    return mix(_runs(codes, n))


def _runs(codes: np.ndarray, n: int) -> np.ndarray:
    """``char_shingles`` before their bits are mixed, which keeps different ones different."""
    power, run, size = np.uint64(0x9E3779B97F4A7C15), codes.astype(np.uint64) + np.uint64(1), 1
    out, have = np.zeros(len(codes) + 1, dtype=np.uint64), 0
    while n > have:
        if n & size:
            out = out[: len(run) - have] * power + run[have:]
            have += size
        if n > have:
            run = run[:-size] * power + run[size:]
            power, size = np.uint64(int(power) ** 2 % 2**64), 2 * size
    return out


def line_places(docs: DataFrame) -> DataFrame:
    """``row_key, doc_id, no, n, h, g, fresh`` of every line that isn't blank: its number, how many its text has, the halves of its 128-bit hash, whether its task meets it first."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, len(whole), 500)):
            row, no, n, h, fresh = [], [], [], [], []
            for k, t in enumerate(b["text"].to_pylist()):
                own = [(i, x) for i, line in enumerate(t.split("\n")) if (x := line.strip())]
                row += [k] * len(own)
                n += [len(own)] * len(own)
                no += [i for i, _ in own]
                for _, x in own:
                    h.append(digest := xxhash.xxh3_128_digest(x))
                    fresh.append(digest not in met)
                    met.add(digest)
            if len(met) > 1_000_000:  # only spares work
                met.clear()
            of, halves = pa.array(row, pa.int64()), np.frombuffer(b"".join(h), dtype=np.int64).reshape(-1, 2)
            columns = [b["row_key"].take(of), b["doc_id"].take(of), pa.array(no, pa.int32()), pa.array(n, pa.int32()), *(pa.array(halves[:, k].copy()) for k in (0, 1)), pa.array(fresh, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["row_key", "doc_id", "no", "n", "h", "g", "fresh"])

    return _keyed(docs).select("row_key", "doc_id", "text").mapInArrow(giving_back(run), f"row_key binary, doc_id {kind}, no int, n int, h long, g long, fresh boolean")


def line_keys(docs: DataFrame, p: LineDedup, twice: frozenset[int], ranges: int) -> DataFrame:
    """The rows of ``dealt_keys`` of lines of at least ``chars`` characters, each where a task meets it first; ``twice``: the first halves that different lines share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            met: set[bytes] = set()
            held: list[str] = []
            of: list[bytes] = []
            for b in (whole.slice(at, 500) for whole in batches for at in range(0, len(whole), 500)):
                for t in b["text"].to_pylist():
                    for line in t.split("\n"):
                        line = line.strip()
                        if len(line) >= p.chars and (x := xxhash.xxh3_128_digest(line)) not in met:
                            met.add(x)
                            held.append(line), of.append(x)
                for at in range(0, len(held), _AT_ONCE):
                    yield _ids(of[at : at + _AT_ONCE], twice), line_signatures(held[at : at + _AT_ONCE], char_shingles, p.chars, p.bands * p.rows, p.seed)
                held.clear(), of.clear()
                if len(met) > 1_000_000:  # only spares work
                    met.clear()

        return dealt_keys(fresh(), ranges, p.bands, p.rows)

    return text_of(docs, "text").mapInArrow(giving_back(run), DEALT)


def _ids(digests: list[bytes], twice: frozenset[int]) -> np.ndarray:
    """The ids of ``with_ids``."""
    halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    out = halves[:, 0].copy()
    if twice:
        for k in [k for k, h in enumerate(out.tolist()) if h in twice]:
            h, g = halves[k].tobytes()[:8], halves[k].tobytes()[8:]
            out[k] = np.uint64(xxhash.xxh64_intdigest(g, xxhash.xxh64_intdigest(h, 42))).view(np.int64)
    return out


def texts_of(docs: DataFrame, lines: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, line`` of the lines ``ids``: what is wanted of a document goes to it, so that of the rest of its lines none moves alone. Of a line that occurs often only the places count where a task meets it first. Rows that repeat an id and text give them again."""
    place = lines.where("fresh").join(built(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct("row_key", "no")).alias("place"))
    of = written(place.groupBy("place.row_key").agg(F.collect_list("place.no").alias("nos"), F.collect_list("id").alias("ids")), "line-of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, len(whole), 500)):
            out = []
            for t, nos in zip(b["text"].to_pylist(), b["nos"].to_pylist(), strict=True):
                own = t.split("\n")
                out += [own[no].strip() for no in nos]
            yield pa.RecordBatch.from_arrays([b["ids"].flatten(), pa.array(out, pa.string())], ["id", "line"])

    return _keyed(docs).select("row_key", "text").join(built(of), "row_key").select("text", "nos", "ids").mapInArrow(giving_back(run), "id long, line string")


def _keyed(docs: DataFrame) -> DataFrame:
    return text_of(docs, "doc_id", "text").withColumn("row_key", row_key())


def repeated_halves(lines: DataFrame) -> DataFrame:
    """``h, shared`` of the first halves that occur more than once, and whether different lines share them, which in practice none do; a written table."""
    met = lines.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count(F.lit(1)).alias("times"))
    return written(met.where("times > 1").selectExpr("h", "low <> high as shared"), "line-repeated")


def with_ids(lines: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """``lines`` with ``id``, one for each 128-bit hash: its first half, or a digest of both where different lines share that half."""
    shared = repeated_halves(lines).where("shared") if shared is None else shared
    return lines.join(shared, "h", "left").withColumn("id", F.when(F.col("shared"), F.xxhash64("h", "g")).otherwise(F.col("h"))).drop("shared", "h", "g")


def shingle_sets(lines: list[str], n: int) -> list[np.ndarray]:
    """The sorted different shingles of each line, by their hashes."""
    out = []
    for some in (lines[at : at + _AT_ONCE] for at in range(0, len(lines), _AT_ONCE)):
        sizes = np.array([len(t) for t in some], dtype=np.int64)
        made = _runs(np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32), n)
        out += [_distinct(made[e - size : max(e - size, e - n + 1)]) for e, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
    return out


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once; np.unique takes four times as long for so few."""
    x = np.sort(hashes)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets: a stable sort merges their two runs, what both have stands twice."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def settled(members: DataFrame, texts: DataFrame, p: LineDedup) -> tuple[DataFrame | None, DataFrame]:
    """(links, members that must still be compared) of buckets with more than ``block`` members, in rounds.

    All members are compared with one of them, the pivot, so texts move once. Those near it are connected by it and
    needn't be compared with each other. Jaccard distance is a metric: who isn't near the pivot can only be near members
    about as far from it, less the allowed distance. These are the next round's bucket, unless they are few (then they are compared in
    pairs) or nearly as many as before (then the bucket isn't one of near copies, and is cut into blocks).
    """
    near, done, links = 1 - p.least + 1e-9, members.where(F.col("n") <= p.block), None
    big = members.where(F.col("n") > p.block)
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("pivot", pa.int64()), ("far", pa.float64()), ("n", pa.int64())])

    def work(unit: int, rows: list[dict]) -> list[tuple]:
        lead = next(r for r in rows if r["lead"])
        own, size = lead["line"], len(lead["line"])
        out = []
        for r in rows:
            if not r["lead"]:
                both = _common(own, r["line"])
                out.append((r["bucket"], r["id"], lead["id"], 1 - both / (size + len(r["line"]) - both), r["n"]))
        return out

    while not big.isEmpty():
        pieces = F.ceil(F.col("n") / p.block).cast("int")
        unit = lambda piece: F.xxhash64("bucket", piece).alias("unit")
        pivots = big.groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", F.lit(7))).alias("id"), F.max("n").alias("n"))
        leads = pivots.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select(unit(F.col("piece")), "bucket", "n", "id", F.lit(True).alias("lead"))
        rows = big.select(unit(F.pmod(F.xxhash64("id", F.lit(5)), pieces).cast("int")), "bucket", "n", "id", F.lit(False).alias("lead"))
        told = by_unit(rows.union(leads).join(texts, "id").select("unit", "bucket", "n", "id", "lead", "line"), work, schema, "bucket long, id long, pivot long, far double, n long", lambda lines: shingle_sets(lines, p.chars), "line")
        told = written(told, "line-pivots")
        met = told.where((F.col("far") <= near) & (F.col("id") != F.col("pivot"))).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        links = met if links is None else links.union(met)
        edge = told.where(F.col("far") > near).groupBy("bucket").agg(F.min("far").alias("low"))  # of the members not near the pivot
        rest = told.join(edge, "bucket").where((F.col("far") >= F.col("low") - near) & (F.col("id") != F.col("pivot"))).select("bucket", "id", F.col("n").alias("before"))
        sizes = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        rest = written(rest.join(sizes, "bucket"), "line-rest")
        again = (F.col("n") > p.block) & (F.col("n") <= 0.7 * F.col("before"))
        done = done.select("bucket", "n", "id").union(rest.where(~again).select("bucket", "n", "id"))
        big = rest.where(again).select("bucket", "n", "id")
    return links, done


def duplicate_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> tuple[DataFrame, DataFrame]:
    """(lines, dropped): every line that isn't blank, ``row_key, doc_id, no, n``, and those of them that go, by ``row_key, doc_id, no``,
    with the place of the line that stays for them, ``kept_id, kept_no``.

    Lines are cut at line feeds and compared without white space at their ends. Equal lines are linked, and so
    are lines whose sets of ``chars``-character shingles have an exact Jaccard of at least ``least``; lines with
    fewer characters only when equal. Of each connected component the line with the smallest (doc_id, digest of
    id and text, line number) stays; null ids come last. Rows that repeat an id and text count as one. Lines are
    equal when their 128-bit hashes are.
    """
    places = written(line_places(docs), "line-places", batch=_BATCH)
    repeated = repeated_halves(places)
    shared = repeated.where("shared")
    twice = frozenset(r.h for r in shared.select("h").collect())  # of n lines about n * n / 2**65 pairs
    lines = with_ids(places, shared) if twice else places.withColumnRenamed("h", "id").drop("g")
    ranges, together = ranges_of(places.count(), p.bands, parts(docs.sparkSession)), p.block // p.bands
    buckets = members = written(near_buckets(line_keys(docs, p, twice, ranges), ranges, most_apart(p.least, p.bands * p.rows), together, p.block), "line-buckets", batch=_BATCH)
    hot = members.where("n = 0").select(F.col("bucket").alias("key"), "id")
    if not hot.isEmpty():
        members = members.where("n > 0").union(shared_buckets(hot, once=True, together=together, bound=p.block)).distinct()
        members = written(members, "line-buckets")
        forget(buckets)
        buckets = members
    wanted = written(members.select("id").distinct(), "line-wanted")
    texts = written(texts_of(docs, lines, wanted), "line-texts", batch=_BATCH)
    if not members.where(F.col("n") > p.block).isEmpty():  # these are read in every round, each text once
        texts, again = written(texts.dropDuplicates(["id"]), "line-texts"), texts
        forget(again)
    forget(wanted)
    links, members = settled(members, texts, p)
    units = texts.join(built(in_blocks(members, p.block)), "id").select("unit", "mine", "i", "j", "id", "line")

    def verify(unit: int, rows: list[dict]) -> list[tuple]:
        """Links enough to join what is connected: a line is compared with one group after another, and with a group until one member is near."""
        rows = list({r["id"]: r for r in rows}.values())
        across = rows[0]["i"] != rows[0]["j"]
        sets = [r["line"] for r in rows]
        sizes = [len(s) for s in sets]
        u, groups = Union(len(rows)), []
        for x, (own, n) in enumerate(zip(sets, sizes, strict=True)):
            near = []
            for g in groups:
                for y in g:
                    o = sizes[y]
                    if (n < p.least * o or o < p.least * n) or (across and rows[x]["mine"] == rows[y]["mine"]):
                        continue
                    both = _common(own, sets[y])
                    if both >= p.least * (n + o - both) - 1e-9:
                        near.append(g)
                        u.join(x, y)
                        break
            joined = [x, *(y for g in near for y in g)]
            groups = [g for g in groups if not any(g is n for n in near)] + [joined]
        return [(r["id"], rows[u.find(x)]["id"]) for x, r in enumerate(rows) if u.find(x) != x]

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    edges = by_unit(units, verify, schema, "a long, b long", lambda lines: shingle_sets(lines, p.chars), "line")
    edges = written(edges if links is None else edges.union(links), "line-links")
    forget(buckets, texts)
    roots = components(edges)
    often = repeated.where("not shared").select(F.col("h").alias("id"))
    if twice:
        often = often.union(with_ids(places.join(shared.select("h"), "h", "left_semi"), shared).select("id").distinct())
    # lines that occur once and are linked to nothing take no further part
    classes = often.join(roots.withColumnRenamed("node", "id"), "id", "full").select("id", F.coalesce("root", "id").alias("root"))
    rooted = written(lines.join(built(written(classes, "line-classes")), "id").select("row_key", "doc_id", "no", "root"), "line-roots")
    forget(edges, roots)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "no")
    first = written(rooted.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-first")
    dropped = rooted.join(first, "root").where(place != F.col("first"))
    dropped = dropped.select("row_key", "doc_id", "no", F.col("first.doc_id").alias("kept_id"), F.col("first.no").alias("kept_no"))
    return places.select("row_key", "doc_id", "no", "n"), dropped


def line_decisions(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_dropped, dropped, kept``.

    ``dropped`` has line numbers from 0, ascending; ``kept``, for each of them, the place ``doc_id, no`` of the
    line that stays for it, by which lines of one class are known. ``n_lines`` doesn't count blank lines: null,
    empty and blank texts have 0.
    """
    lines, dropped = duplicate_lines(docs, p)
    gone = dropped.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("no", F.struct(F.col("kept_id").alias("doc_id"), F.col("kept_no").alias("no")).alias("kept")))).alias("gone"))
    counts = lines.groupBy("row_key").agg(F.max("n").cast("long").alias("n_lines")).join(gone, "row_key", "left")
    out = _keyed(docs).select("row_key", "doc_id").join(counts, "row_key", "left")
    kind = dict(docs.dtypes)["doc_id"]
    empty = {"dropped": F.array().cast("array<int>"), "kept": F.array().cast(f"array<struct<doc_id:{kind},no:int>>")}
    out = out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("gone.no", empty["dropped"]).alias("dropped"), F.coalesce("gone.kept", empty["kept"]).alias("kept"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", "kept")


def dedup_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; rows left without any line go.

    Blank lines stay; a document that had no line but blank ones (or a null or empty text) stays as it is. Of rows
    that repeat an id and text one stays, the first by a digest of its other columns. All columns are kept,
    whatever their names; an empty table gives an empty result.
    """
    _, dropped = duplicate_lines(docs, p)
    gone = written(dropped.groupBy("row_key").agg(F.collect_set("no").alias("gone")), "line-gone")
    rows = keyed_rows(docs)
    if not rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = one_a_key(rows)  # which sorts whole rows, twice
    both = rows.select("row_key", "row").join(built(gone), "row_key", "left")
    left = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = both.select("row", "gone", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left).alias("text"))
    out = out.where(F.col("gone").isNull() | F.col("text").rlike(r"\S"))
    return out.select(*[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
