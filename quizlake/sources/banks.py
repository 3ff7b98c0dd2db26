"""Reference banks that are larger than a task: one JSON file read by byte ranges, cut at the borders of its elements.

A range alone doesn't say whether it begins inside a string. So each range first tells what it does to either
beginning (quotes, depth of brackets); Spark sums that up along the file; then every range knows where it stands and
gives the elements that begin in it. Files are opened by pyarrow, from a folder that all executors reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import BANK_KEYS
from .scratch import written


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file:///") else path)


def _escaped(f, low: int) -> bool:
    """Whether an odd number of backslashes stands before ``low``."""
    n, at = 0, low
    while at > 0:
        begin = max(0, at - 256)
        before = f.read_at(at - begin, begin)
        left = before.rstrip(b"\\")
        n += len(before) - len(left)
        if left:
            break
        at = begin
    return n % 2 == 1


def _marks(raw: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places of marks outside strings, the marks, depth after each counted from 0, whether the end is inside a string)."""
    b = np.frombuffer(raw, dtype=np.uint8)
    back, place = b == 92, np.arange(len(b), dtype=np.int32)
    run = np.where(back, place - np.maximum.accumulate(np.where(back, np.int32(-1), place)), 0)
    if escaped:
        run[: int(np.argmin(back)) if not back.all() else len(b)] += 1
    before = np.concatenate([[int(escaped)], run[:-1]]) if len(b) else run
    quote = (b == 34) & (before % 2 == 0)
    within = (np.cumsum(quote, dtype=np.int32) + inside) % 2 == 1
    at = np.flatnonzero(~within & ~quote & np.isin(b, np.frombuffer(b"[]{},:", dtype=np.uint8)))
    marks = b[at]
    step = np.where((marks == 91) | (marks == 123), 1, np.where((marks == 93) | (marks == 125), -1, 0))
    return at, marks, np.cumsum(step), bool(within[-1]) if len(b) else inside


def _effects(ranges: DataFrame) -> DataFrame:
    """``file, low, high, length, turns, out_depth, in_depth``: what a range does to the state inside or outside a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for path, low, high in zip(*(b[c].to_pylist() for c in ("file", "low", "high")), strict=True):
                files, name = _open(path)
                with files.open_input_file(name) as f:
                    raw, escaped = f.read_at(high - low, low), _escaped(f, low)
                outside, inner = (_marks(raw, x, escaped) for x in (False, True))
                made.append((outside[3], *(int(m[2][-1]) if len(m[2]) else 0 for m in (outside, inner))))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("file", "low", "high", "length")), *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.bool_(), pa.int64(), pa.int64())))], ["file", "low", "high", "length", "turns", "out_depth", "in_depth"])

    return ranges.mapInArrow(run, "file string, low long, high long, length long, turns boolean, out_depth long, in_depth long")


def _standing(effects: DataFrame) -> DataFrame:
    """Each range with ``inside, depth`` at its beginning, and ``last_depth``, ``last_inside`` at the file's end."""
    earlier = Window.partitionBy("file").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    turned = F.coalesce(F.sum(F.col("turns").cast("int")).over(earlier), F.lit(0)) % 2 == 1
    s = effects.withColumn("inside", turned).withColumn("move", F.when(turned, F.col("in_depth")).otherwise(F.col("out_depth")))
    return s.select("file", "low", "high", "length", "inside", F.coalesce(F.sum("move").over(earlier), F.lit(0)).alias("depth"), F.sum("move").over(whole).alias("last_depth"), (F.sum(F.col("turns").cast("int")).over(whole) % 2 == 1).alias("last_inside"))


def _top_level(ranges: DataFrame) -> DataFrame:
    """``file, what, rank, place``: the file's first bracket (``top``: 0 list, 1 object, 2 neither), where lists under a bank's name begin (``list``), and where something ends at depth 1 (``end``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, low, high, inside, depth in zip(*(b[c].to_pylist() for c in ("file", "low", "high", "inside", "depth")), strict=True):
                files, name = _open(path)
                with files.open_input_file(name) as f:
                    raw = f.read_at(high - low, low)
                    if low == 0:
                        first = raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
                        out.append((path, "top", {b"[": 0, b"{": 1}.get(first, 2), 0))
                    at, marks, after, _ = _marks(raw, inside, _escaped(f, low))
                    after = after + depth
                    ends = at[((marks == 93) | (marks == 125)) & (after == 1)]
                    opens = []
                    for q in at[(marks == 91) & (after == 2)].tolist():
                        before = f.read_at(min(128, low + q), max(0, low + q - 128)).rstrip()
                        key = before[:-1].rstrip() if before.endswith(b":") else b""
                        opens += [(k, q) for k, n in enumerate(BANK_KEYS) if key.endswith(b'"%s"' % n.encode())]
                    out += [(path, "list", k, low + q) for k, q in opens]
                    wanted = {int(ends[k]) for q in [0, *(q for _, q in opens)] if (k := int(np.searchsorted(ends, q))) < len(ends)}
                    out += [(path, "end", 0, low + q) for q in sorted(wanted)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["file", "what", "rank", "place"])

    return ranges.mapInArrow(run, "file string, what string, rank int, place long")


def _elements(ranges: DataFrame, step: int) -> DataFrame:
    """``file, low, k, element``: the elements that begin in a range, in order. ``kind``: 0 a list at ``level``, between ``begin`` and ``end``; 1 the values of the file's object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, low, high, length, inside, depth, kind, level, begin, end in zip(*(b[c].to_pylist() for c in ("file", "low", "high", "length", "inside", "depth", "kind", "level", "begin", "end")), strict=True):
                files, name = _open(path)
                with files.open_input_file(name) as f:
                    raw = f.read_at(high - low, low)
                    at, marks, after, within = _marks(raw, inside, _escaped(f, low))
                    after = after + depth
                    here = (after == level) & (low + at >= begin) & (low + at <= end)
                    starts = here & ((marks == 58) if kind else (marks == 91) | (marks == 44))
                    stops = ((marks == 44) & (after == level)) | (((marks == 93) | (marks == 125)) & (after == level - 1))
                    begins, borders = at[starts], at[stops]
                    following = np.searchsorted(borders, begins, side="right")
                    out = [raw[s + 1 : borders[k]] for s, k in zip(begins.tolist(), following.tolist(), strict=True) if k < len(borders)]
                    if len(begins) and following[-1] >= len(borders):  # the last one reaches beyond the range
                        parts, place, now = [raw[begins[-1] + 1 :]], high, int(after[-1])
                        while place < length:
                            more = f.read_at(min(step, length - place), place)
                            at, marks, after, within = _marks(more, within, _escaped(f, place))
                            after = after + now
                            found = at[((marks == 44) & (after == level)) | (((marks == 93) | (marks == 125)) & (after == level - 1))]
                            if len(found):
                                parts.append(more[: found[0]])
                                break
                            parts.append(more)
                            place, now = place + len(more), int(after[-1]) if len(after) else now
                        out.append(b"".join(parts))
                texts = [(k, t.decode("utf-8", "replace")) for k, t in enumerate(x for x in out if x.strip())]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array([low] * len(texts), pa.int64()), pa.array([k for k, _ in texts], pa.int64()), pa.array([t for _, t in texts], pa.string())], ["file", "low", "k", "element"])

    return ranges.mapInArrow(run, "file string, low long, k long, element string")


def scan_bank(spark: SparkSession, path: str, step: int = 4 << 20) -> DataFrame:
    """``file, ref_index, ref`` (variant), ``error``: what ``load_reference`` gives, of banks of any size, read ``step`` bytes a task.

    The values of an object come in the file's order (``load_reference`` has them by name). A file whose brackets or strings aren't closed, or that holds neither a list nor an object, gives one row with
    its ``error``; an element that isn't JSON has its own. Of two lists under one name the first counts. Files without
    a byte give nothing.
    """
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    ranges = sizes.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("low"))
    ranges = ranges.select("file", "low", F.least(F.col("low") + step, F.col("length")).alias("high"), "length").repartition("file", "low")
    known = written(_standing(_effects(ranges)), "bank-ranges")
    tops = written(_top_level(known.repartition("file", "low")), "bank-tops")
    top = tops.where("what = 'top'").select("file", F.col("rank").alias("top"))
    lists = tops.where("what = 'list'").groupBy("file").agg(F.min(F.struct("rank", "place"))["place"].alias("begin"))
    ends = tops.where("what = 'end'").select("file", "place").join(lists, "file").where("place > begin").groupBy("file").agg(F.min("place").alias("end"))
    whole = known.groupBy("file").agg(F.max("last_depth").alias("last_depth"), F.max("last_inside").alias("last_inside"))
    plan = top.join(whole, "file").join(lists, "file", "left").join(ends, "file", "left")
    named = (F.col("top") == 1) & F.col("begin").isNotNull()
    error = F.when(F.col("last_inside") | (F.col("last_depth") != 0), "not JSON").when(F.col("top") == 2, "neither a list nor an object")
    plan = plan.select("file", error.alias("error"), F.when((F.col("top") == 1) & ~named, 1).otherwise(0).alias("kind"), F.when(named, 2).otherwise(1).alias("level"), F.when(named, F.col("begin")).otherwise(0).cast("long").alias("begin"), F.coalesce(F.when(named, F.col("end")), F.lit((1 << 62))).alias("end"))
    plan = written(plan, "bank-plan")
    found = written(_elements(known.join(plan.where("error is null").drop("error"), "file").repartition("file", "low"), step), "bank-elements")
    counts = found.groupBy("file", "low").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = found.join(counts.select("file", "low", before.alias("before")), ["file", "low"])
    ref = F.try_parse_json("element")
    rows = rows.select("file", (F.col("before") + F.col("k")).cast("int").alias("ref_index"), ref.alias("ref"), F.when(ref.isNull(), "element not JSON").alias("error"))
    bad = plan.where("error is not null").select("file", F.lit(None).cast("int").alias("ref_index"), F.lit(None).cast("variant").alias("ref"), "error")
    return rows.union(bad)
