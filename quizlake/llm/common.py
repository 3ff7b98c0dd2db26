"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget, work_dir, written

__all__ = ["SPACES", "WORD", "forget", "giving_back", "keyed_rows", "one_a_key", "parts", "row_key", "table", "text_of", "work_dir", "written"]

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session; grows with the data on a tuned cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns (so extra ones can't clash), ``text`` with null as empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c == "text" else F.col(c) for c in columns])


def row_key() -> Column:
    """A 128-bit digest of ``doc_id`` and ``text``, which stands for a row where ids are null or repeat; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    halves = F.xxhash64(text, "doc_id"), F.xxhash64(F.lit(1), "doc_id", text)
    return F.concat(*[F.unhex(F.lpad(F.hex(h), 16, "0")) for h in halves])


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``row_key, row, doc_id, text, source``: the whole row in one column, so that no name of its can clash with a helper's; a missing column is null."""
    have = set(docs.columns)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in ("doc_id", "text", "source")])
    return d.withColumn("row_key", row_key())


def one_a_key(rows: DataFrame) -> DataFrame:
    """``row_key, row``: of rows with one key, the first by a digest of the other columns."""
    other = [F.col(f"row.`{c}`") for c in rows.schema["row"].dataType.names if c not in ("doc_id", "text")]
    order = F.md5(F.to_json(F.struct(*other))) if other else F.lit("")
    return rows.groupBy("row_key").agg(F.min_by("row", order).alias("row"))


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a task, after which the worker returns the memory that it freed: workers outlive their tasks, and
    allocators keep free pages for the next one, while the executor needs them for stages without Python."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)

    return whole
