"""Incremental jobs: tailing logs, accumulating question chunks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import log_type
from ..operators.questions import KEY, upsert
from ..sources.appended import appended_lines
from ..sources.scratch import forget, written
from ..sources.versions import VersionedTable

LOG = "project string, step string, ts timestamp, text string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail_logs(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """A stream of log lines (JSON, one a line) that aren't blank, with their type.

    Lines appended to a file that was read before come too, each once, when it is complete. A line that isn't JSON
    of ``schema`` has nulls and is left out.
    """
    lines = appended_lines(spark, path, objects=True).select(F.from_json("line", schema).alias("x")).select("x.*")
    return lines.where(F.trim("text") != "").withColumn("type", log_type(F.col("text"))).withColumn("text", F.rtrim("text"))


class Changes(StatefulProcessor):
    """Of each key in a batch the row that stays, by the smallest ``place``, with ``change`` instead of that: ``added`` the first time, ``updated`` later.

    Rows without a key of their own (a null part, or 0 at ``number``) all stay, as added. State: a mark for each key.
    """

    def __init__(self, number: int | None):
        self.number = number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "mark boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if any(k is None for k in key) or (self.number is not None and key[self.number] == 0):
            for row in rows:
                yield self._told(row, "added")
            return
        best = min(rows, key=lambda row: row["place"])
        yield self._told(best, "updated" if self.seen.exists() else "added")
        self.seen.update((True,))

    @staticmethod
    def _told(row: Row, change: str) -> Row:
        named = row.asDict()
        del named["place"]
        return Row(**named, change=change)

    def close(self) -> None:
        pass


def accumulate(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str] = KEY, slots: int = 1024) -> StreamingQuery:
    """New question files go into the table at ``target`` by key, a batch at a time.

    Keyed state tells which keys are new, so that a version knows how many rows it added and updated without reading
    the table. The table is cut into ``slots`` by a hash of the first part of the key (the document), so that a batch rewrites the
    slots of its documents only, into new folders, and is published by moving a pointer: readers never see half of
    a batch, and one that was lost before runs again. A batch that was published already isn't put in again.
    """
    fields = spark.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]
    short = {n: f"c{k}" for k, n in enumerate(names)}  # the processor's rows can't have every name
    table = VersionedTable(spark, target)

    def put(batch: DataFrame, number: int) -> None:
        before = table.manifest()
        if before["batch"] >= number:
            return
        slot = F.pmod(F.xxhash64(F.col(f"`{key[0]}`")), F.lit(slots)).cast("int")
        new = written(batch.select(F.struct(*[F.col(short[n]).alias(n) for n in names]).alias("row"), "change", F.pmod(F.xxhash64(short[key[0]]), F.lit(slots)).cast("int").alias("slot")), "accumulate-batch")
        touched = [r["slot"] for r in new.select("slot").distinct().collect()]  # at most ``slots``
        counts = {r["change"]: r["count"] for r in new.groupBy("change").count().collect()}
        if touched:
            rows = upsert(table.read(schema, before, touched), new.select("row.*"), key)
            table.publish(rows, slot, touched, before, batch=number, added=counts.get("added", 0), updated=counts.get("updated", 0))
        forget(new)

    rows = spark.readStream.schema(schema).json(source)
    rows = rows.select(*[F.col(f"`{n}`").alias(short[n]) for n in names], F.md5(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))).alias("place"))
    out = ", ".join([f"{short[f.name]} {f.dataType.simpleString()}" for f in fields] + ["change string"])
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the processor's processes may not find the package
    kept = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        changed = rows.groupBy(*[short[k] for k in key]).transformWithState(statefulProcessor=Changes(key.index("number") if "number" in key else None), outputStructType=out, outputMode="Update", timeMode="None")
        return changed.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_STORE) if kept is None else spark.conf.set(_STORE, kept)


def current(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The table that ``accumulate`` published last."""
    return VersionedTable(spark, target).read(schema)


def changes(spark: SparkSession, target: str) -> dict:
    """``version, batch, added, updated`` of the current version."""
    m = VersionedTable(spark, target).manifest()
    return {k: m[k] for k in ("version", "batch", "added", "updated")}
