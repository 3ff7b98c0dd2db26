"""Tables published by a pointer: readers see the version that was whole when they began, never half of a write.

``<target>/_current`` names a manifest, which lists the folder of each bucket and how many rows a version added and
updated. A write makes new folders for the buckets it touches, then a manifest, and moves the pointer last.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


class VersionedTable:
    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path, files = self._path(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Write beside the place and move there, so that a reader finds the old or the new content."""
        path, files = self._path(f"_tmp-{uuid.uuid4().hex}")
        stream = files.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        place, _ = self._path(name)
        files.mkdirs(place.getParent())
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(path), context.makeQualified(place), options)

    def manifest(self) -> dict:
        """``version, batch, added, updated, folders``; version 0 of a table that isn't there."""
        name = self._read("_current")
        return json.loads(self._read(name)) if name else {"version": 0, "batch": -1, "added": 0, "updated": 0, "folders": {}}

    def read(self, schema: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the current one), of all buckets or some."""
        folders = (manifest or self.manifest())["folders"]
        paths = [f"{self.target}/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, rows: DataFrame, bucket: Column, touched: list[int], before: dict, **facts) -> dict:
        """Write ``rows``, all rows of the buckets ``touched``, and point to them. ``bucket``: a row's bucket."""
        name, of = f"data/{uuid.uuid4().hex}", "bucket"
        while of in rows.columns:
            of = "_" + of
        rows.withColumn(of, bucket).write.partitionBy(of).parquet(f"{self.target}/{name}")
        there, files = self._path(name)
        folders = dict(before["folders"])
        for b in touched:
            place, _ = self._path(f"{name}/{of}={b}")
            folders.pop(str(b), None)
            if files.exists(place):
                folders[str(b)] = f"{name}/{of}={b}"
        now = {"version": before["version"] + 1, "folders": folders, **facts}
        manifest = f"manifests/{now['version']:09}-{uuid.uuid4().hex}"
        self._write(manifest, json.dumps(now))
        self._write("_current", manifest)
        return now

    def vacuum(self, keep: tuple[dict, ...] = ()) -> None:
        """Delete data that neither the current version nor those of ``keep`` read; only while nothing writes."""
        used = {f.split("/")[1] for m in (self.manifest(), *keep) for f in m["folders"].values()}
        path, files = self._path("data")
        for status in files.listStatus(path) if files.exists(path) else ():
            if status.getPath().getName() not in used:
                files.delete(status.getPath(), True)
