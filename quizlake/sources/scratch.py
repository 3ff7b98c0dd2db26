"""The shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_dir: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local_dir:
            _local_dir.append(tempfile.mkdtemp(prefix="spark-quizlake-"))
        base = "file://" + _local_dir[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None, batch: str = "") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again; ``by``, the last column, makes a folder of each of its values;
    ``batch`` bounds the bytes of the Arrow batches that go to Python, which else have as many rows whether these are short or whole texts.

    Cuts the lineage: what is lost with an executor is read again, not computed again. Shuffle files that made
    the table aren't read any more, so Spark is asked to remove them with the execution that wrote it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    own = {_CLEANUP: "true"} | ({_BATCH: batch} if batch else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def forget(*tables: DataFrame, part: str = "") -> None:
    """Delete tables that ``written`` made and nothing reads any more; or of each only the folder ``part``."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{t._folder}/{part}")
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_index(rows: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """``rows`` with a number from 0 in ``order`` (which must be total for the numbers to be the same again).

    Numbers come from range partitions and their row counts, so no task sorts more than its range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "indexed")
    counts = dealt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.join(F.broadcast(counts.select("_pid", before.alias("_before"))), "_pid")
    rank = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return numbered.withColumn(name, (F.col("_before") + rank).cast("long")).drop("_pid", "_before")
