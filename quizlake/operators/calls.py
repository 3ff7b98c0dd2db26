"""Model calls: made once a prompt, a bounded number at a time, and kept in a store of results."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget, written

#: prompt (and its attachments, where there are any) -> (content, prompt tokens, completion tokens, cost)
Model = Callable[..., tuple[str, int, int, float]]

RESULT = "call_key string, content string, model string, prompt_tokens long, completion_tokens long, cost double, ok boolean, error string"


@dataclass(frozen=True)
class Policy:
    """How models are called.

    Each model is tried ``tries`` times with a pause that grows by ``pause`` seconds. A task makes ``in_flight`` calls
    at a time, at most ``per_second`` of them begin in a second, and a call that takes more than ``seconds`` counts as
    failed. A task makes about ``per_task`` calls, so that a lost executor repeats few; ``tasks`` fixes their number
    instead, which bounds the calls of the whole job.
    """

    tries: int = 3
    pause: float = 1.0
    in_flight: int = 4
    per_second: float | None = None
    seconds: float | None = None
    per_task: int = 500
    tasks: int | None = None
    names: tuple[str, str] = ("primary", "fallback")


def call_key(prompt: Column, *attachments: Column) -> Column:
    """The digest of a prompt and its attachments (binary or text), in their order; null for a null prompt, while a null attachment counts as one that is missing."""
    parts = [F.md5(prompt.cast("binary"))] + [F.coalesce(F.md5(a.cast("binary")), F.lit("-")) for a in attachments]
    return F.when(prompt.isNotNull(), F.md5(F.concat_ws("", *parts).cast("binary")))


class ResultStore:
    """Results of successful calls by key, as Parquet under ``path`` in a shared folder; results are only ever added."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def results(self) -> DataFrame:
        """All results; runs at the same time may have left two of a key."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], RESULT)
        return self.spark.read.schema(RESULT).parquet(self.path)

    def known(self, keys: DataFrame) -> DataFrame:
        """The results of ``keys`` (``call_key``), one a key."""
        names = [c.split()[0] for c in RESULT.split(", ")][1:]
        found = self.results().join(keys.select("call_key").distinct(), "call_key", "left_semi")
        return found.groupBy("call_key").agg(F.min(F.struct(*names)).alias("_r")).select("call_key", *[F.col(f"_r.{n}").alias(n) for n in names])

    def add(self, results: DataFrame) -> None:
        results.where("ok").write.mode("append").parquet(self.path)


def _limited(call: Callable[[], tuple], seconds: float | None) -> tuple:
    """The call's value; an error once it takes longer than ``seconds``. Its thread can't be stopped and is left behind."""
    if seconds is None:
        return call()
    got: list = []

    def work() -> None:
        try:
            got.append((call(), None))
        except BaseException as e:  # noqa: BLE001  handed to the caller
            got.append((None, e))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise TimeoutError(f"no reply in {seconds} s")
    value, error = got[0]
    if error is not None:
        raise error
    return value


def _caller(primary: Model, fallback: Model | None, p: Policy) -> Callable[..., tuple]:
    """What makes one call: (content, model, tokens, tokens, cost, ok, error), from the first model that replies."""
    lock, begun = threading.Lock(), [0.0]

    def wait_turn() -> None:
        if p.per_second:
            with lock:
                begun[0] = max(time.monotonic(), begun[0] + 1 / p.per_second)
                at = begun[0]
            time.sleep(max(0.0, at - time.monotonic()))

    def one(prompt: str, *attachments) -> tuple:
        error = ""
        for name, model in zip(p.names, (primary, fallback), strict=True):
            for k in range(p.tries if model is not None else 0):
                wait_turn()
                try:
                    content, asked, said, cost = _limited(lambda model=model: model(prompt, *attachments), p.seconds)
                    if content is None or not content.strip():
                        raise ValueError("empty reply")
                    return content, name, asked, said, cost, True, None
                except Exception as e:  # noqa: BLE001  whatever a model's client raises
                    error = str(e) or type(e).__name__
                    if k + 1 < p.tries:
                        time.sleep(p.pause * (k + 1))
        return None, None, 0, 0, 0.0, False, error

    return one


def call_each(asked: DataFrame, primary: Model, fallback: Model | None = None, p: Policy = Policy()) -> DataFrame:
    """A result for each row of ``asked`` (``call_key, prompt, attachments``, an array that may be empty), in the rows' order; not written yet."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _caller(primary, fallback, p)
        with ThreadPoolExecutor(p.in_flight) as pool:
            for whole in batches:
                for b in (whole.slice(at, 64 * p.in_flight) for at in range(0, len(whole), 64 * p.in_flight)):
                    made = list(pool.map(lambda x: one(x[0], *(x[1] or ())), zip(b["prompt"].to_pylist(), b["attachments"].to_pylist(), strict=True)))
                    columns = [b["call_key"], *(pa.array([m[k] for m in made], t) for k, t in enumerate(kinds[1:]))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return asked.select("call_key", "prompt", "attachments").mapInArrow(run, RESULT)


def results_of(asked: DataFrame, primary: Model, fallback: Model | None = None, p: Policy = Policy(), store: ResultStore | None = None) -> DataFrame:
    """A written table: the result of every distinct key of ``asked`` and ``cached``, whether the store had it before.

    Only keys without a result in the store are called, each once; successes go into the store as soon as all calls
    are made. What fails isn't stored, so that the next run tries again.
    """
    one = asked.where("call_key is not null").groupBy("call_key").agg(F.any_value("prompt").alias("prompt"), F.any_value("attachments").alias("attachments"))
    known = written(store.known(one), "calls-known") if store else None
    misses = written(one.join(known, "call_key", "left_anti") if store else one, "calls-asked")
    tasks = p.tasks or max(1, -(-misses.count() // p.per_task))
    made = written(call_each(misses.repartition(tasks, "call_key"), primary, fallback, p), "calls-made")
    forget(misses)
    if not store:
        return made.withColumn("cached", F.lit(False))
    store.add(made)
    return made.withColumn("cached", F.lit(False)).unionByName(known.withColumn("cached", F.lit(True)))
