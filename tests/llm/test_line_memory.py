"""What the line stage holds at once: whole rows aren't sorted, texts go to Python in bounded batches, workers give memory back."""

import ctypes
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_lines, docs
from test_near_lines import _edited, _syllables

from quizlake.llm import line_dedup
from quizlake.llm.common import giving_back, written

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_rows_are_not_sorted(spark):
    """Only where rows repeat an id and text is one of them chosen; rows are the same either way."""
    rng = random.Random(8)
    base = [_syllables(rng, 40) for _ in range(5)]
    rows = [(k, "\n".join([_syllables(rng, 30), base[k % 5] if k % 2 else _edited(rng, base[k % 5])])) for k in range(30)]
    rows += [(40, None), (41, ""), (42, base[0])]
    gone = brute_lines(rows, 5)
    want = [(d, t if not any((d, k) in gone for k in (0, 1)) else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in rows]
    want = sorted((x for x in want if x[1] is None or x[1].strip() or x[0] == 41), key=repr)
    once, twice = line_dedup.dedup_lines(docs(spark, *rows)), line_dedup.dedup_lines(docs(spark, *rows, rows[3], (40, None)))
    assert "SortAggregate" not in _plan(once) and "SortMergeJoin" not in _plan(once)
    for out in (once, twice):
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want


def test_texts_go_in_bounded_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))
    before = spark.conf.get(_BATCH)
    got = [r.n for r in written(texts.mapInArrow(sizes, "n long"), "sizes", batch="1m").collect()]
    assert sum(got) >= 12_000_000 and max(got) <= 1_200_000
    assert spark.conf.get(_BATCH) == before


def test_line_texts_are_read_in_bounded_batches(spark, monkeypatch):
    """Every table of lines that is made from whole texts."""
    bounds, own = {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, *a, **b: bounds.setdefault(name, b.get("batch")) and False or own(df, name, *a, **b))
    rng = random.Random(3)
    line = _syllables(rng, 40)
    line_dedup.line_decisions(docs(spark, (1, line), (2, _edited(rng, line)))).collect()
    assert bounds["line-places"] and bounds["line-buckets"] and bounds["line-texts"]


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="only glibc keeps and trims such memory")
def test_workers_give_memory_back():
    kept = []

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    def run(batches):
        held = [np.ones(2500) for _ in range(10_000)]
        kept.append([np.ones(2500) for _ in range(3)])  # above what goes
        yield from batches
        assert len(held) == 10_000

    before = resident()
    assert list(giving_back(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60_000_000
