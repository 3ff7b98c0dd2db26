"""Candidates of near lines: what meets by chance goes early, what is near stays, large groups are spread."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import brute_lines, docs

from quizlake.llm import line_dedup, near_lines
from quizlake.llm.shingles import band_keys

_SYLLABLES = ["en", "sch", "ung", "ver", "be", "ein", "zu", "der ", "keit ", "lich ", "ar", "tion ", "re", "th", "at ", "ou", "mit ", "ge", "haft ", "st"]


def _syllables(rng, k):
    return "".join(rng.choice(_SYLLABLES) for _ in range(k)).strip()


def _edited(rng, line):
    at = rng.randrange(10, len(line) - 10)
    return line[:at] + "Q" + line[at + 1 :]


def test_lines_that_meet_by_chance_are_not_compared(spark, monkeypatch):
    """Lines of few syllables share many shingles, so their bands meet with the square of their number; their texts needn't move."""
    rng = random.Random(5)
    lines = [_syllables(rng, 60) for _ in range(1500)]
    rows = [(k, x) for k, x in enumerate(lines + [_edited(rng, x) for x in lines[:20]])]
    compared, by_unit = [], line_dedup.by_unit
    monkeypatch.setattr(line_dedup, "by_unit", lambda units, *a, **b: compared.append(units.count()) or by_unit(units, *a, **b))
    got = {r.doc_id for r in line_dedup.line_decisions(docs(spark, *rows)).collect() if r.n_dropped}
    assert got == set(range(1500, 1520))
    assert 40 <= compared[-1] <= 80


def test_hot_groups(spark):
    """Keys with more members in a batch than may stay in a range, beside ordinary ones and lines that several tasks meet."""
    rng = random.Random(6)
    base = _syllables(rng, 60) + "kl"
    near = [*dict.fromkeys(_edited(rng, base) for _ in range(260))]
    assert len(near) > near_lines._HOT
    rows = [(k, "\n".join([x, _syllables(rng, 20), near[k % 7]])) for k, x in enumerate(near)]
    for parts in (1, 5):
        got = {(r.doc_id, k) for r in line_dedup.line_decisions(docs(spark, *rows).repartition(parts)).collect() for k in r.dropped}
        assert got == brute_lines(rows, 5)


@pytest.mark.parametrize(("lines", "ranges"), [(40, 1), (900, 7)])
def test_buckets_of_ranges(lines, ranges):
    """Against a plain loop over keys; members of hot keys come back with the whole key, and no range but those for them has many."""
    p, rng = line_dedup.LineDedup(), random.Random(lines)
    texts = [_syllables(rng, 50) for _ in range(lines // 3)]
    texts += [_edited(rng, rng.choice(texts)) for _ in range(lines // 3)] + [_edited(rng, texts[0]) for _ in range(lines // 2)]
    texts = [*dict.fromkeys(texts)]
    signature = near_lines.line_signatures(texts, line_dedup.char_shingles, p.chars, p.bands * p.rows, p.seed)
    ids, most = np.arange(len(texts)) * 7 - 500, near_lines.most_apart(p.least, p.bands * p.rows)
    marks = near_lines.sketches(signature)
    apart = lambda a, b: int(np.bitwise_count(marks[a] ^ marks[b]).sum())
    halves = [(ids[: lines // 2], signature[: lines // 2]), (ids[lines // 4 :], signature[lines // 4 :])]  # some lines twice
    rows = [r for half in halves for b in near_lines.dealt_keys(iter([half]), ranges, p.bands, p.rows) for r in b.to_pylist()]
    out, hot = {}, {}
    for at in {r["range"] for r in rows}:
        own = [r for r in rows if r["range"] == at]
        assert at >= ranges or max(np.unique(np.frombuffer(b"".join(r["key"] for r in own), dtype=np.uint32), return_counts=True)[1], default=0) <= 2 * near_lines._HOT
        told = near_lines.buckets_of(most, ranges, 39, 512)((pa.scalar(at),), pa.Table.from_pylist(own, pa.schema([("range", pa.int32())] + [(c, pa.binary()) for c in ("key", "id", "sketch", "hot")])))
        for r in told.to_pylist():
            (out if r["n"] else hot).setdefault(r["bucket"], set()).add(r["id"])
    by_key = {}
    for k, own in enumerate(band_keys(signature, p.bands, p.rows).tolist()):
        for key in own:
            by_key.setdefault(key, set()).add(k)
    assert bool(hot) == (lines > 500)
    large = [s for s in by_key.values() if len(s) > 2 * near_lines._HOT]
    assert {frozenset((np.array([*s]) * 7 - 500).tolist()) for s in large} <= {frozenset(s) for s in hot.values()}
    together = [s for some in (out, hot) for s in some.values()]
    pairs = {(a, b) for s in by_key.values() if len(s) <= near_lines._HOT for a in s for b in s if a < b and apart(a, b) <= most}
    assert pairs and all(any({a * 7 - 500, b * 7 - 500} <= s for s in together) for a, b in pairs)
    for s in out.values():
        if len(s) == 2:
            a, b = ((x + 500) // 7 for x in s)
            assert apart(a, b) <= most


def test_sketches_of_near_lines_are_near():
    """At the threshold one pair in a million is farther apart than allowed; lines at Jaccard 0.1 seldom pass."""
    most, rng = near_lines.most_apart(0.8, 65), np.random.default_rng(1)
    for jaccard, bound in ((0.8, (0, 0)), (0.1, (19_000, 20_000))):
        a, b = (rng.integers(0, 2**32, (20_000, 65), dtype=np.uint32) for _ in range(2))
        b = np.where(rng.random(a.shape) < jaccard, a, b)
        far = np.bitwise_count(near_lines.sketches(a) ^ near_lines.sketches(b)).sum(axis=1) > most
        assert bound[0] <= far.sum() <= bound[1]


def test_ids_in_tasks_are_those_of_the_table(spark):
    """Also of lines that share the first half of their hash with another."""
    halves = [(5, 7), (5, 8), (6, 9), (-5, 123456789012345), (-5, -1)]
    table = spark.createDataFrame([(k, h, g) for k, (h, g) in enumerate(halves)], "no int, h long, g long")
    want = {r.no: r.id for r in line_dedup.with_ids(table).collect()}
    got = line_dedup._ids([np.array(x, dtype=np.int64).tobytes() for x in halves], frozenset([5, -5]))
    assert got.tolist() == [want[k] for k in range(len(halves))]


def test_a_common_line_has_few_places_to_take_its_text_from(spark):
    """Of a line that most documents have, a task's first place only."""
    rows = [(k, f"one line that all of them have, however many\nan own line of document {k}") for k in range(400)]
    places = line_dedup.line_places(docs(spark, *rows).repartition(3))
    often = places.groupBy("h", "g").agg({"no": "count", "fresh": "max"}).where("count(no) > 1").select("h", "g")
    assert places.join(often, ["h", "g"]).where("fresh").count() <= 3 and places.where("fresh").select("h", "g").distinct().count() == 401
