"""Bounded searches against all pairs, and how little they score."""

import difflib
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake.functions import text as T
from quizlake.operators import match, metadata


def _lines(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 9))) for _ in range(60)]
    out = [" ".join(rng.choices(words, k=rng.randint(2, 14))) for _ in range(n)]
    for k in range(0, n, 5):  # near copies
        w = out[k].split()
        w[rng.randrange(len(w))] = rng.choice(words)
        out[(k + 2) % n] = " ".join(w)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=90), min_size=1, max_size=8), st.floats(0.3, 1.0))
def test_lcs_given_up_only_when_hopeless(texts, t):
    (a, la), (b, lb) = T.encoded([texts[0]], texts)
    most = int(max(a.max(initial=0), b.max(initial=0)))
    need = np.ceil(t * (la[0] + lb) / 2 - 1e-9)
    full, some = T.lcs_lengths(a[0, : la[0]], b, most), T.lcs_lengths(a[0, : la[0]], b, most, need)
    assert all(f == s or (s == -1 and f < n) for f, s, n in zip(full, some, need, strict=True))


@pytest.mark.parametrize(("given", "share"), [(True, 1 / 3), (False, 1 / 2)])
def test_best_by_bound_is_all_pairs(given, share):
    texts = _lines(600, 1)
    if given:  # lines of the given documents
        docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
        texts = sorted({" ".join(line.lower().split())[:160] for d in docs for line in (d or "").split("\n") if len(line) > 10})[::7][:600]
    (b, lb), = T.encoded(texts)
    most, place = int(b.max()), np.arange(len(texts))
    bags, scored = match._bags(b, most), 0
    for p in range(0, len(texts), 20):
        score = 2 * T.lcs_lengths(b[p, : lb[p]], b, most) / (lb[p] + lb)
        want = np.lexsort((place, -score))[:20]
        top, got, n = match.best_by_bound(b[p, : lb[p]], bags[p], b, lb, bags, place, most, 20)
        assert top.tolist() == want.tolist() and got.tolist() == score[want].tolist()
        want = [k for k in want if score[k] >= 0.6428]
        top, _, n = match.best_by_bound(b[p, : lb[p]], bags[p], b, lb, bags, place, most, 20, 0.6428)
        assert top.tolist() == want
        scored += n
    assert scored < len(range(0, len(texts), 20)) * len(texts) * share, (scored, len(texts))


@pytest.mark.parametrize(("t", "block"), [(0.75, 50), (0.5, 7)])
def test_weighted_match_is_all_pairs(spark, t, block):
    texts, answers = _lines(80, 2), ["ab", "abc", "", None]
    rows = [(k, x, answers[k % 4]) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, t string, c string")
    want = []
    for i, a, ca in rows:
        top = sorted(((-T.ratio(a, b), j, cb) for j, b, cb in rows))[:6]
        scored = [(-(0.7 * -s + 0.3 * (T.ratio(ca, cb) if ca and cb else 0.0)), j) for s, j, cb in top]
        want += [(i, j, r + 1) for r, (s, j) in enumerate(sorted(x for x in scored if -x[0] >= t)[:3])]
    got = match.weighted_match(df, df, t, first=6, k=3, block=block)
    assert sorted(map(tuple, got.select("source_id", "ref_id", "rank").collect())) == sorted(want)


def test_similar_pairs_over_bands(spark):
    texts = _lines(60, 3) + ["short", "shor", "x" * 400, "y" * 400 + "x"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "id long, t string")
    want = sorted((i, j) for i, a in rows for j, b in rows if len(a) >= 5 and len(b) >= 5 and T.ratio(a, b) >= 0.7)
    assert sorted(map(tuple, match.similar_pairs(df, df, 0.7).select("source_id", "ref_id").collect())) == want
    assert match.similar_pairs(df, df.limit(0), 0.7).collect() == []


def _names(n, seed):
    rng = random.Random(seed)
    parts = ["cardio", "neuro", "gastro", "pneumo", "onco", "derma", "logie", "chirurgie", "pediatrie", "urgences", "anatomie", "bio", "chimie"]
    return [" ".join("".join(rng.choices(parts, k=2)) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def test_nearest_module_by_bounds():
    modules = [(k, m, m.title()) for k, m in enumerate(dict.fromkeys(_names(300, 4)))]
    nearest = metadata.Nearest(modules)
    names = _names(40, 5) + [modules[7][1], "cardio", "zzz", modules[3][1][:-2]]
    for n in names:
        score = lambda m: 1.0 if m == n else max(difflib.SequenceMatcher(None, n, m).ratio(), 0.85 if n in m or m in n else 0.0)  # noqa: B023, E731
        best = max(range(len(modules)), key=lambda k: (score(modules[k][1]), -k))
        got, place = nearest.best(n, 0.6)
        assert (got, place) == ((score(modules[best][1]), best) if score(modules[best][1]) > 0.6 else (0.6, None))
    assert nearest.scored < len(names) * len(modules) / 3


def _plain_category(rows, modules):
    out = {}
    for key, domain, text in rows:
        for d, module, order, keywords in modules:
            for w in keywords or ():
                if d == domain and w is not None and text is not None and w.lower() in text.lower():
                    out[key] = min(out.get(key, (1,)), (-len(w), order, w, module))
    return {k: (v[3], v[2]) for k, v in out.items()}


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_keywords_by_automaton(spark, most):
    modules = [("m", "Cardio", 0, ["coeur", "coeur droit", "ECG"]), ("m", "Neuro", 1, ["nerf", "ecg", None]), ("c", "Main", 0, ["nerf", "main"]), ("c", "Rien", 1, None), ("z", "Tout", 0, [""])]
    rows = [(1, "m", "Le COEUR droit et le nerf"), (2, "m", "un ecg"), (3, "c", "nerf, main"), (3, "m", "coeur"), (4, "c", None), (5, "z", "x"), (6, "z", ""), (7, None, "nerf"), (8, "m", ""), (9, "c", "le coeur")]
    m = spark.createDataFrame(modules, "domain string, module string, module_ord int, keywords array<string>")
    df = spark.createDataFrame(rows, "doc_id long, domain string, text string").withColumns({"key": F.lit(1), "t": F.lit("x")})
    got = {r.doc_id: (r.module, r.keyword) for r in metadata.keyword_category(df, m, most=most).collect()}
    assert got == _plain_category(rows, modules)
    assert metadata.keyword_category(df, m.limit(0), most=most).collect() == []


def test_many_keywords_take_little_longer(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(5, 9)))
    df = spark.createDataFrame([(k, "m", " ".join(word() for _ in range(400))) for k in range(1500)], "doc_id long, domain string, text string").cache()
    took = {}
    for n in (250, 250, 10_000):
        m = spark.createDataFrame([("m", f"M{k}", k, [word() for _ in range(n // 50)]) for k in range(50)], "domain string, module string, module_ord int, keywords array<string>")
        began = time.time()
        metadata.keyword_category(df, m).count()
        took[n] = time.time() - began
    df.unpersist()
    assert took[10_000] < 2 * took[250] + 1
