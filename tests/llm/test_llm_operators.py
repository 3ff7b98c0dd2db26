"""Brute force, round trips and odd rows for the training-data operators."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake.llm import ann, chat_format, exact_dedup, licenses, line_dedup, linking, lm_score, mixing, ngram_join, sentencepiece, toxicity

DOCS = "doc_id long, text string, source string, score int, size int, kept string"


def docs(spark, *rows):
    """Rows (doc_id, text, source) with further columns whose names clash with results."""
    return spark.createDataFrame([(*r, *(None,) * (3 - len(r)), 1, 2, "x") for r in rows], DOCS)


# ---- 1

@pytest.fixture(scope="module")
def model():
    return sentencepiece.load_model()


@pytest.fixture(scope="module")
def library():
    import sentencepiece as lib

    return lib.SentencePieceProcessor(model_file=sentencepiece.MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdefgh .,\n\té世😀ﬁ½▁<>/s01'_-"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_ids_are_the_library_s(model, library, text):
    c = sentencepiece.codec(model)
    ids = c.encode(text).tolist()
    assert ids == library.encode(text)
    assert c.decode(ids) == text.replace("▁", " ")


def test_long_runs(model, library):
    """100 000 spaces, marks without a piece or letters that never merge cost little more than ten times 10 000."""
    c = sentencepiece.codec(model)
    for run in (" ", "☃", "x", "é "):
        text = "a" + run * 100_000 + "b"
        began = time.process_time()
        ids = c.encode(text).tolist()
        assert time.process_time() - began < 5 and ids == library.encode(text) and c.decode(ids) == text


def test_viterbi_is_the_best_segmentation():
    rng = random.Random(1)
    pieces = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "ca", "cab"]
    m = sentencepiece.PieceModel(tuple(pieces), (0.0, *(-rng.uniform(1, 5) for _ in pieces[1:])), "u" + "n" * 10, False, True)
    c = sentencepiece.Codec(m)

    def best(word):
        if not word:
            return 0.0
        return max((m.scores[c.ids[word[:n]]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in c.ids), default=-math.inf)

    for _ in range(100):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        ids = c.encode(text).tolist()
        assert c.decode(ids) == text and math.isclose(sum(m.scores[i] for i in ids), best("▁" + text))
    assert 0 in c.encode("axb").tolist()


def test_encode_rows(spark, model):
    long = "Long words and more. " * 30_000
    df = docs(spark, (1, "Hello  world\n"), (2, None), (3, ""), (None, "x"), (1, "Hello  world\n"), (5, long)).withColumn("input_ids", F.lit("old"))
    got = sentencepiece.encode_pieces(df, model).collect()
    assert len(got) == 6 and all(r.round_trip and r.n_tokens == len(r.input_ids) for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[2] == 0
    back = sentencepiece.decode_pieces(sentencepiece.encode_pieces(df, model), model).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert sentencepiece.encode_pieces(df.limit(0), model).count() == 0


# ---- 2

def _toxic(rng, n):
    clean = ["river", "stone", "garden", "window", "letter", "paper", "market", "silver", "bridge", "forest"]
    bad = ["idiot", "moron", "stupid", "trash"]
    texts, y = [], []
    for k in range(n):
        words = [rng.choice(clean) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.randint(5, 200))]
        if k % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
            words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words)), y.append(int(k % 3 == 0))
    return texts, y


def test_toxicity_held_out():
    rng = random.Random(2)
    m = toxicity.fit(*_toxic(rng, 400))
    texts, y = _toxic(rng, 200)
    assert np.mean([(m.score(t) >= 0.5) == bool(v) for t, v in zip(texts, y, strict=True)]) > 0.95
    assert m.score("the river and an idiott by the bridge") > 0.5 > m.score("the river and a letter by the bridge")
    assert 0 <= m.score("") < 0.5
    assert toxicity.fit([], []).score("x") < 0.5 and toxicity.fit(["a"], [1]).score("x") > 0.5


def test_toxicity_rows(spark):
    m = toxicity.fit(*_toxic(random.Random(2), 300))
    df = docs(spark, (1, "river"), (1, "river"), (2, None), (3, ""), (None, "idiot moron " * 50_000))
    got = toxicity.score_toxicity(df, m).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score_toxicity(df.limit(0), m).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, None), (7, 0)], "doc_id long, toxic int")
    assert toxicity.training_sample(df, labels.limit(0)) == ([], [])
    texts, y = toxicity.training_sample(df, labels)
    assert set(y) <= {1} and set(texts) <= {"river"}


def test_training_sample_of_a_repeated_id(spark):
    """Both bounds hold where one labelled id has many rows."""
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    df = docs(spark, *[(1, f"idiot {k}") for k in range(500)], (2, "river"), (3, "stone"))
    texts, y = toxicity.training_sample(df, labels, max_rows=(5, 5), max_chars=100)
    assert len(texts) == len(y) <= 3 and sum(map(len, texts)) <= 100 and sum(y) == 1
    assert toxicity.training_sample(df.repartition(7), labels, max_rows=(5, 5), max_chars=100) == (texts, y)


# ---- 3

def brute_lm(rows, order, least=2, alpha=0.4):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    count = collections.Counter(tuple(ws[i : i + n]) for ws in words.values() for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    every = sum(map(len, words.values()))

    def score(gram):
        if len(gram) == 1:
            return math.log(count[gram] / every)
        return math.log(count[gram] / count[gram[:-1]]) if count[gram] >= least else math.log(alpha) + score(gram[1:])

    return {k: (len(ws), sum(score(tuple(ws[max(0, i - order + 1) : i + 1])) for i in range(len(ws)))) for k, ws in words.items()}


@pytest.mark.parametrize("order,least,batch_words", [(2, 2, 10), (3, 2, 10), (3, 2, 2_000_000), (4, 3, 100), (1, 2, 50), (3, 1, 1000)])
def test_lm(spark, order, least, batch_words):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40)))) for k in range(50)] + [(90, None), (91, ""), (92, "\t \n"), (93, "a b " * 3000), (94, "once")]
    got = {r.doc_id: r for r in lm_score.backoff_scores(docs(spark, *rows), order, least=least, batch_words=batch_words).collect()}
    want = brute_lm(rows, order, least)
    assert set(got) == set(want)
    for k, (n, s) in want.items():
        assert got[k].n_words == n and math.isclose(got[k].log_score, s, abs_tol=1e-6)
        assert (got[k].mean_log_score is None) == (n == 0)
    assert lm_score.backoff_scores(docs(spark, *rows).limit(0)).count() == 0


def test_lm_trigrams(spark):
    df = docs(spark, (1, "a b c a b c"), (2, "a b d"))
    got = {r.doc_id: r.log_score for r in lm_score.backoff_scores(df, order=3).collect()}
    one, two = collections.Counter("abcabcabd"), collections.Counter(["ab", "bc", "ca", "ab", "bc", "ab", "bd"])
    n = 9
    a = math.log(one["a"] / n)
    want1 = a + math.log(3 / 3) + math.log(2 / 3) + math.log(0.4 * 0.4 * 3 / n) + math.log(0.4 * 3 / 3) + math.log(2 / 3)
    want2 = a + math.log(3 / 3) + math.log(0.4 * 0.4 * 1 / n)
    assert two["ab"] == 3 and math.isclose(got[1], want1) and math.isclose(got[2], want2)


def test_lm_counts_move_by_pieces(spark, monkeypatch):
    """Counts go and come back as a row a batch and piece, not a row an n-gram; small pieces, deals and slices give the brute force's scores."""
    told = []

    def keep(df, name, *a, **k):
        out = written(df, name, *a, **k)
        if name.startswith("lm-counts"):
            told.append(out.count())
        return out

    written = lm_score.written
    monkeypatch.setattr(lm_score, "written", keep)
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(200)) + " the hot pair" * 20) for k in range(60)]
    want = brute_lm(rows, 3)
    for knobs, most in (({}, 8), ({"batch_words": 10, "slices": 3, "deals": 3, "piece_rows": 100}, 2000)):
        got = {r.doc_id: r for r in lm_score.backoff_scores(docs(spark, *rows).repartition(4), **knobs).collect()}
        assert set(got) == set(want) and all(got[k].n_words == n and math.isclose(got[k].log_score, s, abs_tol=1e-6) for k, (n, s) in want.items())
        assert told and max(told) <= 4 * most
        told.clear()


# ---- 4

def test_licenses(spark):
    mit = licenses.TEMPLATES[1][1]
    words = mit.split()
    near = " ".join(words[:20] + ["CHANGED"] + words[21:])
    filler = "some other words that stand around it " * 40
    df = docs(spark, (1, f"{filler} RELEASED under the   MIT license! {filler}"), (2, filler + near + filler), (3, "Licensed under the Apache"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0."), (7, f"{filler * 400} {licenses.TEMPLATES[4][1]} {filler}"), (8, "Released under the"), (9, "MIT License"))
    got = {(r.doc_id, r.license): (r.containment, r.at_word) for r in licenses.scan_licenses(df).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (6, "CC-BY-NC-4.0"), (7, "GPL-3.0")}
    assert got[1, "MIT"] == (1.0, 280) and 0.8 <= got[2, "MIT"][0] < 1 and got[7, "GPL-3.0"] == (1.0, 112_000)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_relatives_keep_their_names(spark):
    fsf = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    gpl, lesser = "General Public License", "Lesser General Public License"
    bsd = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    never = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    asis = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING'
    notices = [
        (fsf.format(gpl, 2), {"GPL-2.0"}), (fsf.format(gpl, 3), {"GPL-3.0"}), (fsf.format(lesser, 2.1), {"LGPL-2.1"}), (fsf.format(lesser, 3), {"LGPL-3.0"}),
        (fsf.format("Library " + gpl, 2), {"LGPL-2.0"}), (fsf.format("Affero " + gpl, 3), {"AGPL-3.0"}), (fsf.format(gpl, 2) + " filler " * 50 + fsf.format(gpl, 3), {"GPL-2.0", "GPL-3.0"}),
        (fsf.format(lesser, 3) + " " + fsf.format(gpl, 2), {"LGPL-3.0", "GPL-2.0"}), (bsd + never + asis, {"BSD-3-Clause"}), (bsd + asis, {"BSD-2-Clause"}),
    ]
    notices += [(t, {name}) for name, t in licenses.TEMPLATES]
    filler = "some other words that stand around it " * 20
    df = docs(spark, *[(k, f"{filler} {t} {filler}") for k, (t, _) in enumerate(notices)])
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(df).collect():
        got[r.doc_id].add(r.license)
    wrong = [(t, want, got[k]) for k, (t, want) in enumerate(notices) if got[k] != want]
    assert not wrong


def brute_licenses(text, p):
    """Of each template the largest containment in any window of its length, cut off at the text's ends, and where the first such one begins."""
    words = re.findall(r"\w+", text.lower())
    sh = [tuple(words[i : i + p.words]) for i in range(len(words) - p.words + 1)]
    out = {}
    for k, (_, t) in enumerate(p.templates):
        tw = re.findall(r"\w+", t.lower())
        want = {tuple(tw[i : i + p.words]) for i in range(len(tw) - p.words + 1)}
        n = len(tw) - p.words + 1
        every = [(len(want & set(sh[max(0, i) : i + n])) / len(want), -max(0, i)) for i in range(-n // 2, len(sh) + 1) if sh[max(0, i) : i + n]]
        share, at = max(every, default=(0, 0))
        if share >= p.least:
            out[k] = (share, -at)
    return out


def test_licenses_against_brute_force(spark):
    rng = random.Random(14)
    p = licenses.LicenseScan(templates=tuple(licenses.TEMPLATES[k] for k in (1, 3, 8, 11, 31, 32, 35, 36)))
    rows = []
    for d in range(160):
        words = rng.choice(p.templates)[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"zz{rng.randrange(50)}"
        cut = rng.randint(0, len(words) // 5) if d % 2 else 0
        words = words[cut:] if d % 4 == 1 else words[: len(words) - cut]
        rest = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 80]))) for _ in range(2)]
        rows.append((d, " ".join([rest[0], *words, rest[1]]).strip()))
    rows += [(900, " ".join(p.templates[0][1].split()[:-3])), (901, "a b c " + " ".join(p.templates[0][1].split()[:-3]))]
    got = {(r.doc_id, r.license): (round(r.containment, 9), r.at_word) for r in licenses.scan_licenses(docs(spark, *rows), p).collect()}
    want = {}
    for d, text in rows:
        found = brute_licenses(text, p)
        for k, (share, at) in found.items():
            name = p.templates[k][0]
            if (d, name) not in want or share > want[d, name][0]:
                want[d, name] = (round(share, 9), at)
    assert {x for x in got} == {x for x in want} and (900, "MIT") in got and (901, "MIT") in got
    assert sum(got[x][0] == want[x][0] for x in want) >= 0.98 * len(want)
    table = spark.createDataFrame(list(p.templates), "license string, text string")
    assert sorted(licenses.templates_of(table)) == sorted(p.templates)
    with pytest.raises(ValueError):
        licenses.templates_of(table, 3)


# ---- 5

def test_exact(spark):
    df = docs(spark, (3, "a  b"), (1, "a b"), (2, "a\n\tb"), (4, None), (5, ""), (6, "a b "), (1, "a b"), (None, "z"), (None, "a b"), (9, "x y" * 50_000))
    got = exact_dedup.exact_dedup(df).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    group = by[hashlib.sha256(b"a b").hexdigest()]
    assert len(got) == 10 and len(group) == 5 and {r.keep_id for r in group} == {1} and {r.group_size for r in group} == {5}
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    assert [r.kept for r in by[hashlib.sha256(b"z").hexdigest()]] == [True]
    assert {r.doc_id for r in by[hashlib.sha256(b"").hexdigest()]} == {4, 5}
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_texts_that_share_a_hash(spark, monkeypatch):
    """With every hash the same, only the bytes tell texts apart."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: exact_dedup.F.lit("one hash"))
    got = exact_dedup.exact_dedup(docs(spark, (1, "a b"), (2, "a  b"), (3, "c"), (4, "d"))).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)]


# ---- 6

def test_pieces_and_parts(spark):
    """Lists cut small give the same neighbours, and candidates are copied by the queries that probe their list, not by all rows."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    rows = lambda p: sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, p).collect())
    whole = rows(ann.AnnIndex())
    small = rows(ann.AnnIndex(rows=16, asked=4))
    assert len(whole) == len(small) == 400
    assert len({x[:3] for x in whole} & {x[:3] for x in small}) >= 0.9 * 400


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[300:400] = x[300]
    rows = [(i, v.tolist(), 9) for i, v in enumerate(x)] + [(700, None, 1), (720, [0.0] * 16, 1), (740, [float("nan")] * 16, 1), (760, [None] * 16, 1), (780, [1.0], 1), (None, x[0].tolist(), 1), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20)) and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        hits += len({i for i, _ in found} & set(order))
        assert all(math.isclose(v, s[i]) for i, v in found) and found == sorted(found, key=lambda t: (-t[1], t[0]))
    assert hits / (20 * len(got)) >= 0.9
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(6)
    q, v = rng.normal(size=(20, 65)).astype(np.float32), rng.normal(size=(500, 65)).astype(np.float32)
    qi, vi = ann.scan_block(q, v, 10, 16, 2.1)
    d = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    left = {(a, b) for a, b in zip(qi.tolist(), vi.tolist(), strict=True)}
    true = {(a, b) for a in range(20) for b in np.argsort(d[a])[:10].tolist()}
    assert len(true & left) / len(true) > 0.95 and len(left) < 20 * 500 / 5


# ---- 7

def test_mix(spark):
    rng = random.Random(7)
    rows = [(k, "w " * rng.randint(1, 30), f"s{k % 5}") for k in range(400)] + [(1000 + k, "w " * 20, "tiny") for k in range(3)] + [(2000, "u v", None), (2001, None, "s1"), (2002, "", None), (1, "w w", "s1")]
    df = docs(spark, *rows)
    got = mixing.mix_sources(df).collect()
    again = sorted(mixing.mix_sources(df.repartition(7)).collect(), key=repr)
    assert sorted(got, key=repr) == again and len(got) == len(rows)
    total = sum(r["size"] for r in got)
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    by = collections.defaultdict(list)
    for r, (_, _, s) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0]), strict=True):
        by[s].append(r)
    targets, left, rest = {}, total, dict(zip(sources, [1, 2, 3] * 9))
    size = {s: sum(r["size"] for r in by[s]) for s in sources}
    while True:
        over = [s for s in rest if left * rest[s] / sum(rest.values()) > 3 * size[s]]
        if not over:
            break
        level = left / sum(rest.values())
        for s in over:
            targets[s] = 3 * size[s]
        left -= sum(3 * size[s] for s in over)
        for s in over:
            del rest[s]
        del level
    targets |= {s: left * w / sum(rest.values()) for s, w in rest.items()}
    for s in sources:
        assert {r.source_size for r in by[s]} == {size[s]} and math.isclose(by[s][0].target, targets[s])
        assert abs(sum(r.taken for r in by[s]) - targets[s]) <= 16
        assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in by[s])
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_weights_matter(spark):
    df = docs(spark, *[(k, "w " * 10, "a" if k < 1000 else "b") for k in range(2000)]).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0))
    got = mixing.mix_sources(df, weight=F.col("w"), source_weights=(1.0, 2.0)).where("doc_id < 1000").collect()
    heavy = sum(r.taken for r in got if r.doc_id % 2 == 0) / sum(r.taken for r in got)
    assert heavy > 0.7


# ---- 8

PIECES = st.lists(st.sampled_from(["<", "[", "|", "\\", "s>", "/s>", "INST]", "/INST]", "|turn|>", "|says|>", "|done|>", "</s>", "<|done|>", "é", "\n", " ", "a", "世", "<|turn|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_template_round_trip(turns):
    t = chat_format.ChatTemplate()
    text, spans = t.render(turns)
    assert t.parse(text) == turns
    assert [t.unescape(text[a:b]) for a, b in spans] == [x for _, x in turns]
    assert text.count(t.close) == len(turns)


def test_chat(spark):
    rng = random.Random(8)
    bits = ["hello ", "  ", "</s>", "[INST]", "<|done|>", "世界", "é\n", "\\", "<", "x" * 30, "<|turn|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))), 1) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(99, None, None, None, 1), (99, 0, "assistant", None, 1), (None, 0, "assistant", "null id", 1), (98, 0, "assistant", "long " * 40_000, 1), (60, 0, "user", "same", 1), (60, 0, "user", "same", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    formatted = chat_format.format_chats(df)
    assert all(len(r.input_ids) == len(r.loss_mask) for r in formatted.collect())
    got = {r.conv_id: r for r in chat_format.chat_digest(formatted).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(df.limit(0)).count() == 0


# ---- 9

def _jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_lines(rows, q=5):
    """(doc_id, line number) of the lines that go."""
    lines = sorted((d is None, d, k, x.strip()) for d, t in dict.fromkeys(rows) for k, x in enumerate((t or "").split("\n")) if x.strip())
    sets = [{x[i : i + q] for i in range(len(x) - q + 1)} for *_, x in lines]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if lines[i][3] == lines[j][3] or (sets[i] and sets[j] and _jaccard(sets[i], sets[j]) >= 0.8):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {(d, k) for i, (_, d, k, _) in enumerate(lines) if find(i) != i}


def _line_rows(rng):
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(120, 300))) for _ in range(25)]

    def edit(x):
        k = rng.randrange(len(x))
        return x[:k] + "Z" + x[k + 1 :]

    rows = []
    for d in range(40):
        rows.append((d, "\n".join(rng.choice([rng.choice(base), edit(rng.choice(base)), "short", f"own line {d} " + "".join(rng.choice("klmnop") for _ in range(80)), "", "  "]) for _ in range(rng.randint(1, 8)))))
    return rows


def test_lines(spark):
    rows = [*_line_rows(random.Random(9)), (50, None), (51, ""), (52, "\n \n"), (53, "tiny"), (54, " tiny ")]
    df = docs(spark, *rows, rows[3], (53, "tiny"))
    gone = brute_lines(rows)
    got = line_dedup.line_decisions(df).collect()
    assert {(r.doc_id, k) for r in got for k in r.dropped} == gone
    assert all(r.n_dropped == len(r.dropped) for r in got)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    for d, t in rows:
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        had = any((d, k) in gone for k in range(len((t or "").split("\n"))))
        if had and not left.strip():
            assert d not in out
        else:
            assert out[d].text == left and out[d].score == 1
    assert line_dedup.line_decisions(df.limit(0)).count() == 0 and line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_places(spark):
    """Every row has a result, and each dropped line the place of the line that stays."""
    line = "the quick brown fox jumps over the lazy dog and then runs back again through the long wet grass to its den"
    near = line[:-1] + "m"
    df = docs(spark, (1, f"own words\n{line}"), (2, f"{near}\n\nown words"), (2, f"{near}\n\nown words"), (3, None), (4, ""), (5, " \n"), (None, line))
    got = sorted(((r.doc_id or 0, r.n_lines, r.dropped, [tuple(x) for x in r.kept]) for r in line_dedup.line_decisions(df).collect()), key=repr)
    two = (2, 2, [0, 2], [(1, 1), (1, 0)])
    assert got == [(0, 1, [0], [(1, 1)]), (1, 2, [], []), two, two, (3, 0, [], []), (4, 0, [], []), (5, 0, [], [])]


def test_lines_that_share_half_a_hash(spark, monkeypatch):
    """Lines are told apart by all 128 bits."""
    lines = spark.createDataFrame([(b"k", 1, 0, 5, 7, None), (b"k", 1, 1, 5, 8, None), (b"k", 1, 2, 6, 9, None)], "row_key binary, doc_id int, no int, h long, g long, keys array<long>")
    got = {r.no: r.id for r in line_dedup.with_ids(lines).collect()}
    assert len(set(got.values())) == 3 and got[2] == 6


def test_line_blocks(spark):
    """A bucket cut into blocks gives the same lines."""
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefghij ") for _ in range(300))
    rows = [(k, base[: 10 + k] + "Q" + base[11 + k :]) for k in range(60)]
    got = line_dedup.line_decisions(docs(spark, *rows), line_dedup.LineDedup(block=7)).collect()
    assert {(r.doc_id, k) for r in got for k in r.dropped} == brute_lines(rows)


def test_small_buckets_with_one_smallest_member(spark):
    """A row stands once in what its small buckets give together; larger buckets stay as they are, and pairs that met still meet."""
    keys = [(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (3, 10), (3, 13), (4, 11), (4, 12), (5, 77), *((9, k) for k in range(10, 16))]
    members = linking.shared_buckets(spark.createDataFrame(keys, "key int, id long"), once=True, together=3, bound=39)
    units = collections.defaultdict(list)
    for r in members.collect():
        units[r.bucket, r.n].append(r.id)
    assert sorted((n, sorted(ids)) for (_, n), ids in units.items()) == [(6, [10, 11, 12, 13, 14, 15]), (39, [10, 11, 12, 13]), (39, [11, 12])]


def test_char_shingles():
    for n in (1, 2, 3, 5, 8, 9, 13):
        text = "abcabcabcabcabcabc"
        h = line_dedup.char_shingles(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), n)
        assert len(h) == len(text) - n + 1
        assert all((h[i] == h[j]) == (text[i : i + n] == text[j : j + n]) for i in range(len(h)) for j in range(len(h)))


# ---- 10

def brute_join(rows, n=5):
    sets = {}
    for d, t in rows:
        w = (t or "").split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    classes = sorted({s for s in sets.values() if s}, key=lambda s: min(d for d in sets if sets[d] == s))
    links = collections.Counter()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)

    own = collections.defaultdict(list)
    for d, s in sets.items():
        own[s].append(d)
    for s in classes:
        for d in own[s]:
            join(d, own[s][0])
    for i, s in enumerate(classes):
        for o in classes[:i]:
            if _jaccard(s, o) >= 0.8:
                links[s] += 1
                links[o] += 1
                join(own[s][0], own[o][0])
    return {d: (find(d), links[s], len(own[s]) if s else 1) for d, s in sets.items()}


@pytest.mark.parametrize("block", [4, 256])
def test_join(spark, block):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(90, 150))] for _ in range(12)]
    rows = []
    for d in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((d, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "one  two"), (204, "one"), (205, " ".join(rng.choice(vocab) for _ in range(30_000)))]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.ngram_join(docs(spark, *rows), ngram_join.Forest(block=block)).collect()}
    want = brute_join(rows)
    wrong = {d: (want[d], got.get(d)) for d in want if want[d] != got.get(d)}
    assert not wrong
    repeated = ngram_join.ngram_join(docs(spark, (1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None))).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_copies) for r in repeated) == [(0, 0, 1), (0, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert ngram_join.ngram_join(docs(spark, (1, "a")).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0
