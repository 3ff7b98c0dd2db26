"""The registered queries over the small tables, against SQL where there is some."""

import math
import random
import zlib

import pytest

from compare import same
from quizlake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name]))


def test_trigrams_are_counted(spark, tmp_path):
    """The context "x b" tells what comes next, "b" alone doesn't; a query of bigrams scores both documents the same."""
    texts = ["x b c", "x b c", "y b d", "y b d", "x b d", "y b c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_score for r in QUERIES["op3_lm_score"](spark, str(tmp_path)).collect()}
    assert got[0] == round(math.log(3 / 18) + math.log(3 / 3) + math.log(2 / 3), 3)
    assert got[4] == round(math.log(3 / 18) + math.log(3 / 3) + math.log(0.4 * 3 / 6), 3)


def test_held_out(spark, sf_dir):
    got = QUERIES["op2_toxicity"](spark, sf_dir).collect()
    assert len(got) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_round_trip(spark, sf_dir):
    assert QUERIES["op1_sentencepiece"](spark, sf_dir).where("not round_trip").count() == 0


def test_licenses(spark, duck, sf_dir):
    want = {r[0] for r in duck.sql("select doc_id from documents where contains(text, 'Released under the MIT License.')").fetchall()}
    assert {r.doc_id for r in QUERIES["op4_license_scan"](spark, sf_dir).where("license = 'MIT'").collect()} >= want


def test_short_lines_with_one_edit(spark, tmp_path):
    """Lines of 30 to 90 characters and copies of them with one changed character, by the registered query."""
    from test_llm_operators import brute_lines

    rng = random.Random(13)
    rows = []
    for d in range(0, 120, 2):
        line = "".join(rng.choice("abcdefghij ") for _ in range(28 + d // 2)).strip("  ") + "kl"
        at = rng.randrange(1, len(line) - 1)
        rows += [(d, line), (d + 1, line[:at] + "Z" + line[at + 1 :])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, k) for r in QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect() for k in r.dropped}
    assert got == brute_lines(rows, 5) and got >= {(d, 0) for d, t in rows if d % 2 and len(t) >= 49}


def test_pipeline(spark, sf_dir):
    """Each stage against brute force on what the stage before it kept."""
    import corpus_pipeline
    from test_llm_operators import brute_join, brute_lines

    from quizlake.llm import sentencepiece, toxicity
    from quizlake.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    model = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    clean = written(stages["toxicity"](spark, docs, sf_dir), "t1")
    assert clean.columns == docs.columns
    assert rows(clean) == {d: t for d, t in rows(docs).items() if model.score(t or "") < 0.5}

    lines = written(stages["line_dedup"](spark, clean, sf_dir), "t2")
    before = rows(clean)
    gone = brute_lines(list(before.items()))
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in before.items()}
    assert rows(lines) == {d: t for d, t in want.items() if t.strip() or not before[d].strip()}
    assert lines.columns == docs.columns and lines.where("n_chars <> length(text)").count() == 0

    single = written(stages["ngram_join"](spark, lines, sf_dir), "t3")
    before = rows(lines)
    assert rows(single) == {d: before[d] for d, (c, _, _) in brute_join(list(before.items())).items() if c == d}

    mixed = written(stages["mix_sources"](spark, single, sf_dir), "t4")
    before, total = rows(single), sum(len((t or "").split()) for t in rows(single).values())
    got = [(r.doc_id, r.text) for r in mixed.collect()]
    assert all(before[d] == t for d, t in got) and max(got.count(x) for x in got) <= 3 and mixed.columns == docs.columns
    assert abs(sum(len(t.split()) for _, t in got) - total) <= 0.1 * total

    codec = sentencepiece.codec(sentencepiece.load_model())
    last = stages["sentencepiece"](spark, mixed, sf_dir).collect()
    assert len(last) == len(got) and all(codec.decode(r.input_ids) == r.text and r.round_trip for r in last)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f", None, None, 1), (2, "a b c d e f", None, None, 1), (None, "a b c d e g", "x", "s", 2)]])
def test_pipeline_odd_rows(spark, sf_dir, rows):
    import corpus_pipeline
    from quizlake.llm.common import written

    names = ["score", "size", "_gone_", "_gone", "gone", "row_key", "row", "_row", "_times", "times", "_copy", "col", "_score", "_predicted", "predicted", "class_id", "id", "key", "taken"]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "odd").selectExpr("*", *[f"'{n}' as `{n}`" for n in names], "map('a', doc_id) as m", "1 as `a.b`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), name)
        assert after.columns == docs.columns and after.count() <= 3 * docs.count()
        assert all(r[n] == n for r in after.collect() for n in names)
        docs = after
    corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_which_of_repeated_rows_stays(spark):
    """Rows that repeat an id and text but differ elsewhere: the same one stays however the rows lie."""
    import corpus_pipeline

    rows = [(1, "a b c d e f g", f"source {k}") for k in range(20)] + [(2, "other words here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.one_of_near):
        got = {tuple(sorted((r.doc_id, r.source) for r in stage(spark, df.repartition(k), "").collect())) for k in (1, 7)}
        assert len(got) == 1 and len(next(iter(got))) == 2


def test_ann_recall(spark):
    """The registered query over the given vectors, against brute force."""
    import collections

    import numpy as np

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    got = collections.defaultdict(list)
    for r in QUERIES["op6_ann"](spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = total = 0
    for k, i in enumerate(ids.tolist()):
        if i % 20 == 0:
            s = x @ x[k]
            best = [ids[j] for j in np.lexsort((ids, -s)) if j != k][:20]
            hits, total = hits + len(set(best) & set(got[i])), total + len(best)
            assert len(got[i]) == len(best)
    assert hits / total >= 0.95


def test_lines_and_documents_against_brute_force(spark, sf_dir):
    """The registered queries over whole documents."""
    from test_llm_operators import brute_join, brute_lines

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    lines = {(r.doc_id, k) for r in QUERIES["op9_line_dedup"](spark, sf_dir).collect() for k in r.dropped}
    assert lines == brute_lines(docs, 5)
    want = brute_join(docs)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in QUERIES["op10_ngram_join"](spark, sf_dir).collect()} == want


def test_toxicity_on_the_given_labels(spark):
    """Held-out labelled rows of sf0.1: what training on the other labels catches and what it leaves alone."""
    from quizlake.llm import toxicity
    from quizlake.llm.common import table

    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").where("toxic in (0, 1)").select("doc_id", "toxic").distinct()
    model = toxicity.fit(*toxicity.training_sample(docs, labels))
    out = [(r.text or "", r.toxic) for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    said = [s >= 0.5 for s in model.scores([t for t, _ in out])]
    caught = sum(s for s, (_, y) in zip(said, out, strict=True) if y)
    assert caught >= 0.9 * sum(y for _, y in out) and sum(s for s, (_, y) in zip(said, out, strict=True) if not y) <= 0.02 * len(out)
