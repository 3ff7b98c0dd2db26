"""Hand-made rows with results derived by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake.functions import text as T
from quizlake.operators import answers, completion, costs, match, metadata, pages, questions


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_normalize(spark):
    assert one(spark, "Été: l'œdème  (N°2)", T.normalize_text) == "ete l deme n 2"
    assert one(spark, None, T.normalize_text) == ""
    assert spark.range(1).select(T.normalize_nfkd(F.lit("ﬁn ½ É"))).first()[0] == "fin 1 2 e"


def test_ratio():
    assert round(T.ratio("kitten", "sitting"), 4) == 0.6154
    assert T.ratio("", "") == 1.0


@settings(max_examples=200, deadline=None)
@given(st.text("abc é", max_size=20), st.text("abc é", max_size=20))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert T.lcs_length(a, b) == t[-1][-1]


@pytest.mark.parametrize(("text", "want"), [
    ("|Q|A|B|C|D|E|\n|---|---|---|---|---|---|\n|1| |X|X| |X|\n|2|✓| | | | |", [(1, "BCE"), (2, "A")]),
    ("|Q|e|d|c|b|a|\n|7|X| | |X| |", [(7, "BE")]),
])
def test_tables(spark, text, want):
    df = spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")
    assert rows(answers.parse_tables(df), "number", "answer") == want


@pytest.mark.parametrize(("text", "want"), [("1: BCE\n2. ab | 10 - D", [(1, "BCE"), (2, "AB"), (10, "D")]), ("07: C", [(7, "C")]), ("1 : BCE", [(1, "BCE")])])
def test_lists(spark, text, want):
    df = spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")
    assert rows(answers.parse_lists(df), "number", "answer") == want


def test_answer_key(spark):
    df = spark.createDataFrame([("d", 4, "|Q|A|B|\n|1|X| |\n1: B\n2: A"), ("d", 5, "2: C")], "doc_id string, page int, text string")
    assert rows(answers.answer_key(df), "number", "answer", "src") == [(1, "A", "table"), (2, "C", "list")]


def test_page_score(spark):
    assert one(spark, "Corrigé\n| A | B | C | D |", T.page_score) == 60
    assert one(spark, "clé de correction", T.page_score) == 40
    assert one(spark, ", ".join(f"{k}: bce" for k in range(12)), T.page_score) == 50


def test_answer_pages(spark):
    df = spark.createDataFrame([("d", p, s) for p, s in ((1, 10), (2, 5), (3, 0), (9, 0))], "doc_id string, page int, score int")
    assert rows(answers.answer_pages(df, F.col("score")), "page") == [(1,), (2,), (3,)]


def test_alignment(spark):
    q = spark.createDataFrame([("d", 1, k, k, None) for k in range(1, 11)], "doc_id string, page int, pos int, number int, correct string")
    key = lambda n: spark.createDataFrame([("d", k, "A") for k in range(1, n)], "doc_id string, number int, answer string")
    assert rows(answers.alignment(q, key(10)), "score", "drift") == [(0.9, False)]
    assert rows(answers.alignment(q, key(6)), "score", "drift") == [(0.5, True)]
    assert answers.apply_with_fallback(q, key(10)).where("correct is null").count() == 1


def test_threshold(spark):
    f = lambda *s: questions.option_threshold(spark.createDataFrame([("d", n) for n in s], "doc_id string, n_options int")).first().threshold
    assert f(5, 5, 4, 4, 2) == 4
    assert f(5, 4, 3) == 3


def test_upsert(spark):
    schema = "doc_id string, page int, number int, v string"
    old = spark.createDataFrame([("d", 1, 1, "a"), ("d", 1, 2, "b"), ("d", 1, 0, "x")], schema)
    new = spark.createDataFrame([("d", 1, 2, "B"), ("d", 2, 1, "c"), ("d", 1, 0, "y")], schema)
    got = questions.upsert(old, new)
    assert rows(got, "page", "number", "v") == [(1, 0, "x"), (1, 0, "y"), (1, 1, "a"), (1, 2, "B"), (2, 1, "c")]
    keyed = got.where("number <> 0")
    assert rows(questions.upsert(keyed, keyed), "page", "number", "v") == rows(keyed, "page", "number", "v")


def test_page_stamp(spark):
    df = spark.createDataFrame([(p, 4, 6) for p in (None, 0, 5, 9)], "page int, chunk_first int, chunk_last int")
    assert [r.page for r in pages.stamp_pages(df).collect()] == [4, 4, 5, 4]


@pytest.mark.parametrize(("spec", "want"), [("1,2,5:9,11", [1, 2, 5, 6, 7, 8, 9, 11]), ("4-6", [4, 5, 6]), ("x", []), ("6-4", [])])
def test_page_numbers(spark, spec, want):
    assert one(spark, spec, pages.page_numbers) == want


@pytest.mark.parametrize(("text", "want"), [("a- First option text\nb) Second option text\n34- Next", {"A": "First option text", "B": "Second option text"}), ("a- First option text\n34- Next", None)])
def test_orphans(spark, text, want):
    got = questions.orphan_options(spark.createDataFrame([("d", 2, text)], "doc_id string, page int, text string")).collect()
    assert (got[0].orphans if got else None) == want


def test_split_merge(spark):
    p = spark.createDataFrame([("d", 1, "1- Question"), ("d", 2, "c- Third option here\nd- Fourth option here\n2- Next")], "doc_id string, page int, text string")
    q = spark.createDataFrame([("d", 1, 0, 1, "Question", {"A": "x"}), ("d", 2, 0, 0, "", {"C": "t"}), ("d", 2, 1, 2, "Next", {"A": "a", "B": "b", "C": "c"})], "doc_id string, page int, pos int, number int, text string, propositions map<string,string>")
    got = {r.number: r for r in questions.merge_splits(q, p).collect()}
    assert set(got) == {1, 2} and set(got[1].propositions) == {"A", "C", "D"} and got[1].merged_from == 2 and got[2].merged_from is None


def test_split_page(spark):
    assert one(spark, "Module de biologie\n34-La question posée est la suivante :", T.page_split)
    assert not one(spark, "34-La question posée est la suivante :", T.page_split)
    assert not one(spark, None, T.page_split)


def test_chain(spark):
    p = spark.createDataFrame([("d", k, str(k)) for k in (1, 2, 3, 10)], "doc_id string, page int, text string")
    s = spark.createDataFrame([("d", 1, 2), ("d", 2, 3)], "doc_id string, page int, next_page int")
    assert rows(pages.merge_chains(p, s), "page", "text") == [(1, "1\n2\n3"), (10, "10")]


def test_cases(spark):
    r = spark.createDataFrame([("d", 1, 1, None), ("d", 1, 2, "X"), ("d", 2, 3, None), ("d", 10, 4, "Y"), ("d", 10, 5, None)], "doc_id string, page int, pos int, trigger string")
    assert [x.cas for x in metadata.carry_forward(r, "trigger").orderBy("pos").collect()] == [None, "X", "X", "Y", "Y"]


def test_fill(spark):
    r = spark.createDataFrame([("d", "f", "2020"), ("e", "f", ""), ("g", "f", None), ("h", "k", None)], "doc_id string, file string, year string")
    d = spark.createDataFrame([("e", "2021")], "doc_id string, year string")
    f = spark.createDataFrame([("g", "f", "2022"), ("e", "f", "2022")], "doc_id string, file string, year string")
    assert rows(metadata.fill_metadata(r, ["year"], d, f, {"year": "2024"}), "doc_id", "year") == [("d", "2020"), ("e", "2021"), ("g", "2022"), ("h", "2024")]


def test_template(spark):
    r = spark.createDataFrame([("1", {"a": "x"}, "y"), ("2", {"a": "x"}, None)], "number string, propositions map<string,string>, A string")
    assert [x.A for x in metadata.map_template(r, keep=()).orderBy("Num").collect()] == ["y", "x"]


def test_modules(spark):
    m = spark.createDataFrame([("medecine", "Cardiologie", 0, ["insuffisance cardiaque"]), ("medecine", "Radiologie", 1, ["ECG"])], "domain string, module string, module_ord int, keywords array<string>")
    r = spark.createDataFrame([(1, "medecine", "ECG: Insuffisance cardiaque"), (2, "medecine", "rien")], "doc_id int, domain string, text string")
    assert rows(metadata.keyword_category(r, m), "doc_id", "module") == [(1, "Cardiologie")]
    a = spark.createDataFrame([(1, "medecine", '"cardiologie"'), (2, "medecine", "C'est Cardiologie"), (3, "medecine", "zzz")], "doc_id int, domain string, answer string")
    assert [x.module for x in metadata.resolve_module(a, m).orderBy("doc_id").collect()] == ["Cardiologie", "Cardiologie", "Autre"]
    n = spark.createDataFrame([("Cardio",)], "name string")
    assert rows(metadata.nearest_module(n, m), "module", "confidence") == [("Cardiologie", 0.85)]


def test_tiers(spark):
    got = spark.createDataFrame([(x,) for x in (0.95, 0.9, 0.8, 0.75, 0.5, 0.0)], "s double").select(T.tier(F.col("s"))).collect()
    assert [r[0] for r in got] == ["green", "green", "yellow", "yellow", "red", "none"]


def test_week(spark):
    got = spark.sql("select explode(array(timestamp'2024-01-06', timestamp'2024-01-07')) ts").select(T.week_key(F.col("ts"))).collect()
    assert [r[0] for r in got] == ["2024-W00", "2024-W01"]


def test_estimate(spark):
    calls = spark.createDataFrame([("none", 0.0, 1_000_000, 0)], "model string, cost double, prompt_tokens long, completion_tokens long")
    assert costs.estimate(calls, spark.createDataFrame(costs.PRICES, "model string, prompt double, completion double")).first().cost == 0.1


def test_badges(spark):
    p = spark.createDataFrame([("a", True)] * 5 + [("a", False), ("b", False), ("c", True)], "project string, ok boolean")
    assert rows(costs.badges(p), "project", "badge") == [("a", "warning"), ("b", "error"), ("c", "success")]


def test_replies(spark):
    schema = "struct<number:bigint>"
    df = spark.createDataFrame([('```json\n[{"number":1,}{"number":2}]\n```',), ("none",)], "x string")
    got = [r[0] for r in df.select(completion.parse_objects(F.col("x"), schema)).collect()]
    assert [x.number for x in got[0]] == [1, 2] and got[1] is None
    assert one(spark, '[{"a":1}, garbage {"a":2}', completion.salvage_objects) == ['{"a": 1}', '{"a": 2}']
    assert one(spark, "The answer is: ACD or so B", lambda c: T.last_answer(c)) == "B"


def test_complete(spark):
    def broken(prompt):
        raise RuntimeError("down")

    df = spark.createDataFrame([("a",), (None,)], "p string")
    got = {r.p: r for r in completion.complete(df, "p", broken, lambda p: (p * 2, 1, 1, 0.5), tries=2, pause=0).collect()}
    assert got["a"].content == "aa" and got["a"].model == "fallback" and got["a"].ok and not got[None].ok


def test_markers(spark):
    body = f"START_PAGE_1 {'x' * 60} END_PAGE_1\nSTART_PAGE_2 {'y' * 30} END_PAGE_2"
    df = spark.createDataFrame([(1, 2, body), (1, 3, body)], "page int, next_page int, content string")
    assert [(r.fixed, r.next_fixed) for r in completion.parse_page_markers(df).orderBy("next_page").collect()] == [("x" * 60, "y" * 30), (None, None)]


@pytest.mark.parametrize("t", [0.75, 0.9])
def test_pruned_is_brute_force(spark, t):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(60)] + ["abcd", ""]
    s = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if len(a) >= 5 and b and T.ratio(a, b) >= t}
    assert {(r.source_id, r.ref_id) for r in match.similar_pairs(s, s, t).collect()} == want


def test_approximate_recall(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa"]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(40)]
    texts += [t[:20] + "x" + t[21:] for t in texts]
    s = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    exact = {(r.source_id, r.ref_id) for r in match.similar_pairs(s, s, 0.9).collect()}
    found = {(r.source_id, r.ref_id) for r in match.approximate_pairs(s, s, 0.9).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact)


def test_weighted(spark):
    s = spark.createDataFrame([(1, "abcdefghij", "ab"), (2, "abcdefghij", ""), (3, "abc", "ab")], "id long, t string, c string")
    r = spark.createDataFrame([(7, "abcdefgh", "ab")], "id long, t string, c string")
    got = {x.source_id: round(x.similarity, 4) for x in match.weighted_match(s, r, 0.1).collect()}
    assert got == {1: round(0.7 * 16 / 18 + 0.3, 4), 2: round(0.7 * 16 / 18, 4)}


def test_report_order(spark):
    side = "named_struct('Num', {}, 'Text', 't', 'Correct', 'A', 'Year', '2024', 'subcategoryName', 's')"
    m = spark.range(20).selectExpr("id source_id", "cast(id % 4 as double) / 4 similarity", "0.5d text_similarity", "cast(null as double) corr_similarity", f"{side.format('id')} source", f"{side.format('id')} ref").repartition(5)
    assert [r.source_id for r in match.order_matches(m).collect()] == sorted(range(20), key=lambda k: (-(k % 4), k))
    assert [int(r.source_num) for r in match.match_report(m).collect()] == sorted((k for k in range(20) if k % 4), key=lambda k: (-(k % 4), k))


def test_orders(spark):
    users = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, 2.0)], "user_id int, cost double").repartition(3)
    assert [r.user_id for r in costs.sort_users(users).collect()] == [3, 1, 4, 2] and [r.user_id for r in costs.sort_users(users, descending=False).collect()] == [2, 1, 4, 3]
    q = spark.createDataFrame([("d", 2, 1), ("d", 1, 10), ("d", 1, 9)], "doc_id string, page int, number int").repartition(3)
    assert [(r.page, r.number) for r in questions.in_order(q).collect()] == [(1, 9), (1, 10), (2, 1)]


def test_repeated_keys_do_not_double(spark):
    q = spark.createDataFrame([("d", 1, 1, "x", "f", "")], "doc_id string, page int, number int, correct string, file string, year string")
    key = spark.createDataFrame([("d", 1, "A"), ("d", 1, "B"), ("d", 1, " ")], "doc_id string, number int, answer string")
    assert [r.correct for r in answers.apply_key(q, key).collect()] == ["B"]
    assert [r.correct for r in answers.fill_gaps(q.withColumn("correct", F.lit(" ")), key).collect()] == ["B"]
    twice = spark.createDataFrame([("d", "f", "2023"), ("d", "f", "2024")], "doc_id string, file string, year string")
    assert [r.year for r in metadata.fill_metadata(q, ["year"], twice, twice).collect()] == ["2024"]
    calls = spark.createDataFrame([("m", 0.0, 1_000_000, 0)], "model string, cost double, prompt_tokens long, completion_tokens long")
    assert [r.cost for r in costs.estimate(calls, spark.createDataFrame([("m", 1.0, 1.0), ("m", 2.0, 1.0)], "model string, prompt double, completion double")).collect()] == [2.0]
    p = spark.createDataFrame([("d", 1, "b"), ("d", 1, "a")], "doc_id string, page int, text string")
    assert [r.page_text for r in pages.with_page_text(q.select("doc_id", "page"), p).collect()] == ["a"]


def test_upsert_is_the_same_again(spark):
    rows = spark.createDataFrame([("d", 1, 1, f"v{k}") for k in range(50)], "doc_id string, page int, number int, v string")
    assert len({questions.upsert(rows.limit(0), rows.repartition(k)).first().v for k in (1, 3, 8)}) == 1


def test_lcs_of_many():
    rng = random.Random(5)
    for _ in range(60):
        a, others = ["".join(rng.choice("abcd ") for _ in range(n)) for n in [rng.randint(1, 200)]][0], ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 200))) for _ in range(12)]
        (x, n), (y, _) = T.encoded([a], others)
        assert T.lcs_lengths(x[0, : n[0]], y, int(max(x.max(initial=0), y.max(initial=0)))).tolist() == [T.lcs_length(a, b) for b in others]


def test_nearest_module(spark):
    import difflib

    names, modules = ["Cardio", "cardiologie", "neuro", "x", "Urologie pédiatrique", "", None], ["Cardiologie", "Neurologie", "Urologie", "Cardiologie"]
    n, m = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(list(zip(modules, range(4), strict=True)), "module string, module_ord long")

    def best(name):
        low = name.strip().lower()
        scored = [(1.0 if low == x.lower() else max(difflib.SequenceMatcher(None, low, x.lower()).ratio(), 0.85 if x.lower() in low or low in x.lower() else 0), -k, x) for k, x in enumerate(modules)]
        return max(scored)

    want = {x: best(x) for x in names if x}
    for block in (2, 512):
        got = {r.name: (r.confidence, r.module) for r in metadata.nearest_module(n, m, 0.3, block).collect()}
        assert got == {x: (c, mod) for x, (c, _, mod) in want.items() if c > 0.3}


def test_registered_for_sql(spark):
    T.register(spark)
    got = spark.sql("select indel_ratio('abcd', 'abd') a, sequence_ratio('abcd', 'bcde') b, normalize_nfkd('ﬁn É') c").first()
    assert (round(got.a, 6), got.b, got.c) == (round(6 / 7, 6), 0.75, "fin e")


def test_object(spark):
    assert one(spark, 'Sure: {"a": 1, "b": "x"} done', completion.parse_object) == {"a": "1", "b": "x"}
    assert one(spark, "none", completion.parse_object) is None and one(spark, '{"a": ', completion.parse_object) is None


def test_runs(spark, tmp_path):
    from quizlake.sources import io

    for run, v in (("2024-01-01", 1), ("2024-01-02", 2)):
        io.save_run(spark.createDataFrame([(v,)], "v int"), str(tmp_path), "3", run)
    assert rows(io.load_runs(spark, str(tmp_path), "3"), "v", "run_id") == [(1, "2024-01-01"), (2, "2024-01-02")]
    assert rows(io.load_runs(spark, str(tmp_path), "3", "current"), "v") == [(2,)] and rows(io.load_runs(spark, str(tmp_path), "3", "2024-01-01"), "v") == [(1,)]


def test_index(spark):
    from quizlake.sources.scratch import with_index

    got = with_index(spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "k int").repartition(9), ["k"]).collect()
    assert all(r["index"] == r.k for r in got) and len(got) == 101
