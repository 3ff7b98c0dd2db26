"""Model calls: how many are made, in which order, under which limits; rows that were lost or crashed before."""

import time

import pytest
from pyspark.sql import functions as F

from quizlake.operators import completion, pages, questions
from quizlake.operators.calls import Policy, ResultStore, call_each, call_key


def counter(path, fail=()):
    """A model that leaves a line in a file for every call; the file outlives the worker."""
    path = str(path)

    def model(prompt, *attachments):
        with open(path, "a") as f:
            f.write(prompt + "\n")
        if prompt in fail:
            raise RuntimeError("down")
        return prompt.upper() + "".join(map(str, attachments)), 1, 1, 0.5

    return model


def calls(path):
    return sorted(path.read_text().split("\n")[:-1])


QUICK = Policy(tries=1, pause=0)


def test_one_call_a_prompt(spark, tmp_path):
    model = counter(tmp_path / "calls")
    df = spark.createDataFrame([(k, f"p{k % 10}") for k in range(50)] + [(99, None)], "id long, p string").repartition(5)
    done = completion.complete(df, "p", model, policy=QUICK)
    for _ in range(3):
        assert done.where("ok").count() == 50
    routed = completion.cascade(done, F.when(F.col("id") < 5, "rule"), lambda rest: rest.withColumn("out", F.col("content")), "out")
    assert routed.count() == 51 and routed.where("method = 'rule'").count() == 5
    assert calls(tmp_path / "calls") == sorted(f"p{k}" for k in range(10))
    assert completion.paid_calls(done).agg(F.sum("cost")).first()[0] == 5.0
    assert done.where("id = 99").select("ok", "error", "content", "call_key").first() == (False, "no prompt", None, None)


def test_store_over_runs(spark, tmp_path):
    model = counter(tmp_path / "calls", fail=("b",))
    store = ResultStore(spark, f"file://{tmp_path}/store")
    rows = lambda *p: spark.createDataFrame([(x,) for x in p], "p string")
    assert tuple(completion.call_stats(completion.complete(rows("a", "b", "a"), "p", model, store=store, policy=QUICK)).first()) == (0, 2, 1)
    assert calls(tmp_path / "calls") == ["a", "b"]
    again = completion.complete(rows("a", "b", "c"), "p", model, store=store, policy=QUICK)
    assert {r.p: (r.cached, r.content) for r in again.collect()} == {"a": (True, "A"), "b": (False, None), "c": (False, "C")}
    assert calls(tmp_path / "calls") == ["a", "b", "b", "c"]
    assert sorted(r.content for r in store.results().collect()) == ["A", "C"]
    assert completion.complete(rows().limit(0), "p", model, store=store, policy=QUICK).collect() == []


def test_key_of_prompt_and_attachments(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", b"x", b""), (2, "p", b"x", b""), (3, "p", b"", b"x"), (4, "p", None, b"x"), (5, None, b"x", b"x")], "id long, p string, a binary, b binary")
    keys = {r[0]: r[1] for r in df.select("id", call_key(F.col("p"), F.col("a"), F.col("b"))).collect()}
    assert keys[1] == keys[2] and len({keys[1], keys[3], keys[4]}) == 3 and keys[5] is None
    got = completion.complete(df, "p", counter(tmp_path / "calls"), attachments=("a", "b"), policy=QUICK).collect()
    assert {r.id: r.content for r in got}[1] == "Pb'x'b''" and len(calls(tmp_path / "calls")) == 3


def test_calls_in_flight(spark):
    def slow(prompt):
        time.sleep(0.2)
        return prompt, 1, 1, 0.0

    df = spark.createDataFrame([(f"{k:02}",) for k in range(50)], "p string").coalesce(1)
    asked = df.select(F.col("p").alias("call_key"), F.col("p").alias("prompt"), F.lit(None).cast("array<binary>").alias("attachments"))
    call_each(asked.limit(1), slow, p=QUICK).collect()  # workers are there
    began = time.time()
    got = [r.content for r in call_each(asked, slow, p=Policy(in_flight=10)).collect()]
    assert time.time() - began < 4 and got == [f"{k:02}" for k in range(50)]


def test_time_and_rate_limits(spark):
    def hangs(prompt):
        if prompt == "hang":
            time.sleep(30)
        return prompt, 1, 1, 0.0

    df = spark.createDataFrame([("hang",), ("a",), ("b",), ("c",), ("",)], "p string")
    began = time.time()
    got = {r.p: r for r in completion.complete(df, "p", hangs, policy=Policy(tries=1, seconds=1.0, in_flight=2, tasks=1)).collect()}
    assert time.time() - began < 20
    assert not got["hang"].ok and "no reply" in got["hang"].error and got["a"].ok and got["c"].ok
    assert not got[""].ok and got[""].error == "empty reply"
    from quizlake.operators.calls import _caller

    one, began = _caller(hangs, None, Policy(per_second=20)), time.time()
    for _ in range(10):
        one("x")
    assert time.time() - began >= 0.45


def test_columns_of_the_caller_stay(spark, tmp_path):
    df = spark.createDataFrame([("a", "mine", 3.0, "in")], "p string, model string, cost double, model_in string")
    got = completion.complete(df, "p", counter(tmp_path / "c"), policy=QUICK).first()
    assert (got.model_in_in, got.cost_in, got.model_in, got.model, got.cost) == ("mine", 3.0, "in", "primary", 0.5)
    told = completion.complete(df.withColumnRenamed("p", "content"), "content", counter(tmp_path / "d"), policy=QUICK).first()
    assert told.content_in == "a" and told.content == "A"
    routed = completion.cascade(df.withColumn("method", F.lit("own")), F.col("p"), lambda rest: rest.withColumn("out", F.lit("m")), "out").first()
    assert (routed.method, routed.method_in) == ("rule", "own")


def test_until_covered(spark):
    rows = spark.createDataFrame([(d, n) for d in ("a", "b", None) for n in range(10)] + [("a", None), ("a", 1)], "doc_id string, number int")
    asked = []

    def half(missing, turn):
        asked.append((turn, missing.count()))
        return missing.where((F.col("number") % 2 == 0) | (F.col("doc_id") == "a") | (F.lit(turn) > 2)).select("doc_id", "number", F.lit(f"v{turn}").alias("value"))

    got = completion.until_covered(rows, ["doc_id", "number"], half).collect()
    assert len(got) == 20  # the key has a null otherwise
    assert asked == [(1, 20), (2, 5), (3, 5)]
    assert sorted({(r.doc_id, r.round) for r in got}) == [("a", 1), ("b", 1), ("b", 3)]
    none = completion.until_covered(rows, ["doc_id", "number"], lambda m, t: m.limit(0).withColumn("value", F.lit("x"))).collect()
    assert len(none) == 20 and all(r.value is None and r["round"] is None for r in none)
    assert completion.until_covered(rows.limit(0), ["doc_id", "number"], half).collect() == []


def test_solve_questions(spark, tmp_path):
    def flaky(prompt):
        with open(tmp_path / "calls", "a") as f:
            f.write("x")
        if prompt.startswith("Attempt 1"):
            return "I can't say", 1, 1, 0.0
        numbers = prompt.split("All ")[1].split(": ")[1].split("\n")[0].split(", ")
        return 'Sure: {"' + '", "'.join(f'{n}": "ac, {n}' for n in numbers[: (len(numbers) + 1) // 2]) + '"}', 1, 1, 0.0

    q = spark.createDataFrame([("d", k, f"q{k}", {"A": "x", "B": None}) for k in range(8)] + [("d", None, "t", None), ("e", 1, None, None), ("d", 3, "again", None)], "doc_id string, number int, text string, propositions map<string,string>")
    got = {(r.doc_id, r.number): (r.answer, r["round"]) for r in completion.solve_questions(q, flaky, batch=5, policy=QUICK, store=ResultStore(spark, f"file://{tmp_path}/s")).collect()}
    assert got[("e", 1)] == ("AC", 2) and len(got) == 9
    assert sorted(r or 9 for (d, _), (_, r) in got.items() if d == "d") == [2, 2, 2, 2, 2, 3, 3, 9]


@pytest.mark.parametrize(("text", "want"), [
    ('{"a":' * 100_000, []), ('{"a":' * 100_000 + '{"b": 1}', ['{"b": 1}']), ('{"a": {"b": 1}, oops {"c": "}"} "x', ['{"b": 1}', '{"c": "}"}']), ('{"a": "x, {"b": 1}', ['{"b": 1}']), ("", []), (None, []), ('[{"a":1} {"a":1}', ['{"a": 1}', '{"a": 1}']), ("{" * 50_000 + '"x"' + "}" * 50_000, []), ('{"q": "say \\\\"{\\\\" "} {bad} {"k": [1, {"z": null}]}', ['{"q": "say \\\\"{\\\\" "}', '{"k": [1, {"z": null}]}']),
])
def test_salvage(spark, text, want):
    text, want = (text.replace("\\\\", "\\") if text else text), [w.replace("\\\\", "\\") for w in want]
    began = time.time()
    assert spark.createDataFrame([(text,)], "x string").select(completion.salvage_objects("x")).first()[0] == want
    assert time.time() - began < 20


def test_salvage_of_deep_objects(spark):
    deep = '{"a":' * 100_000 + "1" + "}" * 100_000 + ' {"b": 2}'
    got = spark.createDataFrame([(deep,)], "x string").select(completion.salvage_objects("x")).first()[0]
    assert got[-1] == '{"b": 2}'


def test_page_list_of_long_runs(spark):
    p = spark.createDataFrame([("d", k, "x") for k in (1, 5, 70)] + [("e", 3, "y"), (None, 1, "z")], "doc_id string, page int, text string")
    specs = spark.createDataFrame([("d", "5-2000000000"), ("d", "1-99999999999,9-2"), ("e", "1-99999999999999999999,4"), ("f", "1"), (None, "1"), ("d", None)], "doc_id string, spec string")
    assert sorted((r.doc_id, r.page) for r in pages.page_list(p, specs).collect()) == [("d", 1), ("d", 5), ("d", 70)]
    assert spark.range(1).select(pages.page_numbers(F.lit("3, 1:2,x,7-5"))).first()[0] == [1, 2, 3]


def test_chains_of_repeated_splits(spark):
    p = spark.createDataFrame([("d", k, c) for k, c in ((1, "a"), (2, "b"), (3, "c"))], "doc_id string, page int, text string")
    s = spark.createDataFrame([("d", 1, 2), ("d", 1, 2), ("d", 2, 3)], "doc_id string, page int, next_page int")
    assert [tuple(r) for r in pages.merge_chains(p, s).select("text", "n_pages").collect()] == [("a\nb\nc", 3)]


def test_null_keys_are_kept_and_not_repeated(spark):
    schema = "doc_id string, page int, number int, v string, _gen int, _rn int"
    old = spark.createDataFrame([("d", 1, None, "a", 1, 2), ("d", 1, None, "b", 1, 2), ("d", 1, 2, "c", 1, 2), ("d", None, 3, "x", 1, 2)], schema)
    new = spark.createDataFrame([("d", 1, None, "n", 7, 8), ("d", 1, 2, "C", 7, 8), ("d", None, 3, "y", 7, 8)], schema)
    got = sorted((str(r.number), r.v, r._gen, r._rn) for r in questions.upsert(old, new).collect())
    assert got == [("2", "C", 7, 8), ("3", "x", 1, 2), ("3", "y", 7, 8), ("None", "a", 1, 2), ("None", "b", 1, 2), ("None", "n", 7, 8)]
    assert tuple(questions.upsert_counts(old, new).first()) == (1, 2)
    once = questions.quarantine(old.limit(0), new)
    assert questions.quarantine(once, new).count() == 3
