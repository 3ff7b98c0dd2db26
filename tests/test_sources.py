"""Scans and sinks over files that the test writes; streaming jobs."""

import json

import pytest
from pyspark.sql import functions as F

from quizlake.operators.questions import upsert
from quizlake.sources import io
from quizlake.sources.versions import VersionedTable
from quizlake.streaming import jobs


def test_pages(spark, tmp_path):
    (tmp_path / "exam 1").mkdir()
    for n in (2, 10):
        (tmp_path / "exam 1" / f"page_{n}.txt").write_text(f"text {n}\nmore", encoding="utf-8")
    (tmp_path / "exam 1" / "cover.txt").write_text("cover")
    got = {(r.doc_id, r.page): r.text for r in io.scan_pages(spark, str(tmp_path)).collect()}
    assert got == {("exam 1", 2): "text 2\nmore", ("exam 1", 10): "text 10\nmore", ("exam 1", 0): "cover"}


def test_questions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"page": 1, "number": 1, "text": "q", "propositions": {"A": "x"}}, {"page": 1, "number": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"page": 3, "number": 9, "text": "r"}))
    (tmp_path / "c.json").write_text("{broken")
    got = io.scan_questions(spark, str(tmp_path)).collect()
    assert sorted(r.number for r in got if r.number) == [1, 2, 9] and sum(r._corrupt_record is not None for r in got) == 1


def test_reference(spark, tmp_path):
    for name, body in (("list", [{"Num": 1}, {"Num": 2}]), ("key", {"x": 1, "questions": [{"Num": 5}]}), ("values", {"a": {"Num": 7}, "b": {"Num": 8}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        got = io.load_reference(spark, str(tmp_path / f"{name}.json")).select("ref_index", F.try_variant_get("ref", "$.Num", "int")).collect()
        assert [tuple(r) for r in got] == {"list": [(0, 1), (1, 2)], "key": [(0, 5)], "values": [(0, 7), (1, 8)]}[name]


def test_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Num,,Text\n 1 ,x, hello\n,,\n2,,there\n")
    df = io.scan_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["Num", "col_1", "Text"] and [tuple(r) for r in df.collect()] == [("1", "x", "hello"), ("2", None, "there")]


def test_modules(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"medecine": {"Cardiologie": {"focus": "f", "keywords": ["ecg"]}}, "biologie": ["Biochimie"], "system_context": "text"}))
    got = {(r.domain, r.module): list(r.keywords) for r in io.load_modules(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("medecine", "Cardiologie"): ["ecg"], ("biologie", "Biochimie"): []}


def test_stage(spark, tmp_path):
    df = spark.createDataFrame([(1, "accepted"), (2, "rejected")], "id int, status string")
    io.save_stage(df, str(tmp_path), "2")
    assert [r.id for r in io.load_stage(spark, str(tmp_path), "2", status="rejected").collect()] == [2]
    assert set(io.audit(df, "merged").columns) == {"id", "status", "action", "at"}


def test_export(spark):
    df = spark.createDataFrame([("z", None, ["a", "a", "b"], "q", "")], "extra string, Exp string, Tag array<string>, Text string, Cas string")
    got = io.export_columns(df)
    assert got.columns == ["Text", "Tag", "extra"] and got.first().Tag == "a, b"


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"project": "p", "step": "1", "text": t}) for t in ("[OK] done ", "  ", "ERROR x")))
    q = jobs.tail_logs(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("logs_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.text, r.type) for r in spark.table("logs_test").collect()} == {("[OK] done", "ok"), ("ERROR x", "error")}


def test_log_stream_follows_files(spark, tmp_path):
    from quizlake.sources.appended import appended_lines

    top = tmp_path / "logs"
    (top / "a").mkdir(parents=True)

    def run(**how):
        q = appended_lines(spark, str(top), **how).writeStream.format("parquet").option("path", str(tmp_path / "got")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted((r.file, r.line) for r in spark.read.parquet(str(tmp_path / "got")).collect())

    (top / "a" / "1.log").write_bytes("one\ntwo é\r\n\nhalf".encode())
    want = [("a/1.log", ""), ("a/1.log", "one"), ("a/1.log", "two é")]
    assert run() == want
    with (top / "a" / "1.log").open("ab") as f:
        f.write(b" a line\nnext\n")
    (top / "2.log").write_bytes(b"x" * 300_000 + b"\n" + b"y\n" * 1000 + b"cut")
    want += [("a/1.log", "half a line"), ("a/1.log", "next"), ("2.log", "x" * 300_000)] + [("2.log", "y")] * 1000
    assert run(partition_bytes=1000) == sorted(want)
    assert run() == sorted(want)
    (top / "2.log").write_bytes(b"anew\n")  # shorter: begun anew
    (top / "_tmp").write_bytes(b"not a log\n")
    (top / "3.log").write_bytes(b"")
    assert run() == sorted([*want, ("2.log", "anew")])


def _chunk(folder, name, rows):
    folder.mkdir(exist_ok=True)
    tmp = folder / f".{name}"
    tmp.write_text("\n".join(json.dumps(dict(zip(("doc_id", "page", "number", "v"), r, strict=True))) for r in rows))
    tmp.rename(folder / f"{name}.json")


def test_accumulate(spark, tmp_path):
    schema = "doc_id string, page int, number int, v string"
    where = (str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    seen = []
    for k, part in enumerate(([("d", 1, 1, "a"), ("d", 1, 2, "b"), ("d", 1, None, "n"), ("d", 1, None, "n")], [("d", 1, 2, "B"), ("d", 2, 1, "c"), ("d", 2, 1, "c"), ("e", 1, 0, "z")])):
        _chunk(tmp_path / "in", k, part)
        before = jobs.current(spark, where[2], schema) if k else None  # a reader that began before the write
        jobs.accumulate(spark, *where, slots=8).awaitTermination(60)
        seen.append(jobs.changes(spark, where[2]))
        if before is not None:
            assert sorted(r.v for r in before.collect()) == ["a", "b", "n", "n"]
    got = jobs.current(spark, where[2], schema)
    assert sorted((r.page, r.number or 0, r.v) for r in got.collect()) == [(1, 0, "n"), (1, 0, "n"), (1, 0, "z"), (1, 1, "a"), (1, 2, "B"), (2, 1, "c")]
    assert [(s["version"], s["added"], s["updated"]) for s in seen] == [(1, 4, 0), (2, 2, 1)]
    jobs.accumulate(spark, *where, slots=8).awaitTermination(60)  # restarted without anything new
    assert jobs.changes(spark, where[2]) == seen[-1]
    table = VersionedTable(spark, where[2])
    table.vacuum()
    assert got.count() == 6 and sorted(upsert(got, got.where("number > 0")).toPandas().v) == ["B", "a", "c", "n", "n", "z"]


def test_accumulate_after_a_crash(spark, tmp_path, monkeypatch):
    """A batch that dies after its data is written, before the pointer moves, leaves the old version and comes once when run again."""
    schema = "doc_id string, page int, number int, v string"
    where = (str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    _chunk(tmp_path / "in", 0, [("d", 1, 1, "a"), ("d", 1, 0, "free")])
    jobs.accumulate(spark, *where).awaitTermination(60)
    _chunk(tmp_path / "in", 1, [("d", 1, 1, "A"), ("d", 1, 0, "more"), ("f", 1, 1, "new")])
    write = VersionedTable._write

    def dies(self, name, text):
        if name == "_current":
            raise RuntimeError("lost")
        write(self, name, text)

    monkeypatch.setattr(VersionedTable, "_write", dies)
    with pytest.raises(Exception, match="lost"):
        jobs.accumulate(spark, *where).awaitTermination(60)
    assert sorted(r.v for r in jobs.current(spark, where[2], schema).collect()) == ["a", "free"]
    monkeypatch.setattr(VersionedTable, "_write", write)
    jobs.accumulate(spark, *where).awaitTermination(60)
    assert sorted(r.v for r in jobs.current(spark, where[2], schema).collect()) == ["A", "free", "more", "new"]
    assert jobs.changes(spark, where[2]) == {"version": 2, "batch": 1, "added": 2, "updated": 1}
