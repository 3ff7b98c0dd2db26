"""What operators keep or read beside their rows: saved matches, totals of a pass, banks with faults."""

import json

import pyarrow.parquet as pq
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quizlake.operators import completion, pages, questions
from quizlake.sources import io


def test_saved_matches_are_read_by_range(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.range(4000).select(F.col("id").cast("string").alias("qcm_id"), (F.col("id") % 1000 / 999).alias("similarity"), F.lit("x").alias("band_"))
    io.save_matches(df, path)
    some = io.load_matches(spark, path, 0.3, 0.42)
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in df.where("similarity between 0.3 and 0.42").collect()}
    files = {f.rsplit("/", 2)[1] for f in some.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files == {"band=6", "band=7", "band=8"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and "GreaterThanOrEqual(similarity,0.3)" in plan
    for f in (tmp_path / "m" / "band=7").glob("*.parquet"):  # the row groups' ranges lie inside the band
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column([meta.row_group(g).column(c).path_in_schema for c in range(meta.num_columns)].index("similarity")).statistics
            assert 0.35 <= stats.min <= stats.max < 0.4
    assert io.load_matches(spark, path, 0.0, 0.0).count() == 4 and io.load_matches(spark, path).count() == 4000


def test_totals_come_with_the_rows(spark):
    p = spark.createDataFrame([("d", k, c) for k, c in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))], "doc_id string, page int, text string")
    s = spark.createDataFrame([("d", 1, 2), ("d", 2, 3)], "doc_id string, page int, next_page int")
    seen = Observation()
    assert pages.merge_chains(p, s, seen).count() == 2 and seen.get == {"pages": 4, "chains": 1, "merged": 2}
    b = spark.createDataFrame([("d", 1, 2, "new"), ("d", 1, 9, "none")], "doc_id string, fix int, page int, text string")
    seen = Observation()
    assert completion.apply_fix_blocks(p, b, seen).where("fixed").count() == 1 and seen.get == {"pages": 4, "fixed": 1}
    seen = Observation()
    completion.cascade(p, F.when(F.col("page") < 2, "rule"), lambda rest: rest.withColumn("out", F.lit("m")), "out", seen).collect()
    assert seen.get == {"rule": 1, "model": 3}
    text = spark.createDataFrame([("d", 1, "1- Which of these?"), ("d", 2, "A- first option\nB- second option\n2- Next: one?")], "doc_id string, page int, text string")
    q = spark.createDataFrame([("d", 1, 0, 1, "Which", None), ("d", 2, 0, 0, "", {"A": "first"}), ("d", 2, 1, 2, "Next", None)], "doc_id string, page int, pos int, number int, text string, propositions map<string,string>")
    seen = Observation()
    assert questions.merge_splits(q, text, totals=seen).count() == 2 and seen.get == {"questions": 2, "merged": 1, "dropped": 1}


def test_banks_with_faults(spark, tmp_path):
    banks = {
        "a": {"qcms": {"x": 1}, "items": [{"Num": 1}, {"Num": 2}]}, "b": [{"Num": 3}], "c": {"first": {"Num": 4}, "second": {"Num": 5}}, "d": {"questions": [], "data": [{"Num": 9}]}, "e": "only text",
    }
    for name, bank in banks.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(bank))
    (tmp_path / "f.json").write_text('[{"Num": 6}, ')
    (tmp_path / "g.json").write_text(" ")
    rows = io.load_reference(spark, str(tmp_path)).select(F.substring(F.col("file"), -6, 1).alias("bank"), "ref_index", F.try_variant_get("ref", "$.Num", "int").alias("num"), "error").collect()
    got = sorted((r.bank, r.ref_index, r.num) for r in rows if r.error is None)
    assert got == [("a", 0, 1), ("a", 1, 2), ("b", 0, 3), ("c", 0, 4), ("c", 1, 5)]
    assert {(r.bank, r.error) for r in rows if r.error} == {("e", "neither a list nor an object"), ("f", "not JSON"), ("g", "not JSON")}


def _as_loaded(df):
    return sorted(((r.bank, r.ref_index is None, r.ref_index or 0, r.ref, r.error) for r in df.select(F.regexp_extract("file", "([^/]+)$", 1).alias("bank"), "ref_index", F.to_json("ref").alias("ref"), "error").collect()), key=repr)


def test_banks_by_ranges(spark, tmp_path):
    from quizlake.sources.banks import scan_bank

    tricky = [{"Num": k, "t": x * n, "in": [{"a": [1, {"b": "]}"}]}, []]} for k, (x, n) in enumerate([('"', 3), ("\\", 41), ("\\\"", 9), ("é]}{[,:", 7), ("", 1), ("plain ", 40), ("\n", 5)] * 6)]
    banks = {
        "list": json.dumps(tricky), "pretty": json.dumps(tricky, indent=3, ensure_ascii=False), "named": json.dumps({"name": "x, [y]", "other": [[9]], "qcms": {"no": [1]}, "data": tricky, "items": [5]}), "values": json.dumps({f"k{k:03}": t for k, t in enumerate(tricky)}),
        "spaced": ' {"questions" : \n [ 1 , "two" , null, {"x":[ ]} ] , "z": 3}', "empty": "[ ]", "none": "{}", "text": '"only [text"', "cut": json.dumps(tricky)[:-30], "open": '["abc', "bom": "﻿[1,2]",
    }
    for name, text in banks.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    want = _as_loaded(io.load_reference(spark, str(tmp_path)))
    want = [r for r in want if r[0] != "bom"] + [("bom", False, 0, "1", None), ("bom", False, 1, "2", None)]
    for step in (64, 331, 1 << 20):
        assert _as_loaded(scan_bank(spark, str(tmp_path), step)) == sorted(want, key=repr)
    assert scan_bank(spark, str(tmp_path / "list"), 500).select(F.countDistinct("ref_index")).first()[0] == len(tricky)
