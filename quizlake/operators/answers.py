"""Answer keys: finding their pages, reading them, applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SIMPLE_WORDS, answer_clean, detect_score

#: Marks of a chosen option.
MARKS = ("X", "1", "V", "O", "✓", "✔")


def answer_pages(pages: DataFrame, score: Column, least: int = 15, relaxed: int = 5) -> DataFrame:
    """``doc_id, page`` of likely answer pages and their existing neighbours.

    Pages score at least ``least``; in a document without any, at least ``relaxed``.
    """
    scored = pages.select("doc_id", "page", score.alias("score"))
    top = F.max("score").over(Window.partitionBy("doc_id"))
    chosen = scored.withColumn("top", top).where(F.col("score") >= F.when(F.col("top") >= least, least).otherwise(relaxed))
    near = chosen.select("doc_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page")).distinct()
    return pages.select("doc_id", "page").join(near, ["doc_id", "page"], "left_semi").distinct()


def top_answer_pages(pages: DataFrame, k: int = 5, least: int = 40, score: Column | None = None) -> DataFrame:
    """The ``k`` pages of a document with the best older score, ties to the lower page."""
    scored = pages.select("doc_id", "page", (detect_score(F.col("text")) if score is None else score).alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "page"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def parse_tables(pages: DataFrame) -> DataFrame:
    """``doc_id, page, pos, number, answer`` of tables with one marked column an option.

    The nearest head above a row names its columns; separators and rows without a number or mark are left out.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    lines = lines.where(F.startswith("line", F.lit("|")) & F.endswith("line", F.lit("|")) & (F.length("line") > 1))
    split = F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|")
    lines = lines.withColumn("cells", F.transform(split, lambda x: F.upper(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))))
    is_head = F.array_contains("cells", "A") & F.array_contains("cells", "B")
    w = Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("is_head", is_head).withColumn("head", F.last(F.when(is_head, F.col("cells")), ignorenulls=True).over(w))
    rows = rows.where(~F.col("is_head") & F.col("head").isNotNull() & ~F.contains("line", F.lit("---")) & F.regexp_like(F.col("cells")[0], F.lit(r"^\d{1,9}$")))
    named = F.zip_with(*[F.slice(c, F.lit(2), F.size(c)) for c in ("head", "cells")], lambda h, c: F.when(h.isin("A", "B", "C", "D", "E") & c.isin(*MARKS), h))
    out = rows.select("doc_id", "page", "pos", F.col("cells")[0].cast("int").alias("number"), F.array_join(F.array_sort(F.array_compact(named)), "").alias("answer"))
    return out.where("answer <> ''")


def parse_lists(pages: DataFrame) -> DataFrame:
    """``doc_id, page, pos, number, answer`` of pairs such as ``1: BCE``, ``2. ab`` or ``10 - D``."""
    pattern = F.lit(r"(?mU)(?:^|\||\s)(\d{1,3})\s*[:.\-\s]+\s*([A-Ea-e]{1,5})(?:\s|\||$)")
    return _pairs(pages, pattern)


def parse_simple(pages: DataFrame) -> DataFrame:
    """Pairs such as ``12 ACE`` on pages with a word of answer keys."""
    t = F.lower("text")
    hit = F.lit(False)
    for w in SIMPLE_WORDS:
        hit = hit | F.contains(t, F.lit(w))
    return _pairs(pages.where(hit), F.lit(r"(?U)(\d{1,3})\s+([A-E]{1,5})"))


def _pairs(pages: DataFrame, pattern: Column) -> DataFrame:
    both = F.arrays_zip(F.regexp_extract_all("text", pattern, 1).alias("n"), F.regexp_extract_all("text", pattern, 2).alias("a"))
    return pages.select("doc_id", "page", F.posexplode(both).alias("pos", "p")).select("doc_id", "page", "pos", F.col("p.n").cast("int").alias("number"), answer_clean(F.col("p.a")).alias("answer"))


def merge_keys(keys: DataFrame) -> DataFrame:
    """One answer a (doc_id, number) from ``doc_id, page, pos, number, answer, priority``: later page, then lower priority value, then later position."""
    w = Window.partitionBy("doc_id", "number").orderBy(F.desc("page"), "priority", F.desc("pos"), F.desc("answer"))
    return keys.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def answer_key(pages: DataFrame) -> DataFrame:
    """The document's answer key: on a page tables beat lists."""
    both = parse_tables(pages).withColumn("priority", F.lit(0)).unionByName(parse_lists(pages).withColumn("priority", F.lit(1)))
    return merge_keys(both).select("doc_id", "page", "number", "answer", F.when(F.col("priority") == 0, "table").otherwise("list").alias("src"))


def apply_key(questions: DataFrame, key: DataFrame) -> DataFrame:
    """``correct`` from the key by (doc_id, number), the old answer where the key has none or a blank one; of repeated key rows the greatest answer counts."""
    k = key.groupBy("doc_id", "number").agg(F.max(F.when(F.trim("answer") != "", F.col("answer"))).alias("_new"))
    return questions.join(k, ["doc_id", "number"], "left").withColumn("correct", F.coalesce("_new", "correct")).drop("_new")


def fill_gaps(questions: DataFrame, key: DataFrame) -> DataFrame:
    """Only blank answers are filled; of repeated key rows the greatest answer counts."""
    k = key.groupBy("doc_id", "number").agg(F.max("answer").alias("_new"))
    blank = F.coalesce(F.trim("correct"), F.lit("")) == ""
    return questions.join(k, ["doc_id", "number"], "left").withColumn("correct", F.when(blank, F.coalesce("_new", "correct")).otherwise(F.col("correct"))).drop("_new")


def drop_answers(questions: DataFrame) -> DataFrame:
    return questions.withColumn("correct", F.lit(None).cast("string"))


def alignment(questions: DataFrame, key: DataFrame) -> DataFrame:
    """Share of a document's question numbers that its key has; drift where it is above 0 and below 0.8."""
    q = questions.where("number is not null").select("doc_id", "number").distinct()
    k = key.where("number is not null").select("doc_id", "number").distinct().withColumn("hit", F.lit(1))
    per = q.join(k, ["doc_id", "number"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_questions"), F.avg(F.coalesce("hit", F.lit(0))).alias("score"), F.min("number").alias("q_min"), F.max("number").alias("q_max"))
    keys = k.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_keys"), F.min("number").alias("k_min"), F.max("number").alias("k_max"))
    return per.join(keys, "doc_id", "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0))).withColumn("drift", (F.col("score") > 0) & (F.col("score") < 0.8))


def apply_with_fallback(questions: DataFrame, key: DataFrame, least: float = 0.9) -> DataFrame:
    """``apply_key``; where alignment is at least ``least``, a question without a key takes the key of its own rank.

    Questions are ranked by (page, pos), keys by number.
    """
    ok = alignment(questions, key).where(F.col("score") >= least).select("doc_id", F.lit(True).alias("_ok"))
    q = questions.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")))
    k = key.groupBy("doc_id", "number").agg(F.max("answer").alias("_exact"))
    by_rank = k.select("doc_id", F.col("_exact").alias("_ranked"), F.row_number().over(Window.partitionBy("doc_id").orderBy("number")).alias("_rank"))
    out = q.join(k, ["doc_id", "number"], "left").join(ok, "doc_id", "left").join(by_rank, ["doc_id", "_rank"], "left")
    new = F.coalesce("_exact", F.when(F.col("_ok"), F.col("_ranked")), "correct")
    return out.withColumn("correct", new).drop("_exact", "_ranked", "_ok", "_rank")


def unmatched_keys(key: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers without a question."""
    return key.join(questions.select("doc_id", "number"), ["doc_id", "number"], "left_anti")


def coverage(questions: DataFrame, most: int = 15) -> DataFrame:
    """Answered and missing questions of a document and the first missing numbers."""
    blank = F.coalesce(F.trim("correct"), F.lit("")) == ""
    missing = F.slice(F.array_sort(F.collect_set(F.when(blank, F.col("number")))), 1, most)
    return questions.groupBy("doc_id").agg(F.count_if(~blank).alias("corrected"), F.count_if(blank).alias("missing"), missing.alias("missing_numbers"))


def incomplete_batches(found: DataFrame, batch_size: int, least: float = 0.9) -> DataFrame:
    """Batches (``doc_id, batch, n_found``) that a model answered too little of, for another try."""
    return found.where(F.col("n_found") < F.lit(batch_size * least)).select("doc_id", "batch", (F.col("n_found") / batch_size).alias("share"))
