"""Run costs, step badges, progress, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import week_key


def by_model(costs: DataFrame) -> DataFrame:
    """Cost, calls and tokens of each model. ``costs``: user_id, project, step, model, prompt_tokens, completion_tokens, cost, ts."""
    return costs.groupBy("model").agg(*_sums())


def by_step(costs: DataFrame) -> DataFrame:
    return costs.groupBy("step").agg(*_sums())


def _sums() -> list:
    return [F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")]


def summary(costs: DataFrame) -> DataFrame:
    """Per model, per step and in all, in one pass; ``level`` says which."""
    g = costs.groupingSets([["model"], ["step"], []], "model", "step").agg(*_sums(), F.grouping_id().alias("gid"))
    return g.withColumn("level", F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "model").otherwise("step")).drop("gid")


def weekly(costs: DataFrame, last: int = 6) -> DataFrame:
    """Each project's cost in the week of its last call; cost and project names of the ``last`` weeks, newest first."""
    per = costs.groupBy("project").agg(F.sum("cost").alias("cost"), F.max("ts").alias("ts"))
    return per.groupBy(week_key(F.col("ts")).alias("week")).agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_set("project")).alias("projects")).orderBy(F.desc("week")).limit(last)


def users(people: DataFrame, projects: DataFrame, costs: DataFrame) -> DataFrame:
    """Projects and cost (4 digits) of every user, and of all (null user)."""
    per_project = costs.groupBy("user_id").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("calls"))
    own = projects.groupBy("user_id").agg(F.count(F.lit(1)).alias("projects"))
    per = people.select("user_id").distinct().join(own, "user_id", "left").join(per_project, "user_id", "left")
    return per.rollup("user_id").agg(F.coalesce(F.sum("projects"), F.lit(0)).alias("projects"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))


#: Price lists a million tokens (model, prompt, completion).
PRICES = (
    ("qwen/qwen-2-vl-72b-instruct", 0.4, 0.4),
    ("qwen/qwen-2-vl-7b-instruct", 0.1, 0.1),
    ("qwen/qwen-2.5-vl-7b-instruct:free", 0.0, 0.0),
    ("nvidia/nemotron-3-nano-30b-a3b:free", 0.0, 0.0),
    ("google/gemini-2.0-flash-exp:free", 0.0, 0.0),
    ("google/gemma-3-27b-it:free", 0.0, 0.0),
    ("google/gemini-2.0-flash-lite-001", 0.1, 0.3),
    ("deepseek/deepseek-r1-distill-llama-70b", 0.23, 0.69),
)


def estimate(calls: DataFrame, prices: DataFrame, default: tuple[float, float] = (0.1, 0.1)) -> DataFrame:
    """``cost`` as reported where above 0, else from tokens and the price list (``model, prompt, completion``), unknown models at the default.

    Of price rows that repeat a model the dearest counts.
    """
    p = prices.groupBy("model").agg(F.max(F.struct("prompt", "completion")).alias("_p")).select("model", F.col("_p.prompt").alias("_p"), F.col("_p.completion").alias("_c"))
    rate = F.col("prompt_tokens") / 1e6 * F.coalesce("_p", F.lit(default[0])) + F.col("completion_tokens") / 1e6 * F.coalesce("_c", F.lit(default[1]))
    return calls.join(p, "model", "left").withColumn("cost", F.when(F.col("cost") > 0, F.col("cost")).otherwise(rate)).drop("_p", "_c")


def badges(pages: DataFrame) -> DataFrame:
    """Of each project: pages ok and failed, and success, warning (some failed) or error (none ok). ``pages``: project, ok."""
    per = pages.groupBy("project").agg(F.count_if("ok").alias("pages_ok"), F.count_if(~F.col("ok")).alias("pages_failed"))
    return per.withColumn("badge", F.when(F.col("pages_ok") == 0, "error").when(F.col("pages_failed") > 0, "warning").otherwise("success"))


def question_badges(pages: DataFrame) -> DataFrame:
    """Of each project: questions and pages without any; error (no question), warning (some page empty) or success. ``pages``: project, n_questions."""
    per = pages.groupBy("project").agg(F.sum("n_questions").alias("qcms"), F.count_if(F.col("n_questions") == 0).alias("empty_pages"))
    return per.withColumn("badge", F.when(F.col("qcms") == 0, "error").when(F.col("empty_pages") > 0, "warning").otherwise("success"))


def merged_badges(projects: DataFrame, merged: DataFrame) -> DataFrame:
    """Of each of ``projects`` (project): merged questions, and error where there are none. ``merged``: a row a question, with project."""
    per = merged.groupBy("project").agg(F.count(F.lit(1)).alias("merged_qcms"))
    out = projects.select("project").distinct().join(per, "project", "left").withColumn("merged_qcms", F.coalesce("merged_qcms", F.lit(0)))
    return out.withColumn("badge", F.when(F.col("merged_qcms") == 0, "error").otherwise("success"))


def manifest(pages: DataFrame) -> DataFrame:
    """Totals of a document's page calls. ``pages``: doc_id, page, cost, duration, tokens; repeated calls of a page all cost, the page counts once."""
    return pages.groupBy("doc_id").agg(F.countDistinct("page").alias("total_pages"), F.sum("cost").alias("total_cost"), F.sum("duration").alias("total_duration"), F.sum("tokens").alias("total_tokens"))


def sort_users(users: DataFrame, measure: str = "cost", descending: bool = True) -> DataFrame:
    """Users by a measure, missing ones as 0, ties by user."""
    value = F.coalesce(F.col(measure), F.lit(0))
    return users.orderBy(value.desc() if descending else value.asc(), "user_id")


def progress(steps: DataFrame) -> DataFrame:
    """Highest completed step of each project. ``steps``: project, step_ord."""
    return steps.groupBy("project").agg(F.max("step_ord").alias("current_step"))


def recent(projects: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` projects used last, ties by name."""
    return projects.groupBy("project").agg(F.max("ts").alias("updated_at")).orderBy(F.desc("updated_at"), "project").limit(k)


def run_history(runs: DataFrame) -> DataFrame:
    """Runs of each project newest first, the newest marked current. ``runs``: project, run_id."""
    w = Window.partitionBy("project").orderBy(F.desc("run_id"))
    return runs.select("project", "run_id").distinct().withColumn("pos", F.row_number().over(w)).withColumn("current", F.col("pos") == 1)


def latest_stage(rows: DataFrame) -> DataFrame:
    """Rows of each document's latest stage. ``rows``: doc_id, stage_rank and more."""
    top = rows.groupBy("doc_id").agg(F.max("stage_rank").alias("stage_rank"))
    return rows.join(top, ["doc_id", "stage_rank"])


def batch_report(rows: DataFrame) -> DataFrame:
    """Documents and rows by status; a failed document doesn't touch the others. ``rows``: doc_id, status."""
    return rows.groupBy("status").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("n_rows"))


def cache_stats(hits: DataFrame, misses: DataFrame) -> DataFrame:
    """``hits, misses`` of a ``cache_split``."""
    both = hits.select(F.lit(1).alias("hit")).unionByName(misses.select(F.lit(0).alias("hit")))
    return both.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count_if(F.col("hit") == 0).alias("misses"))


def cache_split(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with ``cached``, misses) of items by the digest of their content. ``items``: id, content; ``cache``: digest, value."""
    cache = cache.groupBy("digest").agg(F.max("value").alias("value"))
    keyed = items.withColumn("digest", F.md5(F.col("content").cast("binary")))
    return keyed.join(cache.withColumnRenamed("value", "cached"), "digest"), keyed.join(cache, "digest", "left_anti")
