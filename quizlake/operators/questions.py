"""Questions keyed by (doc_id, page, number): cleaning, upsert, repair of what page breaks split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import safe_int

KEY = ["doc_id", "page", "number"]


def sanitize(rows: DataFrame) -> DataFrame:
    """``page`` and ``number`` as integers (0 where they are none); ``no_number`` marks questions without one."""
    return rows.withColumns({"page": safe_int(F.col("page")), "number": safe_int(F.col("number"))}).withColumn("no_number", F.col("number") == 0)


def validate(rows: DataFrame, first_page: int = 1) -> DataFrame:
    """Rows with a text and propositions; the page defaults to ``first_page``."""
    return rows.where(F.col("text").isNotNull() & F.col("propositions").isNotNull()).withColumn("page", F.coalesce("page", F.lit(first_page)))


def in_order(rows: DataFrame) -> DataFrame:
    """Questions by document, page and number."""
    return rows.orderBy(*KEY)


def last_by_key(rows: DataFrame, key: list[str], *values: str) -> DataFrame:
    """One row a key: the greatest by ``values``, so that a repeated key never doubles what is joined to it."""
    best = rows.groupBy(*key).agg(F.max(F.struct(*values)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{v}").alias(v) for v in values])


def _fits(rows: DataFrame, key: list[str]) -> Column:
    """Whether a row has a key of its own: no part is null, and its number isn't 0."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"`{k}`").isNotNull()
    return out & (F.col("number") != 0) if "number" in key else out


def upsert(old: DataFrame, new: DataFrame, key: list[str] = KEY, order: list | None = None) -> DataFrame:
    """Old rows with new ones put in by key; nothing is deleted. Of equal keys in one table the first by ``order`` wins, by default
    the one with the smallest digest of the whole row.

    Rows whose ``number`` is 0 or null, or whose key has another null, have no key of their own and are all kept.
    Columns may have any name.
    """
    if not order:
        order = [F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in old.columns])))]
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    gen, rn = "_gen", "_rn"
    while gen in names or rn in names:
        gen, rn = "_" + gen, "_" + rn
    both = old.withColumn(gen, F.lit(0)).unionByName(new.withColumn(gen, F.lit(1)), allowMissingColumns=True)
    own = _fits(both, key)
    alone = both.where(~own)  # apart from the window: they would all be one key
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(gen), *order))
    return both.where(own).withColumn(rn, first).where(F.col(rn) == 1).drop(rn).unionByName(alone).drop(gen)


def upsert_counts(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """How many new keys replace an old row and how many are added; rows without a key of their own count as added."""
    own = new.where(_fits(new, key)).select(*key).distinct()
    hit = own.join(old.select(*key).distinct().withColumn("_old", F.lit(1)), key, "left").select("_old")
    hit = hit.unionByName(new.where(~_fits(new, key)).select(F.lit(None).cast("int").alias("_old")))
    return hit.agg(F.count("_old").alias("updated"), F.count_if(F.col("_old").isNull()).alias("added"))


def quarantine(bucket: DataFrame, incomplete: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The bucket plus the rows whose key it lacks; nulls in a key are equal, so that a second run adds nothing again."""
    have = bucket.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & incomplete[k].eqNullSafe(have[f"_k{i}"])
    return bucket.unionByName(incomplete.join(have, same, "left_anti"), allowMissingColumns=True)


def replace_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of ``new`` take the place of the same pages of ``old``."""
    return old.join(new.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").unionByName(new, allowMissingColumns=True)


def option_threshold(rows: DataFrame) -> DataFrame:
    """Of each document: the smallest number of options that occurs at least twice, else the smallest; 4 without questions.

    ``rows``: ``doc_id, n_options``.
    """
    sizes = rows.groupBy("doc_id", "n_options").agg(F.count(F.lit(1)).alias("n"))
    least = F.coalesce(F.min(F.when(F.col("n") >= 2, F.col("n_options"))), F.min("n_options"), F.lit(4))
    return sizes.groupBy("doc_id").agg(least.cast("int").alias("threshold"))


def incomplete(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Questions with fewer options than their document's threshold."""
    return rows.join(thresholds, "doc_id").where(F.col("n_options") < F.col("threshold"))


def fix_incomplete(rows: DataFrame, fixed: DataFrame, key: list[str] = KEY) -> DataFrame:
    """A fixed row's options replace the original's where they are more."""
    f = fixed.groupBy(*key).agg(F.max_by("propositions", F.struct(F.size("propositions"), F.to_json("propositions"))).alias("_p"))  # of repeats the one with most options
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    better = F.col("_p").isNotNull() & (size("_p") > size("propositions"))
    return rows.join(f, key, "left").withColumn("fixed", better).withColumn("propositions", F.when(better, F.col("_p")).otherwise(F.col("propositions"))).drop("_p")


#: How an option line begins.
OPTION_LINES = (r"^[\(\[]?([a-eA-E])[\)\]]?\s*[-:]\s*(.+)", r"^[\(\[]?([a-eA-E])[\)\]]\s+(.+)")


def orphan_options(pages: DataFrame, first: int = 15) -> DataFrame:
    """Pages that begin with options of a question on the page before: ``doc_id, page, orphans map<letter, text>``.

    Looks at the first lines up to a question number, takes options longer than 5 characters, the last of a
    letter, and needs two letters.
    """
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lines = F.transform(F.slice(F.split(strip(F.col("text")), "\n"), 1, first), strip)
    stop = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(r"^\d+[-\.\):]"))), True)
    lines = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)

    def option(x):
        hits = [F.struct(F.upper(F.regexp_extract(x, "(?U)" + p, 1)).alias("k"), strip(F.regexp_extract(x, "(?U)" + p, 2)).alias("v")) for p in OPTION_LINES]
        return F.when(hits[0]["k"] != "", hits[0]).otherwise(hits[1])

    found = pages.select("doc_id", "page", F.posexplode(F.filter(F.transform(lines, option), lambda o: (o["k"] != "") & (F.length(o["v"]) > 5))).alias("pos", "o"))
    last = found.groupBy("doc_id", "page", F.col("o.k").alias("k")).agg(F.max_by("o.v", "pos").alias("v"))
    return last.groupBy("doc_id", "page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("orphans")).where(F.size("orphans") >= 2)


def merge_splits(questions: DataFrame, pages: DataFrame, least: int = 3, totals: Observation | None = None) -> DataFrame:
    """Options that begin a page go to the last question of the page before, where it has fewer than ``least``.

    ``questions``: ``doc_id, page, pos, number, text, propositions``. A question that gets options has
    ``merged_from`` set; the first row of the page they come from goes when it has no text or number. A page
    that only holds such a row counts as empty. Both are decided on the input, before anything is changed.
    ``totals`` gets ``questions, merged, dropped`` with the first action.
    """
    follow = pages.select("doc_id", "page", F.lead("page").over(Window.partitionBy("doc_id").orderBy("page")).alias("next_page"))
    by_page = Window.partitionBy("doc_id", "page")
    q = questions.withColumn("_last", F.row_number().over(by_page.orderBy(F.desc("pos"))) == 1).withColumn("_first", F.row_number().over(by_page.orderBy("pos")) == 1)
    q = q.withColumn("_bare", F.coalesce(F.col("text") == "", F.lit(True)) | F.coalesce(F.col("number") == 0, F.lit(True)))
    orphans = orphan_options(pages).select("doc_id", F.col("page").alias("next_page"), "orphans")
    ends = q.where(F.col("_last") & (F.coalesce(F.size("propositions"), F.lit(0)) < least)).select("doc_id", "page").distinct()
    merges = ends.join(follow, ["doc_id", "page"]).join(orphans, ["doc_id", "next_page"])
    q = q.join(merges.select("doc_id", "page", "next_page", "orphans"), ["doc_id", "page"], "left")
    q = q.join(merges.select("doc_id", F.col("next_page").alias("page"), F.lit(True).alias("_taken")), ["doc_id", "page"], "left")
    gone = F.coalesce("_taken", F.lit(False)) & F.col("_first") & F.col("_bare")
    here = F.col("_last") & F.col("orphans").isNotNull()
    q = q.observe(totals, F.count_if(~gone).alias("questions"), F.count_if(~gone & here).alias("merged"), F.count_if(gone).alias("dropped")) if totals is not None else q
    q = q.where(~gone)
    old = F.coalesce("propositions", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    new = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("orphans", k)), F.col("orphans"))
    return q.withColumn("propositions", F.when(here, new).otherwise(F.col("propositions"))).withColumn("merged_from", F.when(here, F.col("next_page"))).select(*questions.columns, "merged_from")
