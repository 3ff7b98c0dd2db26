"""Scans and sinks: page texts, question JSON, reference banks, tabular banks, stage outputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "doc_id string, page int, pos int, number int, text string, propositions map<string,string>, year string, subcategory string, clinical_case_hint string, correction string, metadata_detected struct<module:string,source:string,year:string>"


def scan_pages(spark: SparkSession, path: str, page: str = r"(?i)page_?(\d+)[^/]*$", doc: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """``doc_id, page, text`` of text files, by default ``<doc>/page_N.txt``; page 0 where the path has no number.

    ``page`` and ``doc`` are patterns over the path whose first group is the page number and the document.
    """
    name = F.col("_metadata.file_path")
    number = F.coalesce(F.regexp_extract(name, page, 1).try_cast("int"), F.lit(0))
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return files.select(F.url_decode(F.regexp_extract(name, doc, 1)).alias("doc_id"), number.alias("page"), F.col("value").alias("text"))


def scan_questions(spark: SparkSession, path: str, schema: str = QUESTION, glob: str = "*.json") -> DataFrame:
    """Question JSON files (a list or one object each), all of a stage; what can't be read is in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter=glob)


#: Where an object keeps its bank.
BANK_KEYS = ("qcms", "questions", "data", "items")


def load_reference(spark: SparkSession, path: str) -> DataFrame:
    """``ref_index, ref`` (variant), ``file, error`` of reference banks: a list, or the first list among ``qcms, questions, data, items``, else the object's values.

    A file that isn't JSON, or holds neither a list nor an object, gives one row with its ``error`` and nulls; one without a byte gives none.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    kind = lambda c: F.substring_index(F.schema_of_variant(c), "<", 1)
    inner = [F.try_variant_get("v", f"$.{k}", "variant") for k in BANK_KEYS]
    lists = [F.when(kind(x) == "ARRAY", x) for x in inner]
    whole = F.when(kind(F.col("v")) == "ARRAY", F.col("v")).when(kind(F.col("v")) == "OBJECT", F.coalesce(*lists, F.col("v")))
    error = F.when(F.col("v").isNull(), "not JSON").when(~kind(F.col("v")).isin("ARRAY", "OBJECT"), "neither a list nor an object")
    banks = files.select("file", whole.alias("l"), error.alias("error"))
    rows = banks.where("l is not null").lateralJoin(spark.tvf.variant_explode(F.col("l").outer()).select(F.col("pos").cast("int").alias("ref_index"), F.col("value").alias("ref")))
    bad = banks.where("l is null").select(F.lit(None).cast("int").alias("ref_index"), F.lit(None).cast("variant").alias("ref"), "file", "error")
    return rows.select("ref_index", "ref", "file", "error").union(bad)


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited bank: all columns as trimmed strings, unnamed ones ``col_i``, rows without any value dropped."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    named = raw.toDF(*[f"col_{i}" if not c or c.startswith("_c") else c.strip() for i, c in enumerate(raw.columns)])
    return named.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in named.columns]).replace("", None).dropna("all")


def load_modules(spark: SparkSession, path: str, domains: tuple[str, ...] = ("medecine", "chirurgie", "biologie")) -> DataFrame:
    """The module dimension of a JSON file, domain -> module -> {focus, keywords, differentiation} or domain -> [module]."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    d = doc.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("domain"), F.col("value").alias("modules"))).where(F.col("domain").isin(*domains))
    m = d.lateralJoin(spark.tvf.variant_explode(F.col("modules").outer()).select("pos", "key", "value"))
    field = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind)
    return m.select(
        "domain", F.coalesce("key", F.try_variant_get("value", "$", "string")).alias("module"), F.col("pos").cast("int").alias("module_ord"), field("focus", "string").alias("focus"),
        F.coalesce(field("keywords", "array<string>"), F.array().cast("array<string>")).alias("keywords"), field("differentiation", "string").alias("differentiation"),
    )


def save_stage(rows: DataFrame, path: str, step: str, form: str = "parquet", by: tuple[str, ...] = ("status",)) -> None:
    """One stage's rows under ``path/step=...``, split by ``by``; earlier steps stay."""
    rows.write.mode("overwrite").partitionBy(*by).format(form).save(f"{path}/step={step}")


def save_matches(matches: DataFrame, path: str, width: float = 0.05) -> None:
    """Matches as a table that exports read by ranges: folders by bands of similarity, ``width`` wide, sorted by it inside.

    A band is written by several tasks where it is large, so that no task sorts more than its part of the range.
    """
    rows = matches.withColumn("band", F.floor(F.col("similarity") / width).cast("int"))
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "band", "similarity", "qcm_id").sortWithinPartitions("band", "similarity").write.mode("overwrite").partitionBy("band").parquet(path)


def load_matches(spark: SparkSession, path: str, low: float = 0.0, high: float = 1.0, width: float = 0.05) -> DataFrame:
    """Saved matches with ``low`` <= similarity <= ``high``; other bands' folders aren't read, nor are row groups outside the range. ``width`` as saved."""
    rows = spark.read.parquet(path)
    near = F.col("band").between(math.floor(low / width), math.floor(high / width))
    return rows.where(near & F.col("similarity").between(low, high)).drop("band")


def load_stage(spark: SparkSession, path: str, step: str, form: str = "parquet", status: str | None = None) -> DataFrame:
    df = spark.read.format(form).load(f"{path}/step={step}")
    return df.where(F.col("status") == status) if status else df


#: Order of the exported columns.
PREFERRED = ("Num", "Cas", "Text", "A", "B", "C", "D", "E", "Correct", "Exp", "categoryName", "tagSuggere", "subcategoryName", "Year", "Tag", "Type")


def export_columns(rows: DataFrame, preferred: tuple[str, ...] = PREFERRED) -> DataFrame:
    """Columns that hold a value somewhere: preferred ones in their order, then others by name; lists as distinct joined text."""
    kinds = dict(rows.dtypes)
    used = {c: (F.size(F.col(c)) > 0) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string") != "", F.lit(False)) for c in rows.columns}
    seen = rows.agg(*[F.max(u).alias(c) for c, u in used.items()]).first()  # one row
    names = [c for c in preferred if c in used and seen[c]] + sorted(c for c in used if c not in preferred and seen[c])
    return rows.select(*[(F.array_join(F.array_distinct(F.col(c)), ", ") if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in names])


def save_run(rows: DataFrame, path: str, step: str, run_id: str) -> None:
    """A snapshot of a step's rows; earlier runs of the step stay."""
    rows.write.mode("overwrite").parquet(f"{path}/step={step}/run_id={run_id}")


def load_runs(spark: SparkSession, path: str, step: str, run_id: str | None = None) -> DataFrame:
    """All snapshots of a step with their ``run_id``; one of them by its id, or the newest for ``current``."""
    runs = spark.read.option("basePath", f"{path}/step={step}").parquet(f"{path}/step={step}").withColumn("run_id", F.col("run_id").cast("string"))
    if run_id is None:
        return runs
    newest = runs.agg(F.max("run_id")).first()[0] if run_id == "current" else run_id
    return runs.where(F.col("run_id") == newest)


def audit(rows: DataFrame, action: str) -> DataFrame:
    """An audit trail: each row with the action and when it was done."""
    return rows.withColumn("action", F.lit(action)).withColumn("at", F.current_timestamp())


def audit_report(*trails: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each action: how many entries, in how many documents, and when the first and last were made."""
    every = trails[0].select(key, "action", "at")
    for t in trails[1:]:
        every = every.unionByName(t.select(key, "action", "at"))
    return every.groupBy("action").agg(F.count(F.lit(1)).alias("total"), F.countDistinct(key).alias("documents"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
