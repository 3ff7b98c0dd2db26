"""Pages: ``doc_id, page, text``. Filters, neighbours, chains, chunks, samples, page texts of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import page_split, page_status

def _by_page():
    return Window.partitionBy("doc_id").orderBy("page")


def page_range(pages: DataFrame, spec: str) -> DataFrame:
    """``a-b``, ``n``, or anything else for all pages."""
    low, _, high = spec.strip().partition("-")
    if not low.isdigit() or (high and not high.isdigit()):
        return pages
    return pages.where(F.col("page").between(int(low), int(high or low)))


def page_runs(spec: Column) -> Column:
    """``array<struct<low, high>>`` of ``5``, ``4,5,6``, ``4-10``, ``4:10`` or a mix; parts that aren't pages, run backwards or hold numbers beyond a long are left out."""
    parts = F.split(F.regexp_replace(F.translate(spec, ":", "-"), " ", ""), ",")
    ends = F.transform(F.filter(parts, lambda x: F.regexp_like(x, F.lit(r"^\d+(-\d+)?$"))), lambda x: F.transform(F.split(x, "-"), lambda y: y.try_cast("long")))
    runs = F.transform(ends, lambda e: F.struct(e[0].alias("low"), F.element_at(e, -1).alias("high")))
    return F.filter(runs, lambda r: r["low"] <= r["high"])


def page_numbers(spec: Column, last: Column | int = 100_000) -> Column:
    """The sorted distinct pages of ``page_runs`` up to ``last``, beyond which no run is written out."""
    last = F.lit(last).cast("long") if isinstance(last, int) else last.cast("long")
    near = F.filter(page_runs(spec), lambda r: r["low"] <= last)
    return F.sort_array(F.array_distinct(F.flatten(F.transform(near, lambda r: F.sequence(r["low"], F.least(r["high"], last)).cast("array<int>")))))


def page_list(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Pages listed by ``specs`` (``doc_id, spec``), however long the runs are: runs end at the document's last page before they are written out."""
    ends = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
    wanted = specs.select("doc_id", "spec").join(ends, "doc_id").select("doc_id", F.explode(page_numbers(F.col("spec"), F.col("_last"))).alias("page")).distinct()
    return pages.join(wanted, ["doc_id", "page"], "left_semi")


def skip_pages(pages: DataFrame, guidance: DataFrame) -> DataFrame:
    """Without the pages that ``guidance`` (``doc_id, guidance``) says to skip or ignore; whole numbers are compared."""
    found = F.regexp_extract_all(F.lower("guidance"), F.lit(r"(?:skip|ignore)\s+page\s+(\d+)"), 1)
    gone = guidance.select("doc_id", F.explode(found).alias("page")).withColumn("page", F.col("page").cast("int")).distinct()
    return pages.join(gone, ["doc_id", "page"], "left_anti")


def has_text_layer(pages: DataFrame, least: float = 50) -> DataFrame:
    """Whether the first 3 pages of a document have more than ``least`` trimmed characters on average."""
    first = pages.where("page <= 3").groupBy("doc_id").agg(F.avg(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("mean_chars"))
    return first.withColumn("has_text", F.col("mean_chars") > least)


def with_status(pages: DataFrame) -> DataFrame:
    return pages.withColumn("status", page_status(F.col("text")))


def page_pairs(pages: DataFrame) -> DataFrame:
    """Each page with the next one of its document."""
    return pages.select("doc_id", "page", "text", F.lead("page").over(_by_page()).alias("next_page"), F.lead("text").over(_by_page()).alias("next_text")).where("next_page is not null")


def split_pages(pages: DataFrame, since_question: bool = False) -> DataFrame:
    """Pairs (page, next page) where the page ends in a question without its options."""
    flagged = pages.select("doc_id", "page", page_split(F.col("text"), since_question).alias("split"), F.lead("page").over(_by_page()).alias("next_page"))
    return flagged.where(F.col("split") & F.col("next_page").isNotNull()).select("doc_id", "page", "next_page")


def confident_splits(guesses: DataFrame, least: int = 80) -> DataFrame:
    """Guesses (``page_from, page_to, has_split, confidence``) of a split that are sure enough."""
    return guesses.where(F.col("has_split") & (F.col("confidence") >= least))


def flagged_pages(guesses: DataFrame) -> DataFrame:
    """``doc_id, page`` of all pages that stand on either side of a guessed split (``doc_id, page_from, page_to, has_split``), whatever its confidence."""
    return guesses.where("has_split").select("doc_id", F.explode(F.array("page_from", "page_to")).alias("page")).distinct()


def with_page_text(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with ``page_text``, the text of their page; empty where there is none. Of pages that repeat a number the first text by order counts."""
    texts = pages.groupBy("doc_id", "page").agg(F.min("text").alias("page_text"))
    return rows.join(texts, ["doc_id", "page"], "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))


def merge_chains(pages: DataFrame, splits: DataFrame, totals: Observation | None = None) -> DataFrame:
    """Pages joined to the page before where ``splits`` (``doc_id, page, next_page``) says so; a whole chain is one page, which keeps its first number.

    Splits may repeat. ``totals`` gets ``pages, chains, merged`` (pages that went into one before) with the first action.
    """
    marked = pages.join(splits.select("doc_id", F.col("next_page").alias("page")).distinct().withColumn("joined", F.lit(True)), ["doc_id", "page"], "left")
    island = F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(_by_page())
    grouped = marked.withColumn("island", island).groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    out = grouped.select("doc_id", F.col("pages")[0]["page"].alias("page"), F.size("pages").alias("n_pages"), F.array_join(F.col("pages.text"), "\n").alias("text"))
    n = F.col("n_pages")
    return out.observe(totals, F.sum(n).alias("pages"), F.count_if(n > 1).alias("chains"), F.sum(n - 1).alias("merged")) if totals is not None else out


def page_window(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with each existing page among the one before, their own and the one after; an equi-join on three keys a row."""
    near = rows.withColumn("near_page", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)))
    return near.join(pages.select("doc_id", F.col("page").alias("near_page"), F.col("text").alias("near_text")), ["doc_id", "near_page"])


def chunks(pages: DataFrame, size: int) -> DataFrame:
    """``chunk`` from 0, of ``size`` pages (or rows) each, with the chunk's first and last page."""
    numbered = pages.withColumn("chunk", F.floor((F.row_number().over(_by_page()) - 1) / size).cast("int"))
    w = Window.partitionBy("doc_id", "chunk")
    return numbered.withColumn("chunk_first", F.min("page").over(w)).withColumn("chunk_last", F.max("page").over(w))


def stamp_pages(rows: DataFrame) -> DataFrame:
    """Rows with ``chunk_first, chunk_last``: a page that is null, 0 or outside becomes the chunk's first."""
    return rows.withColumn("page", F.when(F.col("page").between(F.col("chunk_first"), F.col("chunk_last")), F.col("page")).otherwise(F.col("chunk_first")))


def concat_pages(pages: DataFrame, head: str | None = "=== PAGE %d ===", between: str = "\n\n") -> DataFrame:
    """One text a document, pages in order under ``head``; ``head=None`` and the page-break mark for plain text."""
    block = (lambda x: F.concat(F.format_string(head + "\n", x["page"]), x["text"])) if head else (lambda x: x["text"])
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n_pages"), F.array_join(F.transform("p", block), between).alias("text"))


PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"


def analysis_sample(pages: DataFrame, most: int = 15_000) -> DataFrame:
    """Text for analysis: first 3 pages, the last, and of long documents every 10th from 5 (500 characters)."""
    w = Window.partitionBy("doc_id")
    p = pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(_by_page()).alias("rn"), F.max("page").over(w).alias("total"))
    head = F.when(F.col("rn") <= 3, F.struct(F.lit(0).alias("part"), "page", F.format_string("=== PAGE %d ===\n%s", "page", "text").alias("t")))
    last = F.when((F.col("total") > 3) & (F.col("page") == F.col("total")), F.struct(F.lit(1).alias("part"), "page", F.format_string("=== PAGE %d (LAST) ===\n%s", "page", "text").alias("t")))
    tenth = (F.col("total") > 10) & (F.col("page") >= 5) & (F.col("page") < F.col("total")) & (F.pmod(F.col("page") - 5, F.lit(10)) == 0)
    some = F.when(tenth, F.struct(F.lit(2).alias("part"), "page", F.format_string("=== PAGE %d (SAMPLE) ===\n%s...", F.col("page"), F.substring("text", 1, 500)).alias("t")))
    blocks = p.select("doc_id", F.explode(F.array_compact(F.array(head, last, some))).alias("b"))
    whole = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["t"]), "\n\n").alias("text"))
    return whole.withColumn("text", F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("\n\n[... TRUNCATED ...]"))).otherwise(F.col("text")))


def sample_pages(pages: DataFrame) -> DataFrame:
    """First two and last page, all of up to three; ``answers`` marks the last page of several."""
    w = Window.partitionBy("doc_id")
    p = pages.withColumn("rn", F.row_number().over(_by_page())).withColumn("n", F.count(F.lit(1)).over(w))
    return p.where("n <= 3 or rn <= 2 or rn = n").select("doc_id", "page", "text", ((F.col("rn") == F.col("n")) & (F.col("n") > 1)).alias("answers"))
