"""Registered queries of the operators over the given tables, and the same in SQL for DuckDB.

Tables stand in for question data: documents are pages (a source's documents among a thousand ids are an exam, rows in
id order its pages), lines of an order are options or questions, events are model calls, conversations are questions with cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, completion, costs, match, metadata, pages, questions
from ..sources import banks, io, scratch
from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- tables in their roles, with the same in SQL

def exam() -> Column:
    """An exam has at most a thousand pages, so exams grow in number with the documents, not in size."""
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 1000))


_EXAM = "(coalesce({0}source, '') || '/' || ({0}doc_id // 1000))"


def as_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(exam().alias("exam"), "doc_id", "text")
    return docs.select(F.col("exam").alias("doc_id"), F.row_number().over(Window.partitionBy("exam").orderBy("doc_id")).alias("page"), "text")


PAGES = f"pages_ as (select {_EXAM.format('')} doc_id, cast(row_number() over (partition by {_EXAM.format('')} order by documents.doc_id) as integer) page, text from documents)"


def as_questions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(exam().alias("doc_id"), F.lit(1).alias("page"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("number"), F.when(F.col("doc_id") % 7 == 0, "E").when(F.col("doc_id") % 7 == 1, " ").alias("correct"))


QUESTIONS = f"questions_ as (select {_EXAM.format('documents.')} doc_id, documents.doc_id pos, documents.doc_id number, case documents.doc_id % 7 when 0 then 'E' when 1 then ' ' end correct from documents)"


def as_key(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "labels").groupBy(F.col("doc_id").alias("number")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").select(exam().alias("doc_id"), F.col("doc_id").alias("number"))
    return marks.join(docs, "number", "left").select(F.coalesce("doc_id", F.lit("none")).alias("doc_id"), "number", F.when(F.col("toxic") == 1, "BD").when(F.col("quality") == 1, "A").otherwise("").alias("answer"))


KEY = f"key_ as (select coalesce({_EXAM.format('d.')}, 'none') doc_id, l.doc_id number, case when toxic = 1 then 'BD' when quality = 1 then 'A' else '' end answer from (select doc_id, max(quality) quality, max(toxic) toxic from labels group by doc_id) l left join documents d on d.doc_id = l.doc_id)"


def as_costs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id"), F.concat(F.lit("p"), F.col("user_id") % 50).alias("project"), F.col("event_type").alias("step"), F.concat(F.lit("m"), F.col("user_id") % 7).alias("model"), F.length("props").cast("long").alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"), F.round("value", 2).cast("decimal(18,2)").alias("cost"), "ts")


COSTS = "costs_ as (select user_id, 'p' || (user_id % 50) project, event_type step, 'm' || (user_id % 7) model, cast(length(props) as bigint) prompt_tokens, event_id % 100 completion_tokens, cast(round(value, 2) as decimal(18,2)) cost, ts from events)"

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# ---- scans: files that the query writes from the tables and reads back

@query("select 'exam' || (item_id % 5) doc_id, cast(item_id as integer) page, md5(text) md5 from benchmark")
def page_scan(spark, d):
    path = scratch.new_path(spark, "pages")
    b = table(spark, d, "benchmark").select("text", F.concat(F.lit("exam"), F.col("item_id") % 5).alias("exam"), F.concat(F.lit("page_"), F.col("item_id")).alias("file"))
    b.write.partitionBy("exam", "file").text(path)
    return io.scan_pages(spark, path, page=r"file=page_(\d+)/", doc=r"exam=([^/]+)/").select("doc_id", "page", F.md5(F.regexp_replace("text", r"\n$", "")).alias("md5"))


@query("select c_custkey number, c_mktsegment \"text\", cast(2 + c_custkey % 3 as integer) n from customer")
def qcm_scan(spark, d):
    path = scratch.new_path(spark, "questions")
    q = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_custkey").alias("number"), F.lit(1).alias("page"), F.col("c_mktsegment").alias("text"), F.map_from_arrays(F.slice(F.array(*[F.lit(x) for x in "ABCD"]), F.lit(1), (2 + F.col("c_custkey") % 3).cast("int")), F.slice(F.array(F.col("c_mktsegment"), *[F.lit(x) for x in ("b", "c", "d")]), F.lit(1), (2 + F.col("c_custkey") % 3).cast("int"))).alias("propositions")).alias("q"))
    q.groupBy("nation").agg(F.to_json(F.collect_list("q")).alias("value")).write.partitionBy("nation").text(path)
    got = io.scan_questions(spark, path, glob="*.txt").where("_corrupt_record is null")
    return got.select(F.col("number").cast("long").alias("number"), "text", F.size("propositions").alias("n"))


@query("select cast(row_number() over (partition by item_id // 25 order by item_id) - 1 as integer) ref_index, item_id num, md5(text) md5 from benchmark")
def ref_load(spark, d):
    """Banks of 25 items, a file each."""
    path = scratch.new_path(spark, "bank")
    rows = table(spark, d, "benchmark").groupBy(F.floor(F.col("item_id") / 25).alias("bank"))
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: F.struct(x["item_id"].alias("Num"), x["text"].alias("Text"))).alias("questions"))
    rows.select("bank", F.to_json(F.struct(F.lit("bank").alias("name"), "questions")).alias("value")).write.partitionBy("bank").text(path)
    return io.load_reference(spark, path).select("ref_index", F.try_variant_get("ref", "$.Num", "long").alias("num"), F.md5(F.try_variant_get("ref", "$.Text", "string")).alias("md5"))


@query("select cast(row_number() over (partition by c_nationkey order by c_custkey) - 1 as integer) ref_index, c_custkey num, md5(c_name || ', \"[' || c_mktsegment || ']}') md5 from customer")
def ref_ranges(spark, d):
    """A bank a nation, each one JSON text in one file, read by ranges of 2000 bytes."""
    path = scratch.new_path(spark, "banks")
    text = F.concat("c_name", F.lit(', "['), "c_mktsegment", F.lit("]}"))
    item = F.to_json(F.struct(F.col("c_custkey").alias("Num"), text.alias("Text")))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("x")))).alias("items"))  # a nation has as many as fit its file
    whole = F.concat(F.lit('{"name": "bank", "questions": ['), F.array_join(F.col("items.x"), ", "), F.lit("]}"))
    rows.select(F.col("c_nationkey").alias("bank"), whole.alias("value")).write.partitionBy("bank").text(path)
    got = banks.scan_bank(spark, path, 2000).where("error is null")
    return got.select("ref_index", F.try_variant_get("ref", "$.Num", "long").alias("num"), F.md5(F.try_variant_get("ref", "$.Text", "string")).alias("md5"))


@query("select doc_id, row_number() over (order by doc_id) - 1 ref_index from documents")
def ref_index(spark, d):
    return scratch.with_index(table(spark, d, "documents").select("doc_id"), ["doc_id"], "ref_index")


@query("select cast(c_custkey as varchar) num, nullif(trim(c_mktsegment), '') \"text\" from customer")
def ref_tabular(spark, d):
    path = scratch.new_path(spark, "bank-table")
    table(spark, d, "customer").select(F.col("c_custkey").alias("num"), F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")).alias("text")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return io.scan_table(spark, path)


# ---- scalar functions

@query("select doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) norm from documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query(r"select doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(replace(text, chr(0), ''), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)), '^\n+|\n+$', '', 'g') clean from documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("""with n as (select doc_id, [trim(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', ' ', 'g')) for x in [text, lang, source]] p from documents)
          select doc_id, array_to_string([x for x in p if x <> ''], ' ') matched from n""")
def match_text(spark, d):
    return table(spark, d, "documents").select("doc_id", match.match_text(F.col("text"), F.col("lang"), F.col("source")).alias("matched"))


@query("""with n as (select distinct p_name t from part), p as (select a.t a, b.t b, string_split(a.t, '') ca, string_split(b.t, '') cb from n a, n b where a.t <= b.t),
          l as (select a, b, list_reduce(list_transform(ca, lambda x: list_transform(cb, lambda y: cast(x = y as integer))), lambda old, m: list_transform(range(1, len(m) + 1),
                lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when m[k] = 1 then case when k > 1 then old[k - 1] else 0 end + 1 else old[k] end))), list_transform(cb, lambda y: 0)) r from p)
          select a, b, round(2.0 * r[-1] / (length(a) + length(b)), 6) similarity from l""")
def indel_ratio(spark, d):
    n = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    b = n.withColumnRenamed("a", "b")
    return n.join(b, F.col("a") <= F.col("b")).select("a", "b", F.round(T.indel_ratio("a", "b"), 6).alias("similarity"))


@query("select doc_id, substr(regexp_replace(upper(text), '[^A-E]', '', 'g'), 1, 5) answer, coalesce(nullif(list_extract(regexp_extract_all(upper(strip_accents(replace(text, 'ß', 's'))), '\\b([A-E]{1,5})\\b', 1), -1), ''), substr(regexp_replace(upper(strip_accents(replace(text, 'ß', 's'))), '[^A-E]', '', 'g'), 1, 5)) last from documents")
def answer_clean(spark, d):
    plain = F.translate(F.translate(F.col("text"), "ß", "s"), "".join(a for a, _ in T._LATIN), "".join(b for _, b in T._LATIN))
    return table(spark, d, "documents").select("doc_id", T.answer_clean(F.col("text")).alias("answer"), T.last_answer(plain).alias("last"))


_SCORE = r"""cast(20 * (cast(contains(t, 'corrigé') as int) + cast(contains(t, 'correction') as int) + cast(contains(t, 'answer key') as int) + cast(contains(t, 'clé de correction') as int))
    + 10 * (cast(contains(t, 'réponse') as int) + cast(contains(t, 'réponses') as int) + cast(contains(t, 'rep.') as int) + cast(contains(t, 'answers') as int))
    + 40 * cast(regexp_matches(t, '\|\s*a\s*\|\s*b\s*\|\s*c') as int)
    + least(50, 5 * len(regexp_extract_all(t, '\d{1,3}\s*[:.\-→]\s*[a-e]{1,5}'))) + least(40, 4 * len(regexp_extract_all(u, '\b\d{1,3}\s+[A-E]{1,5}\b'))) as integer)"""


@query(f"select doc_id, {_SCORE} score from (select doc_id, lower(text) t, strip_accents(replace(text, 'ß', 's')) u from documents)")
def page_score(spark, d):
    return table(spark, d, "documents").select("doc_id", T.page_score(F.col("text")).alias("score"))


_MARK = "substr('ABCDE', cast(1 + l_partkey % 5 as integer), 1) || case when l_suppkey % 2 = 0 and l_partkey % 5 < 4 then 'E' else '' end"
PLANTED = f"""ln as (select l_orderkey k, l_linenumber n, {_MARK} a from lineitem),
    planted as (select k // 40 doc_id, cast(k % 40 as integer) page, case k % 4 when 0 then 'Corrigé' || chr(10) || string_agg(n || ': ' || lower(a), chr(10) order by n, a)
                when 1 then 'Réponse' || chr(10) || string_agg(n || ' ' || a, chr(10) order by n, a) when 2 then 'Une page de texte' else '| A | B | C |' end text from ln group by k)"""


def _planted(spark, d):
    """An order is a page: a list of answers, pairs of numbers and answers, plain text or a head of a table."""
    marks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").alias("n"), F.expr(_MARK.replace("//", "div")).alias("a")).alias("m"))
    per = marks.groupBy("k").agg(F.array_sort(F.collect_list("m")).alias("m"))
    joined = lambda between, f: F.array_join(F.transform("m", lambda x: F.concat(x["n"], F.lit(between), f(x["a"]))), "\n")
    text = F.when(F.col("k") % 4 == 0, F.concat(F.lit("Corrigé\n"), joined(": ", F.lower))).when(F.col("k") % 4 == 1, F.concat(F.lit("Réponse\n"), joined(" ", lambda a: a)))
    text = text.when(F.col("k") % 4 == 2, "Une page de texte").otherwise("| A | B | C |")
    return per.select(F.floor(F.col("k") / 40).alias("doc_id"), (F.col("k") % 40).cast("int").alias("page"), text.alias("text"))


_NUMBERED = "select k // 40 doc_id, cast(k % 40 as integer) page, cast(row_number() over (partition by k order by n, a) - 1 as integer) pos, n number, a answer from ln where k % 4 = "


@query(f"with {PLANTED} {_NUMBERED} 0")
def answer_regex(spark, d):
    return answers.parse_lists(_planted(spark, d)).where("page % 4 = 0")


@query(f"with {PLANTED} {_NUMBERED} 1")
def answer_regex_simple(spark, d):
    return answers.parse_simple(_planted(spark, d))


@query(r"""select doc_id, lt and q and not o split from (select doc_id, len(b) >= 2 lt, coalesce(regexp_matches(b[1], '^\d+[-.)]\s*.{15,}[:?]\s*$'), false) q,
           len([x for x in b[1:8] if regexp_matches(x, '(?i)^[a-e][-.)]\s*.{5,}')]) >= 3 o from (select doc_id, [x for x in
           [trim(x) for x in list_reverse(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)))[1:15]]
           if x <> '' and not regexp_matches(x, '(?i)Dr\.|\bSCE\b|parasitologie|page\s*\d+|scanned|camscanner')] b from documents))""")
def split_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", T.page_split(F.col("text")).alias("split"))


# ---- pages

@query(f"with {PAGES} select doc_id, page, length(text) n from pages_ where page between 3 and 9")
def page_range(spark, d):
    return pages.page_range(as_pages(spark, d), "3-9").select("doc_id", "page", F.length("text").cast("long").alias("n"))


@query(f"""with {PAGES}, s as (select distinct {_EXAM.format('')} doc_id, length({_EXAM.format('')}) n from documents)
           select p.doc_id, p.page from pages_ p join s using (doc_id) where p.page in (1, 2) or p.page between n and n + 4 or p.page between 20 and 22""")
def page_list(spark, d):
    n = F.length(exam())
    specs = table(spark, d, "documents").select(exam().alias("doc_id"), F.concat(F.lit("1, 2,"), n, F.lit(":"), n + 4, F.lit(",20-22,x,9-")).alias("spec")).distinct()
    return pages.page_list(as_pages(spark, d), specs).select("doc_id", "page")


@query(f"with {PAGES} select doc_id, page from pages_ where page not in (11, 4)")
def skip_pages(spark, d):
    p = as_pages(spark, d)
    return pages.skip_pages(p, p.select("doc_id").distinct().withColumn("guidance", F.lit("Please skip page 11, and ignore page 4."))).select("doc_id", "page")


@query(f"with {PAGES} select doc_id, round(avg(length(trim(coalesce(text, '')))), 6) mean_chars, avg(length(trim(coalesce(text, '')))) > 50 has_text from pages_ where page <= 3 group by doc_id")
def has_text_layer(spark, d):
    return pages.has_text_layer(as_pages(spark, d)).withColumn("mean_chars", F.round("mean_chars", 6))


@query("select doc_id, case when trim(coalesce(text, '')) in ('', '[EMPTY_PAGE]') then 'empty' when trim(text) = '[OCR_ERROR]' or starts_with(trim(text), 'ERROR:') then 'error' else 'ok' end status from documents")
def page_status(spark, d):
    return pages.with_status(table(spark, d, "documents")).select("doc_id", "status")


@query(f"with {PAGES} select * from (select doc_id, page, lead(page) over w next_page, md5(lead(text) over w) next_md5 from pages_ window w as (partition by doc_id order by page)) where next_page is not null")
def page_pairs(spark, d):
    return pages.page_pairs(as_pages(spark, d)).select("doc_id", "page", "next_page", F.md5("next_text").alias("next_md5"))


@query(f"""with {PAGES}, j as (select *, sum(case when page % 5 in (2, 3) then 0 else 1 end) over (partition by doc_id order by page) island from pages_)
           select doc_id, cast(min(page) as integer) page, count(*) n_pages, md5(string_agg(text, chr(10) order by page)) md5 from j group by doc_id, island""")
def page_islands(spark, d):
    p = as_pages(spark, d)
    splits = p.where("page % 5 in (2, 3)").select("doc_id", (F.col("page") - 1).alias("page"), F.col("page").alias("next_page"))
    return pages.merge_chains(p, splits).select("doc_id", "page", F.col("n_pages").cast("long").alias("n_pages"), F.md5("text").alias("md5"))


@query(rf"""with {PAGES}, f as (select doc_id, page, length(text) % 3 = 0 s, lead(page) over (partition by doc_id order by page) next_page from pages_)
           select doc_id, page, next_page from f where s and next_page is not null""")
def split_pages(spark, d):
    marked = as_pages(spark, d).withColumn("text", F.when(F.length("text") % 3 == 0, F.concat("text", F.lit("\nModule de biologie\n34-La question posée est la suivante :"))).otherwise(F.concat("text", F.lit("\nFin."))))
    return pages.split_pages(marked)


@query(f"with {PAGES}, g as (select doc_id, page from pages_ where page % 6 = 1) select doc_id, page from g union all select doc_id, page + 1 from g")
def flagged_pages(spark, d):
    guesses = as_pages(spark, d).select("doc_id", F.col("page").alias("page_from"), (F.col("page") + 1).alias("page_to"), (F.col("page") % 6 == 1).alias("has_split"))
    return pages.flagged_pages(guesses)


@query(f"""with {PAGES}, q as (select doc_id, page, page + 5 wanted from pages_) select q.doc_id, q.page, md5(coalesce(p.text, '')) md5 from q left join pages_ p on p.doc_id = q.doc_id and p.page = q.wanted""")
def page_text_join(spark, d):
    p = as_pages(spark, d)
    return pages.with_page_text(p.select("doc_id", F.col("page").alias("own"), (F.col("page") + 5).alias("page")), p).select("doc_id", F.col("own").alias("page"), F.md5("page_text").alias("md5"))


@query(f"""with {PAGES}, q as (select doc_id, page, unnest([page - 1, page, page + 1]) near_page from pages_ where page % 4 = 0)
           select q.doc_id, q.page, q.near_page, length(p.text) n from q join pages_ p on p.doc_id = q.doc_id and p.page = q.near_page""")
def page_window(spark, d):
    p = as_pages(spark, d)
    return pages.page_window(p.where("page % 4 = 0").select("doc_id", "page"), p).select("doc_id", "page", "near_page", F.length("near_text").cast("long").alias("n"))


@query(f"""with {PAGES}, c as (select doc_id, page, cast((row_number() over (partition by doc_id order by page) - 1) // 5 as integer) chunk from pages_)
           select *, min(page) over w chunk_first, max(page) over w chunk_last from c window w as (partition by doc_id, chunk)""")
def chunking(spark, d):
    return pages.chunks(as_pages(spark, d).select("doc_id", "page"), 5)


@query(f"""with {PAGES}, c as (select doc_id, page, cast((row_number() over (partition by doc_id order by page) - 1) // 3 as integer) chunk from pages_),
           k as (select *, min(page) over w f, max(page) over w l from c window w as (partition by doc_id, chunk)), b as (select doc_id, page own, f, l, case page % 4 when 0 then null when 1 then 0 when 2 then page + 9 else page end page from k)
           select doc_id, own, case when page between f and l then page else f end page from b""")
def page_stamp(spark, d):
    c = pages.chunks(as_pages(spark, d).select("doc_id", "page"), 3).withColumn("own", F.col("page"))
    bad = F.when(F.col("own") % 4 == 0, None).when(F.col("own") % 4 == 1, 0).when(F.col("own") % 4 == 2, F.col("own") + 9).otherwise(F.col("own"))
    return pages.stamp_pages(c.withColumn("page", bad)).select("doc_id", "own", "page")


@query(f"""with {PAGES} select doc_id, count(*) n_pages, md5(string_agg('=== PAGE ' || page || ' ===' || chr(10) || text, chr(10) || chr(10) order by page)) md5,
           md5(string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) order by page)) plain from pages_ group by doc_id""")
def page_concat(spark, d):
    p = as_pages(spark, d)
    plain = pages.concat_pages(p, None, pages.PAGE_BREAK).select("doc_id", F.md5("text").alias("plain"))
    return pages.concat_pages(p).select("doc_id", F.col("n_pages").cast("long").alias("n_pages"), F.md5("text").alias("md5")).join(plain, "doc_id")


@query(f"""with {PAGES}, r as (select *, max(page) over (partition by doc_id) total from pages_),
           b as (select doc_id, 0 part, page, '=== PAGE ' || page || ' ===' || chr(10) || text t from r where page <= 3
                 union all select doc_id, 1, page, '=== PAGE ' || page || ' (LAST) ===' || chr(10) || text from r where total > 3 and page = total
                 union all select doc_id, 2, page, '=== PAGE ' || page || ' (SAMPLE) ===' || chr(10) || substr(text, 1, 500) || '...' from r where total > 10 and page >= 5 and page < total and (page - 5) % 10 = 0),
           j as (select doc_id, string_agg(t, chr(10) || chr(10) order by part, page) t from b group by doc_id)
           select doc_id, md5(case when length(t) > 15000 then substr(t, 1, 15000) || chr(10) || chr(10) || '[... TRUNCATED ...]' else t end) md5 from j""")
def doc_sample(spark, d):
    return pages.analysis_sample(as_pages(spark, d)).select("doc_id", F.md5("text").alias("md5"))


@query(f"""with {PAGES}, r as (select *, count(*) over (partition by doc_id) n from pages_) select doc_id, page, page = n and n > 1 answers from r where n <= 3 or page <= 2 or page = n""")
def sample_pages(spark, d):
    return pages.sample_pages(as_pages(spark, d)).select("doc_id", "page", "answers")


# ---- answers

def _xtables(spark, d):
    """Pages with a table of marked options, one an order, made of its lines."""
    mark = lambda c, v, m: F.when(F.col(c) == v, m).otherwise(" ")
    row = F.concat(F.lit("| "), F.col("l_linenumber"), F.lit("|"), mark("l_returnflag", "A", "X"), F.lit("|"), mark("l_returnflag", "N", "v"), F.lit("| "), mark("l_returnflag", "R", "1"), F.lit(" |"), mark("l_linestatus", "F", "✓"), F.lit("|"), mark("l_linestatus", "O", "o"), F.lit("|"))
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows"))
    return per.select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("Corrigé\n|Q|A|b|C|d|E|\n|---|---|---|---|---|---|\n"), "rows").alias("text"))


@query("""select cast(l_orderkey as varchar) doc_id, l_linenumber number, case l_returnflag when 'A' then 'A' when 'N' then 'B' when 'R' then 'C' else '' end || case l_linestatus when 'F' then 'D' when 'O' then 'E' else '' end answer from lineitem""")
def xtable_parse(spark, d):
    return answers.parse_tables(_xtables(spark, d)).select("doc_id", "number", "answer")


@query("""with l as (select cast(l_orderkey as varchar) doc_id, l_linenumber number, case l_returnflag when 'A' then 'A' when 'N' then 'B' when 'R' then 'C' else '' end || case l_linestatus when 'F' then 'D' when 'O' then 'E' else '' end answer, l_quantity, l_returnflag, l_linestatus from lineitem),
          r as (select *, row_number() over (partition by doc_id, number order by answer desc) rn from l)
          select doc_id, 1 page, number, answer, 'table' src from r where rn = 1""")
def answer_key(spark, d):
    pages_ = scratch.written(_xtables(spark, d), "answer-pages")
    key = answers.parse_tables(pages_).withColumn("pos", F.lit(0)).withColumn("priority", F.lit(0))
    key = key.unionByName(answers.parse_lists(pages_).withColumn("priority", F.lit(1)))
    return answers.merge_keys(key).select("doc_id", "page", "number", "answer", F.when(F.col("priority") == 0, "table").otherwise("list").alias("src"))


@query(f"with {QUESTIONS}, {KEY} select q.doc_id, q.number, coalesce(case when trim(k.answer) <> '' then k.answer end, q.correct) correct from questions_ q left join key_ k using (doc_id, number)")
def apply_key(spark, d):
    return answers.apply_key(as_questions(spark, d), as_key(spark, d)).select("doc_id", "number", "correct")


@query(f"with {QUESTIONS}, {KEY} select q.doc_id, q.number, case when coalesce(trim(q.correct), '') = '' then coalesce(k.answer, q.correct) else q.correct end correct from questions_ q left join key_ k using (doc_id, number)")
def fill_gaps(spark, d):
    return answers.fill_gaps(as_questions(spark, d), as_key(spark, d)).select("doc_id", "number", "correct")


_ALIGN = f"""{QUESTIONS}, {KEY}, al as (select q.doc_id, count(*) n_questions, avg(case when k.number is null then 0.0 else 1.0 end) score from (select distinct doc_id, number from questions_) q left join (select distinct doc_id, number from key_) k using (doc_id, number) group by q.doc_id),
    nk as (select doc_id, count(distinct number) n_keys from key_ group by doc_id)"""


@query(f"with {_ALIGN} select al.doc_id, n_questions, round(score, 6) score, coalesce(n_keys, 0) n_keys, score > 0 and score < 0.8 drift from al left join nk using (doc_id)")
def alignment(spark, d):
    return answers.alignment(as_questions(spark, d), as_key(spark, d)).select("doc_id", "n_questions", F.round("score", 6).alias("score"), "n_keys", "drift")


@query(f"""with {_ALIGN}, q as (select *, row_number() over (partition by doc_id order by pos) rk from questions_), k as (select doc_id, number, max(answer) answer, row_number() over (partition by doc_id order by number) rk from key_ group by doc_id, number)
           select q.doc_id, q.number, coalesce(e.answer, case when al.score >= 0.3 then f.answer end, q.correct) correct from q left join k e on e.doc_id = q.doc_id and e.number = q.number left join k f on f.doc_id = q.doc_id and f.rk = q.rk left join al on al.doc_id = q.doc_id""")
def apply_key_fallback(spark, d):
    return answers.apply_with_fallback(as_questions(spark, d), as_key(spark, d), 0.3).select("doc_id", "number", "correct")


@query(f"with {QUESTIONS}, {KEY} select k.doc_id, k.number, k.answer from key_ k left join (select * from questions_ where number % 3 <> 0) q using (doc_id, number) where q.pos is null")
def unmatched_keys(spark, d):
    return answers.unmatched_keys(as_key(spark, d), as_questions(spark, d).where("number % 3 <> 0")).select("doc_id", "number", "answer")


@query(f"""with {QUESTIONS} select doc_id, count(*) filter (where coalesce(trim(correct), '') <> '') corrected, count(*) filter (where coalesce(trim(correct), '') = '') missing,
           array_to_string(list_sort(list(distinct number) filter (where coalesce(trim(correct), '') = ''))[1:15], ',') missing_numbers from questions_ group by doc_id""")
def coverage(spark, d):
    return answers.coverage(as_questions(spark, d)).withColumn("missing_numbers", F.array_join(F.col("missing_numbers").cast("array<string>"), ","))


_DETECT = r"""cast(15 * (cast(contains(t, 'corrigé') as int) + cast(contains(t, 'correction') as int) + cast(contains(t, 'réponse') as int) + cast(contains(t, 'rep.') as int) + cast(contains(t, 'answers') as int) + cast(contains(t, 'clé') as int) + cast(contains(t, 'answer key') as int))
    + 40 * cast(regexp_matches(t, '\|\s*a\s*\|\s*b\s*\|\s*c') as int) + least(50, 5 * len(regexp_extract_all(t, '\d{1,3}\s*[\.:\-\s]\s*[a-e]{1,5}'))) as integer)"""


@query(f"""with {PLANTED}, s as (select doc_id, page, {_SCORE} score from (select *, lower(text) t, text u from planted)), m as (select *, max(score) over (partition by doc_id) top from s),
           c as (select doc_id, page from m where score >= case when top >= 15 then 15 else 5 end), n as (select distinct doc_id, unnest([page - 1, page, page + 1]) page from c) select doc_id, page from planted semi join n using (doc_id, page)""")
def answer_pages(spark, d):
    return answers.answer_pages(_planted(spark, d), T.page_score(F.col("text")))


@query(f"with {PLANTED}, s as (select doc_id, page, {_DETECT} score from (select *, lower(text) t from planted)), r as (select *, row_number() over (partition by doc_id order by score desc, page) rank from s where score >= 40) select * from r where rank <= 5")
def answer_pages_top5(spark, d):
    return answers.top_answer_pages(_planted(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {QUESTIONS} select doc_id, number, cast(null as varchar) correct from questions_")
def drop_answers(spark, d):
    return answers.drop_answers(as_questions(spark, d)).select("doc_id", "number", "correct")


@query("select * from (select conv_id doc_id, turn // 4 batch, count(*) / 4.0::double share from conversations group by 1, 2) where share < 0.9")
def incomplete_batches(spark, d):
    found = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).alias("batch")).agg(F.count(F.lit(1)).alias("n_found"))
    return answers.incomplete_batches(found, 4)


# ---- questions

def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("number"), F.lit(1).alias("page"), "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")


def _order():
    return [F.desc("l_extendedprice"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_quantity")]


@query("""with b as (select *, case when l_suppkey % 3 = 0 then 1 else 0 end gen from lineitem), r as (select *, row_number() over (partition by l_orderkey, l_linenumber order by gen desc, l_extendedprice desc, l_partkey desc, l_suppkey desc, l_quantity desc) rn from b)
          select l_orderkey doc_id, l_linenumber number, l_extendedprice, l_partkey from r where rn = 1""")
def qcm_upsert(spark, d):
    rows = _lines(spark, d)
    return questions.upsert(rows.where("l_suppkey % 3 <> 0"), rows.where("l_suppkey % 3 = 0"), order=_order()).select("doc_id", "number", "l_extendedprice", "l_partkey")


@query("select l_orderkey doc_id, l_linenumber number, row_number() over (order by l_orderkey, l_linenumber, l_extendedprice desc, l_partkey desc, l_suppkey desc, l_quantity desc) place from lineitem")
def question_order(spark, d):
    rows = questions.in_order(_lines(spark, d)).select("doc_id", "page", "number", *[(-F.col(c)).alias(c) for c in ("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")])
    rows = scratch.with_index(rows, ["doc_id", "page", "number", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity"], "place")
    return rows.select("doc_id", "number", (F.col("place") + 1).alias("place"))


@query("""with n as (select distinct l_orderkey, l_linenumber from lineitem where l_suppkey % 3 = 0), o as (select distinct l_orderkey, l_linenumber, 1 x from lineitem where l_suppkey % 3 <> 0)
          select count(x) updated, count(*) - count(x) added from n left join o using (l_orderkey, l_linenumber)""")
def qcm_upsert_counts(spark, d):
    rows = _lines(spark, d)
    return questions.upsert_counts(rows.where("l_suppkey % 3 <> 0"), rows.where("l_suppkey % 3 = 0"))


@query("""select l_orderkey doc_id, l_linenumber number, l_partkey from lineitem where l_quantity > 25 union all
          select l_orderkey, l_linenumber, l_partkey from lineitem x where not coalesce(l_quantity > 25, false) and not exists (from lineitem y where y.l_quantity > 25 and y.l_orderkey = x.l_orderkey and y.l_linenumber = x.l_linenumber)""")
def quarantine(spark, d):
    rows = _lines(spark, d)
    return questions.quarantine(rows.where("l_quantity > 25"), rows.where("not coalesce(l_quantity > 25, false)")).select("doc_id", "number", "l_partkey")


@query("""with n as (select * from lineitem where l_suppkey % 5 = 0) select l_orderkey doc_id, l_linenumber page, l_partkey, 1 gen from n union all
          select l_orderkey, l_linenumber, l_partkey, 0 from lineitem o where not coalesce(l_suppkey % 5 = 0, false) and not exists (from n where n.l_orderkey = o.l_orderkey and n.l_linenumber = o.l_linenumber)""")
def page_replace(spark, d):
    rows = _lines(spark, d).withColumn("page", F.col("number"))
    new = rows.where("l_suppkey % 5 = 0").withColumn("gen", F.lit(1))
    return questions.replace_pages(rows.where("not coalesce(l_suppkey % 5 = 0, false)").withColumn("gen", F.lit(0)), new).select("doc_id", "page", "l_partkey", "gen")


def _options(spark, d):
    """Orders as questions of a customer's exam, with as many options as they have lines."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n_options"))
    return table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("number"), "n_options")


_OPTIONS = "options_ as (select o_custkey doc_id, o_orderkey number, cast(n as integer) n_options from orders join (select l_orderkey, count(*) n from lineitem group by 1) on o_orderkey = l_orderkey), thr as (select doc_id, cast(coalesce(min(n_options) filter (where n >= 2), min(n_options), 4) as integer) threshold from (select doc_id, n_options, count(*) n from options_ group by 1, 2) group by doc_id)"


@query(f"with {_OPTIONS} select * from thr")
def prop_threshold(spark, d):
    return questions.option_threshold(_options(spark, d))


@query(f"with {_OPTIONS} select doc_id, number, n_options, threshold from options_ join thr using (doc_id) where n_options < threshold")
def incomplete(spark, d):
    rows = _options(spark, d)
    return questions.incomplete(rows, questions.option_threshold(rows)).select("doc_id", "number", "n_options", "threshold")


def _with_options(spark, d):
    letters = F.slice(F.array(*[F.lit(x) for x in "ABCDEFGHIJ"]), 1, F.least("n", F.lit(10)))
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("l_returnflag") == "N").cast("int").alias("k"))
    rows = n.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("number"), "n", "k")
    make = lambda c: F.map_from_arrays(F.slice(letters, F.lit(1), F.greatest(F.least(F.col(c), F.lit(10)), F.lit(0))), F.slice(letters, F.lit(1), F.greatest(F.least(F.col(c), F.lit(10)), F.lit(0))))
    return rows, make


@query("""with c as (select l_orderkey doc_id, least(count(*), 10) n, least(count(*) filter (where l_returnflag = 'N'), 10) k from lineitem group by 1)
          select doc_id, n > k fixed, cast(greatest(n, k) as integer) n_options from c""")
def incomplete_fix(spark, d):
    rows, make = _with_options(spark, d)
    fixed = questions.fix_incomplete(rows.withColumn("propositions", make("k")), rows.withColumn("propositions", make("n")))
    return fixed.select("doc_id", "fixed", F.size("propositions").alias("n_options"))


@query("""select l_orderkey doc_id, l_linenumber number, coalesce(try_cast(l_comment as integer), 0) page from (select l_orderkey, l_linenumber, substr(cast(l_partkey as varchar) || l_returnflag, 1, 3) l_comment from lineitem)""")
def sanitize(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("number"), F.substring(F.concat(F.col("l_partkey").cast("string"), "l_returnflag"), 1, 3).alias("page"))
    return questions.sanitize(rows).select("doc_id", "number", "page")


@query()
def validate_rows(spark, d):
    o = table(spark, d, "documents").select(F.col("doc_id").alias("number"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 7 > 0, F.create_map(F.lit("A"), F.col("lang"))).alias("propositions"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("int")).alias("page"))
    return questions.validate(o, 3).select("number", "page")


ORACLE_SQL["validate_rows"] = "select doc_id number, cast(coalesce(case when doc_id % 2 = 0 then doc_id end, 3) as integer) page from documents where doc_id % 5 > 0 and doc_id % 7 > 0 and text is not null"


def _with_orphans(spark, d):
    """Documents as pages; every third begins with two or three options of the page before."""
    opts = F.when(F.col("page") % 3 == 0, F.concat(F.lit("a- First "), F.col("doc_id"), F.lit("\n(b) Second "), F.col("doc_id"), F.when(F.col("page") % 2 == 0, F.concat(F.lit("\n[E]  Third: "), F.col("page"))).otherwise(""), F.lit("\nc- short\n34- Next question here\nd- not an orphan\n"))).otherwise("")
    return as_pages(spark, d).withColumn("text", F.concat(opts, "text"))


@query(f"with {PAGES} select doc_id, page, 'First ' || doc_id a, 'Second ' || doc_id b, case when page % 2 = 0 then 'Third: ' || page end e, case when page % 2 = 0 then 3 else 2 end n from pages_ where page % 3 = 0")
def orphan_options(spark, d):
    o = questions.orphan_options(_with_orphans(spark, d)).where("page % 3 = 0")
    return o.select("doc_id", "page", F.col("orphans")["A"].alias("a"), F.col("orphans")["B"].alias("b"), F.col("orphans")["E"].alias("e"), F.size("orphans").alias("n"))


@query(f"""with {PAGES}, c as (select doc_id, max(page) last from pages_ group by 1)
           select p.doc_id, p.page, cast(case when p.page % 3 = 2 and p.page < last then 3 + (p.page % 2) else 2 end as integer) n_options, case when p.page % 3 = 2 and p.page < last then p.page + 1 end merged_from from pages_ p join c using (doc_id) where p.page % 6 <> 3 """)
def split_merge(spark, d):
    p = _with_orphans(spark, d).where("page % 3 = 0").unionByName(as_pages(spark, d).where("page % 3 <> 0").withColumn("text", F.lit("1- Question")))
    q = as_pages(spark, d).select("doc_id", "page", F.lit(0).alias("pos"), F.when(F.col("page") % 6 == 3, 0).otherwise(F.col("page")).alias("number"), F.lit("q").alias("text"), F.create_map(F.lit("B"), F.lit("x"), F.lit("C"), F.lit("y")).alias("propositions"))
    return questions.merge_splits(q, p).select("doc_id", "page", F.size("propositions").alias("n_options"), "merged_from")


# ---- metadata

@query("""with t as (select conv_id doc_id, turn page, case when role = 'system' then text end trig from conversations)
          select doc_id, page, md5(last_value(trig ignore nulls) over (partition by doc_id order by page rows between unbounded preceding and current row)) cas from t""")
def carry_forward(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("pos"), F.when(F.col("role") == "system", F.col("text")).alias("trigger"))
    return metadata.carry_forward(c, "trigger").select("doc_id", "page", F.md5("cas").alias("cas"))


@query("""with t as (select conv_id doc_id, turn number, turn // 2 page, case when role = 'system' then 'Case ' || turn || chr(13) || chr(10) || text end trig from conversations),
          c as (select *, last_value(trig ignore nulls) over (partition by doc_id order by number rows between unbounded preceding and current row) cas from t),
          g as (select doc_id, cas, page, count(*) n, min(number) f from c group by 1, 2, 3), b as (select *, min(f) over (partition by doc_id, cas) bg from g)
          select doc_id, case when cas is not null then dense_rank() over (partition by doc_id, cas is null order by bg) end case_no, string_split(cas, chr(13) || chr(10))[1] label, page, cast(n as integer) n from b""")
def case_summary(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("number"), F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("pos"), F.when(F.col("role") == "system", F.concat(F.lit("Case "), F.col("turn"), F.lit("\r\n"), F.col("text"))).alias("trigger"))
    s = metadata.case_summary(metadata.carry_forward(c, "trigger"))
    return s.select("doc_id", F.col("case_no").cast("long").alias("case_no"), "label", "page", "n")


@query("""select o_orderkey number, coalesce(nullif(case when o_orderkey % 4 = 0 then o_orderstatus else '' end, ''), nullif(c_mktsegment, ''), case when o_orderpriority like '1%' then 'urgent' end, '2024') as "year"
          from orders left join (select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment end c_mktsegment from customer) on c_custkey = o_custkey""")
def metadata_fill(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("number"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).otherwise("").alias("year"))
    per_doc = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("year"))
    per_file = o.select("doc_id", "file").distinct().withColumn("year", F.when(F.startswith("file", F.lit("1")), "urgent"))
    return metadata.fill_metadata(o, ["year"], per_doc, per_file, {"year": "2024"}).select("number", "year")


@query("select o_orderkey number, array_to_string([x for x in [nullif(case when o_orderkey % 3 > 0 then o_clerk_ end, ''), cast(y as varchar)] if x is not null], '/') tag from (select o_orderkey, o_orderpriority o_clerk_, case when o_orderkey % 5 > 0 then year(o_orderdate) end y from orders)")
def tag_build(spark, d):
    o = table(spark, d, "orders")
    t = metadata.tag(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate")))
    return o.select(F.col("o_orderkey").alias("number"), F.array_join(t, "/").alias("tag"))


@query("select event_id, event_type field, value / 100 confidence from events where value / 100 >= 0.6")
def confidence_filter(spark, d):
    return metadata.confident(table(spark, d, "events").select("event_id", F.col("event_type").alias("field"), (F.col("value") / 100).alias("confidence")))


@query("select event_id page_from, event_id + 1 page_to, cast(value as integer) confidence from (select event_id, floor(value) value from events where event_type <> 'view') where value >= 80")
def split_filter(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("page_from"), (F.col("event_id") + 1).alias("page_to"), (F.col("event_type") != "view").alias("has_split"), F.floor("value").cast("int").alias("confidence"))
    return pages.confident_splits(e).drop("has_split")


_KEYWORDS = [("medecine", "Cardiologie", 0, ["insuffisance cardiaque", "ECG", "the", "tion"]), ("medecine", "Neurologie", 1, ["ering", "achlich", "mente"]), ("chirurgie", "Urologie", 0, ["on", "heit", "réeau"]), ("biologie", "Biochimie", 0, ["and", "eaux", "ción"])]
_MODULES = "m as (select * from (values " + ", ".join(f"('{a}', '{b}', {c}, '{w}')" for a, b, c, ws in _KEYWORDS for w in ws) + ") v(domain, module, module_ord, keyword))"
_DOMAIN = "case doc_id % 3 when 0 then 'medecine' when 1 then 'chirurgie' else 'biologie' end"


def _modules(spark):
    return spark.createDataFrame(_KEYWORDS, "domain string, module string, module_ord int, keywords array<string>")


def _domain():
    return metadata.domain_of(F.when(F.col("doc_id") % 3 == 0, "Médecine").when(F.col("doc_id") % 3 == 1, "Chirurgie").otherwise("Bio"))


@query(f"""with {_MODULES}, h as (select doc_id, module, keyword, row_number() over (partition by doc_id order by length(keyword) desc, module_ord, keyword) rn from (select doc_id, lower(text) t, {_DOMAIN} domain from documents) join m using (domain) where contains(t, lower(keyword)))
           select doc_id, module, keyword from h where rn = 1""")
def keyword_category(spark, d):
    return metadata.keyword_category(table(spark, d, "documents").withColumn("domain", _domain()), _modules(spark))


@query("""with m as (select distinct domain, module, module_ord from (values ('medecine', 'The', 0), ('medecine', 'En', 1), ('chirurgie', 'On', 0), ('biologie', 'An', 0)) v(domain, module, module_ord)),
          r as (select doc_id, """ + _DOMAIN + """ domain, replace(replace(trim(lower(text)), '"', ''), '''', '') t from documents),
          h as (select doc_id, module, row_number() over (partition by doc_id order by case when lower(module) = t then 0 else 1 end, module_ord) rn from r join m using (domain) where contains(t, lower(module)))
          select r.doc_id, coalesce(h.module, 'Autre') module from r left join h on h.doc_id = r.doc_id and h.rn = 1""")
def module_resolve(spark, d):
    m = spark.createDataFrame([("medecine", "The", 0), ("medecine", "En", 1), ("chirurgie", "On", 0), ("biologie", "An", 0)], "domain string, module string, module_ord int")
    return metadata.resolve_module(table(spark, d, "documents").withColumn("domain", _domain()), m, "text").select("doc_id", "module")


@query()
def nearest_module(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    modules = table(spark, d, "nation").select(F.col("n_name").alias("module"), F.col("n_nationkey").alias("module_ord"))
    return metadata.nearest_module(names.unionByName(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()), modules, 0.3)


@query("""select o_orderkey doc_id, cast(o_orderkey as integer) Num, coalesce(nullif(o_orderpriority, ''), o_orderstatus) Text, c_mktsegment A, o_orderstatus B, cast(year(o_orderdate) as varchar) as "Year"
          from orders left join customer on c_custkey = o_custkey and c_custkey % 2 = 0""")
def template_map(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 2 = 0")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    q = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("question"), F.col("c_mktsegment").alias("A"), F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.col("o_orderstatus")).alias("propositions"), F.year("o_orderdate").alias("year"))
    return metadata.map_template(q).select("doc_id", "Num", "Text", "A", "B", "Year")


@query("select coalesce(cast(o_orderkey as varchar), '') Num, coalesce(c_mktsegment, '') \"Text\", coalesce(o_orderstatus || ', ' || o_orderpriority, '') Tag, cast(o_custkey as varchar) extra from orders left join customer on c_custkey = o_custkey and c_custkey % 2 = 0")
def export_columns(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 2 = 0")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = o.select(F.col("o_custkey").alias("extra"), F.array("o_orderstatus", "o_orderpriority", "o_orderstatus").alias("Tag"), F.col("c_mktsegment").alias("Text"), F.col("o_orderkey").alias("Num"), F.lit(None).cast("string").alias("Exp"), F.lit("").alias("Cas"))
    return io.export_columns(rows)


# ---- costs and runs

_SUMS = "sum(cost) cost, count(*) calls, cast(sum(prompt_tokens) as bigint) prompt_tokens, cast(sum(completion_tokens) as bigint) completion_tokens"


@query(f"with {COSTS} select model, {_SUMS} from costs_ group by model")
def cost_by_model(spark, d):
    return costs.by_model(as_costs(spark, d))


@query(f"with {COSTS} select step, {_SUMS} from costs_ group by step")
def cost_by_step(spark, d):
    return costs.by_step(as_costs(spark, d))


@query(f"with {COSTS} select model, step, {_SUMS}, case grouping_id(model, step) when 3 then 'total' when 1 then 'model' else 'step' end level from costs_ group by grouping sets ((model), (step), ())")
def cost_summary(spark, d):
    return costs.summary(as_costs(spark, d))


@query(f"with {COSTS}, p as (select project, sum(cost) cost, max(ts) ts from costs_ group by 1) select strftime(ts, '%Y-W%U') as \"week\", sum(cost) cost, array_to_string(list_sort(list(distinct project)), ',') projects from p group by 1 order by 1 desc limit 6")
def cost_weekly(spark, d):
    return costs.weekly(as_costs(spark, d)).withColumn("projects", F.array_join("projects", ","))


@query("select event_id, strftime(ts, '%Y-W%U') as \"week\" from events")
def week_keys(spark, d):
    return table(spark, d, "events").select("event_id", T.week_key(F.col("ts")).alias("week"))


@query(f"""with {COSTS}, u as (select c_custkey user_id from customer), p as (select user_id, count(distinct project) projects from costs_ group by 1), c as (select user_id, sum(cost) cost, count(*) calls from costs_ group by 1),
           j as (select u.user_id, projects, calls, cost from u left join p using (user_id) left join c using (user_id))
           select user_id, cast(coalesce(sum(projects), 0) as bigint) projects, cast(coalesce(sum(calls), 0) as bigint) calls, round(coalesce(sum(cast(cost as double)), 0), 4) cost from j group by rollup (user_id)""")
def user_costs(spark, d):
    c = as_costs(spark, d).withColumn("cost", F.col("cost").cast("double"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return costs.users(people, c.select("user_id", "project").distinct(), c)


@query("""with p as (select * from (values ('click', 0.4, 0.4), ('view', 0.1, 0.3), ('purchase', 0.23, 0.69)) v(model, prompt, completion)),
          e as (select event_id, event_type model, case when event_id % 3 = 0 then value else 0 end cost, length(props) a, event_id % 100 b from events)
          select event_id, round(case when cost > 0 then cost else a / 1e6 * coalesce(prompt, 0.1) + b / 1e6 * coalesce(completion, 0.1) end, 9) cost from e left join p using (model)""")
def cost_estimate(spark, d):
    prices = spark.createDataFrame([("click", 0.4, 0.4), ("view", 0.1, 0.3), ("purchase", 0.23, 0.69)], "model string, prompt double, completion double")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0).alias("cost"), F.length("props").alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"))
    return costs.estimate(e, prices).select("event_id", F.round("cost", 9).alias("cost"))


@query(f"with {COSTS} select project, max(ts) updated_at from costs_ group by 1 order by 2 desc, 1 limit 5")
def recent_projects(spark, d):
    return costs.recent(as_costs(spark, d))


@query("""with p as (select user_id project, count(*) filter (where event_type <> 'error') pages_ok, count(*) filter (where event_type = 'error') pages_failed from events group by 1)
          select *, case when pages_ok = 0 then 'error' when pages_failed > 0 then 'warning' else 'success' end badge from p""")
def step_badge(spark, d):
    return costs.badges(table(spark, d, "events").select(F.col("user_id").alias("project"), (F.col("event_type") != "error").alias("ok")))


@query("select user_id project, max(event_id % 9) current_step from events where event_type <> 'error' group by 1")
def project_progress(spark, d):
    return costs.progress(table(spark, d, "events").where("event_type <> 'error'").select(F.col("user_id").alias("project"), (F.col("event_id") % 9).alias("step_ord")))


@query("""with r as (select distinct o_custkey project, strftime(o_orderdate, '%Y-%m-%d') run_id from orders), n as (select *, row_number() over (partition by project order by run_id desc) pos from r) select *, pos = 1 current from n""")
def run_history(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_id"))
    return costs.run_history(o).withColumn("pos", F.col("pos").cast("long"))


_RANK = "case o_orderstatus when 'O' then 7 when 'F' then 6 else 5 end"


@query(f"with s as (select o_custkey doc_id, o_orderkey, {_RANK} stage_rank from orders) select doc_id, stage_rank, o_orderkey from (select *, max(stage_rank) over (partition by doc_id) top from s) where stage_rank = top")
def latest_stage(spark, d):
    return costs.latest_stage(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.expr(_RANK).alias("stage_rank"), "o_orderkey"))


@query("select o_orderkey, case when o_orderstatus in ('O', 'F') then 'accepted' else 'rejected' end status from orders")
def accepted_split(spark, d):
    """Both outputs of a step, each read back by itself."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus").isin("O", "F"), "accepted").otherwise("rejected").alias("status"))
    path = scratch.new_path(spark, "stage")
    io.save_stage(o, path, "1")
    return io.load_stage(spark, path, "1", status="accepted").unionByName(io.load_stage(spark, path, "1", status="rejected")).select("o_orderkey", "status")


_RUNS = "r as (select o_custkey doc_id, o_orderkey, case when o_orderkey % 3 = 0 then '2024-01-02' else '2024-01-01' end run_id from orders)"


@query(f"with {_RUNS} select *, false latest from r union all select *, true from r where run_id = (select max(run_id) from r)")
def run_snapshots(spark, d):
    """Two runs of a step kept side by side, all read back, and the newest alone."""
    o, path = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey"), scratch.new_path(spark, "runs")
    io.save_run(o.where("o_orderkey % 3 <> 0"), path, "5", "2024-01-01")
    io.save_run(o.where("o_orderkey % 3 = 0"), path, "5", "2024-01-02")
    every, last = io.load_runs(spark, path, "5"), io.load_runs(spark, path, "5", "current")
    return every.withColumn("latest", F.lit(False)).unionByName(last.withColumn("latest", F.lit(True))).select("doc_id", "o_orderkey", "run_id", "latest")


@query("""select 'merged' action, count(*) total, count(distinct l_orderkey) documents from lineitem where l_returnflag = 'R' union all
          select 'fixed', count(*), count(distinct l_orderkey) from lineitem where l_returnflag = 'A'""")
def audit_report(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_returnflag")
    trails = [io.audit(rows.where(F.col("l_returnflag") == f), a) for f, a in (("R", "merged"), ("A", "fixed"))]
    return io.audit_report(*trails).select("action", "total", "documents")


@query("select coalesce(o_orderstatus, 'none') status, count(distinct o_custkey) documents, count(*) n_rows from orders group by 1")
def batch_report(spark, d):
    return costs.batch_report(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.coalesce("o_orderstatus", F.lit("none")).alias("status")))


@query("""with c as (select distinct md5(coalesce(text, '')) digest from documents where doc_id % 2 = 0) select doc_id, md5(coalesce(text, '')) digest, md5(coalesce(text, '')) in (select digest from c) hit from documents""")
def cache_split(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("content"))
    cache = docs.where("doc_id % 2 = 0").select(F.md5(F.col("content").cast("binary")).alias("digest"), F.lit("stored").alias("value")).distinct()
    hits, misses = costs.cache_split(docs, cache)
    return hits.select("doc_id", "digest", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", "digest", F.lit(False).alias("hit")))


@query("""with c as (select distinct md5(coalesce(text, '')) digest from documents where doc_id % 2 = 0), k as (select md5(coalesce(text, '')) in (select digest from c) hit from documents)
          select count(*) filter (where hit) hits, count(*) filter (where not hit) misses from k""")
def cache_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    cache = docs.where("doc_id % 2 = 0").select(F.md5(F.col("content").cast("binary")).alias("digest"), F.lit("stored").alias("value"))
    return costs.cache_stats(*costs.cache_split(docs, cache))


@query("select user_id doc_id, count(distinct event_id % 20) total_pages, sum(cast(round(value, 2) as decimal(18,2))) total_cost, cast(sum(event_id % 7) as bigint) total_duration, cast(sum(length(props)) as bigint) total_tokens from events group by 1")
def ocr_manifest(spark, d):
    e = table(spark, d, "events")
    return costs.manifest(e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 20).alias("page"), F.round("value", 2).cast("decimal(18,2)").alias("cost"), (F.col("event_id") % 7).alias("duration"), F.length("props").alias("tokens")))


@query("""with p as (select user_id project, event_id % 30 page, count(*) filter (where event_type = 'purchase') n from events group by 1, 2)
          select project, cast(sum(n) as bigint) qcms, count(*) filter (where n = 0) empty_pages, case when sum(n) = 0 then 'error' when count(*) filter (where n = 0) > 0 then 'warning' else 'success' end badge from p group by 1""")
def question_badges(spark, d):
    p = table(spark, d, "events").groupBy(F.col("user_id").alias("project"), (F.col("event_id") % 30).alias("page")).agg(F.count_if(F.col("event_type") == "purchase").alias("n_questions"))
    return costs.question_badges(p)


@query("""select c_custkey project, coalesce(n, 0) merged_qcms, case when coalesce(n, 0) = 0 then 'error' else 'success' end badge from customer left join (select o_custkey, count(*) n from orders group by 1) on o_custkey = c_custkey""")
def merged_badges(spark, d):
    return costs.merged_badges(table(spark, d, "customer").select(F.col("c_custkey").alias("project")), table(spark, d, "orders").select(F.col("o_custkey").alias("project")))


@query(f"with {COSTS} select user_id, sum(cost) cost, row_number() over (order by sum(cost) desc, user_id) place from costs_ group by 1")
def user_sort(spark, d):
    """Users by cost; the place comes from the rank of the sorted rows' own order."""
    per = costs.sort_users(as_costs(spark, d).groupBy("user_id").agg(F.sum("cost").alias("cost")))
    return scratch.with_index(per.withColumn("_down", -F.col("cost")), ["_down", "user_id"], "place").select("user_id", "cost", (F.col("place") + 1).alias("place"))


# ---- replies

def _replies(spark, d):
    """Model replies with what goes wrong in them, made from the events: by id a list in a fence with trailing commas, one object, objects without commas
    between them after a comment, a nested object, and a list that is cut off."""
    e, k = table(spark, d, "events"), F.col("event_id") % 5
    obj = lambda more="": F.concat(F.lit('{"number": '), F.col("event_id"), F.lit(', "text": "'), F.col("event_type"), F.lit('"' + more + "}"))
    content = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n["), obj(","), F.lit("\n"), obj(","), F.lit(",]\n```\nDone.")))
    content = content.when(k == 1, F.concat(F.lit("Sure. "), obj(), F.lit(" That is all.")))
    content = content.when(k == 2, F.concat(F.lit("[\n// first\n"), obj(), F.lit("\n"), obj(), F.lit(" "), obj(), F.lit("\n]")))
    content = content.when(k == 3, F.concat(F.lit("["), obj(', "more": {"a": [1, 2], "b": {"c": "}"}}'), F.lit("]")))
    content = content.otherwise(F.concat(F.lit("["), obj(), F.lit(', {"number": ')))
    return e.select("event_id", "event_type", content.alias("content"))


@query("select event_id, case when event_id % 5 < 4 then event_id end number, case when event_id % 5 < 4 then event_type end \"text\", case event_id % 5 when 0 then 2 when 1 then 1 when 2 then 3 when 3 then 1 end n from events")
def json_repair(spark, d):
    r = completion.parse_replies(_replies(spark, d), "content", "struct<number:bigint,text:string>")
    return r.select("event_id", F.get("objects", F.lit(0))["number"].alias("number"), F.get("objects", F.size("objects") - 1)["text"].alias("text"), F.when(F.col("objects").isNotNull(), F.size("objects")).alias("n"))


@query("""with o as (select *, '{"number": ' || event_id || ', "text": "' || event_type || '"}' obj, '{"more": {"a": [1, 2], "b": {"c": "}"}}, "number": ' || event_id || ', "text": "' || event_type || '"}' nested from events)
          select event_id, case event_id % 5 when 0 then null when 3 then nested else obj end as "first", case event_id % 5 when 0 then 0 when 2 then 3 else 1 end n from o""")
def json_salvage(spark, d):
    r = _replies(spark, d).withColumn("o", completion.salvage_objects("content"))
    return r.select("event_id", F.get("o", F.lit(0)).alias("first"), F.size("o").alias("n"))


@query("select event_id, case when event_id % 5 in (1, 3, 4) then cast(event_id as varchar) end number, case when event_id % 5 in (1, 3, 4) then event_type end \"text\" from events")
def object_extract(spark, d):
    r = _replies(spark, d).where("event_id % 5 in (1, 3, 4)").unionByName(_replies(spark, d).where("event_id % 5 not in (1, 3, 4)").withColumn("content", F.lit("no object")))
    o = r.withColumn("o", completion.parse_object(F.col("content")))
    return o.select("event_id", F.col("o")["number"].alias("number"), F.col("o")["text"].alias("text"))


@query("select doc_id, upper(lang) lang, cast(length(substr(text, 1, 500)) as bigint) n from documents")
def model_extract(spark, d):
    """Prompt, call and parse; the model is a function that says what it was asked about."""
    def model(prompt: str):
        lang, _, text = prompt.partition("|")
        return f'```json\n[{{"lang": "{lang.upper()}", "n": {len(text)},}}]\n```', len(prompt), 9, 0.0

    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    done = completion.extract(docs, T.prompt("%s|%s", (F.col("lang"), 20), (F.col("text"), 500)), model, "struct<lang:string,n:bigint>", pause=0)
    return done.select("doc_id", F.col("objects")[0]["lang"].alias("lang"), F.col("objects")[0]["n"].alias("n"))


_ASKED = "(lang || '|' || coalesce(source, ''))"


def _asked(spark: SparkSession, d: str, store: completion.ResultStore) -> DataFrame:
    """Two runs over one store: documents with even ids, then all; prompts repeat, and one in seven gets no reply."""
    def model(prompt: str):
        if len(prompt) % 7 == 0:
            raise RuntimeError("no reply")
        return prompt.upper(), len(prompt), 1, 0.25

    docs = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("|"), F.coalesce("source", F.lit(""))).alias("prompt"))
    policy = completion.Policy(tries=1, pause=0)
    completion.complete(docs.where("doc_id % 2 = 0"), "prompt", model, store=store, policy=policy)
    return completion.complete(docs, "prompt", model, store=store, policy=policy)


@query(f"""with p as (select doc_id, {_ASKED} prompt from documents), e as (select distinct prompt from p where doc_id % 2 = 0)
           select doc_id, case when length(prompt) % 7 <> 0 then upper(prompt) end content, length(prompt) % 7 <> 0 ok, prompt in (from e) and length(prompt) % 7 <> 0 cached from p""")
def model_store(spark, d):
    """Results of a second run: what the first one stored isn't called again, what failed is."""
    return _asked(spark, d, completion.ResultStore(spark, scratch.new_path(spark, "results"))).select("doc_id", "content", "ok", "cached")


@query(f"""with p as (select distinct {_ASKED} prompt from documents where lang is not null), e as (select distinct {_ASKED} prompt from documents where doc_id % 2 = 0)
           select count_if(length(prompt) % 7 <> 0 and prompt in (from e)) hits, count_if(length(prompt) % 7 = 0 or prompt not in (from e)) misses, count_if(length(prompt) % 7 = 0) failed,
                  sum(case when length(prompt) % 7 <> 0 and prompt not in (from e) then 0.25 else 0 end)::double cost from p""")
def model_store_stats(spark, d):
    """Prompts the store knew, called for and failed in the second run, and what its calls cost."""
    done = scratch.written(_asked(spark, d, completion.ResultStore(spark, scratch.new_path(spark, "results"))), "store-run")
    cost = completion.paid_calls(done).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")).first()[0]
    return completion.call_stats(done).withColumn("cost", F.lit(cost))


@query(f"""with {QUESTIONS}, q as (select doc_id, number, case when length(doc_id) % 2 = 0 then case when number % 20 = 0 then 4 else 0 end else number % 5 end k from questions_),
           c as (select doc_id, count_if(k = 0) / count(*) c1, count_if(k <= 1) / count(*) c2 from q group by doc_id),
           r as (select doc_id, number, k, case when k = 0 then 1 when k = 1 and c1 < 0.9 then 2 when k = 2 and c1 < 0.9 and c2 < 0.9 then 3 end rd from q join c using (doc_id))
           select doc_id, number, case when rd is not null then chr(65 + number::int % 5) end answer, rd::int "round" from r""")
def answers_covered(spark, d):
    """Questions of an exam asked 25 at a time; with each attempt the model answers more of them."""
    def model(prompt: str):
        attempt, said = int(prompt.split()[1]), {}
        for line in prompt.splitlines():
            if line.startswith("item "):
                k, number = (int(x) for x in line.split()[1:])
                if k < attempt:
                    said[str(number)] = "abcde"[number % 5] + " (!)"
        return "Here: " + str(said).replace("'", '"'), 1, 1, 0.0

    n = F.col("number")
    k = F.when(F.length("doc_id") % 2 == 0, F.when(n % 20 == 0, 4).otherwise(0)).otherwise(n % 5)
    q = as_questions(spark, d).select("doc_id", "number", F.format_string("item %d %d", k, n).alias("text"), F.create_map(F.lit("A"), F.lit("x")).alias("propositions"))
    return completion.solve_questions(q, model, policy=completion.Policy(pause=0)).select("doc_id", "number", "answer", "round")


@query(f"""with {PAGES}, p as (select doc_id, page, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) t from pages_) select doc_id, page fix, page, md5(t) md5 from p where page % 2 = 1
           union all select doc_id, page, page + 1, md5(page || ' next') from p where page % 2 = 1""")
def fix_parse(spark, d):
    p = as_pages(spark, d).withColumn("t", T.normalize_text(F.col("text")))
    block = F.when(F.col("page") % 2 == 1, F.format_string("FIX_%d\nPAGE_%d: %s\nPAGE_%d:\n %d next\nEND_FIX_%d", "page", "page", "t", F.col("page") + 1, "page", "page")).otherwise(F.format_string("NO_FIX_%d", "page"))
    return completion.parse_fix_blocks(p.select("doc_id", block.alias("content"))).select("doc_id", "fix", "page", F.md5("text").alias("md5"))


@query(f"""with {PAGES} select doc_id, page, md5(case when page % 3 = 0 then 'fixed ' || page else text end) md5, page % 3 = 0 fixed from pages_""")
def fix_apply(spark, d):
    p = as_pages(spark, d)
    block = F.format_string("FIX_%d\nPAGE_%d: fixed %d\nEND_FIX_%d", "page", "page", "page", "page")
    blocks = completion.parse_fix_blocks(p.where("page % 3 = 0").select("doc_id", block.alias("content")))
    return completion.apply_fix_blocks(p, blocks).select("doc_id", "page", F.md5("text").alias("md5"), "fixed")


@query("select event_id, case when event_id % 7 = 0 or event_type = 'error' then 'error' when event_type = 'purchase' then 'ok' when event_type = 'view' then 'warn' else 'info' end type from events")
def log_classify(spark, d):
    mark = F.when(F.col("event_type") == "error", "❌ failed ").when(F.col("event_type") == "purchase", "[OK] ").when(F.col("event_type") == "view", "⚠️ ").otherwise("")
    return table(spark, d, "events").select("event_id", T.log_type(F.concat(mark, F.col("props"), F.when(F.col("event_id") % 7 == 0, " ERROR 5").otherwise(""))).alias("type"))


@query("select doc_id, md5('Analyse (' || lang || '):' || chr(10) || substr(text, 1, 2000)) md5 from documents")
def prompt_build(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.prompt("Analyse (%s):\n%s", (F.col("lang"), 20), (F.col("text"), 2000))).alias("md5"))


@query("select doc_id, case when contains(text, 'tion') then 'tion' else upper(lang) end category, case when contains(text, 'tion') then 'rule' else 'model' end \"method\" from documents")
def cascade_route(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")

    def model(rest: DataFrame) -> DataFrame:
        done = completion.complete(rest, "lang", lambda p: (p.upper(), len(p), 1, 0.0), pause=0)
        return done.withColumnRenamed("content", "category").select("doc_id", "category")

    return completion.cascade(docs, F.when(F.contains("text", F.lit("tion")), "tion"), model, "category").select("doc_id", "category", "method")


@query("select case when contains(text, 'tion') then 'rule' else 'model' end \"method\", count(*) n from documents group by 1")
def method_counts(spark, d):
    done = completion.cascade(table(spark, d, "documents").select("doc_id", "text"), F.when(F.contains("text", F.lit("tion")), "tion"), lambda rest: rest.withColumn("category", F.lit("other")), "category")
    return completion.method_counts(done)


# ---- matching

def _bank(spark, d):
    """Questions: all benchmark items. Reference bank: all distinct lines of the documents."""
    source = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.normalize_text(F.col("text")).alias("t"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    ref = lines.select(F.concat_ws("-", "doc_id", "no").alias("id"), T.normalize_text(F.col("line")).alias("t")).where("t <> ''").groupBy("t").agg(F.min("id").alias("id"))
    return source.withColumn("id", F.col("id").cast("string")), ref.select("id", "t")


@query()
def fuzzy_match(spark, d):
    """Flagship: questions against the bank, top 5, tier."""
    m = match.fuzzy_match(*_bank(spark, d))
    return m.select("source_id", "qcm_id", "ref_id", F.round("similarity", 6).alias("similarity"), F.size("candidates").alias("n_candidates"), "tier")


_LCS = """list_reduce(list_transform(ca, lambda x: list_transform(cb, lambda y: cast(x = y as integer))), lambda old, m: list_transform(range(1, len(m) + 1),
          lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when m[k] = 1 then case when k > 1 then old[k - 1] else 0 end + 1 else old[k] end))), list_transform(cb, lambda y: 0))[-1]"""


def _sides(column: str) -> str:
    norm = lambda c: f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"
    return f"select min(p_partkey) id, {norm(column)} t, {norm('min(p_brand)')} c from part group by {column}"


@query(f"""with s as ({_sides('p_name')}), r as ({_sides('p_type')}), p as (select s.id source_id, r.id ref_id, s.t st, s.c sc, r.t rt, r.c rc from s, r where length(s.t) >= 5),
           x as (select *, string_split(st, '') ca, string_split(rt, '') cb from p), y as (select * exclude (ca, cb), 2.0 * {_LCS} / (length(st) + length(rt)) ts from x),
           f as (select *, string_split(sc, '') ca, string_split(rc, '') cb from (select *, row_number() over (partition by source_id order by ts desc, ref_id) k from y) where k <= 20),
           g as (select source_id, ref_id, 0.7 * ts + (1 - 0.7) * case when sc = '' or rc = '' then 0 else 2.0 * {_LCS} / (length(sc) + length(rc)) end similarity from f),
           h as (select *, row_number() over (partition by source_id order by similarity desc, ref_id) rank from g where similarity >= 0.3)
           select source_id, ref_id, round(similarity, 6) similarity, cast(rank as integer) rank from h where rank <= 5""")
def fuzzy_weighted(spark, d):
    names = lambda c: table(spark, d, "part").groupBy(F.col(c).alias("t0")).agg(F.min("p_partkey").alias("id"), F.min("p_brand").alias("c0"))
    s = names("p_name").select("id", T.normalize_text(F.col("t0")).alias("t"), T.normalize_text(F.col("c0")).alias("c"))
    r = names("p_type").select("id", T.normalize_text(F.col("t0")).alias("t"), T.normalize_text(F.col("c0")).alias("c"))
    return match.weighted_match(s, r, 0.3).select("source_id", "ref_id", F.round("similarity", 6).alias("similarity"), "rank")


def _scores(spark, d):
    e = table(spark, d, "events").withColumn("s", F.pmod(F.col("event_id") * 37, F.lit(101)) / 100)
    side = lambda c: F.struct(F.col("event_id").alias("Num"), F.col(c).alias("Text"), F.lit("AB").alias("Correct"), F.year("ts").alias("Year"), F.col("event_type").alias("subcategoryName"))
    return e.select(F.md5(F.col("event_id").cast("string")).alias("qcm_id"), F.col("s").alias("similarity"), F.col("s").alias("text_similarity"), F.lit(None).cast("double").alias("corr_similarity"), side("props").alias("source"), side("event_type").alias("ref"))


_S = "s as (select *, (event_id * 37 % 101) / 100 s from events)"


@query(f"with {_S} select count(*) matched, round(avg(s), 4) mean_similarity, count(*) filter (where s >= 0.9) green, count(*) filter (where s >= 0.75 and s < 0.9) yellow, count(*) filter (where s < 0.75) red from s where s > 0")
def match_summary(spark, d):
    return match.match_summary(_scores(spark, d))


_OWN = "cast(event_id as varchar) source_num, props source_question, 'AB' source_correct, cast(year(ts) as varchar) source_year, event_type source_sub"
_REF = "cast(event_id as varchar) ref_num, event_type ref_question, 'AB' ref_correct, cast(year(ts) as varchar) ref_year, event_type ref_sub"
_BAND = "case when s >= 0.9 then 'green' when s >= 0.75 then 'yellow' else 'red' end"


@query(f"with {_S} select {_OWN}, printf('%.1f%%', s * 100) match_score, printf('%.1f%%', s * 100) text_score, '' corr_score, 'text_only' \"mode\", {_REF}, {_BAND} band from s where s > 0")
def match_report(spark, d):
    return match.match_report(_scores(spark, d))


@query(f"with {_S} select md5(cast(event_id as varchar)) qcm_id, row_number() over (order by s desc, md5(cast(event_id as varchar))) place from s")
def match_order(spark, d):
    """Matches best first; the place is that of the row in this order."""
    m = match.order_matches(_scores(spark, d).withColumn("source_id", F.col("qcm_id"))).withColumn("down", -F.col("similarity"))
    return scratch.with_index(m.select("qcm_id", "down"), ["down", "qcm_id"], "place").select("qcm_id", (F.col("place") + 1).alias("place"))


@query(f"with {_S} select md5(cast(event_id as varchar)) qcm_id, s similarity, case when s = 0 then 'No match' else printf('%.1f%%', s * 100) end label from s where s between 0 and 0.6")
def match_export(spark, d):
    return match.match_export(_scores(spark, d)).select("qcm_id", "similarity", "label")


_SHEET = f"""md5(cast(event_id as varchar)) "ID", cast(event_id as varchar) "Num", props "Question", '' "A", '' "B", '' "C", '' "D", '' "E", 'AB' "Correct", cast(year(ts) as varchar) "Year", '' "Category", event_type "Subcategory", '' "Tag", '' "Source",
    case when s = 0 then 'No match' else printf('%.1f%%', s * 100) end "Similarity", cast(event_id as varchar) "Ref #", event_type "Ref Question", 'AB' "Ref Correct", cast(year(ts) as varchar) "Ref Year", case when s = 0 then 'grey' else {_BAND} end band"""


@query(f"with {_S} select {_SHEET} from s where s between 0.2 and 0.95 or s = 0")
def match_sheet(spark, d):
    m = _scores(spark, d)
    return match.export_sheet(match.match_export(m, 0.2, 0.95).unionByName(match.match_export(m, 0.0, 0.0)))


@query(f"with {_S} select {_SHEET} from s where event_type = 'purchase'")
def match_sheet_ids(spark, d):
    """The export of a list of ids, some of them named twice."""
    ids = table(spark, d, "events").where("event_type = 'purchase'").select(F.md5(F.col("event_id").cast("string")).alias("qcm_id"))
    return match.export_sheet(match.match_export(_scores(spark, d), ids=ids.unionByName(ids)))


@query("""select o_orderkey key, cast(o_orderkey as varchar) num, coalesce(case when o_orderkey % 2 = 0 then o_orderstatus end, o_orderpriority) txt, coalesce(cast(year(o_orderdate) as varchar), '') yr, '' a, o_orderstatus || ', ' || o_orderpriority tag from orders""")
def slim_record(spark, d):
    """Short records, with names in lower case where the usual ones are missing or null, and full ones with their tags joined."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("num"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("text_"), F.col("o_orderpriority").alias("other"), F.year("o_orderdate").alias("Year"), F.array("o_orderstatus", "o_orderpriority").alias("Tag"))
    o = o.withColumn("Text", F.coalesce("text_", "other"))
    r = o.select(F.col("num").alias("key"), match.slim(o).alias("s"), match.full(o).alias("f"))
    return r.select("key", F.col("s.Num").alias("num"), F.col("s.Text").alias("txt"), F.col("s.Year").alias("yr"), F.col("s.A").alias("a"), F.col("f.Tag").alias("tag"))


# ---- what is kept beside the rows

@query(f"with {_S} select md5(cast(event_id as varchar)) qcm_id, s similarity, case when s = 0 then 'No match' else printf('%.1f%%', s * 100) end label from s where s between 0.3 and 0.62")
def match_saved(spark, d):
    """The export of a range from saved matches."""
    path = scratch.new_path(spark, "matches")
    io.save_matches(_scores(spark, d), path)
    saved = io.load_matches(spark, path, 0.3, 0.62)
    return match.match_export(saved, 0.3, 0.62).select("qcm_id", "similarity", "label")


@query(f"""with {PAGES}, j as (select *, sum(case when page % 5 in (2, 3) then 0 else 1 end) over (partition by doc_id order by page) island from pages_), c as (select count(*) n from j group by doc_id, island)
           select 'chains' trail, sum(n)::bigint n_rows, sum(n - 1)::bigint changed from c union all select 'fixes', count(*), count_if(page % 3 = 0) from pages_
           union all select 'cascade', count(*), count_if(not contains(text, 'tion')) from documents where text is not null""")
def trail_totals(spark, d):
    """Totals that the operators count in the pass that writes their rows."""
    p = as_pages(spark, d)
    splits = p.where("page % 5 in (2, 3)").select("doc_id", (F.col("page") - 1).alias("page"), F.col("page").alias("next_page"))
    block = F.format_string("FIX_%d\nPAGE_%d: fixed %d\nEND_FIX_%d", "page", "page", "page", "page")
    blocks = completion.parse_fix_blocks(p.where("page % 3 = 0").select("doc_id", block.alias("content")))
    chains, fixes, routes = Observation("chains"), Observation("fixes"), Observation("routes")
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    for rows in (
        pages.merge_chains(p, splits, chains), completion.apply_fix_blocks(p, blocks, fixes),
        completion.cascade(docs, F.when(F.contains("text", F.lit("tion")), "tion"), lambda rest: rest.withColumn("category", F.lit("other")), "category", routes),
    ):
        scratch.forget(scratch.written(rows, "trail"))
    c, f, r = chains.get, fixes.get, routes.get
    return spark.createDataFrame([("chains", c["pages"], c["merged"]), ("fixes", f["pages"], f["fixed"]), ("cascade", r["rule"] + r["model"], r["model"])], "trail string, n_rows long, changed long")


@query("""with n as (select r_name domain, n_name module, n_nationkey k from nation join region on r_regionkey = n_regionkey)
          select domain, module, (row_number() over (partition by domain order by module) - 1)::int module_ord, case when k % 2 = 0 then 'about ' || module end focus, case when k % 2 = 0 then 2 else 0 end n_keywords from n
          where domain in (select r_name from region where r_regionkey < 3)""")
def modules_load(spark, d):
    """A module file, half of the modules with nothing but their name, read as a dimension; of five domains three are asked for."""
    path = scratch.new_path(spark, "modules")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rich = F.struct(F.concat(F.lit("about "), "n_name").alias("focus"), F.array("n_name", F.lit("x")).alias("keywords"))
    entry = F.struct(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, rich).otherwise(F.struct(F.lit(None).cast("string").alias("focus"), F.lit(None).cast("array<string>").alias("keywords"))).alias("value"))
    domains = n.groupBy("r_name").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    whole = domains.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "m")))).alias("value"))  # a dimension of 25 rows
    whole.write.text(path)
    wanted = tuple(r["r_name"] for r in table(spark, d, "region").where("r_regionkey < 3").collect())
    return io.load_modules(spark, path, wanted).select("domain", "module", "module_ord", "focus", F.size("keywords").alias("n_keywords"))


@query(f"""with {PAGES} select doc_id, page, case when page % 4 <> 0 and page % 2 <> 0 then 'begin ' || page || ' ' || repeat('x', 50) end fixed, case when page % 4 <> 0 and page % 2 <> 0 then 'next ' || (page + 1) || ' ' || repeat('y', 20) end next_fixed from pages_""")
def marker_parse(spark, d):
    """Both pages between their marks; nothing where one is missing (every fourth) or too short (every second)."""
    p = as_pages(spark, d).select("doc_id", "page", (F.col("page") + 1).alias("next_page"))
    body = F.when(F.col("page") % 2 == 0, "short").otherwise(F.concat(F.lit("begin "), "page", F.lit(" " + "x" * 50)))
    second = F.when(F.col("page") % 4 == 0, "").otherwise(F.format_string("START_PAGE_%d next %d %s END_PAGE_%d", "next_page", "next_page", F.lit("y" * 20), "next_page"))
    content = F.concat(F.format_string("Sure:\nSTART_PAGE_%d\n%s\nEND_PAGE_%d\n", "page", body, "page"), second)
    return completion.parse_page_markers(p.withColumn("content", content)).select("doc_id", "page", "fixed", "next_fixed")


@query("select conv_id doc_id, turn page, cast(null as varchar) cas from conversations")
def carry_nothing(spark, d):
    """Where no case begins, nothing is carried."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("trigger"))
    return metadata.carry_forward(c, "trigger").select("doc_id", "page", "cas")


@query("""select o_orderkey number, nullif(case when o_orderkey % 4 = 0 then o_orderstatus else '' end, '') s, coalesce(nullif(case when o_orderkey % 4 = 0 then o_orderstatus else '' end, ''), g) g,
          coalesce(nullif(case when o_orderkey % 4 = 0 then o_orderstatus else '' end, ''), g, case when o_orderpriority like '1%' then 'urgent' end) a
          from orders left join (select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment end g from customer) on c_custkey = o_custkey""")
def metadata_strategies(spark, d):
    """One field under each strategy: skipped, document values only, both values but no fallback."""
    own = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).otherwise("")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("number"), *[own.alias(n) for n in "sga"])
    given = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    per_doc = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), *[given.alias(n) for n in "sga"])
    urgent = F.when(F.startswith("file", F.lit("1")), "urgent")
    per_file = o.select("doc_id", "file").distinct().select("doc_id", "file", *[urgent.alias(n) for n in "sga"])
    return metadata.fill_metadata(o, list("sga"), per_doc, per_file, {n: "none" for n in "sga"}, {"s": "S", "g": "G", "a": "A"}).select("number", *"sga")


# ---- streams, over files that the query writes from the tables

@query("""select event_id, case when event_id % 7 = 0 or event_type = 'error' then 'error' else 'info' end type from events where event_type <> 'view'""")
def log_tail(spark, d):
    """Log lines by the stream, appended to files between two triggers; a blank line for every view."""
    path, out, checkpoint = (scratch.new_path(spark, n) for n in ("logs", "tailed", "tail-checkpoint"))
    said = F.when(F.col("event_type") == "view", "  ").otherwise(F.concat("event_id", F.lit(" "), "event_type", F.when(F.col("event_type") == "error", " ERROR").otherwise(""), F.when(F.col("event_id") % 7 == 0, " ERROR 5").otherwise("")))
    lines = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.lit("p").alias("project"), F.lit("1").alias("step"), "ts", said.alias("text"))).alias("value"))
    for part in (0, 1):
        lines.where(F.col("event_id") % 2 == part).select("value").write.mode("append").text(path)
        stream = jobs.tail_logs(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.split("text", " ")[0].cast("long").alias("event_id"), "type")


@query("""with c as (select c_custkey // 3 k, c_custkey % 3 chunk, c_name from customer where c_custkey % 7 <> 0)
          select 'd' || (k % 100) doc_id, cast(k + 1 as integer) number, arg_max(c_name, chunk) v, (select count(distinct k) from c where chunk <= 1) - (select count(*) from c where chunk = 0) added,
                 (select count(*) from c where chunk <= 1) - (select count(distinct k) from c where chunk <= 1) updated from c group by k""")
def stream_upsert(spark, d):
    """Three chunks of questions into one table by the stream, and what the second one added and updated."""
    source, target, checkpoint = (scratch.new_path(spark, n) for n in ("chunks", "questions", "upsert-checkpoint"))
    schema = "doc_id string, page int, number int, v string"
    k = F.floor(F.col("c_custkey") / 3)
    rows = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.concat(F.lit("d"), k % 100).alias("doc_id"), F.lit(1).alias("page"), (k + 1).alias("number"), F.col("c_name").alias("v"), (F.col("c_custkey") % 3).alias("chunk"))
    counts = {}
    for chunk in range(3):
        rows.where(F.col("chunk") == chunk).drop("chunk").write.mode("append").json(source)
        jobs.accumulate(spark, source, schema, target, checkpoint, slots=16).awaitTermination()
        counts[chunk] = jobs.changes(spark, target)
    got = jobs.current(spark, target, schema).select("doc_id", "number", "v")
    return got.withColumns({n: F.lit(counts[1][n]).cast("long") for n in ("added", "updated")})
