"""Metadata, clinical cases, categories, output template."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import first_nonempty, nonempty
from ..sources.scratch import written


def carry_forward(rows: DataFrame, value: str, partition: str = "doc_id", order: tuple[str, ...] = ("page", "pos"), out: str = "cas") -> DataFrame:
    """Each row gets the last ``value`` at or before it in its document: a case holds until the next one, across pages."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def case_summary(rows: DataFrame) -> DataFrame:
    """Questions of each case on each page, cases numbered by first appearance; ``label`` is the text before the line break, null for standalone ones."""
    per = rows.groupBy("doc_id", "cas", "page").agg(F.sort_array(F.collect_list("number")).alias("numbers"), F.min("pos").alias("first_pos"))
    begin = F.min(F.struct("page", "first_pos")).over(Window.partitionBy("doc_id", "cas"))
    per = per.withColumn("begin", begin)
    rank = F.dense_rank().over(Window.partitionBy("doc_id", F.col("cas").isNull()).orderBy("begin"))
    return per.select("doc_id", F.when(F.col("cas").isNotNull(), rank).alias("case_no"), F.split("cas", "\r\n", 2)[0].alias("label"), "page", "numbers", F.size("numbers").alias("n"))


def fill_metadata(rows: DataFrame, fields: list[str], per_doc: DataFrame, per_file: DataFrame, fallback: Mapping[str, str] | None = None, strategy: Mapping[str, str] | None = None) -> DataFrame:
    """Missing ``fields`` from the document's value, then the file's, then the fallback.

    ``strategy`` of a field: ``G`` document values only, ``P`` file values and fallback too (default), ``A`` both
    values, ``S`` skip. ``per_doc``: doc_id and fields; ``per_file``: doc_id, file and fields.
    """
    fallback, strategy = fallback or {}, strategy or {}
    d = per_doc.groupBy("doc_id").agg(*[F.max(f).alias(f"_d_{f}") for f in fields])  # a repeated key must not double rows
    p = per_file.groupBy("doc_id", "file").agg(*[F.max(f).alias(f"_p_{f}") for f in fields])
    out = rows.join(d, "doc_id", "left").join(p, ["doc_id", "file"], "left")
    for f in fields:
        how = strategy.get(f, "P")
        given = [F.col(f)] + [F.col(f"_d_{f}")] * (how in "GPA") + [F.col(f"_p_{f}")] * (how in "PA") + [F.lit(fallback.get(f))] * (how == "P")
        out = out.withColumn(f, first_nonempty(*[c.cast("string") for c in given]))
    return out.select(*rows.columns)


def tag(source: Column, year: Column) -> Column:
    """The non-empty ones of source and year."""
    return F.array_compact(F.array(nonempty(source.cast("string")), nonempty(year.cast("string"))))


def confident(guesses: DataFrame, least: float = 0.6) -> DataFrame:
    """Guesses (``field, value, confidence``) that are sure enough."""
    return guesses.where(F.col("confidence") >= least)


def domain_of(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(t, F.lit("chir")), "chirurgie").when(F.contains(t, F.lit("bio")), "biologie").otherwise("medecine")


def keyword_category(rows: DataFrame, modules: DataFrame, text: str = "text", key: str = "doc_id", most: int = 32 << 20) -> DataFrame:
    """``key, module, keyword`` of the longest keyword a text holds, in its domain (both have ``domain``), ties by module order.

    ``modules``: ``domain, module, module_ord, keywords``. One pass of an automaton over a text finds all of its
    keywords, however many there are; keywords of up to ``most`` bytes are shipped to the tasks once, of more each
    text is joined with its domain's. Null and empty texts hold no keyword but the empty one.
    """
    words = modules.select("domain", "module", "module_ord", F.explode("keywords").alias("keyword")).where("keyword is not null and domain is not null")
    words = words.withColumn("low", F.lower("keyword"))
    best = F.min(F.struct((-F.length("keyword")).alias("short"), "module_ord", "keyword", "module")).alias("b")
    texts = rows.select(F.col(key).alias("key"), "domain", F.lower(text).alias("t"))
    if (words.agg(F.sum(F.octet_length("low") + F.octet_length("module") + 16)).first()[0] or 0) > most:
        hit = texts.join(words, "domain").where(F.contains("t", "low")).groupBy("key").agg(best)
    else:
        kept = words.groupBy("domain", "low").agg(best).select("domain", "low", "b.*")
        hit = texts.where("t is not null").mapInArrow(_longest(kept), f"key {dict(texts.dtypes)['key']}, b {kept.select(F.struct('short', 'module_ord', 'keyword', 'module').alias('b')).schema['b'].dataType.simpleString()}")
        hit = hit.groupBy("key").agg(F.min("b").alias("b"))
    return hit.select(F.col("key").alias(key), "b.module", "b.keyword")


def _longest(words: DataFrame):
    """A task's function: of each text the best keyword, by an automaton over the keywords of all domains."""
    spark = words.sparkSession
    shipped = spark.sparkContext.broadcast([(r["domain"], r["low"], (r["short"], r["module_ord"], r["keyword"], r["module"])) for r in words.collect()])  # of a checked size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[str, tuple]] = {}
        for domain, low, value in shipped.value:
            found.setdefault(low, {})[domain] = value
        everywhere, automaton = found.pop("", {}), ahocorasick.Automaton()
        for low, by in found.items():
            automaton.add_word(low, by)
        automaton.make_automaton()
        for b in batches:
            keys, out = [], []
            for k, (domain, text) in enumerate(zip(b["domain"].to_pylist(), b["t"].to_pylist(), strict=True)):
                top = everywhere.get(domain)
                for by in {id(by): by for _, by in automaton.iter(text)}.values() if found else ():
                    value = by.get(domain)
                    if value is not None and (top is None or value < top):
                        top = value
                if top is not None:
                    keys.append(k), out.append(dict(zip(("short", "module_ord", "keyword", "module"), top, strict=True)))
            yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(keys, pa.int64())), pa.array(out, kind)], ["key", "b"])

    kind = to_arrow_type(words.select(F.struct("short", "module_ord", "keyword", "module").alias("b")).schema["b"].dataType)
    return run


def resolve_module(rows: DataFrame, modules: DataFrame, answer: str = "answer", key: str = "doc_id") -> DataFrame:
    """The module that a reply names: equal, else contained (first in order), else ``Autre``."""
    m = modules.select("domain", "module", "module_ord", F.lower("module").alias("m"))
    r = rows.withColumn("_t", F.translate(F.trim(F.lower(answer)), "\"'", ""))
    hit = r.select(key, "domain", "_t").join(m, "domain").where(F.contains("_t", F.col("m")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("m") == F.col("_t"), 0).otherwise(1), "module_ord"))
    best = hit.withColumn("rn", rank).where("rn = 1").select(key, "module")
    return rows.join(best, key, "left").withColumn("module", F.coalesce("module", F.lit("Autre")))


def nearest_module(names: DataFrame, modules: DataFrame, least: float = 0.6, block: int = 512, part: int = 4096) -> DataFrame:
    """``name, module, confidence`` of distinct names: equal 1, else the larger of sequence ratio and 0.85 where one contains the other; above ``least``.

    The ratio of two texts depends on which comes first and has no lower bound by common parts that would make an
    equi-join, so names and modules meet in bounded blocks. Inside one, lengths and letter bags bound each ratio from above:
    modules are scored best bound first until none can beat the best so far.
    """
    n = names.select("name").distinct().withColumn("n", F.trim(F.lower("name"))).where("n <> ''")
    m = modules.select("module", F.col("module_ord").cast("long").alias("module_ord"), F.lower("module").alias("m")).where("m is not null")
    n = written(n, "nearest-names")
    cut, parts = (max(1, -(-x.count() // size)) for x, size in ((m, block), (n, part)))
    asked = n.select("name", "n", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(cut - 1))).alias("block"))
    lists = m.select("*", F.pmod(F.xxhash64("module", "module_ord"), F.lit(cut)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            nearest = Nearest(sorted(zip(right["module_ord"].to_pylist(), right["m"].to_pylist(), right["module"].to_pylist(), strict=True)))
            for name, text in zip(left["name"].to_pylist(), left["n"].to_pylist(), strict=True):
                score, k = nearest.best(text, least)
                if k is not None:
                    out.append((name, score, nearest.modules[k][0], nearest.modules[k][2]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("name", "confidence", "module_ord", "module"), columns, (pa.string(), pa.float64(), pa.int64(), pa.string()), strict=True)})

    made = asked.groupBy("block", "part").cogroup(lists.groupBy("block", "part")).applyInArrow(best, "name string, confidence double, module_ord long, module string")
    made = made.groupBy("name").agg(F.max(F.struct("confidence", (-F.col("module_ord")).alias("first"), "module")).alias("b"))
    return made.where(F.col("b.confidence") > least).select("name", "b.module", "b.confidence")


class Nearest:
    """Modules ``(module_ord, lower-case name, name)`` in order, searched by bounds; ``scored`` counts the sequence ratios worked out."""

    def __init__(self, modules: list[tuple[int, str, str]]):
        self.modules, self.scored = modules, 0
        self.letters = {c: k for k, c in enumerate(sorted({c for _, m, _ in modules for c in m}))}
        self.bags = np.array([self._bag(m) for _, m, _ in modules])
        self.lengths = np.array([len(m) for _, m, _ in modules])
        self.matchers = [difflib.SequenceMatcher(None, "", m) for _, m, _ in modules]

    def _bag(self, text: str) -> np.ndarray:
        return np.bincount([self.letters[c] for c in text if c in self.letters], minlength=len(self.letters))

    def best(self, text: str, least: float) -> tuple[float, int | None]:
        """(score, place) of the nearest module above ``least``, the first of equal ones."""
        bound = 2 * np.minimum(self._bag(text), self.bags).sum(axis=1) / np.maximum(self.lengths + len(text), 1)
        inside = np.array([m in text or text in m for _, m, _ in self.modules])
        bound = np.where(inside, np.maximum(bound, 0.85), bound)
        top, place = least, None
        for k in np.lexsort((np.arange(len(bound)), -bound)).tolist():
            if bound[k] < top - 1e-12 or (place is None and bound[k] <= least):
                break
            if text == self.modules[k][1]:
                score = 1.0
            else:
                self.scored += 1
                self.matchers[k].set_seq1(text)
                score = max(self.matchers[k].ratio(), 0.85 if inside[k] else 0.0)
            if score > top or (place is not None and score == top and k < place):
                top, place = score, k
        return top, place


#: Names a template column may have in the input.
ALIASES: dict[str, tuple[str, ...]] = {
    "Num": ("number", "Num", "id", "num"),
    "Text": ("text", "Text", "question", "questionText"),
    "Correct": ("correction", "Correct", "answer"),
    "categoryName": ("module", "categoryName", "module_detected"),
    "subcategoryName": ("subcategory", "subcategoryName"),
    "tagSuggere": ("tagSuggere", "domain", "domain_tag"),
    "Year": ("year", "Year"),
    "Source": ("source", "Source"),
    "Tag": ("tag", "Tag"),
    "Cas": ("cas", "Cas", "clinical_case"),
}
TEMPLATE = ("Num", "Cas", "Text", "A", "B", "C", "D", "E", "Correct", "Exp", "categoryName", "tagSuggere", "subcategoryName", "Year", "Tag", "Type")


def map_template(rows: DataFrame, template: tuple[str, ...] = TEMPLATE, keep: tuple[str, ...] = ("doc_id",), samples: Mapping[str, str] | None = None) -> DataFrame:
    """Template columns from the names the input has; options from columns A to E, else from ``propositions``.

    The first non-empty alias wins; ``samples`` gives values for what stays empty (default null). ``Cas`` is
    always carried.
    """
    # case matters: "text" and "Text" may both stand in the input
    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = []
    for name in dict.fromkeys([*template, "Cas"]):
        given = [F.col(c) if have[c] != "array<string>" else F.array_join(c, ", ") for c in (*ALIASES.get(name, ()), name) if c in have]
        if name in "ABCDE" and "propositions" in have:
            given += [F.col("propositions")[name], F.col("propositions")[name.lower()]]
        given += [F.lit(samples[name])] if samples and name in samples else []
        value = first_nonempty(*[c.cast("string") for c in given]) if given else F.lit(None).cast("string")
        out.append((value.cast("int") if name == "Num" else value).alias(name))
    return rows.select(*keep, *out)
