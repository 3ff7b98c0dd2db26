"""Model completions as a table function, answers until enough are there, cascades of rules before models, parsing of replies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import json_body, json_repair
from ..sources.scratch import written
from .calls import Model, Policy, ResultStore, call_key, results_of

#: What ``complete`` adds.
ADDED = ("content", "model", "prompt_tokens", "completion_tokens", "cost", "ok", "error", "cached", "call_key")


def aside(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``rows`` whose columns with one of ``names`` are called ``<name>_in`` (or with more ``_in`` where that is taken)."""
    have, renamed = set(rows.columns), {}
    for name in (c for c in rows.columns if c in names):
        new = name + "_in"
        while new in have:
            new += "_in"
        have.add(new)
        renamed[name] = new
    return rows.withColumnsRenamed(renamed)


def complete(
    rows: DataFrame, prompt: str, primary: Model, fallback: Model | None = None, tries: int = 3, pause: float = 1.0, names: tuple[str, str] = ("primary", "fallback"),
    store: ResultStore | None = None, attachments: tuple[str, ...] = (), policy: Policy | None = None,
) -> DataFrame:
    """Rows plus ``content, model, prompt_tokens, completion_tokens, cost, ok, error, cached, call_key``.

    The calls are made here, once for every different prompt (with its ``attachments``, columns handed to the model
    after it), and written: what is done with the result later makes none. With a ``store`` only prompts that it
    doesn't know are called; ``cached`` says that a result was there before. A row shows what its call cost, so costs
    are summed over calls (``paid_calls``), not rows. ``policy`` says how calls are made; without one ``tries``, ``pause`` and
    ``names`` do. A call that fails, and a null prompt, leave ``content`` null and ``ok`` false. The caller's columns
    of these names are kept as ``<name>_in``; repeated rows all stay; an empty table gives an empty result.
    """
    policy = policy or Policy(tries=tries, pause=pause, names=names)
    kept = aside(rows, ADDED)
    now = {old: new for old, new in zip(rows.columns, kept.columns, strict=True)}
    keyed = kept.withColumn("call_key", call_key(F.col(now[prompt]), *[F.col(now[a]) for a in attachments]))
    given = F.array(*[F.col(now[a]).cast("binary") for a in attachments]) if attachments else F.lit(None).cast("array<binary>")
    asked = keyed.select("call_key", F.col(now[prompt]).alias("prompt"), given.alias("attachments"))
    out = keyed.join(results_of(asked, primary, fallback, policy, store), "call_key", "left")
    out = out.withColumns({
        "ok": F.coalesce("ok", F.lit(False)), "cached": F.coalesce("cached", F.lit(False)), "error": F.when(F.col("call_key").isNull(), "no prompt").otherwise(F.col("error")),
        **{n: F.coalesce(n, F.lit(0)) for n in ("prompt_tokens", "completion_tokens")}, "cost": F.coalesce("cost", F.lit(0.0)),
    })
    return out.select(*kept.columns, *ADDED)


def paid_calls(done: DataFrame) -> DataFrame:
    """``call_key, model, prompt_tokens, completion_tokens, cost, ok`` of the calls that ``complete`` made, one row a call; what the store had costs nothing."""
    names = ("model", "prompt_tokens", "completion_tokens", "cost", "ok")
    return done.where(~F.col("cached") & F.col("call_key").isNotNull()).groupBy("call_key").agg(*[F.any_value(n).alias(n) for n in names])


def call_stats(done: DataFrame) -> DataFrame:
    """``hits, misses, failed``: how many different prompts the store knew, were called for, and got no reply."""
    one = done.where(F.col("call_key").isNotNull()).groupBy("call_key").agg(F.any_value("cached").alias("cached"), F.any_value("ok").alias("ok"))
    return one.agg(F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"), F.count_if(~F.col("ok")).alias("failed"))


def cascade(rows: DataFrame, rule: Column, model: Callable[[DataFrame], DataFrame], out: str, totals: Observation | None = None) -> DataFrame:
    """``out`` by the rule where it gives a value, else from ``model`` (which adds ``out`` to the rest); ``method`` says which.

    The rule's result is written, so that neither branch works out the input again. The caller's ``method`` is kept
    as ``method_in``, its ``out`` is replaced. ``totals`` gets ``rule, model`` with the first action.
    """
    tried = written(aside(rows, ("method",)).withColumn(out, rule), "cascade")
    done = tried.where(F.col(out).isNotNull()).withColumn("method", F.lit("rule"))
    rest = model(tried.where(F.col(out).isNull()).drop(out)).withColumn("method", F.lit("model"))
    both = done.unionByName(rest, allowMissingColumns=True)
    return both.observe(totals, *[F.count_if(F.col("method") == m).alias(m) for m in ("rule", "model")]) if totals is not None else both


def extract(rows: DataFrame, prompt: Column, primary: Model, schema: str, fallback: Model | None = None, **how) -> DataFrame:
    """Prompt, call and parse in one: ``rows`` with what ``complete`` adds and ``objects``, the reply's objects (null where none can be read).

    The prompt is a column and the models are the caller's, so this is extraction, metadata, categories or
    repair according to what is asked.
    """
    asked = aside(rows, ("objects",))
    name = _free("prompt", asked)
    return parse_replies(complete(asked.withColumn(name, prompt), name, primary, fallback, **how).drop(name), "content", schema)


def _free(name: str, rows: DataFrame) -> str:
    """A column name that ``rows`` doesn't have."""
    while name in rows.columns:
        name = "_" + name
    return name


def until_covered(rows: DataFrame, key: list[str], ask: Callable[[DataFrame, int], DataFrame], by: str = "doc_id", least: float = 0.9, rounds: int = 3) -> DataFrame:
    """``key, by, value, round``: a value for every distinct key, asked for again and again until enough are there.

    ``ask(missing, round)`` gets the keys (``key`` and ``by``) without a value of those groups of ``by`` that have
    less than the share ``least``, and returns ``key, value`` for some of them (nulls and other keys don't count, of
    several values the smallest does). At most ``rounds`` rounds are made, from 1; what has no value then is
    listed with a null. Every round is written, and one that leaves nothing to ask ends the loop.
    """
    every = written(rows.select(*dict.fromkeys([*key, by])).where(F.expr(" and ".join(f"`{k}` is not null" for k in key))).distinct(), "cover-keys")
    sizes = written(every.groupBy(by).agg(F.count(F.lit(1)).alias("n")), "cover-sizes")
    have, missing = None, every
    for turn in range(1, rounds + 1):
        got = ask(missing, turn).where("value is not null").groupBy(*key).agg(F.min("value").alias("value"))
        got = written(missing.join(got, key).withColumn("round", F.lit(turn)), "cover-round")
        have = got if have is None else have.unionByName(got)
        found = have.groupBy(by).agg(F.count(F.lit(1)).alias("found"))
        short = sizes.join(found, sizes[by].eqNullSafe(found[by]), "left").where(F.coalesce("found", F.lit(0)) < least * F.col("n")).select(sizes[by].alias("_short"))
        left = every.join(have.select(*key), key, "left_anti")
        missing = written(left.join(short, left[by].eqNullSafe(F.col("_short")), "left_semi"), "cover-missing")
        if missing.isEmpty():
            break
    rest = every.join(have.select(*key), key, "left_anti")
    return have.unionByName(rest.withColumns({"value": F.lit(None).cast(dict(have.dtypes)["value"]), "round": F.lit(None).cast("int")}))


def solve_questions(questions: DataFrame, primary: Model, fallback: Model | None = None, batch: int = 25, least: float = 0.9, rounds: int = 3, **how) -> DataFrame:
    """``doc_id, number, answer, round`` of questions (``doc_id, number, text, propositions``), asked ``batch`` at a time, those without an answer again.

    A prompt names its questions and its attempt, so that a store never gives the incomplete reply of an earlier
    attempt. The reply is one object, number to letters; letters A to E count, at most five. Questions that repeat a
    number count once; a null number has no answer and no row.
    """
    options = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("propositions", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit("")))), ", ")
    block = F.format_string("\n--- Q%s ---\n%s\nProps: %s\n", F.col("number").cast("string"), F.coalesce("text", F.lit("")), options)
    asked = questions.where("number is not null").groupBy("doc_id", "number").agg(F.min(block).alias("block"))
    asked = written(asked, "solve-questions")

    def ask(missing: DataFrame, turn: int) -> DataFrame:
        rows = asked.join(missing, ["doc_id", "number"], "left_semi")
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("number")) - 1
        rows = rows.withColumn("batch", F.floor(place / batch))
        prompts = rows.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("number", "block"))).alias("q"))
        head = F.format_string("Attempt %d of %d. Solve these questions. Return only a JSON map of question numbers to letters.\nAll %d: %s\n", F.lit(turn), F.lit(rounds), F.size("q"), F.array_join(F.col("q.number").cast("array<string>"), ", "))
        prompts = prompts.select("doc_id", F.concat(head, F.array_join(F.col("q.block"), "")).alias("prompt"))
        replies = complete(prompts, "prompt", primary, fallback, **how)
        said = replies.select("doc_id", F.explode(parse_object(F.col("content"))).alias("number", "said"))
        letters = F.substring(F.regexp_replace(F.upper("said"), "[^A-E]", ""), 1, 5)
        kind = dict(asked.dtypes)["number"]
        return said.select("doc_id", F.col("number").try_cast(kind).alias("number"), F.when(letters != "", letters).alias("value"))

    return until_covered(asked, ["doc_id", "number"], ask, "doc_id", least, rounds).withColumnRenamed("value", "answer")


def method_counts(rows: DataFrame) -> DataFrame:
    """How many rows a ``cascade`` settled by rule and by model."""
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def parse_object(content: Column) -> Column:
    """The one object of a reply as ``map<string,string>``, from its first opening to its last closing brace; null where it can't be read."""
    body = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, "map<string,string>"))


def parse_objects(content: Column, schema: str) -> Column:
    """The objects of a reply, as ``array<schema>``: as they stand, else repaired; null where neither can be read. ``parse_replies`` does less work a row."""
    as_list = lambda c: F.when(F.startswith(c, F.lit("{")), F.concat(F.lit("["), c, F.lit("]"))).otherwise(c)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, f"array<{schema}>"))
    return F.coalesce(good(as_list(json_body(content))), good(as_list(json_repair(content))))


def parse_replies(rows: DataFrame, content: str, schema: str) -> DataFrame:
    """``rows`` with ``objects``, ``array<schema>`` from the replies: as they stand, else repaired; null where neither can be read.

    Bodies are columns of their own, so that each pattern runs once a row, and the repair only where it is needed.
    """
    as_list = lambda c: F.when(F.startswith(c, F.lit("{")), F.concat(F.lit("["), c, F.lit("]"))).otherwise(c)
    plain = rows.withColumn("_body", as_list(json_body(F.col(content))))
    plain = plain.withColumn("_body", F.when(F.try_parse_json("_body").isNotNull(), F.col("_body")).otherwise(as_list(json_repair(F.col(content)))))
    return plain.withColumn("objects", F.when(F.try_parse_json("_body").isNotNull(), F.from_json("_body", f"array<{schema}>"))).drop("_body")


#: What decides how braces pair: escapes, quotes, braces.
_MARKS = re.compile(r'\\.|["{}]', re.S)
_DEEP = 400


def _hopeless(text: str, low: int, high: int, deep: bool) -> set[int]:
    """Where reading began at ``low`` and failed at ``high``: the braces still open there, which fail at the same place; with ``deep`` also those nested too deep."""
    opened: list[list[int]] = []  # place and height so far
    out, quoted = set(), False
    for m in _MARKS.finditer(text, low, high):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif c == "{":
            opened.append([m.start(), 1])
        elif c == "}" and opened:
            at, height = opened.pop()
            if deep and height > _DEEP:
                out.add(at)
            if opened:
                opened[-1][1] = max(opened[-1][1], height + 1)
    return out.union(at for at, _ in opened)


@F.pandas_udf(ArrayType(StringType()))
def salvage_objects(content: pd.Series) -> pd.Series:
    """Every JSON object that can be read anywhere in a broken reply, as JSON text, from left to right, outer ones first.

    A brace that is known to fail where an outer one failed isn't tried again, so a reply cut off inside many objects takes
    one pass. Of an object nested too deep to be read the inner 400 levels are. Null or empty text gives none.
    """
    decoder = json.JSONDecoder()

    def objects(text: str | None) -> list[str]:
        text, out, at = text or "", [], 0
        skip: set[int] = set()
        while (at := text.find("{", at)) >= 0:
            if at not in skip:
                try:
                    found, end = decoder.raw_decode(text, at)
                    out.append(json.dumps(found, ensure_ascii=False, sort_keys=True))
                    at = end
                    continue
                except json.JSONDecodeError as e:
                    skip |= _hopeless(text, at, e.pos, False)
                except RecursionError:
                    skip |= _hopeless(text, at, len(text), True)
            at += 1
        return out

    return content.map(objects)


def parse_page_markers(rows: DataFrame, least: tuple[int, int] = (50, 20)) -> DataFrame:
    """``page, next_page`` texts between START_PAGE_n and END_PAGE_n of a reply (``content``); null where one is missing or too short."""
    def between(n: str) -> Column:
        pattern = F.concat(F.lit(r"(?s)START_PAGE_"), F.col(n), F.lit(r"(?!\d)(.*?)END_PAGE_"), F.col(n), F.lit(r"(?!\d)"))
        return F.regexp_replace(F.get(F.regexp_extract_all("content", pattern, F.lit(1)), F.lit(0)), r"^\s+|\s+$", "")

    out = rows.withColumn("_a", between("page")).withColumn("_b", between("next_page"))
    ok = (F.length("_a") >= least[0]) & (F.length("_b") >= least[1])
    return out.withColumn("fixed", F.when(ok, F.col("_a"))).withColumn("next_fixed", F.when(ok, F.col("_b"))).drop("_a", "_b")


def parse_fix_blocks(replies: DataFrame) -> DataFrame:
    """``doc_id, fix, page, text`` of the FIX_i ... END_FIX_i blocks of a reply (``doc_id, content``), a row for each ``PAGE_n:``."""
    block = r"(?s)(?<!NO_)(?<!END_)FIX_(\d+)\s*\n(.*?)\nEND_FIX_\1"
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(block), 1).alias("fix"), F.regexp_extract_all("content", F.lit(block), 2).alias("body"))
    blocks = replies.select("doc_id", F.explode(both).alias("b")).select("doc_id", F.col("b.fix").cast("int").alias("fix"), F.col("b.body").alias("body"))
    page = r"(?s)PAGE_(\d+):\s*(.*?)(?=PAGE_|$)"
    pages = F.arrays_zip(F.regexp_extract_all("body", F.lit(page), 1).alias("page"), F.regexp_extract_all("body", F.lit(page), 2).alias("text"))
    out = blocks.select("doc_id", "fix", F.explode(pages).alias("p"))
    return out.select("doc_id", "fix", F.col("p.page").cast("int").alias("page"), F.regexp_replace("p.text", r"^\s+|\s+$", "").alias("text"))


def apply_fix_blocks(pages: DataFrame, blocks: DataFrame, totals: Observation | None = None) -> DataFrame:
    """Pages with the texts of ``parse_fix_blocks`` in place of their own, and ``fixed``. Of texts for one page that of the last block counts.

    ``totals`` gets ``pages, fixed`` with the first action.
    """
    new = blocks.groupBy("doc_id", "page").agg(F.max(F.struct("fix", "text"))["text"].alias("_text"))
    out = pages.join(new, ["doc_id", "page"], "left")
    out = out.withColumn("fixed", F.col("_text").isNotNull()).withColumn("text", F.coalesce("_text", "text")).drop("_text")
    return out.observe(totals, F.count(F.lit(1)).alias("pages"), F.count_if("fixed").alias("fixed")) if totals is not None else out
