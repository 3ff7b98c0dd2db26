"""Operator 13, main text of web pages by wrappers inferred from the pages of a host.

Every page of a host is aligned with the host's wrapper, a union-free regular expression of groups, optional groups,
repeated groups and text slots. Each task aligns its own pages first, so a host with very many pages leaves one
wrapper a task; wrappers of one host are then aligned with each other in bounded blocks, round by round, until each
host has one. The wrapper says which slots hold the same text on all pages and where the varied text of a host
stands; pages are read again by their host's wrapper.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .html_groups import HEADINGS, TEXT_BLOCKS, Group, fold, load, matched, of, parse


@dataclass(frozen=True)
class Wrapping:
    """Parameters. A slot whose text is the same on all of at least ``template`` pages is template text; ``block``
    wrappers of a host meet in a task; wrappers of up to ``most`` bytes in all are broadcast, more are joined."""

    template: int = 3
    links: float = 0.6
    block: int = 32
    most: int = 32 << 20


def host_of(url):
    """A URL's host and port in lower case; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, p: Wrapping = Wrapping()) -> DataFrame:
    """``host, wrapper`` from ``host, html``, a row a host; a written table."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, Group] = {}

        def flush() -> pa.RecordBatch:
            rows = [(h, json.dumps(w.dump(), ensure_ascii=False)) for h, w in have.items()]
            have.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["host", "wrapper"])

        for b in batches:
            for host, text in zip(b["host"].to_pylist(), b["html"], strict=True):
                page = parse(text.as_py())[0]
                if host in have:
                    fold(have[host], page)
                else:
                    have[host] = page
            if len(have) > 5000:
                yield flush()
        yield flush()

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        first, *rest = (load(x) for x in sorted(t["wrapper"].to_pylist()))
        for w in rest:
            fold(first, w)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(first.dump(), ensure_ascii=False)], pa.string())})

    now = written(pages.select("host", "html").mapInArrow(own, "host string, wrapper string"), "wrappers")
    while True:
        counts = written(now.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "wrapper-counts")
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            forget(counts)
            return now
        several = now.withColumn("no", F.xxhash64(F.monotonically_increasing_id())).join(counts.where("n > 1"), "host")
        dealt = several.withColumn("block", F.pmod("no", F.ceil(F.col("n") / p.block)).cast("int"))
        alone = now.join(counts.where("n = 1").select("host"), "host", "left_semi")
        then, now = now, written(dealt.select("host", "block", "wrapper").groupBy("host", "block").applyInArrow(merge, "host string, wrapper string").union(alone), "wrappers")
        forget(then, counts)


def main_text(page: str, wrapper: Group | None, p: Wrapping = Wrapping()) -> str:
    """The page's main text: its articles, else its main part, else the group where the wrapper finds most varied text."""
    root, leaves = parse(page)
    found: dict[int, Group] = {}
    if wrapper is not None:
        matched(wrapper, root, found)

    def weight(g: Group) -> float:
        w = found.get(id(g), g)
        return w.chars / w.pages

    for region in "21":
        tops = {}
        for _, _, path in leaves:
            top = next((g for g in path if g.label[0] == region), None)
            if top is not None:
                tops[id(of(top))] = of(top)
        if tops:
            least = max(map(weight, tops.values())) / 2
            chosen = {k for k, g in tops.items() if weight(g) >= least}
            return " ".join(text for _, text, path in leaves if any(id(of(g)) in chosen for g in path))
    return _varied_text(leaves, found, weight, p)


def _varied_text(leaves: list, found: dict[int, Group], weight, p: Wrapping) -> str:
    """Without a marked region: the container to which the slots with varied text and few links add up, and the heading before it."""
    def fixed(slot: Group) -> bool:
        w = found.get(id(of(slot)))
        return w is not None and w.text != "" and w.pages >= p.template

    def menu(path: tuple) -> bool:
        return any(g.links > p.links * g.size for g in path[1:])

    varied = [x for x in leaves if not fixed(x[0])] or leaves  # copies of one page: all of its texts are the same
    prose = [x for x in varied if not menu(x[2]) and x[0].links <= p.links * x[0].size] or varied
    credit: dict[int, float] = {}
    seen = set()
    for slot, _, path in prose:
        if id(of(slot)) in seen:
            continue
        seen.add(id(of(slot)))
        around = [g for g in path if g.tag not in TEXT_BLOCKS] or [path[0]]
        for share, g in zip((1.0, 0.5), around[::-1], strict=False):
            credit[id(of(g))] = credit.get(id(of(g)), 0.0) + share * weight(of(slot))
    if not credit:
        return ""
    best = max(credit.values())
    top = next(k for k, c in credit.items() if c == best)
    inside = [any(id(of(g)) == top for g in path) for _, _, path in prose]
    begin = inside.index(True)
    head = [k for k in range(begin) if prose[k][2][-1].tag in HEADINGS][-1:]
    return " ".join(text for k, (_, text, _) in enumerate(prose) if inside[k] or k in head)


def extract_text(pages: DataFrame, p: Wrapping = Wrapping()) -> DataFrame:
    """One row per row of ``pages`` (``page_id, url, html``): ``page_id, url, text, n_chars``.

    The text is that of the article: without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and comments, character references decoded, white space inside a block as one space, blocks joined by one. A
    null or empty page, or one without text, gives ''. Pages without a host (null or odd urls) share one wrapper.
    Repeated rows all get a row; other columns are ignored; an empty table gives an empty result. Elements nested
    deeper than 120 belong to their ancestors.
    """
    spark = pages.sparkSession
    base = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    wrappers = infer_wrappers(base.select("host", "html"), p)
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    shared = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()}) if size <= p.most else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Group] = {}
        for b in batches:
            of_row = b["wrapper"] if shared is None else [None] * len(b)
            out = []
            for host, page, given in zip(b["host"].to_pylist(), b["html"], of_row, strict=True):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[host] = load(shared.value[host] if shared is not None else given.as_py())
                out.append(main_text(page.as_py(), known[host], p))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string())], ["page_id", "url", "text"])

    rows = base if shared is not None else base.join(wrappers, "host")
    kinds = dict(pages.dtypes)
    made = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return made.withColumn("n_chars", F.length("text").cast("long"))
