"""Operators 11 to 13 against plain versions, and odd rows."""

from __future__ import annotations

import hashlib
import html
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlake.llm import centroids, divergence, line_dedup, toxicity, wrappers
from quizlake.llm.common import written
from quizlake.llm.html_groups import fold, load, parse


def _plain_clusters(rows, p):
    kept = [(i, [math.floor(p.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == p.dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{p.seed}:{r[0]}".encode()).hexdigest(), r[1]))[: p.k]
    cs = [list(v) for _, v in first]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))[::-1] for _, v in kept]
    for _ in range(p.rounds):
        near = assign()
        for j in range(len(cs)):
            own = [v for (_, v), (k, _) in zip(kept, near, strict=True) if k == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i, *a) for (i, _), a in zip(kept, assign(), strict=True)), cs


@pytest.mark.parametrize(("dim", "k", "rounds", "seed"), [(4, 3, 5, 2), (2, 7, 9, 5), (6, 40, 3, 2)])
def test_clusters_against_plain(spark, dim, k, rounds, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (102, None), (103, [1.0] * (dim - 1)), (104, [1.0] * (dim - 1) + [None]), (105, [math.nan] * dim), (106, [math.inf] * dim), (107, []), (108, [0.0] * dim)]
    p = centroids.Clustering(k=k, rounds=rounds, dim=dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "v": F.lit(0), "dots": F.lit(None)})
    got, cs = centroids.cluster_vectors(df, p)
    want, plain = _plain_clusters(rows, p)
    assert sorted(map(tuple, got.collect())) == want
    assert cs.tolist() == plain


def test_clusters_few_changes_and_large_components():
    p = centroids.Clustering(dim=3)
    big = np.array([[1 << 26, -(1 << 26), 1 << 26], [1, 2, 3]], dtype=np.int64)
    assert centroids.products(big, big).tolist() == [[3 << 52, (1 << 26) * 2], [(1 << 26) * 2, 14]]
    assert p.dim == 3


def test_clusters_odd_tables(spark):
    p = centroids.Clustering(k=3, dim=2)
    schema = "vec_id long, embedding array<double>"
    assert centroids.cluster_digest(spark.createDataFrame([], schema), p).collect() == []
    assert centroids.cluster_digest(spark.createDataFrame([(1, None), (2, [1.0])], schema), p).collect() == []
    out = centroids.cluster_digest(spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1e9, 0.0])], schema), p).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["inertia"]) for r in out) == [("1", 0, 0, 0), ("None", 0, 0, 0)]


def _plain_audit(rows, d):
    rows = [(*[(x or "") for x in (lang, source)], re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        seen = Counter(t for r in own for t in set(r[2]))
        kept = [t for t, n in seen.items() if n >= d.documents]
        count = {s: Counter(t for r in own if r[1] == s for t in r[2] if seen[t] >= d.documents) for s in {r[1] for r in own}}
        every = sum(count.values(), Counter())
        share = lambda c, t: 1 + d.scale * (c[t] + d.add) // (c.total() + d.add * len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = [(o, sum(f(share(c, t), share(count[o], t)) for t in kept)) for o in count if o != s]
            terms = [(t, f(share(c, t), share(every, t))) for t in c if share(c, t) > share(every, t)]
            for part, items, top in (("pair", pairs, None), ("term", terms, d.top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("d", [divergence.Divergence(documents=2, slice=3, block=2, top=3), divergence.Divergence(documents=3), divergence.Divergence(documents=50, block=1)])
def test_divergence_against_plain(spark, d):
    rng = random.Random(3)
    words = ["Ab", "ab", "AB", "été", "ÉTÉ", "x1y", "日本", "don't", "zz", "q", "Ω", "ß", "long" * 5000]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "d", "e", "é", None]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(90)]
    rows += [("en", "empty", None), ("en", "a", "ab ab ab"), ("en", "a", "ab ab ab"), ("de", "one", "nur einmal"), ("xx", "p", "..."), ("xx", "q", "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit(1), "n": F.lit("x"), "no": F.lit(None)})
    assert sorted(map(tuple, divergence.audit_sources(df, d).collect())) == _plain_audit(rows, d)


def test_divergence_shares_of_large_counts():
    d = divergence.Divergence()
    counts = np.array([0, 7, 10**15], dtype=np.int64)
    assert divergence.shares(counts, 2 * 10**15, d).tolist() == [1 + 10**9 * (c + 2) // (2 * 10**15) for c in (0, 7, 10**15)]


def test_divergence_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def _articles(page):
    """The text between the article tags, for pages that have one article and nothing to leave out inside it."""
    own = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(h1|p|br)[^>]*>", " ", own))).split())


def test_html_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: _articles(r["html"]) for r in pages.collect()}
    got = wrappers.extract_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def _plain_page(k, rng):
    """A page of blocks without telling names: a menu, a notice, the article, readers' links, a footer."""
    say = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(n)) + "."
    title, paragraphs = say(5), [say(rng.randint(20, 40)) for _ in range(rng.randint(1, 6))]
    menu = "".join(f'<div class="c1"><a href="/{x}">{x} page</a></div>' for x in ("home", "news", "sport"))
    extra = f"<div class='c7'><div><a href='/{say(1)}'>{say(6)}</a></div><div><a href='/x'>{say(5)}</a></div></div>" if k % 2 else ""
    body = "".join(f"<p>{t}" + ("</p>" if rng.random() < 0.5 else "") for t in paragraphs)
    page = f"<html><body><div class='c0'>{menu}</div><div class='c2'>We set small files on your machine &amp; more. Read on or go.</div><div class='c3'><h1>{title}</h1><div class='c4'>{body}</div></div>{extra}<div class='c9'>All rights with the owner of this place, since long ago.</div></body></html>"
    return page, " ".join([title, *paragraphs])


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_html_without_telling_names(spark, most):
    rng = random.Random(5)
    pages = [_plain_page(k, rng) for k in range(40)]
    rows = [(k, f"http://Plain.Example.org:80/{k}", p) for k, (p, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(df, wrappers.Wrapping(most=most, block=3)).collect()}
    assert got == {k: t for k, (_, t) in enumerate(pages)}


def test_html_leaves_out_what_is_not_the_article(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav>menu</nav><div id="cookie-notice">cookies</div><main><article class="post comments-open"><header><h1>Head  line</h1></header><p>One&nbsp;&lt;b&gt; <b>bo</b>ld<br>two<script>var x="</p>";</script>
    <div class="ad-slot">buy</div><aside>side</aside><form><p>mail<input></form><ul><li>a<li>b <a href=x>link</a></ul><table><tr><td>c<td>d</table><pre> e
    f </pre><p hidden>gone</p><div style="display:none">gone</div><section class="entry-content">kept &copy; 5 < 6</section>
    <div class="comments"><article id="comment-1"><p>reader</article></div></article></main><footer>foot</footer><!-- <p>no --></body></html>"""
    got = wrappers.main_text(page, None)
    assert got == "Head line One <b> bold two a b link c d e f kept \u00a9 5 < 6"


@pytest.mark.parametrize(("page", "want"), [
    ("<table><tr><td><a href=1>a</a><br><a href=2>b</a></td><td><font><h1>T</h1>Text one is here and long.<p>Text two is here and long.</font></td></tr></table><hr>Copyright", "T Text one is here and long. Text two is here and long."),
    ("<div class=site-header><a href=/>Home</a></div><div class=content><div class=post id=post-12><h2 class=post-title>Title</h2><p>First part of it.</p><blockquote>Quote</blockquote><ul><li>one<li>two</ul></div><div class=comments><p>Nice post, and a long comment at that, longer than all.</div></div><div class='widget-area sidebar'><p>About me, quite long too.</div>", "Title First part of it. Quote one two"),
    ("<div class=notice-bar>We moved</div><div role=main><p>Body <em>te</em>xt.</p><div class=newsletter-signup>Join</div></div>", "Body text."),
    ("<article><h1>Main</h1><p>" + "long text " * 20 + "</p></article><article class=teaser><p>t1</p></article><article class=comment><p>" + "c " * 200 + "</p></article>", "Main " + "long text " * 19 + "long text"),
    ("<article>a &lt; b &nbsp; c&#233; &unknown; &copy 2020 <pre> x\n y </pre><select><option>o</select><textarea>t</textarea>z</article>", "a < b c\u00e9 &unknown; \u00a9 2020 x y z"),
])
def test_html_layouts(page, want):
    assert wrappers.main_text(page, None) == want


def test_html_odd_pages(spark):
    deep = "<div>" * 30_000 + "deep text" + "</div>" * 30_000
    rows = [(1, None, None), (1, None, None), (2, "", ""), (3, "not a url", "no markup, only text"), (None, "http://a/", "<article>x"), (5, "http://a/", deep), (6, "http://b/?q", "<p>" * 50_000 + "end"), (7, "http://b/", "<a '" * 20_000), (8, "http://c", "<article></article><p>only this"), (9, "http://c", "<b><i>" * 20_000 + "in" + "<li>x" * 2000)]
    rows += [(20 + k, "http://copies/", "<div><p>the same text on every page</p></div>") for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("x"), "wrapper": F.lit(None)})
    got = {}
    for r in wrappers.extract_text(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == ["", ""] and got[2] == [""] and got[3] == ["no markup, only text"] and got[None] == ["x"] and got[5] == ["deep text"] and got[6] == ["end"] and got[8] == ["only this"]
    assert all(got[k] == ["the same text on every page"] for k in range(20, 25))
    assert len(got) == 14
    assert wrappers.extract_text(df.limit(0)).collect() == []


def test_wrappers_align_groups():
    a, b, c = (parse(x)[0] for x in ("<div class=m>menu</div><h2>t1</h2><p>x</p><h2>t2</h2><p>y</p>", "<div class=m>menu</div><h2>t</h2><p>z</p>", "<div class=m>menu</div><div class=n>new</div><h2>t</h2><p>z</p><p>zz</p>"))
    fold(a, b), fold(a, c)
    again = load(json.dumps(a.dump()))
    assert again.dump() == a.dump()
    kinds = {k.label: (k.many, k.optional, k.pages) for k in again.kids}
    assert kinds["0div.m"] == (False, False, 3) and kinds["0div.n"] == (False, True, 1)
    assert [k.text != "" for k in again.kids[0].kids] == [True]


_M = (1 << 64) - 1


def _plain_score(m, text):
    """The score of a text by loops over words and subwords, from the model's weights alone."""
    def mixed(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _M
        return (((x ^ (x >> 29)) * 0xA0761D6478BD642F) & _M) ^ (x >> 17)

    values = []
    for w in text.split():
        w = "<" + re.sub(r"^\W+|\W+$", "", w).lower() + ">"
        buckets = [zlib.crc32(w.encode())]
        for n in range(m.grams[0], m.grams[1] + 1):
            for i in range(len(w) - n + 1):
                h = 0
                for c in w[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & _M
                buckets.append(mixed(h))
        values.append(sum(float(m.weights[b % len(m.weights)]) for b in buckets) / len(buckets))
    if not values:
        return 1 / (1 + math.exp(-m.bias))
    e = [math.exp(v - max(values)) for v in values]
    pooled = sum(x * v for x, v in zip(e, values, strict=True)) / sum(e)
    return 1 / (1 + math.exp(-(m.plain * sum(values) / len(values) + pooled + m.bias)))


def test_toxicity_against_plain_loops(spark):
    rng = random.Random(8)
    words = ["river", "stone", "Garden,", "idiot", "moron!", "é", "...", "window", "x", "trash"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(120)]
    m = toxicity.fit(texts, [int("idiot" in t or "moron" in t) for t in texts], rounds=30)
    unseen = ["an idiott and a mor0n", "", "river", " \t ", "idiot " * 3 + "river " * 2000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + unseen)], "doc_id long, text string")
    for r in toxicity.score_toxicity(df, m).collect():
        assert r.score == pytest.approx(_plain_score(m, r.text), abs=1e-9)
    assert m.score("idiot " + "river " * 2000) > 0.5 > m.score("river " * 2000)


def _near_lines(n, seed):
    """Lines of one group: chains of edits, so that some are near others but not near the first, and a few strangers."""
    rng = random.Random(seed)
    line = "".join(rng.choices("abcdefghij ", k=200)).strip() + "kl"
    out = [line]
    while len(out) < n:
        x = list(rng.choice(out[:1] * 6 + out[-3:]))
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(len(x))] = rng.choice("QRSTUV")
        out.append("".join(x))
    return [*dict.fromkeys(out), *("".join(rng.choices("mnopqrst ", k=150)).strip() + "z" for _ in range(5))]


@pytest.mark.parametrize(("n", "block", "seed"), [(120, 8, 1), (90, 16, 2), (60, 5, 3)])
def test_lines_settled_by_pivots_are_connected_as_by_all_pairs(spark, n, block, seed):
    lines = _near_lines(n, seed)
    p = line_dedup.LineDedup(block=block)
    sets = line_dedup.shingle_sets(lines, p.chars)
    members = written(spark.createDataFrame([(1, len(lines), k) for k in range(len(lines))] + [(2, 2, 0), (2, 2, 1)], "bucket long, n long, id long"), "members")
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    links, rest = line_dedup.settled(members, texts, p)
    linked = lambda a, b: (both := len(set(sets[a].tolist()) & set(sets[b].tolist()))) >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9
    by_bucket = {}
    for r in rest.collect():
        by_bucket.setdefault(r.bucket, []).append(r.id)
    got = [tuple(r) for r in links.collect()]
    assert all(linked(a, b) for a, b in got) and sorted(by_bucket[2]) == [0, 1]
    got += [(a, b) for ids in by_bucket.values() for a in ids for b in ids if a < b and linked(a, b)]
    want = [(a, b) for a in range(len(lines)) for b in range(a) if linked(a, b)]

    def classes(pairs):
        root = list(range(len(lines)))
        for _ in range(len(lines)):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert classes(got) == classes(want)


def test_near_copies_move_in_proportion(spark):
    """Of 4 096 copies with one edit each, every text moves to one task a round, not to eight."""
    p = line_dedup.LineDedup()
    base = "".join(random.Random(4).choices("abcdefghij ", k=200)) + "kl"
    lines = [base[:k % 200] + chr(0x4E00 + k) + base[k % 200 + 1:] for k in range(4096)]
    members = written(spark.createDataFrame([(1, len(lines), k) for k in range(len(lines))], "bucket long, n long, id long"), "members")
    links, rest = line_dedup.settled(members, spark.createDataFrame(list(enumerate(lines)), "id long, line string"), p)
    assert links.count() == len(lines) - 1 and rest.count() == 0
