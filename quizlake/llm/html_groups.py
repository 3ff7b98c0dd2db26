"""Pages as nested token groups, and their alignment: the step on one or two pages that ``wrappers`` runs inside tasks.

A page's tokens become groups: a block element is a group of what it holds, a run of text between block borders is a
slot. Runs of alike groups fold into one repeated group. Two token streams are aligned group by group: what both
have is merged, what one lacks becomes optional, texts that differ become open slots.
"""

from __future__ import annotations

import functools
import html
import json
import re

import xxhash

#: Comments, declarations, tags. A tag ends at the next unquoted ``<`` where it has no end of its own.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")

#: Kinds of elements.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style textarea title xmp iframe noembed noframes noscript template nav footer aside form button select option input label dialog menu svg canvas object audio video".split())
TEXT_BLOCKS = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
HEADINGS = frozenset(("h1", "h2"))
#: What a start tag closes, and where the search for it ends.
_CLOSES = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
#: Words of a class, id or role that mark what isn't the article; the second list only where no word of the third stands beside them.
_NOISE = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer foot copyright sidebar sidebars ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion"
    " cookie cookies consent gdpr popup modal newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations pagination pager paging"
    " comment comments commentlist respond reply replies discussion disqus".split()
)
_WEAK = frozenset("header masthead banner side aside widget widgets notice notices alert disclaimer overlay search searchbox form toolbar skip trending popular complementary contentinfo".split())
_OWN = frozenset("article entry post content main body story text".split())

#: Elements below this depth belong to their ancestors; lists of groups beyond this length are folded by label, then by tag.
DEPTH, PARTS = 120, 96


class Group:
    """A group of tokens: ``label`` (kind of region, tag, classes, id), ``kids``; a slot (label ``#``) has ``text``: the digest of a text that never changed, or '' once it did.

    ``chars, linked`` (characters, those in links) add up what is folded in; ``size, links`` are the group's own.
    """

    __slots__ = ("chars", "kids", "label", "linked", "links", "many", "optional", "pages", "same", "sign", "size", "text")

    def __init__(self, label: str, kids: list | None = None, text: str = "", chars: int = 0, linked: int = 0):
        self.label, self.kids, self.text, self.chars, self.linked = label, kids or [], text, chars, linked
        self.many = self.optional = False
        self.pages, self.same, self.sign = 1, None, 0
        self.size, self.links = chars, linked

    @property
    def tag(self) -> str:
        return _tag(self.label)

    def dump(self) -> list:
        return [self.label, int(self.many), int(self.optional), self.pages, self.text, self.chars, self.linked, [k.dump() for k in self.kids]]


def _tag(label: str) -> str:
    return label[1:].partition(".")[0].partition("#")[0]


def load(x: list | str) -> Group:
    label, many, optional, pages, text, chars, linked, kids = json.loads(x) if isinstance(x, str) else x
    g = Group(label, [load(k) for k in kids], text, chars, linked)
    g.many, g.optional, g.pages = bool(many), bool(optional), pages
    _sign(g)
    return g


def _sign(g: Group) -> None:
    g.sign = hash((g.label, *[k.sign for k in g.kids]))


def of(g: Group) -> Group:
    """The group that a group was folded into."""
    while g.same is not None:
        g = g.same
    return g


@functools.lru_cache(maxsize=20_000)
def _facts(name: str, attributes: str) -> tuple[str, bool]:
    """(label, dropped) of a start tag. Labels begin with 2 for an article, 1 for a main part, 0 for the rest."""
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    classes, key, role = got.get("class", "").split(), got.get("id", ""), got.get("role", "").lower()
    region = "2" if name == "article" or role == "article" or got.get("itemprop") == "articleBody" else "1" if name == "main" or role == "main" else "0"
    gone = name in DROPPED or "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")) is not None
    if not gone and name not in ("html", "body"):
        for token in (*classes, key, role):
            words = [w.lower() for w in _WORDS.findall(token)]
            if name in ("article", "main"):
                gone = gone or (bool(words) and _NOISE.issuperset(words))
            elif words and words[0] not in ("has", "with", "no", "is"):
                gone = gone or not _NOISE.isdisjoint(words) or (not _WEAK.isdisjoint(words) and _OWN.isdisjoint(words))
    marks = "".join("." + c for c in sorted(classes)) + (f"#{key}" if key else "")
    return region + name + _DIGITS.sub("9", marks), gone


def parse(page: str) -> tuple[Group, list[tuple[Group, str, tuple[Group, ...]]]]:
    """(the page's group, its slots in page order with their text and the groups they stand in)."""
    root = Group("0page")
    stack: list[tuple] = [("", root, False)]  # name, its group (None: inline), whether its text is dropped
    opened: dict[str, int] = {}
    leaves: list = []
    run: list[str] = []
    linked = 0
    blocks = [root]

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                slot = Group("#", None, xxhash.xxh3_64_hexdigest(text), len(text), min(linked, len(text)))
                blocks[-1].kids.append(slot)
                leaves.append((slot, text, tuple(blocks)))
            run.clear()
        linked = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            name, group, _ = stack.pop()
            opened[name] -= 1
            if group is not None:
                flush()
                blocks.pop()
                if group.kids:
                    group.kids = repeats(group.kids)
                    _total(group)
                    blocks[-1].kids.append(group)

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and not stack[-1][2]:
            text = page[at:end]
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            if opened.get("a"):
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if opened.get(name):
                depth = len(stack) - 1
                inline = name in INLINE
                while stack[depth][0] != name and not (inline and stack[depth][1] is not None):
                    depth -= 1
                if stack[depth][0] == name:
                    close(depth)
            continue
        if name in RAW:
            close_tag = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close_tag.start() if close_tag else size
            continue
        if name in VOID:
            if name in ("br", "hr") and not stack[-1][2]:
                run.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            if opened.get("p"):
                depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p")
                close(depth)
            wanted, border = _CLOSES.get(name, ((), ()))
            if any(opened.get(w) for w in wanted):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in border:
                        break
                    if stack[k][0] in wanted:
                        close(k)
                        break
        if len(stack) > DEPTH:
            continue
        label, gone = _facts(name, "" if name == "a" else m[3])
        if name == "header" and not gone:
            gone = not any(b.label[0] in "12" for b in blocks)
        group = None
        if not inline:
            flush()
            group = Group(label)
            blocks.append(group)
        stack.append((name, group, gone or stack[-1][2]))
        opened[name] = opened.get(name, 0) + 1
    close(1)
    flush()
    root.kids = repeats(root.kids)
    _total(root)
    return root, leaves


def _total(g: Group) -> None:
    g.chars, g.linked = g.size, g.links = sum(k.chars for k in g.kids), sum(k.linked for k in g.kids)
    _sign(g)


def _alike(a: Group, b: Group) -> bool:
    return a.sign == b.sign or (a.label == b.label and a.tag in TEXT_BLOCKS)


def repeats(kids: list[Group]) -> list[Group]:
    """``kids`` with runs of alike groups, or of alike pairs and triples of groups, folded into repeated groups."""
    out: list[Group] = []
    for k in kids:
        out.append(k)
        again = True
        while again:
            again = False
            if len(out) > 1 and _alike(out[-2], out[-1]) and out[-1].label != "#":
                last = out.pop()
                fold(out[-1], last, 0)
                out[-1].many = again = True
                continue
            for n in (2, 3):
                if len(out) > n and out[-n - 1].label == f"({n}" and all(map(_alike, out[-n - 1].kids, out[-n:])):
                    tail = Group(f"({n}", out[-n:])
                    del out[-n:]
                    _total(tail)
                    fold(out[-1], tail, 0)
                    again = True
                elif len(out) >= 2 * n and all(map(_alike, out[-2 * n : -n], out[-n:])):
                    first, second = Group(f"({n}", out[-2 * n : -n]), Group(f"({n}", out[-n:])
                    del out[-2 * n :]
                    _total(first), _total(second)
                    fold(first, second, 0)
                    first.many = True
                    out.append(first)
                    again = True
                if again:
                    break
    return bounded(out)


def bounded(kids: list[Group]) -> list[Group]:
    """At most about ``PARTS`` groups: of a longer list those with the same label, then those with the same tag, are one repeated group."""
    for name in (lambda g: g.label, lambda g: g.label[:1] + g.tag[:12], lambda g: "0other"):
        if len(kids) <= PARTS:
            break
        by: dict[str, Group] = {}
        for k in kids:
            key = name(k)
            if key in by:
                fold(by[key], k, 0)
                by[key].many = True
            else:
                by[key] = k
        kids = list(by.values())
    return kids


def aligned(a: list[Group], b: list[Group]) -> list[tuple[int, int]]:
    """Places of the groups that match, in order: the common subsequence of labels with the largest weight, equal inner structure weighing double."""
    if [x.label for x in a] == [x.label for x in b]:
        return [(k, k) for k in range(len(a))]
    weight = lambda x, y: 0 if x.label != y.label else 2 if x.sign == y.sign else 1
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            w = weight(a[i], b[j])
            best[i][j] = max(best[i + 1][j], best[i][j + 1], w + best[i + 1][j + 1] if w else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        w = weight(a[i], b[j])
        if w and best[i][j] == w + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def fold(a: Group, b: Group, pages: int = 1) -> None:
    """Merge ``b`` into ``a``. ``pages``: 1 if they are of different pages, 0 inside one page."""
    b.same = a
    a.pages += b.pages * pages
    a.chars, a.linked = a.chars + b.chars, a.linked + b.linked
    a.many, a.optional = a.many or b.many, a.optional or b.optional
    if a.label == "#":
        a.text = a.text if a.text == b.text else ""
        return
    if not a.kids and not b.kids:
        return
    pairs, kids, i, j = aligned(a.kids, b.kids), [], 0, 0
    for x, y in [*pairs, (len(a.kids), len(b.kids))]:
        for own in (*a.kids[i:x], *b.kids[j:y]):
            own.optional = True
            kids.append(own)
        if x < len(a.kids):
            fold(a.kids[x], b.kids[y], pages)
            kids.append(a.kids[x])
        i, j = x + 1, y + 1
    a.kids = bounded(_runs(kids)) if len(kids) > len(pairs) else kids
    _sign(a)


def _runs(kids: list[Group]) -> list[Group]:
    """Neighbours that became alike by a merge are one repeated group."""
    out: list[Group] = []
    for k in kids:
        if out and out[-1].label != "#" and _alike(out[-1], k):
            last = out[-1]
            pages = max(last.pages, k.pages)
            fold(last, k, 0)
            last.many, last.pages = True, pages
        else:
            out.append(k)
    return out


def matched(w: Group, g: Group, found: dict[int, Group]) -> None:
    """Align a page with its wrapper, which stays as it is; ``found`` gets the wrapper's group of each group."""
    found[id(g)] = w
    for x, y in aligned(w.kids, g.kids):
        matched(w.kids[x], g.kids[y], found)
