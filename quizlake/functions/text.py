"""Scalar functions on texts, as column expressions; Arrow UDFs only for scores that Spark lacks."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Latin letters and their base letters, from Unicode decomposition.
_LATIN = [(c, unicodedata.normalize("NFKD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFKD", c)[0].isascii() and unicodedata.normalize("NFKD", c)[0].isalpha()]


def nonempty(c: Column) -> Column:
    """Null for what counts as missing: null or an empty string."""
    return F.when(c != "", c)


def first_nonempty(*columns: Column) -> Column:
    return F.coalesce(*[nonempty(c) for c in columns])


def safe_int(c: Column) -> Column:
    """Integer or 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def normalize_text(c: Column) -> Column:
    """Without accents, lower case, everything but a-z and 0-9 as single spaces, trimmed.

    JVM only: Latin letters lose their accents by a table, combining marks are dropped. Ligatures and fractions
    become spaces; ``normalize_nfkd`` decomposes them.
    """
    plain = F.translate(F.coalesce(c, F.lit("")), "".join(a for a, _ in _LATIN), "".join(b for _, b in _LATIN))
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(plain, r"\p{M}+", "")), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def normalize_nfkd(texts: pd.Series) -> pd.Series:
    """As ``normalize_text``, by full compatibility decomposition."""
    plain = texts.fillna("").map(lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))
    return plain.str.lower().str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of ``b`` positions at a time (bit-parallel)."""
    where: dict[str, int] = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    row = full = (1 << len(b)) - 1
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b); 1 for two empty texts."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def encoded(*groups: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group of texts (codes, lengths): a row of small character numbers a text, common to all groups, filled up with 0."""
    points = [np.frombuffer("".join(g).encode("utf-32-le"), dtype=np.uint32) for g in groups]
    _, numbers = np.unique(np.concatenate(points), return_inverse=True)
    out, at = [], 0
    for g, x in zip(groups, points, strict=True):
        lengths = np.array([len(t) for t in g], dtype=np.int64)
        codes = np.zeros((len(g), int(lengths.max(initial=0))), dtype=np.int32)
        codes[np.arange(codes.shape[1])[None, :] < lengths[:, None]] = numbers[at : at + len(x)] + 1
        out.append((codes, lengths))
        at += len(x)
    return out


def lcs_lengths(text: np.ndarray, others: np.ndarray, most: int, need: np.ndarray | None = None) -> np.ndarray:
    """``lcs_length`` of one text with many, all as ``encoded`` numbers up to ``most``: the same steps for all at once, in words of 64 positions of the text.

    With ``need``, the lengths asked for, others that can't reach theirs any more are given up: theirs comes out as -1.
    """
    n, words = len(text), -(-len(text) // 64)
    if not words:
        return np.zeros(len(others), dtype=np.int64)
    where = np.zeros((words, most + 1), dtype=np.uint64)
    for k, x in enumerate(text.tolist()):
        where[k // 64, x] |= np.uint64(1 << k % 64)
    row = np.full((words, len(others)), ~np.uint64(0))
    out, alive = np.full(len(others), -1, dtype=np.int64), np.arange(len(others))
    lengths = (others > 0).sum(axis=1) if need is not None else None
    last = ~np.uint64((1 << n % 64) - 1) if n % 64 else np.uint64(0)

    def found() -> np.ndarray:
        return n - (np.bitwise_count(np.concatenate([row[:-1], row[-1:] | last])).sum(axis=0).astype(np.int64) - (64 * words - n))

    columns = np.ascontiguousarray(others.T)
    for k in range(len(columns)):
        if need is not None and k and k % 32 == 0 and len(alive):
            stay = found() + np.maximum(lengths[alive] - k, 0) >= need[alive]
            if not stay.all():
                alive, row = alive[stay], np.ascontiguousarray(row[:, stay])
        if not len(alive):
            return out
        column = columns[k] if len(alive) == len(others) else columns[k, alive]
        carry = np.uint64(0)
        for w in range(words):
            old = row[w]
            hit = old & where[w, column]
            total = old + hit
            more = total < old
            total += carry
            carry = (more | (total < carry)).astype(np.uint64)
            row[w] = total | (old - hit)
    out[alive] = found()
    return out


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def clean_text(c: Column) -> Column:
    """NUL dropped, blanks and tabs collapsed, every line and the whole trimmed."""
    flat = F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), r"[ \t]+", " ")
    return F.regexp_replace(F.array_join(F.transform(F.split(flat, "\n"), F.trim), "\n"), r"^\n+|\n+$", "")


def answer_clean(c: Column, most: int = 5) -> Column:
    """Letters A to E of an answer, upper case, at most ``most``."""
    return F.substring(F.regexp_replace(F.upper(c), "[^A-E]", ""), 1, most)


def last_answer(reply: Column) -> Column:
    """The last A-E word of a reply, else all its letters A to E."""
    upper = F.upper(reply)
    found = F.regexp_extract_all(upper, F.lit(r"\b([A-E]{1,5})\b"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(answer_clean(reply))


#: Words of answer-key pages.
STRONG_WORDS = ("corrigé", "correction", "answer key", "clé de correction")
MODERATE_WORDS = ("réponse", "réponses", "rep.", "answers")
DETECT_WORDS = ("corrigé", "correction", "réponse", "rep.", "answers", "clé", "answer key")
SIMPLE_WORDS = ("corrigé", "correction", "réponse", "rep.")

#: Patterns of the page scores and of the split scan below.
TABLE_HEAD = r"(?iu)\|(?U)\s*a\s*\|\s*b\s*\|\s*c"


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _points(hit: Column, points: int) -> Column:
    return F.when(hit, points).otherwise(0)


def page_score(text: Column) -> Column:
    """How likely a page holds answers: words, a table head, lists of pairs (at most 50), upper-case pairs (at most 40)."""
    t = F.lower(text)
    pairs = F.regexp_count(t, F.lit(r"(?U)\d{1,3}\s*[:\.\-→]\s*[a-e]{1,5}"))
    upper = F.regexp_count(text, F.lit(r"(?U)\b\d{1,3}\s+[A-E]{1,5}\b"))
    words = [_points(F.contains(t, F.lit(w)), 20) for w in STRONG_WORDS] + [_points(F.contains(t, F.lit(w)), 10) for w in MODERATE_WORDS]
    return _sum([*words, _points(F.regexp_like(t, F.lit(TABLE_HEAD)), 40), F.least(pairs * 5, F.lit(50)), F.least(upper * 4, F.lit(40))]).cast("int")


def detect_score(text: Column) -> Column:
    """The older page score, without the word tiers."""
    t = F.lower(text)
    pairs = F.regexp_count(t, F.lit(r"(?U)\d{1,3}\s*[\.:\-\s]\s*[a-e]{1,5}"))
    words = [_points(F.contains(t, F.lit(w)), 15) for w in DETECT_WORDS]
    return _sum([*words, _points(F.regexp_like(t, F.lit(TABLE_HEAD)), 40), F.least(pairs * 5, F.lit(50))]).cast("int")


def page_split(text: Column, since_question: bool = False) -> Column:
    """Whether a page ends in a question whose options are on the next: of its last 15 lines, without blanks and
    footers, the last is a question and fewer than 3 options stand among the last 8 (``since_question``: after
    the last question line)."""
    lines = F.transform(F.slice(F.reverse(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "\n")), 1, 15), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    body = F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"(?iu)Dr\.|\bSCE\b|parasitologie|page(?U)\s*\d+|scanned|camscanner")))
    is_question = lambda x: F.regexp_like(x, F.lit(r"(?U)^\d+[-.)]\s*.{15,}[:?]\s*$"))
    options = F.size(F.filter(F.slice(body, 1, 8), lambda x: F.regexp_like(x, F.lit(r"(?iu)^[a-e][-.)](?U)\s*.{5,}"))))
    few = F.lit(True) if since_question else options < 3  # the last line is the question: no option follows it
    return F.coalesce((F.size(body) >= 2) & is_question(F.get(body, F.lit(0))) & few, F.lit(False))


def page_status(text: Column) -> Column:
    """``empty``, ``error`` or ``ok`` by the markers of the extraction."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when((t == "") | (t == "[EMPTY_PAGE]"), "empty").when((t == "[OCR_ERROR]") | F.startswith(t, F.lit("ERROR:")), "error").otherwise("ok")


def tier(score: Column, green: float = 0.9, yellow: float = 0.75) -> Column:
    return F.when(score == 0, "none").when(score >= green, "green").when(score >= yellow, "yellow").otherwise("red")


def percent(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def week_key(ts: Column) -> Column:
    """Year and week, weeks from Sunday, as %Y-W%U."""
    week = F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7)
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def log_type(text: Column) -> Column:
    def has(*marks: str) -> Column:
        return F.regexp_like(text, F.lit("|".join(marks)))

    return F.when(has("❌", "ERROR"), "error").when(has("✅", r"\[OK\]"), "ok").when(has("⚠️", r"\[WARN\]"), "warn").otherwise("info")


def json_body(content: Column) -> Column:
    """What lies between the first opening and the last closing bracket of a reply, without code fences."""
    plain = F.regexp_replace(F.regexp_replace(content, r"```json\s*", ""), r"```\s*", "")
    return nonempty(F.regexp_extract(plain, r"(?s)[\[{].*[\]}]", 0))


def json_repair(content: Column) -> Column:
    """``json_body`` with comments and trailing commas dropped and missing commas between objects put in."""
    plain = F.regexp_replace(json_body(content), r"(?m)^\s*//.*$", "")
    plain = F.regexp_replace(plain, r",(\s*[}\]])", "$1")
    return F.regexp_replace(plain, r"\}(\s*)\{", "}, $1{")


def prompt(template: str, *parts: tuple[Column, int]) -> Column:
    """``template`` with a %s for each (text, most characters of it)."""
    return F.format_string(template, *[F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in parts])


def register(spark) -> None:
    """The Arrow UDFs under their own names, for SQL."""
    for f in (normalize_nfkd, indel_ratio, sequence_ratio):
        spark.udf.register(f.func.__name__ if hasattr(f, "func") else f.__name__, f)
