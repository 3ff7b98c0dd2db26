"""Operator 2, toxicity.

Every word is a bag of subwords: itself and its character n-grams between ``<`` and ``>``, hashed to buckets, and the
average of their embeddings. A text is averaged twice from its words: plainly, and with weights by a softmax over what the
words say themselves, so that one word isn't thinned out in a long text. Both averages go through the same linear softmax over
(clean, toxic); embeddings, softmax and the part of the plain average are trained together, in numpy, on a bounded
sample of labelled rows. A misspelling that was never seen shares n-grams, and so vectors, with the word it stands for.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .shingles import mix

_EDGES = re.compile(r"^\W+|\W+$")


@dataclass
class ToxicityModel:
    """``weights``: each bucket's part of the logit (its embedding times the difference of the softmax rows); ``plain``: the part of the plain average."""

    weights: np.ndarray
    bias: float
    plain: float
    grams: tuple[int, int]
    _words: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_words": {}}

    def _values(self, words: list[str]) -> np.ndarray:
        """Each word's part of the logit."""
        flat, sizes = bags(words, len(self.weights), self.grams)
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes) / sizes

    def scores(self, texts: list[str]) -> np.ndarray:
        """Softmax probability of ``toxic`` of each text; the bias alone for a text without words."""
        split = [t.split() for t in texts]
        known, every = self._words, set(itertools.chain.from_iterable(split))
        if len(known) > 400_000:  # a bound on the worker's memory
            known.clear()
        if new := list(every.difference(known)):
            known.update(zip(new, self._values(new).tolist(), strict=True))
        values = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), dtype=np.float64)
        mean, pooled, _ = averages(values, np.array([len(x) for x in split], dtype=np.int64), 1.0)
        return 1 / (1 + np.exp(-(self.plain * mean + pooled + self.bias)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def averages(values: np.ndarray, sizes: np.ndarray, sharp: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plain average, average with weights softmax(``sharp`` * value), those weights) of the values of each text, ``sizes`` values a text; 0 for an empty one."""
    full = np.flatnonzero(sizes)
    mean, pooled = np.zeros(len(sizes)), np.zeros(len(sizes))
    if not len(full):
        return mean, pooled, np.empty(0)
    n = sizes[full]
    starts = np.cumsum(n) - n
    mean[full] = np.add.reduceat(values, starts) / n
    weight = np.exp(sharp * (values - np.repeat(np.maximum.reduceat(values, starts), n)))
    weight /= np.repeat(np.add.reduceat(weight, starts), n)
    pooled[full] = np.add.reduceat(weight * values, starts)
    return mean, pooled, weight


def bags(words: list[str], buckets: int, grams: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (int32) of the subwords of each word, one word after another, and how many each has: of the word in lower
    case, without punctuation at its edges, between ``<`` and ``>``, the whole and all its n-grams."""
    marked = [f"<{_EDGES.sub('', w).lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) for w in marked], dtype=np.int64)
    word, left = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    owners, made = [np.arange(len(words))], [np.array([zlib.crc32(w.encode()) for w in marked], dtype=np.uint64)]
    run = np.zeros(len(codes) + 1, dtype=np.uint64)
    for n in range(1, grams[1] + 1):  # hashes of all runs of n characters
        run = run[:-1][: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        run = np.append(run, np.uint64(0))
        if n >= grams[0]:
            inside = np.flatnonzero(left[: len(run) - 1] >= n)
            owners.append(word[inside]), made.append(mix(run[inside]))
    owner, flat = np.concatenate(owners), np.concatenate(made)
    return (flat[np.argsort(owner, kind="stable")] % np.uint64(buckets)).astype(np.int32), np.bincount(owner, minlength=len(words))


def fit(texts: list[str], toxic: list[int], buckets: int = 1 << 17, dim: int = 8, grams: tuple[int, int] = (3, 6), rounds: int = 60, seed: int = 3, least_docs: int = 4, decay: float = 1e-4) -> ToxicityModel:
    """Train embeddings and softmax together by Adam over all given texts.

    The first third of the rounds averages plainly only, in the others the weights of words follow what they say so
    far. Without both classes the model is the share of the one class, for any text.
    """
    y = np.array(toxic, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return ToxicityModel(np.zeros(buckets), float(np.log(p / (1 - p))) if len(y) else -2.0, 0.0, grams)
    vocab: dict[str, int] = {}
    words, lengths, flat, n_bag = array("i"), array("i"), array("i"), array("i")  # 4 bytes a number: all of it is held at once
    for t in texts:
        before = len(words)
        words.extend(vocab.setdefault(w, len(vocab)) for w in t.split())
        lengths.append(len(words) - before)
    every = list(vocab)
    del vocab
    for at in range(0, len(every), 20_000):
        bag, n = bags(every[at : at + 20_000], buckets, grams)
        flat.frombytes(bag.tobytes()), n_bag.frombytes(n.astype(np.int32).tobytes())
    del every
    words, flat, n_bag = (np.frombuffer(x, dtype=np.int32) if len(x) else np.empty(0, np.int32) for x in (words, flat, n_bag))
    starts, bag_at = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(n_bag)])[:-1]
    ends = np.append(bag_at, len(flat))
    blocks = [(a, min(a + 20_000, len(n_bag)), int(ends[a]), int(ends[min(a + 20_000, len(n_bag))])) for a in range(0, len(n_bag), 20_000)]
    used = np.zeros(buckets, dtype=np.int32)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if a == b:
            continue
        used[np.unique(np.concatenate([flat[bag_at[w] : bag_at[w] + n_bag[w]] for w in np.unique(words[a:b])]))] += 1
    used = used >= least_docs
    rng = np.random.default_rng(seed)
    e = (rng.uniform(-1 / dim, 1 / dim, (buckets, dim)) * used[:, None]).astype(np.float32)
    soft, bias, plain = rng.normal(0, 0.5, (dim, 2)), np.array([0.5, -0.5]), np.array([0.5])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, soft, bias, plain)]
    sizes = np.diff(starts)
    doc_of = np.repeat(np.arange(len(y)), sizes)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for step in range(1, rounds + 1):
        diff = soft[:, 1] - soft[:, 0]
        weight, per_word = e @ diff.astype(np.float32), np.empty(len(n_bag))
        for a, b, s, t in blocks:
            per_word[a:b] = np.add.reduceat(weight[flat[s:t]], bag_at[a:b] - s) / n_bag[a:b]
        sharp = 0.0 if step <= rounds // 3 else 1.0
        values = per_word[words]
        mean, pooled, share = averages(values, sizes, sharp)
        logit = plain[0] * mean + pooled + bias[1] - bias[0]
        p = 1 / (1 + np.exp(-logit))
        g = (p - y) * balance / len(y)
        moved = plain[0] / np.maximum(sizes, 1)[doc_of] + share * (1 + sharp * (values - pooled[doc_of]))  # by a unit of each word's value
        coef = np.bincount(words, weights=g[doc_of] * moved, minlength=len(n_bag)) / n_bag
        pull = np.zeros(buckets)
        for a, b, s, t in blocks:
            pull += np.bincount(flat[s:t], weights=np.repeat(coef[a:b], n_bag[a:b]), minlength=buckets)
        d_soft = e.T @ pull.astype(np.float32)
        grads = [np.outer(pull * used, diff).astype(np.float32) + decay * e, np.stack([-d_soft, d_soft], axis=1), np.array([-g.sum(), g.sum()]), np.array([(g * mean).sum()])]
        for x, grad, (m, v), rate in zip((e, soft, bias, plain), grads, state, (0.05, 0.05, 0.05, 0.05), strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(x.dtype)
    return ToxicityModel((e @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]), float(plain[0]), grams)


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = (4000, 2000), max_chars: int = 40_000_000) -> tuple[list[str], list[int]]:
    """At most ``max_rows`` (clean, toxic) labelled rows and ``max_chars`` characters, the first by a hash of the id.

    Both are bounds on what the driver holds. Of rows that repeat an id the one with the smallest text hash is taken. Rows
    whose ``crc32(doc_id) % 5`` is 0 are held out.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    d = text_of(docs, "doc_id", "text")
    pool = d.select("doc_id", F.length("text").alias("n")).join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = [r for k in (0, 1) for r in pool.where(F.col("toxic") == k).orderBy(*order).limit(max_rows[k]).collect()]
    keep, left = {}, [max_chars // 2, max_chars // 2]
    for r in ids:
        if r.n <= left[r.toxic]:
            left[r.toxic] -= r.n
            keep[r.doc_id] = r.toxic
    one = d.where(F.col("doc_id").isin(list(keep))).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    got = one.orderBy("doc_id", "text").toArrow()
    return got["text"].to_pylist(), [keep[i] for i in got["doc_id"].to_pylist()]


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); columns of those names are replaced.

    Reads only the whole text; null counts as empty. Rows are scored alone, so order, ties and repeats don't
    matter, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float a bucket, whatever the input

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for t in texts:
            yield pd.Series(np.concatenate([m.scores(t.iloc[at : at + 200].tolist()) for at in range(0, len(t), 200)] or [np.empty(0)]), dtype="float64")

    out = docs.drop("score", "predicted").withColumn("score", score(F.coalesce(F.col("text"), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
