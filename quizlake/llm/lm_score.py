"""Operator 3, language-model scores by stupid backoff.

Documents are exploded into their n-grams, known by 64-bit hashes; rows ``gram, batch, n`` are dealt by hash and
summed to the table of counts, which goes back to the batches' n-grams; each batch of documents then adds up its
documents' scores. A frequent n-gram is one row a batch, however many documents of it hold the n-gram, so no hash
has more rows than there are batches.

Words and bigrams are counted before anything goes back, longer n-grams one order after another. An n-gram is at most
as frequent as the two shorter ones it holds, so from trigrams on only those are sent of which both have reached the
count from which an n-gram counts as seen: no other can. N-grams are dealt in parts by their hash and counts go back in
slices of the batches, so that only a part lies in shuffle files at a time. What a batch holds (word numbers,
totals) goes as bytes, and counts go back as one row a batch for many n-grams, so that Spark doesn't move them number by number.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, parts, text_of, written
from .shingles import joined


def _grams(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside the texts, and the place of each one's last word."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    if len(words) < n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    same = text[: len(text) - n + 1] == text[n - 1 :]
    return joined(words ^ np.uint64(n), n)[same], np.flatnonzero(same) + n - 1


def _counts(grams: np.ndarray, known: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The totals of ``grams`` from a table sorted by ``known``; 0 for those it lacks."""
    out = np.zeros(len(grams), dtype=np.int64)
    if len(known):
        order = np.argsort(grams)  # sorted ones are found three times as fast
        grams = grams[order]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        out[order] = np.where(known[at] == grams, totals[at], 0)
    return out


def _table(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and totals of ``grams, totals`` rows."""
    grams, totals = _joined(rows, "grams", np.uint64), _joined(rows, "totals", np.int64)
    order = np.argsort(grams)
    return grams[order], totals[order]


def _numbers(batch: pa.Table, column: str, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(batch[column][0].as_buffer(), dtype=kind)


def _texts(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch, and the number of words of each text."""
    return _numbers(batch, "vocab", np.uint64)[_numbers(batch, "words", np.int32)], _numbers(batch, "sizes")


def _known(batch: pa.Table, n: int) -> np.ndarray:
    """For each word of a batch the total of the n-gram that ends at it (0: not counted or too few)."""
    return _numbers(batch, "c1")[_numbers(batch, "words", np.int32)] if n == 1 else _numbers(batch, f"c{n}")


def _tokens(docs: DataFrame, batch_words: int) -> DataFrame:
    """``batch, doc_ids, sizes, vocab, words, n_words``: documents in batches of about ``batch_words`` words, each word as its place among the batch's different ones."""
    kind = dict(docs.dtypes)["doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, words, total = [], [], [], 0

        def full() -> pa.RecordBatch:
            coded = pa.concat_arrays(words).dictionary_encode()
            vocab = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint64)
            index = coded.indices.to_numpy().astype(np.int32)
            columns = [int.from_bytes(os.urandom(7), "little"), ids, np.concatenate(sizes).astype(np.int64).tobytes(), vocab.tobytes(), index.tobytes(), len(index)]
            kinds = [pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], ["batch", "doc_ids", "sizes", "vocab", "words", "n_words"])

        for b in (whole.slice(at, 500) for whole in batches for at in range(0, len(whole), 500)):
            id_type = b.schema.field("doc_id").type
            split = pc.ascii_split_whitespace(b["text"])
            flat, ends = split.flatten(), np.cumsum(np.concatenate([[0], pc.list_value_length(split).to_numpy()]))
            word = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves an empty one
            sizes.append(np.diff(np.concatenate([[0], np.cumsum(word.to_numpy(zero_copy_only=False))])[ends]))
            words.append(flat.filter(word))
            ids += b["doc_id"].to_pylist()
            total += len(words[-1])
            if total >= batch_words or len(ids) >= batch_words:
                yield full()
                ids, sizes, words, total = [], [], [], 0
        if ids:
            yield full()

    return text_of(docs, "doc_id", "text").mapInArrow(pack, f"batch long, doc_ids array<{kind}>, sizes binary, vocab binary, words binary, n_words long")


def _joined(rows: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column].to_pylist()), dtype=kind)


def _rows(grams: np.ndarray, others: np.ndarray, starts: np.ndarray, keys: pa.Array, names: list[str]) -> pa.RecordBatch:
    """Rows of a key and two arrays as bytes, cut where each row starts."""
    packed = []
    for x in (grams, others):
        offsets = pa.py_buffer((x.itemsize * np.append(starts, len(x))).astype(np.int32))
        packed.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))]))
    return pa.RecordBatch.from_arrays([keys, *packed], names)


def _totals(least: int):
    """``batch, grams, totals`` of the n-grams with a total of ``least``, from a piece's rows ``batch, grams, n``."""

    def run(rows: pa.Table) -> pa.Table:
        sizes = pc.binary_length(rows["grams"]).to_numpy() // 8
        grams, n = _joined(rows, "grams", np.uint64), _joined(rows, "n", np.int32)
        order = np.argsort(grams)
        ordered = grams[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        totals = np.empty(len(grams), dtype=np.int64)
        totals[order] = np.repeat(np.add.reduceat(n[order], starts, dtype=np.int64), np.diff(np.append(starts, len(grams))))
        enough = totals >= least
        ends = np.concatenate([[0], np.cumsum(enough)])[np.cumsum(sizes)]
        return pa.Table.from_batches([_rows(grams[enough], totals[enough], np.append(0, ends[:-1]), rows["batch"].combine_chunks(), ["batch", "grams", "totals"])])

    return run


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, least: int = 2, batch_words: int = 1_000_000, slices: int = 4, deals: int = 2, piece_rows: int = 2_000_000) -> DataFrame:
    """One row per document: ``doc_id, n_words, log_score, mean_log_score``.

    Words are runs of characters other than ASCII white space, as written. The score of word w after context c is
    count(c w) / count(c) where count(c w) >= ``least``, else ``alpha`` times the score after the context
    without its first word; without a context it is count(w) / N. Counts cover all documents, N is the number of
    words. A document's own n-grams are in the counts, so with ``least`` 1 nothing would ever back off; with 2 an
    n-gram that a document alone has, once, isn't evidence for itself. ``log_score`` is the sum of natural
    logarithms over the document's words; contexts don't reach over documents. Null and empty texts have n_words
    0, log_score 0 and a null mean. Repeated rows count as often as they stand there; an empty table gives an
    empty result.

    A task holds a batch of documents and the counts of that batch's n-grams, whatever the size of the corpus.
    """
    kind = dict(docs.dtypes)["doc_id"]
    part = F.pmod(F.xxhash64("batch"), F.lit(slices)).alias("slice")
    tokens = written(_tokens(docs, batch_words).select("*", part), "lm-tokens", by="slice")
    words_in_all = tokens.agg(F.sum("n_words")).first()[0] or 0
    pieces = max(2 * parts(docs.sparkSession), words_in_all // (deals * piece_rows) + 1)
    kinds = {"batch": "long", "doc_ids": f"array<{kind}>", "sizes": "binary", "vocab": "binary", "words": "binary"}
    def range_of(hashes: np.ndarray, of: int) -> np.ndarray:
        """Which of so many equal ranges each hash lies in."""
        return ((hashes >> np.uint64(32)) * np.uint64(of) >> np.uint64(32)).astype(np.int64)

    def ask(n: int, deal: int, of: int):
        """The n-grams of each batch that may be seen, those of one of so many deals, as ``piece, batch, grams, n``: a row for each piece, which is a range of hashes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(len(b)):
                    one = pa.Table.from_batches([b.slice(k, 1)])
                    if n == 1:
                        vocab = _numbers(one, "vocab", np.uint64)
                        every, times = _grams(vocab, np.ones(len(vocab), np.int64), 1)[0], np.bincount(_numbers(one, "words", np.int32), minlength=len(vocab))
                        order = np.argsort(every)
                        every, times = every[order], times[order]
                    else:
                        grams, at = _grams(*_texts(one), n)
                        if n > 2:
                            seen = _known(one, n - 1) >= least
                            grams = grams[seen[at] & seen[at - 1]]
                        every, times = np.unique(grams[range_of(grams, of) == deal] if of > 1 else grams, return_counts=True)
                    piece = range_of(every, of * pieces)
                    starts = np.flatnonzero(np.diff(piece, prepend=-1))
                    keys = pa.array(piece[starts])
                    rows = _rows(every, times.astype(np.int32), starts, keys, ["piece", "grams", "n"])
                    yield rows.append_column("batch", pa.array(np.full(len(starts), one["batch"][0].as_py())))

        return run

    def put(orders: list[int]):
        """Write the totals of n-grams into the batch they came from; the last ones give the scores."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            table = _table(right)
            words, sizes = _texts(left)
            for n in orders:
                if n == 1:
                    vocab = _numbers(left, "vocab", np.uint64)
                    made = np.maximum(_counts(_grams(vocab, np.ones(len(vocab), np.int64), 1)[0], *table), 1)  # a word that isn't sent back occurs once
                else:
                    made = np.zeros(len(words), dtype=np.int64)
                    grams, at = _grams(words, sizes, n)
                    made[at] = _counts(grams, *table)
                left = left.append_column(f"c{n}", pa.array([made.tobytes()], pa.binary()))
            return score(left) if orders[-1] == order else left

        return run

    def score(left: pa.Table) -> pa.Table:
        words, sizes = _texts(left)
        context = _known(left, 1)
        logs = np.log(np.maximum(context, 1) / max(words_in_all, 1))
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for n in range(2, order + 1):
            count, at = _known(left, n), np.flatnonzero(place >= n - 1)
            seen = count[at] >= least
            logs[at] = np.where(seen, np.log(np.where(seen, count[at], 1) / np.where(seen, context[at - 1], 1)), np.log(alpha) + logs[at])
            context = count
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=logs, minlength=len(sizes))
        mean = [s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
        return pa.table({"doc_id": left["doc_ids"].combine_chunks().flatten(), "n_words": pa.array(sizes, pa.int64()), "log_score": pa.array(sums, pa.float64()), "mean_log_score": pa.array(mean, pa.float64())})

    def all_of(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def counts_of(n: int, deal: int, of: int) -> DataFrame:
        asked = whole.mapInArrow(ask(n, deal, of), "piece long, grams binary, n binary, batch long")
        told = asked.groupBy("piece").applyInArrow(_totals(least if n > 1 else 2), "batch long, grams binary, totals binary")
        return written(told.select("*", part), f"lm-counts-{n}", by="slice")

    state, old = [tokens.where(F.col("slice") == k) for k in range(slices)], [tokens]
    for orders in [list(range(1, min(order, 2) + 1)), *([n] for n in range(3, order + 1))]:
        last = orders[-1] == order
        whole = all_of(old).select(*kinds)
        dealt = [(n, deal, of) for n in reversed(orders) for of in (deals if n > 1 else 1,) for deal in range(of)]
        counted = [counts_of(*d) for d in dealt]
        before = list(kinds)
        kinds |= {f"c{n}": "binary" for n in orders}
        schema = f"doc_id {kind}, n_words long, log_score double, mean_log_score double" if last else ", ".join(f"{c} {t}" for c, t in kinds.items())
        done = []
        for k in range(slices):
            mine = all_of(counted).where(F.col("slice") == k).select("batch", "grams", "totals")
            both = state[k].select(*before).groupBy("batch").cogroup(mine.groupBy("batch"))
            done.append(written(both.applyInArrow(put(orders), schema), "lm-scores" if last else f"lm-state-{orders[-1]}"))
            forget(*counted, *([tokens] if old == [tokens] else []), part=f"slice={k}")
            forget(*(old[k : k + 1] if old != [tokens] else []))
        forget(*counted, *old)
        state = old = done
    return all_of(state)
