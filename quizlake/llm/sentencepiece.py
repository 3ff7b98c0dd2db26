"""Operator 1, SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces runs once over the text; at each position its output links give all
pieces that end there, and a table over positions is relaxed with them.

* Unigram models: Viterbi; the table holds the best sum of piece scores.
* BPE models: scores are merge ranks, and the segmentation with the largest sum of ranks is not what the
  model's merges give. The pass is the same, but the table holds the last piece of the merged prefix: a
  piece is accepted where merging leaves it beside the last piece of the prefix before it, and just one is.
  The ids are those of the public library.

A text is cut where two characters meet that no piece has side by side, as neither merging nor a piece can cross
such a place; the parts are encoded alone, and each worker keeps those it has met in a bounded table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


@dataclass(frozen=True)
class PieceModel:
    """The table of a SentencePiece model; ``kinds``: n normal, u unknown, c control, b byte."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    bpe: bool
    dummy_prefix: bool = True
    unk: int = 0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


def load_model(path: str = MODEL) -> PieceModel:
    """Read a model file. Its text must need no character normalisation (as byte-fallback models): else ValueError."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    top: dict[int, bytes] = {k: v for k, v in _fields(sp.serialized_model_proto()) if k in (2, 3) and isinstance(v, bytes)}
    trainer, normalizer = (dict(_fields(top.get(k, b""))) for k in (2, 3))
    if normalizer.get(2) or normalizer.get(4, 1) == 1:
        raise ValueError("the model normalises characters or drops spaces")
    n = sp.get_piece_size()
    kinds = "".join("u" if sp.is_unknown(i) else "c" if sp.is_control(i) else "b" if sp.is_byte(i) else "n" for i in range(n))
    return PieceModel(tuple(sp.id_to_piece(i) for i in range(n)), tuple(sp.get_score(i) for i in range(n)), kinds, trainer.get(3, 1) == 2, bool(normalizer.get(3, 1)), sp.unk_id())


class Codec:
    """Encoder and decoder of a ``PieceModel``."""

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.m = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == "n"}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == "b"}
        self.machine = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.machine.add_word(p, (i, len(p)))
        self.machine.make_automaton()
        self.chars = {p for p in self.ids if len(p) == 1}
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.lengths = [len(p) for p in model.pieces]
        self.whole: dict[int, bool] = {}
        words = all(SPACE not in p.lstrip(SPACE) for p in self.ids) and not any("\n" in p for p in self.ids)
        self.words = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if words else r"(?s).+")
        self.marks = re.compile(rf"[^\W_]+|{SPACE}+[^\W_]*|[^\w{SPACE}]|_+")
        self.plain = re.compile(rf"{SPACE}?[^{SPACE}]*")
        self.seen: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        byte_of = {i: b for b, i in self.bytes.items()}
        self.out = [bytes([byte_of[i]]) if k == "b" else b"" if k == "c" else " ⁇ ".encode() if k == "u" else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True))]

    def merged(self, text: str) -> list[str]:
        """Merge the adjacent pair of the best score, the leftmost of equals, until none is a piece: a queue of pairs, so long runs cost n log n."""
        parts, ids, score = list(text), self.ids, self.m.scores
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = []

        def offer(left: int, right: int) -> None:
            whole = parts[left] + parts[right]
            i = ids.get(whole)
            if i is not None:
                heapq.heappush(queue, (-score[i], left, right, whole))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while queue:
            _, left, right, whole = heapq.heappop(queue)
            if parts[left] is None or parts[right] is None or after[left] != right or parts[left] + parts[right] != whole:
                continue  # one of the two has been merged since
            parts[left], parts[right] = whole, None
            after[left] = then = after[right]
            if then < len(parts):
                before[then] = left
                offer(left, then)
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p is not None]

    def _beside(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces ``a`` and ``b`` beside each other."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        x, y = self.m.pieces[a], self.m.pieces[b]
        got = self.pairs[a * len(self.lengths) + b] = self.merged(x + y) == [x, y]
        return got

    def _first(self, i: int) -> bool:
        """Whether merging a piece's characters gives the piece."""
        got = self.whole[i] = self.merged(self.m.pieces[i]) == [self.m.pieces[i]]
        return got

    def _word(self, word: str) -> bytes:
        """Ids of a word, kept for the next time. It is cut at marks where no piece has both neighbours side by side."""
        parts: list[str] = []
        for x in self.marks.findall(word):
            if parts and parts[-1][-1] + x[0] in self.joined:
                parts[-1] += x
            else:
                parts.append(x)
        seen = self.seen
        if len(seen) > 1_000_000:  # a bound on the worker's memory
            seen.clear()
        out = b""
        for x in parts:
            ids = seen.get(x)
            if ids is None:
                ids = np.array(self._bpe(x) if self.m.bpe else self._viterbi(x), dtype=np.int32).tobytes()
                if len(x) < 64:
                    seen[x] = ids
            out += ids
        if len(word) < 64:
            seen[word] = out
        return out

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.m.unk]

    def _bpe(self, word: str) -> list[int]:
        if not self.plain.fullmatch(word) or not self.chars.issuperset(word):  # ties between runs of spaces; characters without a piece
            return [i for p in self.merged(word) for i in ([self.ids[p]] if p in self.ids else self._fallback(p))]
        last, pairs, whole, size = [-1] * (len(word) + 1), self.pairs, self.whole, len(self.lengths)
        for end, (i, n) in self.machine.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            if start := end - n:
                a = last[start]
                if a < 0:
                    continue
                fits = pairs.get(a * size + i)
                if fits is None:
                    fits = self._beside(a, i)
            else:
                fits = whole.get(i)
                if fits is None:
                    fits = self._first(i)
            if fits:
                last[end] = i
        out, at = [], len(word)
        while at:
            out.append(i := last[at])
            at -= self.lengths[i]
        return out[::-1]

    def _viterbi(self, word: str) -> list[int]:
        """Best sum of scores; of equal sums the one met first. A character without a piece scores below every piece."""
        low = min(self.m.scores, default=0.0) - 10.0
        best: list[float | None] = [0.0, *[None] * len(word)]
        last: list[tuple[int, int] | None] = [None] * (len(word) + 1)
        ends: dict[int, list[tuple[int, int]]] = {}
        for end, x in self.machine.iter(word):
            ends.setdefault(end + 1, []).append(x)
        for end in range(1, len(word) + 1):
            for i, n in ends.get(end, ()):
                score = best[end - n] + self.m.scores[i]
                if best[end] is None or score > best[end]:
                    best[end], last[end] = score, (i, end - n)
            if word[end - 1] not in self.chars and (best[end] is None or best[end - 1] + low > best[end]):
                best[end], last[end] = best[end - 1] + low, (-1, end - 1)
        out, at = [], len(word)
        while at > 0:
            i, start = last[at]
            out += [i] if i >= 0 else self._fallback(word[start])[::-1]
            at = start
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids (int32) of a whole text; none for an empty one."""
        if not text:
            return np.empty(0, dtype=np.int32)
        marked = ((" " if self.m.dummy_prefix else "") + text).replace(" ", SPACE)
        get, word = self.seen.get, self._word
        return np.frombuffer(b"".join([get(w) or word(w) for w in self.words.findall(marked)]), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined, invalid ones replaced, the dummy prefix taken off."""
        text = b"".join(map(self.out.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.m.dummy_prefix and text.startswith(" ") else text


_codecs: dict[int, tuple[PieceModel, Codec]] = {}


def codec(model: PieceModel) -> Codec:
    """One codec for each model in a worker process."""
    key = hash(model)
    if key not in _codecs or _codecs[key][0] != model:
        _codecs[key] = model, Codec(model)
    return _codecs[key][1]


def encode_pieces(docs: DataFrame, model: PieceModel, verify: bool = True) -> DataFrame:
    """``docs`` plus ``input_ids array<int>``, ``n_tokens`` and, with ``verify``, ``round_trip``: whether decoding gives the text back.

    Whole texts; null counts as empty and has no ids. U+2581 in a text becomes a space, as the format has no
    other place for it; such texts have ``round_trip`` false. Columns of these names are replaced, all others
    kept. Rows are encoded alone; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the model's own table, whatever the input
    kept = docs.drop("input_ids", "n_tokens", "round_trip")
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                texts = [t or "" for t in b.column(place).to_pylist()]
                ids = [c.encode(t) for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))), pa.array(np.diff(ends).astype(np.int64))]
                if verify:
                    made.append(pa.array([c.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "input_ids", "n_tokens", "round_trip"][: len(b.schema.names) + len(made)])

    return _through(kept, run, {"input_ids": "array<int>", "n_tokens": "long"} | ({"round_trip": "boolean"} if verify else {}))


def _through(rows: DataFrame, run: Callable, added: dict[str, str]) -> DataFrame:
    """``rows.mapInArrow`` with columns added behind the others; any name is allowed, so they go through under plain ones."""
    plain = rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])
    schema = ", ".join([f"{n} {t}" for n, t in plain.dtypes] + [f"{n} {t}" for n, t in added.items()])
    return plain.mapInArrow(run, schema).toDF(*rows.columns, *added)


def decode_pieces(rows: DataFrame, model: PieceModel) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``input_ids`` (null for null); ids outside the model raise IndexError."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = rows.drop("decoded")
    place = kept.columns.index("input_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            texts = [None if i is None else c.decode(i) for i in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return _through(kept, run, {"decoded": "string"})
