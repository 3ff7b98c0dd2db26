"""Operator 8, chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its assistant spans are intersected with the
token spans by binary search. Turn marks are added tokens of the tokenizer, so no token straddles a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@dataclass(frozen=True)
class ChatTemplate:
    """``open role middle text close`` for each turn.

    ``control`` lists further strings that trainers treat as control marks. Every control string inside a role or
    text gets a backslash after its first character (one more where some stand there already); ``unescape``
    takes it away again, so every text comes back exactly.
    """

    open: str = "<|turn|>"
    middle: str = "<|says|>"
    close: str = "<|done|>"
    control: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    @property
    def marks(self) -> list[str]:
        return [self.open, self.middle, self.close]

    def escape(self, text: str) -> str:
        return _grow(text, self)

    def unescape(self, text: str) -> str:
        return _shrink(text, self)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text and the span of each turn's (escaped) text in it, in code points."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.open}{self.escape(role)}{self.middle}", self.escape(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.close]
            at = spans[-1][1] + len(self.close)
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns back from a rendered conversation."""
        turns = []
        for part in formatted.split(self.open)[1:]:
            role, _, text = part.removesuffix(self.close).partition(self.middle)
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


_patterns: dict = {}


def _compiled(template: ChatTemplate) -> tuple[re.Pattern, re.Pattern]:
    """Patterns that find a control string with any / at least one backslash after its first character."""
    if template not in _patterns:
        found = sorted({*template.marks, *template.control}, key=len, reverse=True)
        if any(x[0] not in "<[" or set("<[\\") & set(x[1:]) for x in found):
            raise ValueError("a control string begins with < or [ and holds neither later, nor a backslash")
        _patterns[template] = tuple(re.compile("|".join(rf"{re.escape(x[0])}\\{n}{re.escape(x[1:])}" for x in found)) for n in "*+")
    return _patterns[template]


def _grow(text: str, template: ChatTemplate) -> str:
    return _compiled(template)[0].sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def _shrink(text: str, template: ChatTemplate) -> str:
    return _compiled(template)[1].sub(lambda m: m[0][0] + m[0][2:], text)


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, whether it lies under one of the sorted, disjoint spans.

    ``offsets`` is (n, 2), sorted by start. Both ends are found by binary search over the span starts and ends; a
    token counts when it overlaps a span.
    """
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    starts, ends = np.array(spans).T
    k = np.searchsorted(ends, offsets[:, 0], side="right")
    inside = k < len(starts)
    return inside & (offsets[:, 1] > starts[np.minimum(k, len(starts) - 1)])


_tokenizers: dict = {}


def load_tokenizer(data: str, template: ChatTemplate):
    """A public tokenizer, from its file's content, with the template's marks as added tokens; other special strings stay text. One for each in a worker process."""
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.decoders import ByteLevel
    from tokenizers.processors import ByteLevel as ByteOffsets

    if (data, template) not in _tokenizers:
        t = Tokenizer.from_str(data)
        t.encode_special_tokens = True
        if isinstance(t.decoder, ByteLevel):
            t.post_processor = ByteOffsets(trim_offsets=False)  # a token's span then holds its leading space
        t.add_tokens([AddedToken(x, normalized=False, special=False) for x in template.marks])
        t.no_truncation()
        _tokenizers[data, template] = t
    return _tokenizers[data, template]


def _shipped(rows: DataFrame, path: str) -> Broadcast:
    """The tokenizer file's content, read on the driver: executors need no file of their own."""
    return rows.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate(), tokenizer: str = TOKENIZER, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, input_ids, loss_mask``.

    Turns are ordered by ``turn`` (null first), ties by role and text, so repeated rows have a defined place;
    null roles and texts count as empty; rows with a null ``conv_id`` form one conversation. Control strings in
    texts are escaped (see ``ChatTemplate``). A conversation without loss roles has an all-false mask; an empty
    table gives no rows. A rendered conversation is one row and its turns meet in one task, as the format needs.
    """
    shared = _shipped(rows, tokenizer)
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(shared.value, template)
        for whole in batches:
            for at in range(0, len(whole), 64):
                b = whole.slice(at, 64)
                turns = [list(zip(r, x, strict=True)) for r, x in zip(b["roles"].to_pylist(), b["texts"].to_pylist(), strict=True)]
                made = [template.render(t) for t in turns]
                ids, masks = [], []
                for e, (_, spans), t in zip(tok.encode_batch([text for text, _ in made], add_special_tokens=False), made, turns, strict=True):
                    wanted = [s for s, (role, _) in zip(spans, t, strict=True) if role in loss_roles and s[1] > s[0]]
                    ids.append(np.array(e.ids, dtype=np.int32))
                    masks.append(loss_mask(np.array(e.offsets, dtype=np.int64).reshape(-1, 2), wanted))
                columns = [b["conv_id"], pa.array([len(t) for t in turns], pa.int64()), pa.array([text for text, _ in made], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "formatted", "input_ids", "loss_mask"])

    kind = dict(rows.dtypes)["conv_id"]
    return grouped.mapInArrow(encode, f"conv_id {kind}, n_turns long, formatted string, input_ids array<int>, loss_mask array<boolean>")


def chat_digest(formatted: DataFrame, template: ChatTemplate = ChatTemplate(), tokenizer: str = TOKENIZER) -> DataFrame:
    """What can be read back from ``format_chats``: turns parsed from the formatted text, loss text decoded from the masked ids.

    One row a conversation, as ``format_chats`` gives them (null texts and roles as empty ones, a null conv_id as one
    conversation). A conversation without an assistant has 0 loss_chars and the digest of an empty text. Other
    columns are ignored; an empty table gives an empty result.
    """

    shared = _shipped(formatted, tokenizer)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(shared.value, template)
        for b in batches:
            out = []
            for text, ids, mask in zip(b["formatted"].to_pylist(), b["input_ids"], b["loss_mask"], strict=True):
                turns = template.parse(text)
                ids = ids.values.to_numpy()
                edge = np.diff(np.concatenate([[0], mask.values.to_numpy(zero_copy_only=False).astype(np.int8), [0]]))
                runs = [tok.decode(ids[s:e].tolist(), skip_special_tokens=False) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                loss = "".join(template.unescape(r) for r in runs)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            rest = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b["conv_id"], *rest], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
