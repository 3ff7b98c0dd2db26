"""Candidates of near lines: band keys move as arrays a batch and range of keys, with a sketch of each line, so that
lines that meet by chance go before anything but their keys has moved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import band_keys, mix, signatures

#: Keys in a range, on average; lines whose keys are dealt together; members of a key in such a batch from which it counts as hot.
_RANGE, _DEALT, _HOT = 250_000, 50_000, 100
#: Members of a key up to which their sketches are compared.
_TESTED = 128
#: Signature values whose two bits make a sketch.
_SLOTS = 64


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of each of the first 64 values of signatures, (n, 2) uint64."""
    some = signature[:, :_SLOTS]
    out = np.zeros((len(some), 2, _SLOTS // 8), dtype=np.uint8)
    for k, bit in enumerate((7, 8)):
        packed = np.packbits((some >> np.uint32(bit)).astype(np.uint8) & np.uint8(1), axis=1)
        out[:, k, : packed.shape[1]] = packed
    return out.reshape(len(some), -1).view(np.uint64)


def most_apart(jaccard: float, values: int, loss: float = 1e-6) -> int:
    """Bits by which the sketches of two lines at ``jaccard`` differ at most, but for a chance of ``loss``: equal values
    give equal bits, of different ones each bit differs half the time."""
    one, spread = np.array([jaccard + (1 - jaccard) / 4, (1 - jaccard) / 2, (1 - jaccard) / 4]), np.ones(1)
    for _ in range(min(values, _SLOTS)):
        spread = np.convolve(spread, one)
    return int(np.flatnonzero(1 - np.cumsum(spread) <= loss)[0])


def dealt_keys(batches: Iterator[tuple[np.ndarray, np.ndarray]], ranges: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """``range, key, id, sketch, hot`` from ids and signatures: of each batch of lines one row for each range of keys, with arrays in bytes.

    ``key`` has the lower halves of the keys in the range. Keys with many members in the batch are named in ``hot``;
    their members, with whole keys, go to ranges from ``ranges`` on, spread by batch, so that no range holds a large group.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        ids, signature = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        keys, marks = band_keys(signature, bands, rows).view(np.uint64).ravel(), sketches(signature)
        order = np.argsort(keys)
        keys, of = keys[order], order // bands
        at = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        whole = (at.astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(first, len(keys)))
        many = n > _HOT
        hot, spared = np.repeat(many, n), first[many]
        numbers = np.arange(ranges + 1)

        def column(values: np.ndarray, ranged: np.ndarray, last: np.ndarray) -> pa.Array:
            data = np.concatenate((values.reshape(-1).view(np.uint8), last.view(np.uint8)))
            offsets = np.append(np.searchsorted(ranged, numbers) * values.itemsize * math.prod(values.shape[1:]), len(data))
            return pa.Array.from_buffers(pa.binary(), ranges + 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])

        none, few = np.empty(0, dtype=np.uint8), ~hot
        where = pa.array(np.append(numbers[:-1], ranges + int(keys[0]) % ranges), pa.int32())
        out = pa.RecordBatch.from_arrays([
            where,
            column((keys[few] & np.uint64(0xFFFFFFFF)).astype(np.uint32), at[few], whole[hot]),
            column(ids[of[few]], at[few], ids[of[hot]]),
            column(marks[of[few]], at[few], none),
            column((keys[spared] & np.uint64(0xFFFFFFFF)).astype(np.uint32), at[spared], none),
        ], ["range", "key", "id", "sketch", "hot"])
        sizes = sum(np.diff(np.frombuffer(out[c].buffers()[1], dtype=np.int32)) for c in ("key", "hot"))
        return out.filter(pa.array(sizes > 0))

    for ids, signature in batches:
        held.append((ids, signature))
        if sum(len(x) for x, _ in held) >= _DEALT:
            yield flush()
    if held:
        yield flush()


DEALT = "range int, key binary, id binary, sketch binary, hot binary"


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin, and their lengths."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1])))
    return first, np.diff(np.append(first, len(keys)))


def _linked(keys: np.ndarray, marks: np.ndarray, most: int) -> np.ndarray:
    """The first place of each place's component; places with one key are linked where their sketches are near."""
    low = np.arange(len(keys))
    left, back, a, b = np.arange(len(keys)), 0, [], []
    while True:
        back += 1
        left = left[left < len(keys) - back]
        left = left[keys[left] == keys[left + back]]
        if not len(left):
            break
        other = left + back
        apart = np.bitwise_count(marks[left, 0] ^ marks[other, 0]).astype(np.int64) + np.bitwise_count(marks[left, 1] ^ marks[other, 1])
        near = apart <= most
        a.append(left[near].astype(np.int32))
        b.append(other[near].astype(np.int32))
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        while len(a):
            least = np.minimum(low[a], low[b])
            np.minimum.at(low, a, least)
            np.minimum.at(low, b, least)
            low = low[low]
            apart = low[a] != low[b]
            if not apart.any():
                break
    return low


def buckets_of(most: int, ranges: int, together: int, bound: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """``bucket, n, id`` of a range: for each key the groups of its members that near sketches connect, named as in ``shared_buckets``.
    Keys with more than ``_TESTED`` members stay whole. ``n`` is 0 where the key is hot: there the bucket is the key."""

    def table(*columns: np.ndarray) -> pa.Table:
        return pa.table({c: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64()) for c, x in zip(("bucket", "n", "id"), columns, strict=True)})

    def named(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``groups``: of each id, sorted, those of one beside each other."""
        first, n = _runs(groups)
        if not len(first):
            return np.empty(0, np.uint64), np.empty(0, np.int64), ids
        hashed = mix(ids.view(np.uint64) + np.uint64(1))
        digest = mix(mix(np.bitwise_xor.reduceat(hashed, first) + n.astype(np.uint64)) + np.add.reduceat(mix(hashed), first))
        least = mix(np.minimum.reduceat(ids, first).view(np.uint64) + np.uint64(3))
        few = n <= together
        return np.repeat(np.where(few, least, digest), n), np.repeat(np.where(few, bound, n), n), ids

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        at = key[0].as_py()
        read = lambda c, kind: np.frombuffer(b"".join(x for x in rows[c].to_pylist() if x), dtype=kind)
        ids = read("id", np.int64)
        if at >= ranges:
            return table(read("key", np.uint64), np.zeros(len(ids), np.int64), ids)
        keys, marks, hot = read("key", np.uint32), read("sketch", np.uint64).reshape(-1, 2), np.unique(read("hot", np.uint32))
        out = []
        if len(hot):
            of = np.isin(keys, hot)
            out.append(((np.uint64(at) << np.uint64(32)) | keys[of].astype(np.uint64), np.zeros(int(of.sum()), np.int64), ids[of]))
            keys, ids, marks = keys[~of], ids[~of], marks[~of]
        order = np.argsort(keys, kind="stable")
        _, n = _runs(keys[order])
        order = order[np.repeat(n > 1, n)]
        order = order[np.lexsort((ids[order], keys[order]))]
        k, i = keys[order], ids[order]
        order = order[np.concatenate((np.ones(min(1, len(k)), dtype=bool), (k[1:] != k[:-1]) | (i[1:] != i[:-1])))]
        k, i, s = keys[order], ids[order], marks[order]
        _, n = _runs(k)
        size = np.repeat(n, n)
        out.append(named(k[size > _TESTED], i[size > _TESTED]))
        few = (size > 1) & (size <= _TESTED)
        k, i, s = k[few], i[few], s[few]
        low = _linked(k, s, most)
        order = np.argsort(low, kind="stable")
        order = order[np.bincount(low, minlength=len(low))[low[order]] > 1]
        out.append(named(low[order], i[order]))
        return table(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return run


def near_buckets(lines: DataFrame, ranges: int, most: int, together: int, bound: int) -> DataFrame:
    """``bucket, n, id`` from the rows of ``dealt_keys``, each once."""
    return lines.groupBy("range").applyInArrow(buckets_of(most, ranges, together, bound), "bucket long, n long, id long").distinct()


def ranges_of(lines: int, bands: int, least: int) -> int:
    """How many ranges the keys of so many lines make."""
    return max(least, math.ceil(lines * bands / _RANGE))


def line_signatures(lines: list[str], shingles: Callable[[np.ndarray, int], np.ndarray], chars: int, k: int, seed: int) -> np.ndarray:
    """MinHash signatures of lines of at least ``chars`` characters, (lines, k)."""
    sizes = np.array([len(t) for t in lines])
    made = shingles(np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32), chars)
    inside = np.ones(int(sizes.sum()), dtype=bool)
    for back in range(1, chars):
        inside[np.cumsum(sizes) - back] = False
    starts = np.concatenate([[0], np.cumsum(sizes - chars + 1)])[:-1]
    return signatures(made[inside[: len(made)]], starts, k, seed)
