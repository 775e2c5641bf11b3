"""Words of Arrow text columns as numpy arrays: byte tables, word limits and 64-bit hashes, a block of whole texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text makes a block of its own.
BLOCK = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text in lower case: digits, letters and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER = [np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    if len(_POWER[0]) < n:
        size = max(n, 2 * len(_POWER[0]), 4096)
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _POWER[0] = np.multiply.accumulate(p)
    return _POWER[0]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and limits (n + 1 of them) of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]] if len(at) else data[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def blocks(batches, text: str = "text", size: int = BLOCK):
    """(batch, bytes, limits) with whole texts of about size bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = raw(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


class Words:
    """The words of a block: begin, end (byte limits), doc (the text's number), hash (64 bits), first (n + 1 limits by text)."""

    __slots__ = ("begin", "end", "first", "hash")

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = True, hashed: bool = True):
        n = len(data)
        data = LOWER[data] if lower else data
        inside = np.zeros(n + 1, bool)
        inside[:n] = kind[data]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[at] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        self.begin = np.flatnonzero(inside & (~before | edge))
        self.end = np.flatnonzero(before & (~inside | edge))
        self.first = np.searchsorted(self.begin, at)
        if hashed:
            if len(self.begin):
                length = self.end - self.begin
                where = np.arange(n) - np.repeat(self.begin, np.diff(np.append(self.begin, n))) if self.begin[0] == 0 else np.concatenate([np.zeros(self.begin[0], np.int64), np.arange(self.begin[0], n) - np.repeat(self.begin, np.diff(np.append(self.begin, n)))])
                part = _BYTE[data]
                part *= powers(int(length.max()) + 1)[np.minimum(where, int(length.max()))]
                part[~inside[:n]] = 0
                self.hash = mix(np.add.reduceat(part, self.begin) + length.astype(np.uint64))
            else:
                self.hash = np.empty(0, np.uint64)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_spans(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans that begin at these places (the first at 0) and reach to the next."""
    length = np.diff(np.append(begin, len(data)))
    part = _BYTE[data]
    part *= powers(int(length.max(initial=1)) + 1)[np.arange(len(data)) - np.repeat(begin, length)]
    return mix(np.add.reduceat(part, begin) + length.astype(np.uint64))


def hash_word(word: str | bytes) -> int:
    """The hash that Words gives one word (already in lower case)."""
    data = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    part = _BYTE[data] * powers(len(data))[: len(data)]
    return int(mix(np.array([np.add.reduce(part, dtype=np.uint64) + np.uint64(len(data))], np.uint64))[0])


def by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values within the limits first; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
