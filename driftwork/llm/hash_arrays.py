"""Sorted hash arrays in files: 64-bit keys with columns of counts, memory-mapped by the workers that read them.

Keys lie in order, cut into buckets by their upper bits; of the rest a file stores 32 bits and 0, 8 or 32 more. With 32 more a key is stored
whole. With none, a key that is not there is taken for another of its bucket, of some 12 keys, once in 3 x 10^8 lookups, however many keys
there are, until a file's buckets have 28 bits. Counts are bytes; the few of 255 or more stand beside them. Columns whose rows
repeat (sizes of contexts) have one byte together. Files lie in the shared folder, written under another
name and renamed, so a task that runs twice leaves the same files; readers map them and touch only the pages they need.
"""

from __future__ import annotations

import struct

import numpy as np

from driftwork.llm import _shared as S
from driftwork.llm import _text as T

_LOW = {0: None, 1: np.dtype("u1"), 4: np.dtype("<u4")}


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as bytes, with those of 255 or more after them as (position, count); or as whole integers, where that is less."""
    big = np.flatnonzero(x >= 255)
    wide = 4 if not len(x) or int(x.max()) < 1 << 32 else 8
    if len(x) + 16 * len(big) > wide * len(x):
        return struct.pack("<qqq", len(x), 0, wide) + x.astype(f"<u{wide}").tobytes()
    return struct.pack("<qqq", len(x), len(big), 1) + np.minimum(x, 255).astype(np.uint8).tobytes() + big.astype("<i8").tobytes() + x[big].astype("<i8").tobytes()


class Counts:
    """A packed column in a buffer."""

    def __init__(self, raw, at: int = 0):
        n, m, wide = struct.unpack_from("<qqq", raw, at)
        at += 24
        self.small = np.frombuffer(raw, f"<u{wide}", n, at)
        at += wide * n
        self.where, self.big, self.plain = np.frombuffer(raw, "<i8", m, at), np.frombuffer(raw, "<i8", m, at + 8 * m), wide > 1
        self.end = at + 16 * m

    def get(self, at: np.ndarray) -> list[np.ndarray]:
        x = self.small[at].astype(np.int64)
        large = np.empty(0, int) if self.plain else np.flatnonzero(x == 255)
        if len(large):
            x[large] = self.big[np.searchsorted(self.where, at[large])]
        return [x]

    def whole(self) -> np.ndarray:
        out = self.small.astype(np.int64)
        out[self.where] = self.big
        return out


def pack_group(columns: list[np.ndarray]) -> bytes:
    """Columns together: a byte for each row, for one of the 255 most frequent rows; other rows follow with their positions."""
    x = np.stack(columns, axis=1).astype(np.int64)
    mark = np.zeros(len(x), np.uint64)
    for c in x.T:
        mark = T.mix(mark * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    _, first, inverse, count = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
    often = np.argsort(-count, kind="stable")[:255]
    code = np.full(len(count), 255, np.uint8)
    code[often] = np.arange(len(often))
    codes = code[inverse.reshape(-1)]
    rare = np.flatnonzero(codes == 255)
    return struct.pack("<qqqq", len(x), len(often), len(rare), x.shape[1]) + codes.tobytes() + x[first[often]].astype("<i8").tobytes() + rare.astype("<i8").tobytes() + x[rare].astype("<i8").tobytes()


class Group:
    """Columns packed together in a buffer."""

    def __init__(self, raw, at: int = 0):
        n, often, rare, width = struct.unpack_from("<qqqq", raw, at)
        at += 32
        self.codes = np.frombuffer(raw, np.uint8, n, at)
        at += n
        self.table = np.frombuffer(raw, "<i8", often * width, at).reshape(often, width)
        at += 8 * often * width
        self.where = np.frombuffer(raw, "<i8", rare, at)
        self.rows = np.frombuffer(raw, "<i8", rare * width, at + 8 * rare).reshape(rare, width)
        self.end = at + 8 * rare * (1 + width)

    def get(self, at: np.ndarray) -> list[np.ndarray]:
        codes = self.codes[at]
        out = self.table[np.minimum(codes, max(0, len(self.table) - 1))]
        rare = np.flatnonzero(codes == 255)
        if len(rare):
            out[rare] = self.rows[np.searchsorted(self.where, at[rare])]
        return list(out.T)

    def whole(self) -> list[np.ndarray]:
        return self.get(np.arange(len(self.codes)))


class HashArray:
    """A sorted hash array in a buffer."""

    def __init__(self, raw):
        self.n, self.columns = 0, []
        if not len(raw):
            return
        self.n, self.bits, low, columns, grouped = struct.unpack_from("<qqqqq", raw, 0)
        at, kind = 40, np.dtype("<u4" if self.n < 1 << 32 else "<u8")
        self.limit = np.frombuffer(raw, kind, (1 << self.bits) + 1, at)
        at += self.limit.nbytes
        self.high = np.frombuffer(raw, "<u4", self.n, at)
        at += 4 * self.n
        self.low_bits, self.low = 8 * low, None
        if low:
            self.low = np.frombuffer(raw, _LOW[low], self.n, at)
            at += low * self.n
        for _ in range(columns):
            self.columns.append((Group if grouped else Counts)(raw, at))
            at = self.columns[-1].end

    @staticmethod
    def parts(keys: np.ndarray, columns: list[np.ndarray], low: int = 4, grouped: bool = False) -> list[bytes]:
        """keys: distinct, sorted; low: bytes that are stored of a key beside four; grouped: columns whose rows often are the same."""
        bits = max(0, min(28, (len(keys) // 8).bit_length() - 1))
        bucket = (keys >> np.uint64(63 - bits)) >> np.uint64(1)
        limit = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u4" if len(keys) < 1 << 32 else "<u8")
        rest = keys << np.uint64(bits)
        packed = [pack_group(columns)] if grouped else list(map(pack_counts, columns))
        out = [struct.pack("<qqqqq", len(keys), bits, low, len(packed), grouped), limit.tobytes(), (rest >> np.uint64(32)).astype("<u4").tobytes()]
        if low:
            out.append(((rest & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - 8 * low)).astype(_LOW[low]).tobytes())
        return [*out, *packed]

    def _stored(self, at: np.ndarray) -> np.ndarray:
        x = self.high[at].astype(np.uint64)
        return x if self.low is None else (x << np.uint64(self.low_bits)) | self.low[at].astype(np.uint64)

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The columns' counts for each key, 0 where it is not there."""
        if not self.n:
            return []
        bucket = ((keys >> np.uint64(63 - self.bits)) >> np.uint64(1)).astype(np.int64)
        rest = (keys << np.uint64(self.bits)) >> np.uint64(32 - self.low_bits)
        lo, end = (self.limit[b].astype(np.int64) for b in (bucket, bucket + 1))
        hi = end
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self._stored(np.minimum(mid, self.n - 1)) < rest)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(mid, hi))
        at = np.minimum(lo, self.n - 1)
        there = (lo < end) & (self._stored(at) == rest)
        return [np.where(there, x, 0) for c in self.columns for x in c.get(at)]


class Tables:
    """The tables of a model in one folder, each cut into shards by key; opened where they are first needed, so it travels with the tasks."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def put(self, table: str, shard: int, keys: np.ndarray, columns: list[np.ndarray], low: int = 4, grouped: bool = False) -> None:
        S.put_file(f"{self.folder}/{table}-{shard}", HashArray.parts(keys, columns, low, grouped))

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (T.mix(keys) % np.uint64(self.shards)).astype(np.int64)

    def find(self, table: str, keys: np.ndarray, columns: int, shard: np.ndarray | None = None) -> list[np.ndarray]:
        """The columns' counts of keys, 0 where a key is not there; shard: where they lie, if not by the key."""
        out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
        shard = self.shard(keys) if shard is None else shard
        order = np.lexsort((keys, shard))
        for i, j in runs(shard[order]):
            at = order[i:j]
            for o, x in zip(out, self._open(table, int(shard[at[0]])).find(keys[at]), strict=False):
                o[at] = x
        return out

    def _open(self, table: str, shard: int) -> HashArray:
        opened = self.__dict__.setdefault("opened", {})
        if (table, shard) not in opened:
            try:
                opened[table, shard] = HashArray(S.mapped(f"{self.folder}/{table}-{shard}"))
            except FileNotFoundError:
                opened[table, shard] = HashArray(b"")
        return opened[table, shard]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "opened"}


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(first, stop) of the runs of equal values."""
    if not len(x):
        return []
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return list(zip(start.tolist(), np.append(start[1:], len(x)).tolist(), strict=True))


def added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys in order, a position of each, sums of the counts)."""
    order = np.argsort(keys, kind="stable")
    sort = keys[order]
    start = np.flatnonzero(np.append(True, sort[1:] != sort[:-1])) if len(sort) else np.empty(0, np.int64)
    return sort[start], order[start], *(np.add.reduceat(c[order], start) if len(start) else c[:0] for c in counts)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney's discounts for counts 0, 1, 2 and 3 or more, from the counts of counts; halves where those are too few."""
    out, n = np.array([0.0, 0.5, 0.5, 0.5]), (n1, n2, n3, n4)
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for k in (1, 2, 3):
            if n[k - 1]:
                out[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)
    return out
