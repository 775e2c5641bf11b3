"""Token ids in sorted-string-table shards, and their readers.

A shard holds documents in ascending id. Keys are the ids as 8 big-endian bytes with the sign bit turned, so that bytes sort like numbers; equal
ids follow each other. A data block is entries of (length of the prefix shared with the key before, length of the rest, bytes of
the value, rest of the key, value); a block begins with a whole key. Values are token ids as 16- or 32-bit little-endian integers.
After the blocks: the sparse index (first key, offset, bytes, entries and ids before each block), a Bloom filter over the keys, and a
footer of fixed size with their places, the counts and a mark. A lookup asks the filter, finds the block by binary search, and
reads that block only.

Documents are dealt by ranges of their ids, and a task closes a shard and begins the next whenever it has SHARD_BYTES, so that it holds no
more than one; shards follow each other by part and number. Each is written under another name and renamed, so a task that runs
twice leaves one whole file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwork.llm import _shared as S
from driftwork.llm import _text as T

BLOCK_BYTES = 64 << 10
#: Bytes of a shard's data from which the next one begins.
SHARD_BYTES = 64 << 20
#: Bytes of ids (4 each) that a reading task takes.
READ_BYTES = 256 << 20
#: Bits of the Bloom filter for each key, and its hash functions.
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Pieces of text that a worker keeps with their ids (about 25 bytes each), and pieces joined to one text for the library.
CACHE_PIECES, JOINED = 3_000_000, 2000
#: Bytes of text encoded together.
ENCODE_BYTES = 6 << 20

_ENTRY, _INDEX, _FOOTER, _MARK = struct.Struct("<BBI"), struct.Struct("<8sQIIQ"), struct.Struct("<QQQQQQII8s"), b"DWTOKEN1"
_FLIP = 1 << 63


def key_of(doc_id: int) -> bytes:
    return ((doc_id & ((1 << 64) - 1)) ^ _FLIP).to_bytes(8, "big")


def id_of(key: bytes) -> int:
    x = int.from_bytes(key, "big") ^ _FLIP
    return x - (1 << 64) if x >= _FLIP else x


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    a, b = T.mix(keys), T.mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return np.stack([(a + b * np.uint64(k)) % np.uint64(bits) for k in range(BLOOM_HASHES)])


class Writer:
    """Collects one shard: add() in ascending order, then finish() for its parts."""

    def __init__(self, width: int):
        self.width, self.parts, self.block, self.index, self.keys = width, [], [], [], []
        self.size = self.offset = self.entries = self.ids = self.block_ids = 0
        self.before = b""

    def add(self, doc_id: int, value: bytes) -> None:
        key, shared = key_of(doc_id), 0
        if self.block:
            while shared < 8 and key[shared] == self.before[shared]:
                shared += 1
        else:
            self.first, self.block_ids = key, self.ids
        self.block.append(_ENTRY.pack(shared, 8 - shared, len(value)) + key[shared:] + value)
        self.size += len(self.block[-1])
        self.ids += len(value) // self.width
        self.before = key
        self.keys.append(doc_id)
        if self.size >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.block:
            self.index.append(_INDEX.pack(self.first, self.offset, self.size, len(self.block), self.block_ids))
            self.parts += self.block
            self.offset += self.size
            self.block, self.size = [], 0

    def finish(self) -> list[bytes]:
        self._close()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS + 7 & ~7)
        bloom = np.zeros(bits, bool)
        bloom[_bloom_places(np.array(self.keys, np.int64).view(np.uint64), bits).ravel().astype(np.int64)] = True
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        footer = _FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), len(self.keys), self.ids, self.width, zlib.crc32(index + bloom), _MARK)
        return [*self.parts, index, bloom, footer]


class Shard:
    """A reader over a shard's bytes (a memory map, where the folder is mounted)."""

    def __init__(self, raw):
        self.raw = memoryview(raw)
        at, size, bloom_at, bloom_size, self.entries, self.ids, self.width, check, mark = _FOOTER.unpack(self.raw[-_FOOTER.size :])
        if mark != _MARK or zlib.crc32(self.raw[at : bloom_at + bloom_size]) != check:
            raise ValueError("not a whole token shard")
        self.index = [_INDEX.unpack_from(self.raw, at + k) for k in range(0, size, _INDEX.size)]
        self.bloom = np.frombuffer(self.raw[bloom_at : bloom_at + bloom_size], np.uint8)

    def __iter__(self):
        """(doc_id, ids before it in the shard, ids)."""
        for k in range(len(self.index)):
            yield from self._block(k)

    def _block(self, k: int):
        _, at, _, count, start = self.index[k]
        key = b""
        for _ in range(count):
            shared, rest, size = _ENTRY.unpack_from(self.raw, at)
            at += _ENTRY.size
            key = key[:shared] + bytes(self.raw[at : at + rest])
            at += rest
            ids = np.frombuffer(self.raw[at : at + size], f"<u{self.width}")
            yield id_of(key), start, ids
            at += size
            start += len(ids)

    def may_hold(self, doc_id: int) -> bool:
        places = _bloom_places(np.array([doc_id], np.int64).view(np.uint64), len(self.bloom) * 8).ravel().astype(np.int64)
        return bool(((self.bloom[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all())

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all rows of a document: the blocks that may begin before it or with it, by binary search."""
        if not self.index or not self.may_hold(doc_id):
            return []
        key, lo, hi = key_of(doc_id), 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        out, k = [], max(0, lo - 1)
        while k < len(self.index) and self.index[k][0] <= key:
            out += [ids for d, _, ids in self._block(k) if d == doc_id]
            k += 1
        return out


#: Texts of these characters only (ASCII without apostrophes, Latin letters) are cut here as the library's byte-level splitter cuts
#: them, and their pieces encoded once; other texts go to the library whole.
_PLAIN = re.compile("[\t\n\r\x20-\x26\x28-\x7eÀ-ÖØ-öø-ɏ]*")
_LETTER, _DIGIT, _BLANK, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[[9, 10, 13, 32]] = _BLANK


def pieces(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the splitter's pieces of a block of such texts begin: runs of letters, digits or others with one space before them, and
    what else there is of blanks, of which the last before a piece stands alone unless it is that space."""
    n = len(data)
    kind = _KINDS[data]
    begin = np.zeros(n, bool)
    begin[at[:-1][at[:-1] < n]] = True
    text = begin.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(begin & ~text & (kind != _BLANK))
    after = after[kind[after - 1] == _BLANK]
    begin[after - 1] = True
    begin[after[data[after - 1] == 32]] = False
    return np.flatnonzero(begin)


class Encoder:
    """Texts to ids with the tokenizers library; frequent pieces are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        vocabulary = self.library.get_vocab()
        # a byte-level token has a character for each of its bytes
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.stock = np.empty(0, f"<u{self.width}")

    def _learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode the pieces data[begin:end] and keep them under their keys."""
        kind, size = f"<u{self.width}", end - begin
        # a blank and letters: joined, the library parts them again, and the ids' bytes tell whose they are
        simple = (size > 1) & (data[begin] == 32) & (_KINDS[data[np.minimum(begin + 1, len(data) - 1)]] == _LETTER)
        some, alone = np.flatnonzero(simple), [np.flatnonzero(~simple)]
        limit = np.concatenate([[0], np.cumsum(size[some])]).astype(np.int64)
        joined = data[np.repeat(begin[some] - limit[:-1], size[some]) + np.arange(limit[-1])].tobytes()
        cuts = [*range(0, len(some), JOINED), len(some)]
        groups = [slice(i, j) for i, j in zip(cuts, cuts[1:], strict=False) if i < j]
        ids, sizes, order = [], [], []
        for g, e in zip(groups, self.library.encode_batch_fast([joined[limit[g.start] : limit[g.stop]].decode() for g in groups], add_special_tokens=False), strict=True):
            found = np.array(e.ids, kind)
            ends, want = np.cumsum(self.bytes_of[found]), limit[g.start + 1 : g.stop + 1] - limit[g.start]
            last = np.searchsorted(ends, want)
            if not len(ends) or ends[-1] != want[-1] or (ends[last] != want).any():
                alone.append(some[g])
                continue
            ids.append(found)
            sizes.append(np.diff(last, prepend=-1))
            order.append(some[g])
        rest = np.concatenate(alone)
        for e in self.library.encode_batch_fast([data[i:j].tobytes().decode() for i, j in zip(begin[rest].tolist(), end[rest].tolist(), strict=True)], add_special_tokens=False):
            ids.append(np.array(e.ids, kind))
            sizes.append([len(ids[-1])])
        sizes, keys = np.concatenate(sizes).astype(np.int64), keys[np.concatenate([*order, rest])]
        self.start = np.concatenate([self.start, len(self.stock) + np.cumsum(sizes) - sizes])
        self.stock = np.concatenate([self.stock, *ids])
        self.keys, self.size = np.concatenate([self.keys, keys]), np.concatenate([self.size, sizes])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.start, self.size = self.keys[order], self.start[order], self.size[order]

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != keys)

    def _plain(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        at = np.concatenate([[0], np.cumsum(np.array([len(x) for x in raw], np.int64))]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = pieces(data, at)
        if not len(begin):
            return [b""] * len(texts)
        end = np.append(begin[1:], len(data))
        keys, first, which = np.unique(T.hash_spans(data, begin), return_index=True, return_inverse=True)
        new = self._missing(keys)
        if len(self.keys) + len(new) > CACHE_PIECES:
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            self._learn(keys[new], data, begin[first[new]], end[first[new]])
        at_key = np.searchsorted(self.keys, keys)
        size, start, stock = self.size[at_key], self.start[at_key], self.stock
        each = size[which]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = stock[np.repeat(start[which] - total[:-1], each) + np.arange(total[-1])]
        limit = total[np.searchsorted(begin, at)]
        return [ids[i:j].tobytes() for i, j in zip(limit, limit[1:], strict=False)]

    def encode(self, texts: list[str], end: int | None) -> list[bytes]:
        tail = b"" if end is None else end.to_bytes(self.width, "little")
        plain = [bool(_PLAIN.fullmatch(t)) and not any(a in t for a in self.added) for t in texts]
        quick = iter(self._plain([t for t, p in zip(texts, plain, strict=True) if p]))
        rest = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [(next(quick) if p else np.array(next(rest).ids, f"<u{self.width}").tobytes()) + tail for p in plain]


def write_shards(docs: DataFrame, folder: str, path: str, end: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append the end id to each document, and write shards; returns (file, part, number, first, last, n_docs, n_ids) by shard.

    Rows with a null id have no key and are left out; a null text is empty; equal ids keep a row each, by text, and may reach into the next
    shard. Other columns are not read; an empty table gives no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")

    def run(batches):
        out = encoder = None
        part, number = TaskContext.get().partitionId(), 0

        def close():
            name = f"{folder}/shard-{part:06}-{number:06}.tok"
            S.put_file(name, out.finish())
            return pa.RecordBatch.from_pylist([{"file": name, "part": part, "number": number, "first": out.keys[0], "last": out.keys[-1], "n_docs": len(out.keys), "n_ids": out.ids}])

        for batch, _, _ in T.blocks(batches, size=ENCODE_BYTES):
            encoder = encoder or Encoder(path)
            for d, v in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()], end), strict=True):
                out = out or Writer(encoder.width)
                out.add(d, v)
                if out.offset + out.size >= SHARD_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out:
            yield close()

    dealt = rows.repartitionByRange(S.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "file string, part long, number long, first long, last long, n_docs long, n_ids long")


def read_shards(spark: SparkSession, shards: DataFrame | list, with_ids: bool = False) -> DataFrame:
    """Rows of the files, given by the rows of write_shards(): doc_id, start (ids of all documents before), n_tokens, ids_crc32, and the ids if wanted.

    What lies before a file is a running sum over the rows of shards, and files are read READ_BYTES of ids to a task, in ascending order,
    whatever their number. A DataFrame is read more than once, so it should be a table.
    """
    named = "file string, part long, number long, n_ids long"
    shards = shards if isinstance(shards, DataFrame) else spark.createDataFrame([(r.file, r.part, r.number, r.n_ids) for r in shards], named)
    shards = shards.select("file", "part", "number", "n_ids", F.lit(0).cast("long").alias("all"))
    files, _ = S.running(shards, "all", ["part", "number"], ["part", "number"], {"upto": "n_ids"})
    size = 4 * (shards.agg(F.sum("n_ids")).first()[0] or 0)
    tasks = max(1, -(-size // READ_BYTES))
    files = files.withColumn("base", F.col("upto") - F.col("n_ids")).repartitionByRange(tasks, "part", "number").sortWithinPartitions("part", "number").select("file", "base")
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = []
                for doc, start, ids in Shard(S.mapped(file)):
                    row = (doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    held.append((*row, ids.tolist()) if with_ids else row)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=[k.split()[0] for k in kind.split(", ")])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=[k.split()[0] for k in kind.split(", ")])

    return files.mapInArrow(run, kind)
