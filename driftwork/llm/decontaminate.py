"""Benchmark decontamination with an FM-index for each training shard.

Words are the maximal runs of digits, ASCII letters (A-Z in lower case) and bytes beyond ASCII. A benchmark item gives its windows of `window`
consecutive words, or one window of all its words where it has fewer. A shard is a block of whole documents: its words are written
in the benchmark's vocabulary, other words part runs, and runs shorter than the shortest window are left out, since none
can lie there. Windows are sought backwards through the shard's wavelet ranks, their places come from sampled suffix positions, and
the words they cover are merged into removal spans.

The benchmark is the query set. It goes to the shared folder in blocks of bounded size and each shard searches one block
after the other, so neither a broadcast nor a worker grows with it. Documents are never shuffled.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwork.llm import _shared as S
from driftwork.llm import _text as T
from driftwork.llm.fm_index import FMIndex

#: Bytes of benchmark text in a block of queries.
QUERY_BYTES = 8 << 20
#: Bytes of documents in a shard.
SHARD_BYTES = 4 << 20


class Queries:
    """A block of benchmark items: the vocabulary, the distinct windows in it, and each window's items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        items = sorted({(i, t or "") for i, t in items})
        self.names = np.array(sorted({i for i, _ in items}), object)
        number = {n: k for k, n in enumerate(self.names)}
        column = pa.array([t for _, t in items], pa.large_string())
        data, at = T.raw(column)
        words = T.Words(data, at, T.ALNUM)
        self.vocabulary, symbol = np.unique(words.hash, return_inverse=True)
        symbol = symbol.astype(np.int64) + 1
        count = np.diff(words.first)
        each = np.where(count >= window, count - window + 1, np.minimum(count, 1))
        owner = np.repeat(np.arange(len(items)), each)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + words.first[owner]
        length = np.minimum(count[owner], window)
        at = begin[:, None] + np.arange(window)
        phrase = np.where(np.arange(window) < length[:, None], symbol[np.minimum(at, max(0, len(symbol) - 1))] if len(symbol) else 0, 0)
        self.phrases, which = np.unique(phrase, axis=0, return_inverse=True) if len(phrase) else (phrase, np.empty(0, np.int64))
        self.lengths = (self.phrases > 0).sum(1)
        who = np.array([number[i] for i, _ in items], np.int64)[owner] if len(items) else owner
        pairs = np.unique(np.stack([np.ravel(which), who]), axis=1)
        self.item = pairs[1]
        self.item_at = np.searchsorted(pairs[0], np.arange(len(self.phrases) + 1))
        self.shortest = int(self.lengths.min(initial=window))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    def find(self, words: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(covered words as +1/-1 steps, text numbers, items): what occurs in a shard."""
        steps, none = np.zeros(len(words.hash) + 1, np.int64), np.empty(0, np.int64)
        if not len(self.phrases) or not len(words.hash):
            return steps, none, none
        symbol = self.symbols(words.hash)
        # runs of known words within one text, long enough for a window
        known = symbol > 0
        begins = np.zeros(len(symbol), bool)
        begins[words.first[:-1][words.first[:-1] < len(symbol)]] = True
        start = np.flatnonzero(known & (begins | np.append(True, ~known[:-1])))
        after = np.append(begins[1:], True) | np.append(~known[1:], True)
        stop = np.flatnonzero(known & after) + 1
        long = stop - start >= self.shortest
        start, stop = start[long], stop[long]
        if not len(start):
            return steps, none, none
        size = stop - start + 1  # a 0 after each run
        where = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        sequence = symbol[np.minimum(where, len(symbol) - 1)]
        sequence[np.cumsum(size) - 1] = 0
        index = FMIndex(sequence, len(self.vocabulary))
        lo, hi = index.search(self.phrases, self.lengths)
        seen = np.flatnonzero(hi > lo)
        count = hi[seen] - lo[seen]
        phrase = np.repeat(seen, count)
        rows = np.repeat(lo[seen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = where[index.locate(rows)]
        np.add.at(steps, place, 1)
        np.add.at(steps, place + self.lengths[phrase], -1)
        doc = np.searchsorted(words.first, place, "right") - 1
        pairs = np.unique(np.stack([doc, phrase]), axis=1) if len(doc) else np.empty((2, 0), np.int64)
        each = self.item_at[pairs[1] + 1] - self.item_at[pairs[1]]
        at = np.repeat(self.item_at[pairs[1]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return steps, np.repeat(pairs[0], each), self.item[at]


def query_blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> list[str]:
    """The benchmark's blocks as files of the shared folder."""
    folder, found, held, size = S.scratch(benchmark.sparkSession, "phrases"), [], [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null")

    def put():
        found.append(f"{folder}/{len(found)}")
        S.put_file(found[-1], pickle.dumps(Queries(held, window), protocol=5))
        held.clear()

    for row in rows.toLocalIterator():
        held.append((row.i, row.t))
        size += len(row.t or "")
        if size > QUERY_BYTES:
            put()
            size = 0
    if held or not found:
        put()
    return found


class Searcher:
    """Loads the blocks of queries in turn; a single one is kept."""

    def __init__(self, files: list[str]):
        self.files, self.kept = files, None

    def __iter__(self):
        for f in self.files:
            if self.kept is None or len(self.files) > 1:
                self.kept = pickle.loads(S.mapped(f))
            yield self.kept

    def scan(self, data: np.ndarray, at: np.ndarray):
        """words, (first, stop) limits of covered spans, spans' limits by text, covered words by text, item names by text."""
        words = T.Words(data, at, T.ALNUM)
        steps, names = np.zeros(len(words.hash) + 1, np.int64), [set() for _ in range(len(at) - 1)]
        for q in self:
            more, doc, item = q.find(words)
            steps += more
            for d, i in zip(doc, item, strict=True):
                names[d].add(q.names[i])
        hit = np.cumsum(steps)[:-1] > 0
        edge = np.zeros(len(hit) + 1, bool)
        edge[words.first] = True
        start = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1]))) if len(hit) else np.empty(0, np.int64)
        stop = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False))) + 1 if len(hit) else np.empty(0, np.int64)
        return words, start, stop, np.searchsorted(start, words.first), T.by_text(hit.astype(np.int64), words.first), names


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit (words within any occurring window), items (ids as strings, sorted), spans.

    spans: array of (first_word, stop_word, begin_byte, end_byte), merged; adjacent ones are one. Null and empty texts have no word and
    no hit; items without words or with a null id are ignored; equal items with different ids all count; repeated rows give a row each;
    an empty benchmark hits nothing; other columns are not read.
    """
    files = query_blocks(benchmark, window, item_col, item_text)

    def run(batches):
        S.lean()
        find = Searcher(files)
        for batch, data, at in T.blocks(batches, size=SHARD_BYTES):
            words, start, stop, span_at, hits, names = find.scan(data, at)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(span_at))
            parts = [start - words.first[doc], stop - words.first[doc], words.begin[start] - at[doc], words.end[stop - 1] - at[doc]]
            spans = pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in parts], names=["first_word", "stop_word", "begin_byte", "end_byte"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.first).astype(np.int64)), pa.array(hits), pa.array([sorted(x) for x in names], pa.list_(pa.string())), spans], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    kind = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first_word:long,stop_word:long,begin_byte:long,end_byte:long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with the removal spans cut from their texts (again while the cut text still holds a window); all columns and rows stay.

    Null and empty texts stay as they are, and so does every text where the benchmark is empty; items without words or with a null id are
    ignored; repeated rows are cut alike. Columns may have any names, equal ones too.
    """
    files = query_blocks(benchmark, window, item_col, item_text)
    place = docs.columns.index(text_col)
    named = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))

    def run(batches):
        S.lean()
        find = Searcher(files)
        for batch, data, at in T.blocks(batches, f"__{place}", SHARD_BYTES):
            left, texts, rows = None, None, np.arange(batch.num_rows)
            while True:
                words, start, stop, span_at, hits, _ = find.scan(data, at)
                bad = np.flatnonzero(hits)
                if not len(bad):
                    break
                texts = texts or batch.column(place).to_pylist()
                left = []
                for d in bad:
                    spans = range(span_at[d], span_at[d + 1])
                    cuts = [at[d], *(x for k in spans for x in (words.begin[start[k]], words.end[stop[k] - 1])), at[d + 1]]
                    left.append(b"".join(data[cuts[k] : cuts[k + 1]].tobytes() for k in range(0, len(cuts), 2)))
                    texts[rows[d]] = left[-1].decode()
                rows = rows[bad]
                data, at = T.raw(pa.array(left, pa.large_binary()))
            yield batch if texts is None else batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return named.mapInArrow(run, named.schema).toDF(*docs.columns)
