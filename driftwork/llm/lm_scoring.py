"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by the scorers.

Order 3 (or 2). The words are counted first: each task counts those of its own texts, a part adds up its share of the words, and gives them
numbers, small ones to frequent words. Words are known by whole 64-bit hashes, so their counts are exact while no two words of the corpus
share one: about n^2 / 3.7e19 such pairs are to be expected of n distinct words.

Then each task counts the trigrams of its own texts by number, and packs them for the part of their middle word; the trigrams of very frequent
middle words (known from the counts; what is frequent moves rows, never counts) are spread by their last two words. A part thus has all
that precede a pair of words, which is what the middle order counts, and, but for frequent middle words, all that follows one. It writes trigrams,
pairs and contexts as sorted hash arrays, and packs for a second exchange what only sums over parts tell: how many words each word
follows, and what follows a frequent word. What is gathered grows with the corpus; the driver gets sums, and the numbers of the frequent
words, of which there are no more than twice as many as parts.

The number of parts follows the number of tokens, so that a task's share stays the same however large the corpus is.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwork.llm import _shared as S
from driftwork.llm import _text as T
from driftwork.llm.hash_arrays import Counts, Group, Tables, added, discounts, pack_counts, pack_group, runs

#: Tokens counted together in a task, tokens of a part, and bytes of text scored together.
FLUSH, PART, SCORE_BYTES = 2_500_000, 2_000_000, 4 << 20

END = T.mix(np.array([0xE0E0], np.uint64))[0]
#: The number of what stands before a text, and of words that training did not see.
BEGIN, UNKNOWN = 0, (1 << 32) - 1


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens, limits by text) of a block: each text's words, then an end."""
    words = T.Words(data, at)
    first = np.concatenate([[0], np.cumsum(np.diff(words.first) + 1)])
    seq = np.full(first[-1], END, np.uint64)
    seq[np.arange(len(words.hash)) + words.doc] = words.hash
    return seq, first


def before(seq: np.ndarray, first: np.ndarray, steps: int) -> np.ndarray:
    """The token so many steps before each one, BEGIN where the text has none there."""
    out = np.full(len(seq), BEGIN, seq.dtype)
    out[steps:] = seq[:-steps]
    for k in range(steps):
        at = first[:-1] + k
        out[at[at < first[1:]]] = BEGIN
    return out


def one_key(w: np.ndarray) -> np.ndarray:
    return T.mix(w.astype(np.uint64))


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return T.mix(T.mix(v.astype(np.uint64)) + w.astype(np.uint64))


def triple_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return T.mix(pair_key(v, w) * np.uint64(0x9E3779B97F4A7C15) + u.astype(np.uint64))


def _is_in(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(some, x), len(some) - 1)
    return some[at] == x


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: the upper bytes, nearly all zero, stand together and compress."""
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return struct.pack("<qq", len(x), wide) + np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].T).tobytes()


def _unplanes(raw, at: int) -> tuple[np.ndarray, int]:
    n, wide = struct.unpack_from("<qq", raw, at)
    out = np.zeros((n, 4), np.uint8)
    out[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at + 16).reshape(wide, n).T
    return out.view("<u4").ravel(), at + 16 + n * wide


_KIND = "kind byte, seat long, word long, n0 long, n1 long, n2 long, n3 long, n4 long, payload binary"
_PACKED, _FREQUENT, _HEADS, _TRIPLES, _PAIRS, _WORDS, _CONTEXTS = range(7)


def _rows(kind: int, n: list, seat=None, word=None, payload=None) -> pa.RecordBatch:
    size = len(payload) if payload is not None else len(n[0])
    n = [*(np.asarray(x, np.int64) for x in n), *[np.zeros(size, np.int64)] * (5 - len(n))]
    zero = np.zeros(size, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int8)), pa.array(zero if seat is None else np.asarray(seat, np.int64)), pa.array(zero if word is None else np.asarray(word, np.int64)), *map(pa.array, n), pa.nulls(size, pa.binary()) if payload is None else pa.array(payload, pa.binary())],
        names=["kind", "seat", "word", *(f"n{i}" for i in range(5)), "payload"],
    )


def _sizes(x: np.ndarray) -> list[np.ndarray]:
    return [(x == 1).astype(np.int64), (x == 2).astype(np.int64), (x > 2).astype(np.int64)]


def _stats(x: np.ndarray) -> list[list[int]]:
    return [[int((x == k).sum())] for k in (1, 2, 3, 4)]


def _flushed(batches, size: int):
    """(hashes, limits) of about size tokens of whole texts together."""
    held, limits, n = [], [], 0
    for _, data, at in T.blocks(batches):
        seq, first = tokens(data, at)
        held.append(seq)
        limits.append(first[1:] + n)
        n += len(seq)
        if n >= size:
            yield np.concatenate(held), np.concatenate([[0], *limits])
            held, limits, n = [], [], 0
    if n:
        yield np.concatenate(held), np.concatenate([[0], *limits])


def _count_words(parts: int, seats: np.ndarray):
    def run(batches):
        for seq, _ in _flushed(batches, FLUSH):
            word, count = np.unique(seq, return_counts=True)
            part = (word % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            word, count = word[order], count[order]
            cuts = runs(part[order])
            yield _rows(_PACKED, [], seats[[part[order[i]] for i, _ in cuts]], payload=[struct.pack("<q", j - i) + word[i:j].tobytes() + pack_counts(count[i:j]) for i, j in cuts])

    return run


def _held(batches, kinds: tuple[int, ...]):
    """Payloads of these kinds by (seat, kind); other rows pass on as batches."""
    held, passed = {}, []
    for batch in batches:
        kind = batch.column(0).to_numpy()
        ours = np.isin(kind, kinds)
        if not ours.all():
            passed.append(batch.take(pa.array(np.flatnonzero(~ours))))
        for i in np.flatnonzero(ours):
            held.setdefault((batch.column(1)[i].as_py(), int(kind[i])), []).append(batch.column(8)[i].as_py())
    return held, passed


def _merge_words(tables: Tables):
    """Add up the words of a part, number and write them; pass on sums and the part's frequent words."""

    def run(batches):
        held, _ = _held(batches, (_PACKED,))
        for place in sorted(held):
            words, counts = [], []
            for raw in held.pop(place):
                n = struct.unpack_from("<q", raw)[0]
                words.append(np.frombuffer(raw, np.uint64, n, 8))
                counts.append(Counts(raw, 8 + 8 * n).whole())
            keys, _, count = added(np.concatenate(words), np.concatenate(counts))
            part = int(keys[0] % np.uint64(tables.shards))
            number = np.empty(len(keys), np.int64)
            number[np.argsort(-count, kind="stable")] = np.arange(len(keys)) * tables.shards + part + 1
            tables.put("words", part, keys, [count, number])
            yield _rows(_WORDS, [[len(keys)], [int(count.sum())]])
            # what may prove frequent in all
            some = np.flatnonzero((count * 2 * tables.shards > count.sum()) | (2 * count > PART))
            yield _rows(_FREQUENT, [count[some]], word=number[some])

    return run


class _Words(Tables):
    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys % np.uint64(self.shards)).astype(np.int64)


def _route(v: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of trigrams with these middle and last words."""
    return (np.where(_is_in(v, hot), pair_key(v, w), one_key(v)) % np.uint64(parts)).astype(np.int64)


def _sorted(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray | None, part: np.ndarray | None = None):
    """Distinct (part, v, u, w), sorted, with the sums of c (or numbers of rows)."""
    last = (u.astype(np.uint64) << np.uint64(32)) | w
    lead = v.astype(np.uint64) if part is None else (part.astype(np.uint64) << np.uint64(32)) | v
    order = np.lexsort((last, lead))
    lead, last = lead[order], last[order]
    start = np.flatnonzero(np.append(True, (lead[1:] != lead[:-1]) | (last[1:] != last[:-1])))
    total = np.diff(np.append(start, len(order))) if c is None else np.add.reduceat(c[order], start)
    at = order[start]
    return v[at], u[at], w[at], total, None if part is None else part[at]


def _count(words: Tables, hot: np.ndarray, parts: int, seats: np.ndarray, order: int):
    def run(batches):
        for seq, first in _flushed(batches, FLUSH):
            known, at = np.unique(seq, return_inverse=True)
            w = words.find("words", known, 2)[1].astype(np.uint32)[at.reshape(-1)]
            v = before(w, first, 1)
            u = before(w, first, 2) if order > 2 else np.zeros_like(w)
            v, u, w, c, part = _sorted(v, u, w, None, _route(v, w, hot, parts))
            cuts, payload = runs(part), []
            for i, j in cuts:
                middle = runs(v[i:j])
                lead = np.array([a for a, _ in middle])
                payload.append(_planes(v[i:j][lead]) + _planes(np.diff(np.append(lead, j - i)).astype(np.uint32)) + _planes(u[i:j]) + _planes(w[i:j]) + pack_counts(c[i:j]))
            yield _rows(_PACKED, [], seats[[part[i] for i, _ in cuts]], payload=payload)

    return run


def _merge(tables: Tables, hot: np.ndarray, seats: np.ndarray, order: int):
    """Add up the trigrams of a part; write trigrams, pairs and contexts; pack what only sums over parts tell."""

    def dealt(kind, keys, counts):
        part = (keys % np.uint64(tables.shards)).astype(np.int64)
        sort = np.lexsort((keys, part))
        cuts = runs(part[sort])
        keys, counts = keys[sort], [c[sort] for c in counts]
        pack = pack_group if len(counts) > 1 else lambda x: pack_counts(x[0])
        return _rows(kind, [], seats[[part[sort[i]] for i, _ in cuts]], payload=[struct.pack("<q", j - i) + keys[i:j].tobytes() + pack([c[i:j] for c in counts]) for i, j in cuts])

    def run(batches):
        held, _ = _held(batches, (_PACKED,))
        for place in sorted(held):
            columns = []
            for raw in held.pop(place):
                v, at = _unplanes(raw, 0)
                size, at = _unplanes(raw, at)
                u, at = _unplanes(raw, at)
                w, at = _unplanes(raw, at)
                columns.append((np.repeat(v, size), u, w, Counts(raw, at).whole()))
            v, u, w, c = map(np.concatenate, zip(*columns, strict=True))
            columns.clear()
            v, u, w, c, _ = _sorted(v, u, w, c)
            part = int(_route(v[:1], w[:1], hot, tables.shards)[0])
            if order > 2:
                keys, at, n = added(triple_key(u, v, w), c)
                tables.put("triples", part, keys, [n], low=0)
                yield _rows(_TRIPLES, _stats(c), seats[[part]])
                start = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])))
                sums = [np.add.reduceat(x, start) for x in (c, *_sizes(c))]
                keys, spread = pair_key(u[start], v[start]), _is_in(v[start], hot)
                yield dealt(_CONTEXTS, keys[spread], [x[spread] for x in sums])
                keys, sums = keys[~spread], [x[~spread] for x in sums]
                sort = np.argsort(keys)
                tables.put("contexts", part, keys[sort], [x[sort] for x in sums], low=0, grouped=True)
            # pairs: how many different words stand before them, or, in the highest order, how often they occur
            lead = (v.astype(np.uint64) << np.uint64(32)) | w
            lead, _, n = added(lead, np.ones(len(lead), np.int64) if order > 2 else c)
            v, w = (lead >> np.uint64(32)).astype(np.uint32), lead.astype(np.uint32)
            keys = pair_key(v, w)
            sort = np.argsort(keys)
            tables.put("pairs", part, keys[sort], [n[sort]], low=0)
            yield _rows(_PAIRS, _stats(n), seats[[part]])
            start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            sums, spread = [np.add.reduceat(x, start) for x in (n, *_sizes(n))], _is_in(v[start], hot)
            yield dealt(_HEADS, one_key(v[start][spread]), [x[spread] for x in sums])
            keys = one_key(v[start][~spread])
            sort = np.argsort(keys)
            tables.put("heads", part, keys[sort], [x[~spread][sort] for x in sums], grouped=True)
            word, _, n = added(w, np.ones(len(w), np.int64))
            yield dealt(_WORDS, one_key(word), [n])

    return run


def _merge_sums(tables: Tables):
    """Add up how many words each word follows, and contexts that end in a frequent word; write them; pass the rest on."""

    def run(batches):
        held, passed = _held(batches, (_WORDS, _CONTEXTS, _HEADS))
        yield from passed
        for place in sorted(held):
            kind, keys, counts = place[1], [], []
            for raw in held.pop(place):
                n = struct.unpack_from("<q", raw)[0]
                keys.append(np.frombuffer(raw, np.uint64, n, 8))
                counts.append(np.stack(Group(raw, 8 + 8 * n).whole() if kind != _WORDS else [Counts(raw, 8 + 8 * n).whole()]))
            keys, _, *sums = added(np.concatenate(keys), *np.concatenate(counts, axis=1))
            part = int(keys[0] % np.uint64(tables.shards))
            if kind == _CONTEXTS:
                tables.put("spread-contexts", part, keys, sums, low=0, grouped=True)
            elif kind == _HEADS:
                tables.put("spread-heads", part, keys, sums, grouped=True)
            else:
                tables.put("follows", part, keys, sums)
                yield _rows(_WORDS, [*_stats(sums[0]), [int(sums[0].sum())]])

    return run


class Model:
    """A trained model: tables in one folder, and global sums; small, so it travels with the tasks."""

    def __init__(self, words: Tables, tables: Tables, hot: np.ndarray, stats: dict[int, list[int]], distinct: int, total: int, order: int):
        self.words, self.tables, self.hot, self.distinct, self.total, self.order = words, tables, hot, distinct, total, order
        self.d = {k: discounts(*stats.get(k, [0] * 5)[:4]) for k in (_TRIPLES, _PAIRS, _WORDS)}
        m1, m2, _, _, self.follows = stats.get(_WORDS, [0] * 5)
        e = self.d[_WORDS]
        self.rest = (e[1] * m1 + e[2] * m2 + e[3] * (distinct - m1 - m2)) / max(1, self.follows)

    def _find(self, table: str, keys: np.ndarray, columns: int, part: np.ndarray | None = None) -> list[np.ndarray]:
        return self.tables.find(table, keys, columns, (keys % np.uint64(self.tables.shards)).astype(np.int64) if part is None else part)

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, numbers) of words."""
        count, number = self.words.find("words", hashes, 2)
        return count, np.where(count > 0, number, UNKNOWN).astype(np.uint32)

    def _level(self, kind: int, n: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The discounted share of counts n, interpolated with the order below; above: total and sizes of their contexts."""
        d = self.d[kind]
        weight = np.where(above[0] > 0, (d[1] * above[1] + d[2] * above[2] + d[3] * above[3]) / np.maximum(above[0], 1), 1.0)
        return np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(above[0], 1) + weight * below

    def single(self, w: np.ndarray) -> np.ndarray:
        """Probabilities of words, by how many words they follow."""
        n, e = self._find("follows", one_key(w), 1)[0], self.d[_WORDS]
        return np.maximum(n - e[np.minimum(n, 3)], 0) / max(1, self.follows) + (self.rest if self.follows else 1.0) / (self.distinct + 1)

    def pair(self, v: np.ndarray, w: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities of words w after v."""
        part = _route(v, w, self.hot, self.tables.shards)
        (n,) = self._find("pairs", pair_key(v, w), 1, part)
        some, at = np.unique(v, return_inverse=True)
        spread, above = _is_in(some, self.hot), np.zeros((4, len(some)), np.int64)
        for table, rows in (("heads", ~spread), ("spread-heads", spread)):
            above[:, rows] = self._find(table, one_key(some[rows]), 4)
        return self._level(_PAIRS, n, above[:, at.reshape(-1)], below)

    def triple(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities of words w after u, v."""
        keys, first, at = np.unique(pair_key(u, v), return_index=True, return_inverse=True)
        spread = _is_in(v[first], self.hot)
        above = np.zeros((4, len(keys)), np.int64)
        above[:, spread] = self._find("spread-contexts", keys[spread], 4)
        above[:, ~spread] = self._find("contexts", keys[~spread], 4, (one_key(v[first][~spread]) % np.uint64(self.tables.shards)).astype(np.int64))
        above = above[:, at.reshape(-1)]
        n, seen = np.zeros(len(w), np.int64), np.flatnonzero(above[0])  # others have no trigram
        keys, first, at = np.unique(triple_key(u[seen], v[seen], w[seen]), return_index=True, return_inverse=True)
        (c,) = self._find("triples", keys, 1, _route(v[seen][first], w[seen][first], self.hot, self.tables.shards))
        n[seen] = c[at.reshape(-1)]
        return self._level(_TRIPLES, n, above, below)

    def score(self, seq: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, probability) of each token of texts."""
        known, at = np.unique(seq, return_inverse=True)
        count, number = self.number(known)
        at, low = at.reshape(-1), self.single(number)
        w = number[at]
        v = before(w, first, 1)
        lead, where, back = np.unique((v.astype(np.uint64) << np.uint64(32)) | w, return_index=True, return_inverse=True)
        p = self.pair(v[where], w[where], low[at[where]])[back.reshape(-1)]
        if self.order > 2:
            p = self.triple(before(w, first, 2), v, w, p)
        return count[at], p


def train(docs: DataFrame, learn: Column | None = None, text_col: str = "text", order: int = 3) -> Model:
    """A model of the rows where learn holds (default: all); null texts are empty ones, which still have an end. Repeated rows count each time."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    rows = (docs.where(learn) if learn is not None else docs).select(F.col(text_col).cast("string").alias("text"))
    parts, folder = S.partitions(spark), S.scratch(spark, "lm")
    words = _Words(folder, parts)
    summed = rows.mapInArrow(_count_words(parts, seats := S.seats(spark, parts)), _KIND).repartition(parts, "seat").mapInArrow(_merge_words(words), _KIND)
    found, path = S.written(summed, "words")
    distinct, total = found.where(f"kind = {_WORDS}").agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    size = max(parts, -(-total // PART))
    # no more than twice as many words as parts, for which they are numbers to route by; what stands before a text is one
    often = found.where(f"kind = {_FREQUENT} and n0 * {2 * size} > {total}").select("word").collect()
    hot = np.array(sorted({BEGIN, *(r.word for r in often)}), np.uint32)
    S.drop(spark, path)
    seats = seats if size == parts else S.seats(spark, size)
    tables = Tables(folder, size)
    counted = rows.mapInArrow(_count(words, hot, size, seats, order), _KIND).repartition(size, "seat").mapInArrow(_merge(tables, hot, seats, order), _KIND)
    sums = counted.repartition(size, "seat").mapInArrow(_merge_sums(tables), _KIND).groupBy("kind").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(5))).collect()
    return Model(words, tables, hot, {r.kind: [r.n0, r.n1, r.n2, r.n3, r.n4] for r in sums}, distinct, total, order)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, n_known, base_score, score (log10), perplexity.

    Tokens are words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case, then an end. base_score is the add-one unigram
    log-probability. Null and empty texts have one token, the end. A model of nothing gives each token an equal share of the vocabulary
    of one unknown word. Equal texts get equal scores; repeated rows give a row each; other columns are not read; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch, data, at in T.blocks(batches, size=SCORE_BYTES):
            seq, first = tokens(data, at)
            count, p = m.score(seq, first)
            base = np.log10((count + 1) / (m.total + m.distinct + 1))
            score = T.by_text(np.log10(p), first)
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, T.by_text((count > 0).astype(np.int64), first), T.by_text(base, first), score, 10 ** (-score / n)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
