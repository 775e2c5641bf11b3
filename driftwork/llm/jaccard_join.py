"""N-gram Jaccard join by signature trees.

Documents are sets of distinct word shingles (64-bit hashes). Equal sets meet by a 128-bit digest. Different sets are first
dealt to clusters that surely hold both sides of every link: tokens are dealt to m parts, and as sets with a Jaccard
similarity of t or more differ in at most h = (1-t)/(1+t)(|x|+|y|) tokens, at least m-h parts are equal. Parts of one
token or none say little, and a pair of which one side has at most e = m-h-1 of those still has a larger part in common. So only larger
parts are emitted; a set with more than e small ones emits its larger parts under another dealing too, and so on, and one that
has too many under every dealing also emits its prefix: of all tokens in one order, common ones last, the first |x| - ceil(t |x|) + 1, among which
two such sets that link have their first common token. A task joins the documents that share a signature among its own first, and sends on one for each of their components. Tokens that a bounded sample of the texts shows to be common
(passages that many documents share) do not count for a part's size; what is in the sample moves work, never results, since a part
is small or not by its content alone.
Within a cluster a signature tree (OR-combined token bitmaps and size ranges) is joined with itself by dual traversal, which
drops node pairs whose largest possible overlap is too small; what remains is counted exactly on the whole sets. Links within
a component that is known already are not counted again, so a group of k near copies costs about k counts.

Large clusters are cut into blocks; each block also holds the cluster's first document, so that near copies join through it. What is then
outside the largest component of its cluster meets the other blocks, as long as that takes SPREAD rows for a document or less. Where it takes more
(many unlike documents in a chain of equal parts), the cluster is dealt anew by signatures: those that documents of several components share
make groups, so a document meets only documents that it has an equal part with, and the rows grow with the documents.

Whole sets are as large as the texts, so they lie in files of the shared folder, each once; rows only say where, and a task reads the sets of a group when it joins it.
"""

from __future__ import annotations

import math
import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwork.llm import _shared as S
from driftwork.llm import _text as T

#: Dealings of the tokens to parts that a set may need.
SEEDS = 16
#: Texts of the sample, from how many of them on a token is common, and common tokens at most (8 bytes each).
SAMPLE, COMMON, MOST_COMMON = 3000, 4, 500_000
#: Tokens that a task sketches together, and signatures whose documents it joins together before they are sent.
TOKENS, SIGNATURES = 1_000_000, 1_500_000
#: Signatures, as far as a sample tells their number, that meet in one task.
MEET = 3_000_000
#: Members of a cluster that one task joins at once.
BLOCK = 256
#: Rows of a cluster's documents, by number of documents, up to which what is outside its largest component meets all blocks.
SPREAD = 4
#: Documents in clusters up to which their ids are broadcast; beyond, tasks look them up in sorted files.
BROADCAST_ROWS = 500_000
#: Tokens of a file of sets (8 bytes each).
FILE = 2_000_000
#: Where a set lies.
AT = ["file", "at", "n"]

_KEY = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: T.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each text's distinct shingles of n words, sorted by both; fewer words make one shingle."""
    count = np.diff(words.first)
    each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), each)
    if not len(doc):
        return doc, np.empty(0, np.uint64)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each) + words.first[doc]
    stop = words.first[doc + 1]
    key = np.zeros(len(doc), np.uint64)
    for k in range(n):
        at = begin + k
        inside = at < stop
        key = np.where(inside, T.mix(key * _KEY + words.hash[np.minimum(at, len(words.hash) - 1)] + np.uint64(k + 1)), key)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


class Scheme:
    """Parts by size class: class b holds sizes in [low[b], low[b+1]), each at most 1/t times the one before."""

    def __init__(self, percent: int):
        self.t = Fraction(percent, 100)
        self.low = [1]

    def upto(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] / self.t)))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.upto(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.low), sizes, "right") - 1

    def parts(self, b: int) -> tuple[int, int, int]:
        """(m, e, s) of class b: number of parts; how many small ones a set may leave out; up to how many tokens a part is small.

        One token is small where the share of such parts (by a Poisson law) lets m settle; else only the empty ones are, which always does.
        m = 0: no differing sets can link.
        """
        low, small = self.low[b], self.low[b + 1] - 1
        large = int(small / self.t)
        h = int((1 - self.t) / (1 + self.t) * (small + large))
        if h < 1:
            return 0, 0, 0
        for s in (1, 0):
            for e in range(2, 3 + max(6, h // 3)):
                m = h + 1 + e
                p = math.exp(-low / m) * (1 + low / m * s)
                if e >= m * p + 2 * math.sqrt(m * p):
                    return m, e, s
        return h + 2, 1, 0


def _parts(key: np.ndarray, doc: np.ndarray, sizes: np.ndarray, classes: np.ndarray, scheme: Scheme, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text number) of the parts that each set emits under its own size class and the one below."""
    found, who = [], []
    first = np.searchsorted(doc, np.arange(len(sizes) + 1))
    for below in (0, 1):
        wanted = classes - below
        for b in np.unique(wanted[(wanted >= 0) & (sizes > 0)]):
            m, e, small = scheme.parts(int(b))
            if not m:
                continue
            sets = np.flatnonzero((wanted == b) & (sizes > 0))
            n = sizes[sets]
            which = np.repeat(np.arange(len(sets)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[sets][which]
            tokens, todo = key[at], np.arange(len(sets))
            counts = np.ones(len(tokens), np.int64)
            if len(common):
                counts[common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens] = 0
            for seed in range(SEEDS):
                salt = T.mix(np.array([(b << 8) + seed + 1], np.uint64))[0]
                k = T.mix(tokens ^ salt)
                slot = which * m + ((k >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                slot, k, own = slot[order], k[order], counts[order]
                start = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                total = np.add.reduceat(T.mix(k ^ _KEY), start)
                size, count = np.diff(np.append(start, len(slot))), np.add.reduceat(own, start)
                slot = slot[start]
                owner, part = slot // m, slot % m
                sig = T.mix(total + T.mix(part.astype(np.uint64) * _KEY + salt) + size.astype(np.uint64))
                loose = m - np.bincount(owner, count > small, len(todo)).astype(np.int64) > e
                keep = count > small
                found.append(sig[keep])
                who.append(sets[todo[owner[keep]]])
                if not loose.any():
                    break
                if seed == SEEDS - 1:  # the prefix
                    stay = loose[which]
                    mine, own = which[stay], T.mix(tokens[stay] ^ salt)
                    order = np.lexsort((own, counts[stay] == 0, mine))
                    mine, own = mine[order], own[order]
                    size = np.bincount(mine, minlength=len(todo))
                    place = np.arange(len(mine)) - (np.cumsum(size) - size)[mine]
                    keep = place < (size - (-(-size * scheme.t.numerator // scheme.t.denominator)) + 1)[mine]
                    found.append(T.mix(own[keep] + _KEY))
                    who.append(sets[todo[mine[keep]]])
                stay = loose[which]
                tokens, counts, which = tokens[stay], counts[stay], (np.cumsum(loose) - 1)[which[stay]]
                todo = todo[loose]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(who)


_OUT = "shard long, kind byte, a long, b long, x binary, y binary"


def _rows(shard, kind, a, b, x=None, y=None):
    n = len(shard)
    blank = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(shard, np.int64)), pa.array(np.full(n, kind, np.int8)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), blank if x is None else pa.array(x, pa.binary()), blank if y is None else pa.array(y, pa.binary())],
        names=["shard", "kind", "a", "b", "x", "y"],
    )


_DOC, _SAME, _PAIR, _DIGEST, _SIG = range(5)


def _stars(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by keys and then ids: the position of each row's smallest partner, and which rows are that partner."""
    order = np.lexsort((ids, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _sketch(size: int, percent: int, seats: np.ndarray, common: np.ndarray):
    """Digests and signatures of texts for the task that each meets its equals in; seats has a number for each of these tasks."""
    shards = len(seats)

    def at_home(ids):
        return seats[(T.mix(ids.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)]

    def run(batches):
        S.lean()
        scheme = Scheme(percent)

        def send(docs):
            """Digests and signatures of some texts; equal ones meet here first, and only the smallest goes on."""
            ids, n, d1, d2, key, doc, null = docs
            yield _rows(seats[:1], _DOC, [len(ids)], [0], [ids.tobytes()], [n.tobytes()])
            full = np.flatnonzero(n > 0)
            order, new, head = _stars((d1[full], d2[full], n[full]), ids[full])
            rows = full[order]
            yield _rows(at_home(ids[rows[~new]]), _SAME, ids[rows[~new]], ids[rows[head[~new]]])
            lead = rows[new]
            sort = np.argsort(d1[lead] % np.uint64(shards), kind="stable")
            yield from packed(_DIGEST, d1[lead][sort], np.stack([d2[lead], ids[lead].view(np.uint64), n[lead].astype(np.uint64)])[:, sort])
            held = np.zeros(len(n), bool)
            held[lead] = True
            sizes = np.where(held, n, 0)
            sets = held[doc]
            sig, who = _parts(key[sets], doc[sets], sizes, scheme.of(np.maximum(n, 1)), scheme, common)
            order, new, _ = _stars((sig, ids[who]), ids[who])  # a document's dealings may repeat a signature
            met.append((sig[order[new]], ids[who][order[new]]))

        def meet():
            """Documents that share signatures here join, and only the smallest of each component goes on, with the signatures of all."""
            sig, ids = (np.concatenate(x) for x in zip(*met, strict=True))
            met.clear()
            order, new, head = _stars((sig,), ids)
            b, a = S.contracted(ids[order[~new]], ids[order[head[~new]]])
            yield _rows(at_home(b), _PAIR, a, b)
            lead, sig = ids[order[new]], sig[order[new]]
            if len(b):
                at = np.minimum(np.searchsorted(b, lead), len(b) - 1)
                lead = np.where(b[at] == lead, a[at], lead)
            sort = np.argsort(sig % np.uint64(shards), kind="stable")
            yield from packed(_SIG, sig[sort], lead[sort].view(np.uint64)[None])

        def packed(kind, key, values):
            """A row for each shard with its keys and values."""
            if not len(key):
                return
            shard = (key % np.uint64(shards)).astype(np.int64)
            start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            stop = np.append(start[1:], len(shard))
            yield _rows(seats[shard[start]], kind, stop - start, start * 0, [key[i:j].tobytes() for i, j in zip(start, stop, strict=True)], [np.ascontiguousarray(values[:, i:j]).tobytes() for i, j in zip(start, stop, strict=True)])

        held, tokens, met = [], 0, []
        for batch, data, at in T.blocks(batches):
            words = T.Words(data, at)
            doc, key = shingles(words, size)
            n = np.bincount(doc, minlength=batch.num_rows).astype(np.int64)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            d1, d2 = (T.by_text(T.mix(key ^ np.uint64(c)), first) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
            held.append((batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64), n, d1, d2, key, doc, None))
            tokens += len(key)
            if tokens > TOKENS:
                yield from send(_joined(held))
                held, tokens = [], 0
                if sum(len(sig) for sig, _ in met) > SIGNATURES:
                    yield from meet()
        if held:
            yield from send(_joined(held))
        if met:
            yield from meet()

    return run


def _joined(parts):
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    return (*(np.concatenate([p[k] for p in parts]) for k in range(5)), np.concatenate([p[5] + s for p, s in zip(parts, shift, strict=False)]), None)


def _common(size: int):
    """The tokens of a small sample that many of its texts have; and, without a token, how many it has in all, and minus its texts."""

    def run(batches):
        found, texts = [], 0
        for batch, data, at in T.blocks(batches):
            found.append(shingles(T.Words(data, at), size)[1])
            texts += batch.num_rows
        keys, count = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        order = np.argsort(-count, kind="stable")[:MOST_COMMON]
        order = order[count[order] >= COMMON]
        tokens = [*keys[order].view(np.int64).tolist(), None, None]
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([*count[order].tolist(), int(count.sum()), -texts])], names=["token", "count"])

    return run


def _meet(batches):
    """A shard's digests and signatures: the smallest document of each meets the others. What they join leaves as a star forest, at most
    one row for a document, however many signatures it shares and with however many others."""
    S.lean()
    digests, sigs = [], []
    for batch in batches:
        kind = batch.column(1).to_numpy()
        passed = np.flatnonzero(kind <= _PAIR)
        if len(passed):
            yield batch.take(pa.array(passed))
        for i in np.flatnonzero(kind > _PAIR):
            key, value = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
            (digests if kind[i] == _DIGEST else sigs).append((key, value.reshape(-1, len(key))))
    for kind, parts in ((_SAME, digests), (_PAIR, sigs)):
        if not parts:
            continue
        key, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
        parts.clear()
        ids = value[-2 if kind == _SAME else -1].view(np.int64)
        order, new, head = _stars((key, value[0], value[2]) if kind == _SAME else (key,), ids)
        b, a = S.contracted(ids[order[~new]], ids[order[head[~new]]])
        yield _rows(a * 0, kind, *((b, a) if kind == _SAME else (a, b)))


def _signed(percent: int, common: np.ndarray):
    """(sig, doc_id, m) of sets (doc_id, m, file, at, n): their signatures."""

    def run(batches):
        S.lean()
        scheme, spans = Scheme(percent), S.Spans()
        for batch in batches:
            at, size = 0, batch.num_rows
            while at < size:
                keys, held = [], 0
                begin = at
                while at < size and (held < TOKENS or at == begin):
                    keys.append(_set(spans, *(batch.column(k)[at].as_py() for k in (2, 3, 4))))
                    held += len(keys[-1])
                    at += 1
                n = np.array([len(k) for k in keys], np.int64)
                sig, who = _parts(np.concatenate(keys), np.repeat(np.arange(len(keys)), n), n, scheme.of(np.maximum(n, 1)), scheme, common)
                order, new, _ = _stars((sig, who), who)  # a set's dealings may repeat a signature
                sig, who = sig[order[new]], who[order[new]]
                ids, m = (batch.column(k).to_numpy(zero_copy_only=False)[begin:at][who] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids), pa.array(m)], names=["sig", "doc_id", "m"])

    return run


def _unpacked(batches):
    """Ids and numbers of shingles, of packed rows."""
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c.as_buffer(), np.int64)) for c in (x, y)], names=["doc_id", "n_shingles"])


def _sets(size: int, folder: str, index: list | None = None):
    """(doc_id, cluster, blocks, file, at, n) of the documents of clusters, whose sets go to files. index: the documents with cluster and blocks, where texts come without."""

    def members(batches):
        keys = S.Keys(index, 3)
        for batch in batches:
            at, (cluster, blocks) = keys.find(batch.column(0).to_numpy(zero_copy_only=False))
            if len(at):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cluster), pa.array(blocks)], names=["doc_id", "text", "cluster", "blocks"])

    def run(batches):
        held, count, name = [], 0, ""
        for batch, data, at in T.blocks(batches if index is None else members(batches)):
            doc, key = shingles(T.Words(data, at), size)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            if held and count + len(key) > FILE:
                S.put_file(name, held)
                held, count = [], 0
            if not held:
                name = f"{folder}/{uuid.uuid4().hex}"
            keep = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "cluster", "blocks")}
            yield pa.RecordBatch.from_arrays([*keep.values(), pa.array([name] * batch.num_rows, pa.string()), pa.array(first[:-1] + count), pa.array(np.diff(first))], names=[*keep, *AT])
            held.append(key.tobytes())
            count += len(key)
        if held:
            S.put_file(name, held)

    return run


def _set(spans: S.Spans, file: str, at: int, n: int) -> np.ndarray:
    return np.frombuffer(spans(file, 8 * at, 8 * n) if n else b"", np.uint64)


class Forest:
    """Union by smallest; labels are positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        while not np.array_equal(jump := self.up[self.up], self.up):
            self.up = jump
        return self.up


class Tree:
    """A signature tree over token sets: children are neighbours by size; nodes hold OR-combined bitmaps and size ranges."""

    LEAF = 16

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray, bits: int):
        self.sets = sets
        size = np.array([len(sets[i]) for i in rows])
        self.rows = rows[np.argsort(size, kind="stable")]
        self.size = np.array([len(sets[i]) for i in self.rows])
        n = len(self.rows)
        maps = np.zeros((n, bits), bool)
        for k, i in enumerate(self.rows):
            maps[k, (sets[i] & np.uint64(bits - 1)).astype(np.int64)] = True
        self.maps = np.packbits(maps, axis=1).view(np.uint64)
        #: Tokens that share a bit with another of the same set: so much may an overlap exceed the common bits.
        self.extra = self.size - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        #: levels[0] are leaves: (first row, last row, bitmap, least size, largest size, largest extra); above, first and last child.
        at = list(range(0, n, self.LEAF))
        level = [(i, min(i + self.LEAF, n)) for i in at]
        nodes = [(lo, hi, np.bitwise_or.reduce(self.maps[lo:hi]), self.size[lo], self.size[hi - 1], self.extra[lo:hi].max()) for lo, hi in level]
        self.levels = [nodes]
        while len(nodes) > 1:
            nodes = [(lo, min(lo + 4, len(nodes)), np.bitwise_or.reduce([x[2] for x in nodes[lo : lo + 4]]), nodes[lo][3], nodes[min(lo + 4, len(nodes)) - 1][4], max(x[5] for x in nodes[lo : lo + 4])) for lo in range(0, len(nodes), 4)]
            self.levels.append(nodes)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 |x and y| >= percent |x or y|, of sorted sets."""
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


def tree_join(sets: list[np.ndarray], own: np.ndarray, other: np.ndarray | None, percent: int, forest: Forest) -> None:
    """Join the components of all linked sets among own (other None), or between own and other, by dual traversal."""
    bits = 64
    while bits < 4 * max(len(s) for s in sets) and bits < 1 << 14:
        bits *= 2
    left = Tree(sets, own, bits)
    right = left if other is None else Tree(sets, other, bits)
    need = percent / (100 + percent) - 1e-9
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        a, b = left.levels[la][i], right.levels[lb][j]
        if 100 * a[4] < percent * b[3] or 100 * b[4] < percent * a[3]:
            continue
        if np.bitwise_count(a[2] & b[2]).sum() + min(a[5], b[5]) < need * (a[3] + b[3]):
            continue
        if la or lb:
            if la >= lb and not (left is right and la == lb and i == j):
                stack += [(la - 1, k, lb, j) for k in range(a[0], a[1])]
            elif left is right and la == lb and i == j:
                stack += [(la - 1, k, lb - 1, m) for k in range(a[0], a[1]) for m in range(k, b[1])]
            else:
                stack += [(la, i, lb - 1, k) for k in range(b[0], b[1])]
            continue
        rows, cols = np.arange(a[0], a[1]), np.arange(b[0], b[1])
        common = np.bitwise_count(left.maps[rows][:, None] & right.maps[cols][None]).sum(2, dtype=np.int64)
        most = common + np.minimum(left.extra[rows][:, None], right.extra[cols][None])
        fits = most >= need * (left.size[rows][:, None] + right.size[cols][None])
        if left is right and i == j:
            fits &= rows[:, None] < cols[None]
        for x, y in zip(*np.nonzero(fits), strict=True):
            p, q = left.rows[rows[x]], right.rows[cols[y]]
            if forest.root(p) != forest.root(q) and linked(sets[p], sets[q], percent):
                forest.join(p, q)


def _join(percent: int):
    """Links within each (cluster, block), of sorted rows: as stars of the documents of one component. What is known to be one component is not counted again."""

    def solve(group):
        ids = np.array([g[0] for g in group], np.int64)
        order = np.lexsort(([g[1] for g in group], ids))
        order = order[np.append(True, np.diff(ids[order]) != 0)]
        ids, group = ids[order], [group[i] for i in order]
        sets, forest = [g[2] for g in group], Forest(len(group))
        known: dict[int, int] = {}
        for i, g in enumerate(group):
            forest.join(known.setdefault(g[3], i), i)
        digest: dict[bytes, int] = {}
        rest = []
        for i, s in enumerate(sets):
            k = digest.setdefault(s.tobytes(), i)
            if k != i:
                forest.join(k, i)
            if k == i or group[i][1] != group[k][1]:
                rest.append(i)
        rest = np.array(rest)
        guest = np.array([group[i][1] for i in rest], bool)
        if len(rest) == 2:
            if linked(sets[rest[0]], sets[rest[1]], percent):
                forest.join(rest[0], rest[1])
        elif len(rest) > 1:
            if (~guest).all():
                tree_join(sets, rest, None, percent, forest)
            elif (~guest).any():
                tree_join(sets, rest[guest], rest[~guest], percent, forest)
        top = forest.labels()
        tail = top != np.arange(len(top))
        return ids[tail], ids[top[tail]]

    def run(batches):
        S.lean()
        now, group, spans = None, [], S.Spans()
        a, b = [], []
        for batch in batches:
            cluster, block, doc, of, m = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("cluster", "block", "doc_id", "of", "m"))
            files = batch.column(batch.schema.get_field_index("file"))
            begin, size = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("at", "n"))
            for i in range(batch.num_rows):
                if (cluster[i], block[i]) != now:
                    if len(group) > 1:
                        for out, x in zip((a, b), solve(group), strict=True):
                            out.append(x)
                    now, group = (cluster[i], block[i]), []
                group.append((doc[i], of[i], _set(spans, files[i].as_py(), int(begin[i]), int(size[i])), m[i]))
        if len(group) > 1:
            for out, x in zip((a, b), solve(group), strict=True):
                out.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (a, b)], names=["a", "b"])

    return run


def _grouped(sets: DataFrame, percent: int) -> DataFrame:
    return sets.repartition(S.partitions(sets.sparkSession), "cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(_join(percent), "a long, b long")


def _met(rows: DataFrame, guests: DataFrame) -> DataFrame:
    """Rows (cluster, block, blocks, chunks, doc_id, ...) in their blocks and each guest in all of them: a block for each pair of a block and a chunk of guests,
    so that no group has more than about two blocks of documents."""
    own = rows.withColumns({"of": F.lit(False), "chunk": F.explode(F.expr("sequence(0, chunks - 1)"))})
    guests = guests.withColumns({"of": F.lit(True), "chunk": F.expr("cast(pmod(xxhash64(doc_id, 1), chunks) as int)"), "block": F.explode(F.expr("sequence(0, blocks - 1)"))})
    pair = (F.col("chunk") * F.col("blocks") + F.col("block")).cast("int").alias("block")
    names = ["cluster", "of", "doc_id", "m", *(n for n in AT if n in rows.columns)]
    return own.select(pair, *names).unionByName(guests.select(pair, *names))


def _guests(wide: DataFrame) -> DataFrame:
    """Rows of clusters in blocks, and of each document outside its cluster's main component one for every block."""
    return _met(wide.drop("of"), wide.where("m <> main").dropDuplicates(["cluster", "doc_id"]).drop("of", "block"))


def _by_signature(wide: DataFrame, percent: int, common: np.ndarray) -> DataFrame:
    """Rows of the groups of documents that share a signature, where they are of several components. A group of more than a block is cut into blocks;
    what is outside its largest component meets them all."""
    sets, _ = S.written(wide.dropDuplicates(["doc_id"]).select("doc_id", "m", *AT), "wide")
    rows, _ = S.written(sets.mapInArrow(_signed(percent, common), "sig long, doc_id long, m long"), "signed")
    xor = [lambda c, n=n: F.bit_xor(c).alias(n) for n in "xy"]
    each = rows.groupBy("sig", "m").agg(F.count("*").alias("count"), *(f(F.xxhash64("doc_id", F.lit(k))) for k, f in enumerate(xor)))
    count = each.groupBy("sig").agg(F.max_by("m", F.struct("count", "m")).alias("main"), F.sum("count").alias("size"), F.count("*").alias("parts"), *(f(c) for c, f in zip("xy", xor, strict=True))).where("parts > 1")
    count = count.groupBy("x", "y", "size").agg(F.min("sig").alias("sig"), F.min("main").alias("main"))  # of groups with the same documents one is enough
    each = each.join(count.select("sig", "main"), "sig").groupBy("sig", "main").agg(F.sum("count").alias("size"), F.sum(F.expr("if(m <> main, count, 0)")).alias("minor"))
    rows = rows.join(each.select(F.col("sig"), "main", _cut("size").alias("blocks"), F.when(F.col("size") > BLOCK, _cut("minor")).otherwise(F.lit(1)).alias("chunks")), "sig")
    rows = rows.withColumnRenamed("sig", "cluster").withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
    return _met(rows, rows.where("blocks > 1 and m <> main").drop("block")).join(sets.select("doc_id", *AT), "doc_id")


def _cut(size: str):
    return F.ceil(F.col(size) / BLOCK).cast("int")


def jaccard_join(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of distinct word shingles have a Jaccard similarity of percent/100 or more.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case; fewer than `shingle` words make one shingle. Returns a row
    for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included). A null or
    empty text has no shingle and links with nothing; equal texts link; rows with a null id are left out; repeated ids give
    one row each, with one component. Other columns of docs are not read, so their names can't clash; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    total = rows.count()
    # of the whole table, since its parts may have other passages in common
    some = rows.where(F.expr(f"pmod(xxhash64(doc_id, 1), {max(1, total)}) < {SAMPLE}")).limit(SAMPLE)
    with S.cleared(spark):
        sample = some.mapInArrow(_common(shingle), "token long, count long").collect()
    common = np.array([r.token for r in sample if r.token is not None], np.int64).view(np.uint64)
    common.sort()
    # a text's signatures under both of its size classes, from the sample's tokens; where they meet moves work, never results
    texts, tokens = (sum(r["count"] for r in sample if r.token is None and (r["count"] < 0) == sign) for sign in (True, False))
    each = tokens / max(1, -texts) * 4 * (100 - percent) / (100 + percent)
    tasks = max(1, math.ceil(total * each / MEET))
    met, met_path = S.written(rows.mapInArrow(_sketch(shingle, percent, S.seats(spark, tasks), common), _OUT).repartition(tasks, "shard").mapInArrow(_meet, _OUT).drop("shard"), "sketch")
    same = met.where(f"kind = {_SAME}").select("a", "b")
    pairs = met.where(f"kind = {_PAIR}").select("a", "b")
    cluster, cluster_path = S.components(pairs)
    # every document of a cluster, its root included
    roots = cluster.groupBy("m").agg((F.count("*") + 1).alias("size"))
    member = cluster.select(F.col("v").alias("doc_id"), F.col("m").alias("cluster")).unionByName(roots.select(F.col("m").alias("doc_id"), F.col("m").alias("cluster")))
    member = member.join(roots.select(F.col("m").alias("cluster"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "cluster")
    member, member_path = S.written(member, "member")
    n = member.count()
    folder, kind, sorted_path = S.scratch(spark, "tokens"), "doc_id long, cluster long, blocks long, file string, at long, n long", None
    if n > BROADCAST_ROWS:
        index, sorted_path = S.sorted_files(member.select("doc_id", "cluster", F.col("blocks").cast("long")), "sorted")
        found = rows.mapInArrow(_sets(shingle, folder, index), kind)
    else:
        found = rows.join(F.broadcast(member.withColumn("blocks", F.col("blocks").cast("long"))), "doc_id").mapInArrow(_sets(shingle, folder), kind)
    sets, sets_path = S.written(found, "sets")
    block = F.expr("explode(if(doc_id = cluster, sequence(0, int(blocks) - 1), array(cast(pmod(xxhash64(doc_id), blocks) as int))))")
    sets = sets.select("cluster", F.col("blocks").cast("int").alias("blocks"), block.alias("block"), F.lit(False).alias("of"), "doc_id", F.col("doc_id").alias("m"), *AT)
    links, links_path = S.written(_grouped(sets, percent), "links")
    if member.where("blocks > 1").limit(1).count():
        part, part_path = S.components(links)
        wide = sets.where("blocks > 1").drop("m")
        own = wide.select("cluster", "doc_id").distinct().join(part.select(F.col("v").alias("doc_id"), "m"), "doc_id", "left").withColumn("m", F.coalesce("m", "doc_id"))
        main = own.groupBy("cluster", "m").count().groupBy("cluster").agg(F.max_by("m", F.struct("count", "m")).alias("main"), (F.sum("count") - F.max("count")).alias("minor"), F.sum("count").alias("size"))
        # one row for each document and, of those outside, one for each block: SPREAD rows for a document at most, else they go by their signatures
        main = main.select("cluster", "main", "minor", _cut("minor").alias("chunks"), (F.col("minor") * F.ceil(F.col("size") / BLOCK) > SPREAD * F.col("size")).alias("many"))
        own, _ = S.written(own.join(main, "cluster"), "own")
        wide = wide.join(own, ["cluster", "doc_id"])
        for r in own.where("minor > 0").select("many").distinct().collect():
            again = _by_signature(wide.where("many"), percent, common) if r.many else _guests(wide.where("minor > 0 and not many"))
            more, _ = S.written(_grouped(again, percent), "links")
            links = links.unionByName(more)
        S.drop(spark, part_path)
    found, _ = S.components(links.unionByName(same))
    S.drop(spark, sets_path, folder, member_path, cluster_path, *([sorted_path] if sorted_path else []))
    out = met.where(f"kind = {_DOC}").select("x", "y").mapInArrow(_unpacked, "doc_id long, n_shingles long")
    return out.join(found.select(F.col("v").alias("doc_id"), "m"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("m", "doc_id").alias("component_id"))
