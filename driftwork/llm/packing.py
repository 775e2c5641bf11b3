"""Packing documents into sequences of one window by non-negative least squares over a histogram of lengths.

A document's ids are cut at every window; what is left, its tail, is shorter. Few lengths that together fill a window are a combination; all of
up to DEPTH lengths are enumerated. How often each is used is solved against the histogram of tails (non-negative least squares by
accelerated projected gradients), rounded to what there is, and what remains is packed greedily, longest first, in bulk; a gap that no
tail fits takes the beginning of a longer one. The last sequence is cut into powers of two, which need no padding.

The plan speaks of lengths and ranks only: the tails of one length from rank r on begin the sequences from s on. So a table of at most
window^2 / 4 entries places any number of documents, each by the rank of its tail among those of its length, which is a running
count over rows dealt by ranges. Full windows are sequences by themselves. Only numbers are exchanged; of the ids those of tails are
kept, and read again where the plan cuts them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwork.llm import _shared as S
from driftwork.llm import _text as T
from driftwork.llm.token_shards import ENCODE_BYTES, Encoder

#: Lengths in a combination at most, and steps of the solver.
DEPTH, STEPS = 3, 400
#: Tails that are cut, or whose ids are wanted, up to which their keys are broadcast (8 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def combinations(window: int, present: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """All ascending rows of up to `depth` of these lengths that sum up to the window; 0 fills the front of shorter ones."""
    there = np.zeros(window + 1, bool)
    there[present[(present > 0) & (present < window)]] = True
    lengths, found = np.flatnonzero(there), []
    rows, sums = np.zeros((1, 0), np.int64), np.zeros(1, np.int64)
    for k in range(2, depth + 1):
        # one more length, not below the last, that leaves room for as large ones
        last = rows[:, -1] if rows.shape[1] else np.ones(len(rows), np.int64)
        lo = np.searchsorted(lengths, last)
        hi = np.searchsorted(lengths, (window - sums) // 2, "right")
        each = np.maximum(hi - lo, 0)
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)
        rows = np.column_stack([np.repeat(rows, each, axis=0), lengths[at]])
        sums = np.repeat(sums, each) + lengths[at]
        ends = there[window - sums]
        full = np.column_stack([rows[ends], window - sums[ends]])
        found.append(np.pad(full, ((0, 0), (depth - k, 0))))
    return np.concatenate(found) if found else np.zeros((0, depth), np.int64)


def repeats(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often each combination is used: x >= 0 with the least squared difference between the lengths it takes and their counts."""
    if not len(combos):
        return np.zeros(0)
    size, flat = len(counts), combos.ravel()
    filled = combos > 0

    def taken(x):
        return np.bincount(flat, np.repeat(x, combos.shape[1]), size) * (np.arange(size) > 0)

    def back(r):
        return np.where(filled, r[combos], 0).sum(1)

    v = np.ones(len(combos))
    for _ in range(20):  # the largest curvature
        w = back(taken(v))
        v = w / np.linalg.norm(w)
    step = 1 / (1.05 * np.linalg.norm(back(taken(v))))
    wanted = counts.astype(float)
    wanted[0] = 0
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(taken(y) - wanted))
        if (new - x) @ (y - new) > 0:  # overshot: begin the acceleration anew
            t = 1.0
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


class Plan:
    """Where tails go, by length and rank. counts[k]: tails of length k, for k below the window.

    Placements: of the tails of length `bin` with ranks lo <= r < hi, the `length` ids from `start` on lie at `offset` of sequence
    seq + (r - lo). Intervals of ranks within which nothing changes list their placements. sequences: their number.
    """

    def __init__(self, counts: np.ndarray, window: int, depth: int = DEPTH):
        self.window, self.sequences, self.places = window, 0, []
        left = counts.astype(np.int64).copy()
        left[0] = 0
        used = np.zeros(window, np.int64)
        combos = combinations(window, np.flatnonzero(left), depth)
        x = np.rint(repeats(combos, left)).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            if not x[j]:
                break
            row = combos[j][combos[j] > 0].tolist()
            n = min(int(x[j]), *(int(left[k]) // row.count(k) for k in row))
            if n > 0:
                self._sequences([(k, 0, int(used[k]) + n * row[:i].count(k), k) for i, k in enumerate(row)], n)
                for k in row:
                    left[k] -= n
                    used[k] += n
        self._greedy({k: [[k, 0, int(used[k]), int(left[k])]] for k in np.flatnonzero(left).tolist()})
        self._index()

    def _sequences(self, pieces: list[tuple[int, int, int, int]], n: int) -> None:
        """n sequences of these pieces: (bin, start, first rank, length)."""
        offset = 0
        for bin, start, lo, length in pieces:
            self.places.append((bin, lo, lo + n, start, length, self.sequences, offset))
            offset += length
        self.sequences += n

    def _greedy(self, groups: dict[int, list[list[int]]]) -> None:
        """Groups of equal pieces by length: [bin, start, first rank, number]. Each round makes as many equal sequences as its groups allow."""
        while groups:
            lengths, taken, gap = sorted(groups), [], self.window
            uses: dict[int, int] = defaultdict(int)

            def free(length):
                return next((g for g in groups[length] if g[3] > uses[id(g)]), None)

            def take(g, length):
                uses[id(g)] += 1
                taken.append((g, length))

            for length in reversed(lengths):
                while length <= gap and (g := free(length)):
                    take(g, length)
                    gap -= length
            cut = next(((g, k) for k in reversed(lengths) if gap and (g := free(k))), None)
            if cut:  # nothing fits: the beginning of a longer piece does
                take(cut[0], gap)
            n = min(g[3] // uses[id(g)] for g, _ in taken)
            if gap and not cut:  # the last pieces of all
                self._powers([(g[0], g[1], g[2], length) for g, length in taken])
                return
            pieces, given = [], defaultdict(int)
            for g, length in taken:
                pieces.append((g[0], g[1], g[2] + given[id(g)] * n, length))
                given[id(g)] += 1
            self._sequences(pieces, n)
            if cut:
                rest = cut[1] - gap
                groups.setdefault(rest, []).append([cut[0][0], cut[0][1] + gap, pieces[-1][2], n])
            for g, _ in {id(g): (g, 0) for g, _ in taken}.values():
                g[2] += n * uses[id(g)]
                g[3] -= n * uses[id(g)]
            groups = {k: kept for k, v in groups.items() if (kept := [g for g in v if g[3]])}

    def _powers(self, pieces: list[tuple[int, int, int, int]]) -> None:
        """Single pieces that do not fill a window, as sequences of powers of two. Equal groups are never listed twice here but for their ranks."""
        total, k = sum(p[3] for p in pieces), 0
        seen: dict[tuple[int, int, int], int] = defaultdict(int)
        queue = []
        for bin, start, lo, length in pieces:
            queue.append([bin, start, lo + seen[bin, start, lo], length])
            seen[bin, start, lo] += 1
        for bit in reversed(range(total.bit_length())):
            room, now = total & 1 << bit, []
            while room:
                bin, start, lo, length = queue[k]
                part = min(room, length)
                now.append((bin, start, lo, part))
                queue[k] = [bin, start + part, lo, length - part]
                k += part == length
                room -= part
            if now:
                self._sequences(now, 1)

    def _index(self) -> None:
        self.places = np.array(self.places, np.int64).reshape(-1, 7)
        self.intervals: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        order = np.argsort(self.places[:, 0], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.places[order, 0])) + 1) if len(order) else []:
            lo, hi = self.places[part, 1], self.places[part, 2]
            begin = np.unique(np.concatenate([lo, hi]))
            a, b = np.searchsorted(begin, lo), np.searchsorted(begin, hi)
            which = np.repeat(part, b - a)
            at = np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            by = np.argsort(at, kind="stable")
            self.intervals[int(self.places[part[0], 0])] = begin, which[by], np.searchsorted(at[by], np.arange(len(begin) + 1))

    def find(self, bin: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, placement) of tails of one length with these ranks, from 0."""
        begin, which, first = self.intervals[bin]
        at = np.searchsorted(begin, ranks, "right") - 1
        each = first[at + 1] - first[at]
        row = np.repeat(np.arange(len(ranks)), each)
        return row, which[np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + first[at][row]]


_ENCODED = "key long, doc_id long, doc_tokens long, windows array<long>, window_no long, tail long, tail_crc long, width int, ids binary"
_PIECES = "key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, at long"


def _encode(path: str, window: int, end: int | None, whole: bool):
    """A row for each document: its ids' checksums by window, the tail's length and checksum, and the tail's ids (or all)."""

    def run(batches):
        S.lean()
        part, row, full, encoder = TaskContext.get().partitionId(), 0, 0, None
        for batch, _, _ in T.blocks(batches, size=ENCODE_BYTES):
            encoder = encoder or Encoder(path)
            out = []
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()], end), strict=True):
                wide = np.frombuffer(raw, f"<u{encoder.width}").astype("<u4").tobytes()
                n, step = len(wide) // 4, 4 * window
                crcs = [zlib.crc32(wide[i : i + step]) for i in range(0, n // window * step, step)]
                tail = n % window
                ids = raw if whole else raw[len(raw) - tail * encoder.width :]
                out.append(((part << 33) + row, doc, n, crcs, (part << 33) + full, tail, zlib.crc32(wide[n // window * step :]), encoder.width, ids))
                row, full = row + 1, full + len(crcs)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _ENCODED.split(", ")])

    return run


def _placed(plan: Plan):
    """Pieces of ranked tails (key, doc_id, doc_tokens, tail, tail_crc, rank from 1); the checksum of a part of a tail is still null."""

    def run(batches):
        for batch in batches:
            key, doc_tokens, tail, crc, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "doc_tokens", "tail", "tail_crc", "rank"))
            rows, places = [], []
            for bin in np.unique(tail):
                own = np.flatnonzero(tail == bin)
                r, p = plan.find(int(bin), rank[own] - 1)
                rows.append(own[r])
                places.append(p)
            if not rows:
                continue
            row = np.concatenate(rows)
            _, lo, _, start, length, seq, offset = plan.places[np.concatenate(places)].T
            whole = length == tail[row]
            at = doc_tokens[row] - tail[row] + start
            doc = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row))
            columns = [pa.array(key[row]), doc, pa.array(at), pa.array(length), pa.array(crc[row], mask=~whole), pa.array(doc_tokens[row]), pa.array(seq + rank[row] - 1 - lo), pa.array(offset), pa.array(start)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def _read(with_ids: bool):
    """Pieces beside the stored ids of their document: the checksum, and the ids if wanted."""

    def run(batches):
        for batch in batches:
            crcs, lists = [], []
            for raw, width, at, n in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("ids", "width", "at", "length")), strict=True):
                w, i = width.as_py(), at.as_py()
                ids = np.frombuffer(raw.as_buffer(), f"<u{w}")[i : i + n.as_py()].astype("<u4")
                crcs.append(zlib.crc32(ids.tobytes()))
                lists.append(ids.astype(np.int64))
            names = [c for c in batch.schema.names if c not in ("ids", "width", "at", "ids_crc32", "key")]
            more = [pa.array(lists, pa.list_(pa.int64()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(crcs, pa.int64()), *more], names=[*names, "ids_crc32", *(["ids"] if with_ids else [])])

    return run


def packed(docs: DataFrame, path: str, window: int = 1024, end: int | None = 0, with_ids: bool = False, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if wanted.

    Documents are encoded whole, the end id is appended; each id lies in one piece, and the pieces of a sequence lie without gaps from offset 0 on.
    All sequences have `window` ids but the last few, which are powers of two, so nothing is padded. Sequences of several documents
    are numbered from 0; those of one full window follow, not without gaps in their numbers. A null text is empty (only the end id; no
    piece where there is none either); a null id stays null; repeated rows are packed each; other columns are not read; an empty table gives no piece.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known, _ = S.written(rows.mapInArrow(_encode(path, window, end, with_ids), _ENCODED), "encoded")
    counts = np.zeros(window, np.int64)
    for r in known.groupBy("tail").count().collect():  # a row for each length below the window
        counts[r.tail] = r["count"]
    plan = Plan(counts, window, depth)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"] + ["ids"] * with_ids

    ranked, _ = S.running(known.where("tail > 0").select("key", "doc_id", "doc_tokens", "tail", "tail_crc", F.lit(1).cast("long").alias("one")), "tail", ["key"], ["key"], {"rank": "one"})
    tails, _ = S.written(ranked.mapInArrow(_placed(plan), _PIECES), "tails")
    windows = known.where("doc_tokens >= {}".format(window)).select("key", "doc_id", "doc_tokens", "window_no", F.posexplode("windows").alias("no", "ids_crc32"))
    first = F.col("no").cast("long") * window
    windows = windows.select("key", "doc_id", first.alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.lit(plan.sequences) + F.col("window_no") + F.col("no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), first.alias("at"))
    if with_ids:
        pieces, rest = tails.withColumn("at", F.col("start")).unionByName(windows), None
    else:
        pieces, rest = tails.where("ids_crc32 is null"), tails.where("ids_crc32 is not null").unionByName(windows)
    small = not with_ids and pieces.count() <= BROADCAST_ROWS
    kind = ", ".join(f"{c} {'array<long>' if c == 'ids' else 'long'}" for c in names)
    read = known.select("key", "width", "ids").join(F.broadcast(pieces) if small else pieces, "key").mapInArrow(_read(with_ids), kind)
    return read if rest is None else read.unionByName(rest.select(*names))
