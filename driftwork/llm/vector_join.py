"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to unit length, so a cosine of c or more is a squared distance of 2(1-c) or less. They are rotated (a fixed random
rotation spreads each vector's length evenly) and cut into blocks of dimensions. Within that budget at least one block's squared
distance is at most the budget's proportional share, so a range join of every block under its share finds all pairs. Each block's
join deals vectors to grid cells over the block's first dimensions, of side twice the block's radius: a vector is at home in one cell and a guest
in the later ones that its ball reaches, so every pair meets in one cell. Those at home in a cell are joined with each other and with the
guests, tile by tile, by matrix products over the block's dimensions only; pairs within the share are verified with the whole original
vectors in double precision. A pair counts in the first block that finds it.

How many dimensions the grid has is told by a bounded sample (it moves work, never results): what cells save in comparisons against what
they cost in copies; one that saves less than half is not worth its copies on disk. Without a grid, which is where vectors spread alike in all directions, the blocks share one cell, and a pair that any block finds is verified once.

Equal vectors are one class with its number, so copies are never paired. Links are counted, not listed: each task adds up the links of
its vectors and keeps a star forest of its components. A cell with many vectors is cut into slots, each a file in the shared folder; what is dealt to
tasks are pairs of slots, by name, so vectors lie on disk once however many pairs there are.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwork.llm import _shared as S

#: Blocks of dimensions, and dimensions of a block's grid at most.
BLOCKS, GRID = 4, 3
#: Vectors of a cell (guests too) that one task joins at once, and rows of a product.
SLOT, TILE = 8192, 512
#: Vectors of the sample, and how many comparisons of a block take as long as a copy of a vector.
SAMPLE, COPY = 2000, 10_000
#: Candidate pairs verified at once.
PAIRS = 50_000
#: Share of the comparisons without a grid that a grid may take at most, and pairs of slots of a task, as far as there are tasks enough.
WORTH, SHARE = 0.5, 8


def rotation(n: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(64).standard_normal((n, n)))[0]


def limits(n: int) -> list[tuple[int, int]]:
    k = min(BLOCKS, n)
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two (which is exact), so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _places(y: np.ndarray, k: int, threshold: float, grid: int):
    """(vectors, cells, whether they are at home there) of block k, for the home and each way to reach further cells."""
    n = y.shape[1]
    lo, hi = limits(n)[k]
    radius, g = np.sqrt(2 * (1 - threshold) * (hi - lo) / n) + 1e-6, min(grid, hi - lo)
    side = 2 * radius
    at = y[:, lo : lo + g] / side
    home = np.floor(at).astype(np.int64)
    # the lower or the upper neighbour in each dimension, where the ball reaches it
    near = np.where(at - home < 0.5, -1, 1)
    reach = np.abs(at - home - (near > 0)) * side <= radius
    for mask in range(1 << g):
        step = np.array([(mask >> d) & 1 for d in range(g)])
        # the home, and later cells only: the first dimension that differs goes up
        later = np.ones(len(y), bool) if not mask else near[:, step.argmax()] > 0
        use = np.flatnonzero((reach | (step == 0)).all(1) & later)
        cell = home[use] + near[use] * step
        key = np.full(len(use), n * 64 + k, np.int64)
        for d in range(g):
            key = key * 100_003 + cell[:, d] + 50_000
        yield use, key, mask == 0


def work(y: np.ndarray, threshold: float, grid: int) -> tuple[float, float]:
    """(comparisons of a block for each pair of vectors, copies of each vector) of a grid of so many dimensions."""
    blocks = len(limits(y.shape[1]))
    if not grid:
        return blocks, 1.0
    compared = copies = 0.0
    for k in range(blocks):
        home, guest = {}, {}
        for _, key, own in _places(y, k, threshold, grid):
            copies += len(key)
            for cell, c in zip(*np.unique(key, return_counts=True), strict=True):
                (home if own else guest)[cell] = (home if own else guest).get(cell, 0) + int(c)
        compared += sum(c * (c - 1) / 2 + c * guest.get(cell, 0) for cell, c in home.items())
    return compared / max(1, len(y) * (len(y) - 1) / 2), copies / len(y)


def plan(sample: list[np.ndarray], threshold: float, number: int) -> dict[int, int]:
    """For each number of dimensions in the sample, the grid's dimensions that take the least work for so many vectors."""
    found = {}
    for n in {len(v) for v in sample}:
        y = _unit(np.stack([v for v in sample if len(v) == n]).astype(float)) @ rotation(n)
        works = [work(y, threshold, g) for g in range(GRID + 1)]
        costs = [c * number + m * COPY if c <= WORTH * works[0][0] or not g else math.inf for g, (c, m) in enumerate(works)]
        found[n] = int(np.argmin(costs))
    return found


def _deal(threshold: float, grids: dict[int, int]):
    """A row for each (block, cell) that a vector is at home in or reaches; one for all blocks without a grid."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            for n in np.unique(size):  # vectors of other dimensions are another space
                rows = np.flatnonzero(size == n)
                part = batch.take(pa.array(rows))
                if not grids.get(int(n), GRID):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), n, np.int64)), pa.array(np.full(len(rows), -1, np.int32)), pa.array(np.ones(len(rows), bool)), *(part.column(c) for c in (0, 1, 2))], names=["cell", "block", "home", "vec_id", "embedding", "number"])
                    continue
                y = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), n)) @ rotation(n)
                for k in range(len(limits(n))):
                    for use, key, own in _places(y, k, threshold, grids.get(int(n), GRID)):
                        at = pa.array(use)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(use), k, np.int32)), pa.array(np.full(len(use), own)), *(part.column(c).take(at) for c in (0, 1, 2))], names=["cell", "block", "home", "vec_id", "embedding", "number"])

    return run


def _solve(threshold: float):
    """Joins each (cell, slot, slot): counts of links by vector, and star edges. block -1: all blocks."""

    def solve(block, ids, vectors, numbers, home, left, right, lo, hi):
        vectors = _scaled(vectors)
        size = np.linalg.norm(vectors, axis=1)
        x, n = vectors / size[:, None], vectors.shape[1]
        y = x @ rotation(n)
        parts = limits(n)
        share = [2 * (1 - threshold) * (d - c) / n + 1e-9 for c, d in parts]
        sides = []
        for k in range(len(parts)) if block < 0 else [block]:
            z = y[:, slice(*parts[k])]
            norm = (z * z).sum(1)[:, None]
            # one product gives the squared distances
            sides.append((np.hstack([z, norm, np.ones_like(norm)]).astype(np.float32), np.hstack([-2 * z, np.ones_like(norm), norm]).astype(np.float32).T, np.float32(share[k] + 1e-4)))
        count, edges, held = np.zeros(len(ids), np.int64), [], 0

        def meet(p, q):
            nonlocal edges, held
            for f in range(0, len(p), PAIRS):
                u, v = p[f : f + PAIRS], q[f : f + PAIRS]
                if block >= 0:  # the first block that finds a pair counts it
                    far = [((y[u, c:d] - y[v, c:d]) ** 2).sum(1) > share[k] for k, (c, d) in enumerate(parts[: block + 1])]
                    first = ~far[block] & np.logical_and.reduce([*far[:block], np.ones(len(u), bool)])
                    u, v = u[first], v[first]
                linked = np.einsum("ij,ij->i", vectors[u], vectors[v]) / (size[u] * size[v]) >= threshold
                u, v = u[linked], v[linked]
                np.add.at(count, u, numbers[v])
                np.add.at(count, v, numbers[u])
                edges.append(np.stack([ids[u], ids[v]]))
                held += len(u)
                if held > 1_000_000:
                    edges = [np.stack(S.contracted(*np.concatenate(edges, axis=1)))]
                    held = len(edges[0][0])

        def join(some, others, once):
            """Pairs between some and others; once: they are the same, and each pair is wanted once."""
            columns = [np.ascontiguousarray(behind[:, others]) for _, behind, _ in sides]
            for i in range(0, len(some), TILE):
                a = some[i : i + TILE]
                rows = [ahead[a] for ahead, _, _ in sides]
                for j in range(i if once else 0, len(others), TILE):
                    close = rows[0] @ columns[0][:, j : j + TILE] <= sides[0][2]
                    for r, c, (_, _, limit) in zip(rows[1:], columns[1:], sides[1:], strict=True):
                        close |= r @ c[:, j : j + TILE] <= limit
                    near = np.flatnonzero(close)
                    if len(near):
                        b = others[j : j + TILE]
                        p, q = a[near // len(b)], b[near % len(b)]
                        keep = p < q if once else slice(None)
                        meet(p[keep], q[keep])

        if lo == hi:
            own = left[home[left]]
            join(own, own, True)
            join(own, left[~home[left]], False)
        else:
            join(left[home[left]], right, False)
            join(right[home[right]], left[~home[left]], False)
        return count, edges

    return solve


def vector_links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id, kept.

    Two rows link when their cosine in double precision is threshold or more. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing, and vectors of different dimensions never link. component_id is the smallest vec_id reachable by
    links, itself included; kept says whether it is its own. Rows with a null id are left out; rows that repeat an id share its links and
    component, equal vectors among them count as copies. Very large and very small components are scaled first, so their squares neither overflow nor
    vanish. Other columns are not read; an empty table gives no row.
    """
    spark = vectors.sparkSession
    kind_of = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind_of).alias("embedding")).where("vec_id is not null")
    good = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    # the key of a class: adding 0.0 makes both zeros one; of large tables its digest of 128 bits is shuffled instead
    keyed = rows.where("good").select("vec_id", F.transform("embedding", lambda x: x + F.lit(0).cast(kind_of[6:-1])).alias("embedding"))
    digests = keyed.select("vec_id", F.size("embedding").alias("size"), F.xxhash64(F.lit(1), "embedding").alias("d1"), F.xxhash64(F.lit(2), "embedding").alias("d2"))
    classes, class_path = S.written(digests.groupBy("d1", "d2").agg(F.min("vec_id").alias("vec_id"), F.min("size").alias("size"), F.count("*").alias("number")), "classes")
    kind = "cell long, block int, home boolean, vec_id long, embedding " + kind_of + ", number long"
    picked = F.broadcast(classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "d1", "d2"))  # SAMPLE vectors at most
    some = keyed.withColumns({name: F.xxhash64(F.lit(k), "embedding") for k, name in ((1, "d1"), (2, "d2"))})
    with S.cleared(spark):
        some = some.join(picked, ["vec_id", "d1", "d2"]).dropDuplicates(["d1", "d2"]).select("embedding").collect()
    number = classes.count()
    grids = plan([np.array(r.embedding) for r in some], threshold, number)
    wide = [n for n, g in grids.items() if not g]  # dimensions without a grid
    whole = keyed.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("number")).select("vec_id", "embedding", "number")
    folder, named = S.scratch(spark, "slots"), "cell long, block int, slot string, n long"
    # one cell for all: a task's vectors are cut into slots as they come
    alone = F.size("embedding").isin(wide) if wide else F.lit(False)
    index = whole.where(alone).coalesce(max(1, math.ceil(number / SLOT))).mapInArrow(_deal(threshold, grids), kind).mapInArrow(_slots(folder), named)
    out, dealt_path = [], None
    if classes.where(~F.col("size").isin(wide) if wide else F.lit(True)).limit(1).count():
        dealt, dealt_path = S.written(whole.where(~alone).mapInArrow(_deal(threshold, grids), kind), "cells")
        slots = dealt.groupBy("cell").count().select("cell", F.ceil(F.col("count") / SLOT).cast("int").alias("slots"))
        slots, _ = S.written(slots, "counts")
        few = dealt.join(slots.where("slots = 1").select("cell"), "cell")
        found = few.repartition(S.partitions(spark), "cell").sortWithinPartitions("cell")
        out.append(S.written(found.mapInArrow(_groups(threshold), "a long, b long, links long"), "links")[0])
        many = dealt.join(slots.where("slots > 1"), "cell").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("slots")).cast("int"))
        many = many.repartition(S.partitions(spark), "cell", "own").sortWithinPartitions("cell", "own").select("cell", "block", "home", "vec_id", "embedding", "number")
        index = index.unionByName(many.mapInArrow(_slots(folder), named))
    index, index_path = S.written(index, "index")
    pairs = index.join(index.select("cell", F.col("slot").alias("other")), "cell").where("slot <= other")
    tasks = max(S.partitions(spark), min(S.SEATS, math.ceil(pairs.count() / SHARE)))
    out.append(S.written(pairs.select("block", "slot", "other").repartition(tasks).mapInArrow(_pairs(threshold), "a long, b long, links long"), "links")[0])
    S.drop(spark, folder, *([dealt_path] if dealt_path else []))
    out = out[0] if len(out) < 2 else out[0].unionByName(out[1])
    counts = out.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    part, _ = S.components(out.where("b is not null").select("a", "b"))
    per = classes.select("vec_id", "d1", "d2", "number").join(counts, F.col("vec_id") == F.col("rep"), "left").drop("rep").join(part.withColumnsRenamed({"v": "vec_id", "m": "root"}), "vec_id", "left")
    per = per.select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("number") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    linked = digests.join(per, ["d1", "d2"]).select("vec_id", "n_links", "component_id")
    lone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _slots(folder: str):
    """Files of at most SLOT rows of one (cell, block), of rows that come by cells; (cell, block, file, rows) of each."""

    def run(batches):
        held: dict[tuple, list] = {}

        def put(key):
            parts = held.pop(key)
            rows, name = pa.Table.from_batches(parts), f"{folder}/{uuid.uuid4().hex}"
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            S.put_file(name, sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([name]), pa.array([rows.num_rows], pa.int64())], names=["cell", "block", "slot", "n"])

        for batch in batches:
            cell, block = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            change = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
            for i, j in zip(change, np.append(change[1:], len(cell)), strict=True):
                key = int(cell[i]), int(block[i])
                for old in [k for k in held if k[1] >= 0 and k != key]:  # rows of a grid's cells come sorted
                    yield put(old)
                while i < j:
                    room = SLOT - sum(p.num_rows for p in held.get(key, []))
                    held.setdefault(key, []).append(batch.slice(i, min(room, j - i)))
                    i += min(room, j - i)
                    if sum(p.num_rows for p in held[key]) >= SLOT:
                        yield put(key)
        for key in [*held]:
            yield put(key)

    return run


def _columns(batch: pa.RecordBatch):
    """home, vec_id, number and the vectors, of rows of one dimension."""
    home, ids, number = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("home", "vec_id", "number"))
    return home, ids, number, batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False).astype(float)


def _finish(solve, block, parts, lo, hi):
    """Joins the rows (own, home, ids, number, vectors) of one cell, whose slots are lo and hi."""
    own, home, ids, number = (np.concatenate([p[k] for p in parts]) for k in range(4))
    vectors = np.concatenate([p[4] for p in parts]).reshape(len(ids), -1)
    order = np.lexsort((ids, own))
    home, own, ids, number, vectors = home[order], own[order], ids[order], number[order], vectors[order]
    left = np.flatnonzero(own == lo)
    right = left if lo == hi else np.flatnonzero(own == hi)
    count, edges = solve(block, ids, vectors, number, home, left, right, lo, hi)
    some = np.flatnonzero(count)
    yield _batch(ids[some], None, count[some])
    a, b = S.contracted(*np.concatenate([np.empty((2, 0), np.int64), *edges], axis=1))
    yield _batch(a, b, None)


def _pairs(threshold: float):
    """Joins each pair of slots (block, file, file), which may be the same."""
    solve = _solve(threshold)

    def read(name):
        table = pa.ipc.open_stream(pa.py_buffer(S.mapped(name))).read_all()
        return [_columns(b) for b in table.to_batches()]

    def run(batches):
        S.lean()
        for batch in batches:
            for row in batch.to_pylist():
                names = [row["slot"]] if row["slot"] == row["other"] else [row["slot"], row["other"]]
                parts = [(np.full(len(p[0]), k), *p) for k, name in enumerate(names) for p in read(name)]
                yield from _finish(solve, row["block"], parts, 0, len(names) - 1)

    return run


def _groups(threshold: float):
    """Collects each cell of sorted rows and joins it."""
    solve = _solve(threshold)

    def run(batches):
        now, held = None, []
        for batch in batches:
            cell, block = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("cell", "block"))
            change = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
            for i, j in zip(change, np.append(change[1:], len(cell)), strict=True):
                key = int(cell[i]), int(block[i])
                if key != now and held:
                    yield from _finish(solve, now[1], held, 0, 0)
                    held = []
                now = key
                part = _columns(batch.slice(i, j - i))
                held.append((np.zeros(j - i, np.int64), *part))
        if held:
            yield from _finish(solve, now[1], held, 0, 0)

    return run


def _batch(a, b, links):
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(n, pa.int64()) if links is None else pa.array(links, pa.int64())], names=["a", "b", "links"])
