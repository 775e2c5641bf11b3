"""Shared folder, lineage cuts and connected components used by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
#: Parts up to which each gets a task of its own; of more, a task's share evens out.
SEATS = 4096
#: Spark's setting by which an execution removes its shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a file of sorted keys, and files that a task keeps open.
KEYS, OPEN = 1_000_000, 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; a local one where that is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[[^,]*(,\d+)?\])?$", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share; the master is {master}")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="driftwork-")
    return _OWN[app]


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the shared one. It is deleted when the driver ends, if drop() has not done so: a result may read it until then."""
    path = f"{shared_dir(spark)}/driftwork-{tag}-{uuid.uuid4().hex[:12]}"
    store, at = _hadoop(spark, path)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing needs any more."""
    for path in paths:
        store, at = _hadoop(spark, path)
        store.delete(at, True)


@contextlib.contextmanager
def cleared(spark: SparkSession):
    """Shuffle files of what is written meanwhile go when it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it: its lineage is cut and it survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    with cleared(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def seats(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n parts a number that repartition(n, number) deals to a task of its own; very many parts are dealt as it comes."""
    if n > SEATS:
        return np.arange(n)
    found = spark.range(max(64, 16 * n)).select("id", F.expr(f"pmod(hash(id), {n})").alias("k")).groupBy("k").agg(F.min("id").alias("id")).collect()
    out = np.arange(n) + max(64, 16 * n)  # a part that none of these falls on shares a task
    for r in found:
        out[r.k] = r.id
    return out


def lean() -> None:
    """Let this worker give memory back between tasks: large arrays are mapped, so they go when they are freed, and free pages are returned."""
    with contextlib.suppress(OSError, AttributeError):  # where the C library is glibc
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Carried:
    """Columns of a table on their way through a Python scan under private names, so that names can't clash, and the text, which crosses once.

    rows: the columns as __0, __1, ... with the text; text: its name there. A column that has the name of a result is replaced by it.
    """

    def __init__(self, docs: DataFrame, keep: list[str] | None, text_col: str, results: str):
        taken = {r.split()[0].lower() for r in results.split(", ")}
        wanted = range(len(docs.columns)) if keep is None else [docs.columns.index(k) for k in keep]
        wanted = [i for i in wanted if docs.columns[i].lower() not in taken]
        at = docs.columns.index(text_col)
        named = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))
        self.text = f"__{at}" if at in wanted and docs.schema[at].dataType.simpleString() == "string" else "__text"
        self.kept, self.results = [f"__{i}" for i in wanted], results
        self.names = [*(docs.columns[i] for i in wanted), *(r.split()[0] for r in results.split(", "))]
        self.rows = named.select(*self.kept, *([] if self.text in self.kept else [F.col(f"__{at}").cast("string").alias("__text")]))

    def scan(self, run) -> DataFrame:
        """The rows that run makes of Arrow batches: the kept columns, in order, and the results."""
        made = StructType([*self.rows.select(*self.kept).schema, *StructType.fromDDL(self.results)])
        return self.rows.mapInArrow(run, made).toDF(*self.names)

    def batch(self, batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(self.kept))), *results], names=[*self.kept, *self.names[len(self.kept) :]])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}


def running(rows: DataFrame, group: str, deal: list, order: list, sums: dict | None = None, xors: dict | None = None, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """rows with running sums and exclusive-ors of long columns within each group (a long column) in this order, the row itself included, and the path of their table.

    sums, xors: name of a column by name of its result. keep: columns that are needed beyond the sorting (all by default). Rows are dealt by ranges of group and deal, so that a group of any size is shared by
    tasks; a task runs over its sorted rows, a block at a time. A group that began in tasks before is completed by what those have of
    it: only a task's first group can be such, so that is at most a row for each task. deal must follow order (its first columns, or beginnings of them).
    """
    sums, xors = sums or {}, xors or {}
    given = keep or rows.columns
    made = StructType([*rows.select(*given).schema, *StructType.fromDDL(", ".join([*(f"{n} long" for n in (*sums, *xors)), "__part int, __first boolean"]))])
    sources = [*(given.index(c) for c in sums.values()), *(given.index(c) for c in xors.values())]
    at = given.index(group)

    def run(batches):
        part, first, before, carry = TaskContext.get().partitionId(), None, None, [0] * len(sources)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(at).to_numpy(zero_copy_only=False)
            first = key[0] if first is None else first
            new = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(new)
            which, follows, out = np.cumsum(new) - 1, key == before, []
            for k, c in enumerate(sources):
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                if k < len(sums):
                    total = np.cumsum(x)
                    total = total - (total[begin] - x[begin])[which]
                    total[follows] += carry[k]
                else:
                    total = np.bitwise_xor.accumulate(x)
                    total = total ^ (total[begin] ^ x[begin])[which]
                    total[follows] ^= carry[k]
                carry[k] = total[-1]
                out.append(pa.array(total))
            before = key[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(n, part, np.int32)), pa.array(key == first)], names=made.names)

    dealt = rows.repartitionByRange(partitions(rows.sparkSession), group, *deal).sortWithinPartitions(group, *order).select(*given)
    held, path = written(dealt.mapInArrow(run, made), "running")
    # a task's share of each group that some task begins with, and what the tasks before have of it
    shared = held.where("__first").select(group).distinct()
    shares = held.join(F.broadcast(shared), group).groupBy(group, "__part").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.bit_xor(c).alias(n) for n, c in xors.items()))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    due = shares.select(group, "__part", *(F.sum(n).over(earlier).alias(f"__{n}") for n in sums), *(F.bit_xor(n).over(earlier).alias(f"__{n}") for n in xors)).dropna()
    due, _ = written(due, "due")
    full = held.join(F.broadcast(due), [group, "__part"], "left")  # at most a row for each task
    add = lambda n: F.coalesce(F.col(f"__{n}"), F.lit(0).cast("long"))
    return full.select(*given, *((F.col(n) + add(n)).alias(n) for n in sums), *(F.col(n).bitwiseXOR(add(n)).alias(n) for n in xors)), path


def local_path(url: str) -> str | None:
    """The path of a mounted shared folder, None where it needs a remote filesystem."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    return url if url.startswith("/") else None


def put_file(url: str, data: bytes | memoryview | list) -> None:
    """Write one whole file so that a second attempt of the task can't leave a mixture."""
    parts, path = data if isinstance(data, list) else [data], local_path(url)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(url)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        part = f"{inner}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            for x in parts:
                out.write(x)
        store.move(part, inner)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        for x in parts:
            out.write(x)
    os.replace(part, path)


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links a-b: each node but the smallest of its component, with that smallest."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


def _contract(batches):
    """Each task's links as a star forest; a block of links at a time, so memory is bounded."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 2_000_000:
            a, b = contracted(a, b)
            if len(a) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["v", "m"])
                a, b = a[:0], b[:0]
    a, b = contracted(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["v", "m"])


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """Connected components of links(a long, b long) as (v, m): each node but the smallest of its component, with that smallest.

    Alternating stars: every round hangs the larger neighbours of a node on the smallest, then the smaller ones. Rounds are
    written to the shared folder. A hub's rows are joined, never grouped, so the join can split them; sums before each
    shuffle are partial. Returns the table and its path.
    """
    spark = links.sparkSession
    kind = "v long, m long"
    pairs = links.select(F.col("a").cast("long").alias("v"), F.col("b").cast("long").alias("m")).where("v <> m")
    edges, path = written(pairs.mapInArrow(_contract, kind).distinct(), "cc")
    while True:
        lowest, low_path = written(edges.groupBy("v").agg(F.min("m").alias("low")), "low")
        # larger neighbours of a node hang on its smallest neighbour
        up = edges.join(lowest.withColumnsRenamed({"v": "m", "low": "top"}), "m", "left").select("v", F.coalesce("top", "m").alias("m"))
        # smaller neighbours of a node hang on the smallest of them
        side = edges.join(lowest, "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        nxt, nxt_path = written(up.unionByName(side).mapInArrow(_contract, kind).distinct(), "cc")
        # done when the table is a star forest: one row a node, and no root is itself hung
        many = nxt.groupBy("v").count().where("count > 1").limit(1).count()
        deep = 0 if many else nxt.join(nxt.select(F.col("v").alias("m")), "m", "left_semi").limit(1).count()
        drop(spark, path, low_path)
        edges, path = nxt, nxt_path
        if not many and not deep:
            return edges, path


def fetched(url: str, into: str) -> str:
    """A local path with the file's bytes: the file itself where the folder is mounted, else a copy at into."""
    path = local_path(url)
    if path is not None:
        return path
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(url)
    with store.open_input_stream(inner) as src, open(into, "wb") as out:
        while chunk := src.read(8 << 20):
            out.write(chunk)
    return into


def mapped(url: str):
    """The file as a read-only memory map; a local copy is unlinked at once, so nothing stays behind."""
    import mmap

    into = os.path.join(tempfile.gettempdir(), f"driftwork-{uuid.uuid4().hex}")
    path = fetched(url, into)
    with open(path, "rb") as f:
        out = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
    if path == into:
        os.unlink(into)
    return out


class Spans:
    """Spans of bytes of files in the shared folder: mapped where it is mounted, read by their ranges elsewhere."""

    def __init__(self):
        self.files = {}

    def _opened(self, url: str):
        path = local_path(url)
        if path is None:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(url)
            return lambda at, size, f=store.open_input_file(inner): f.read_at(size, at)
        return lambda at, size, m=memoryview(mapped(url)): m[at : at + size]

    def __call__(self, url: str, at: int, size: int):
        if url not in self.files:
            if len(self.files) >= OPEN:
                self.files.pop(next(iter(self.files)))
            self.files[url] = self._opened(url)
        return self.files[url](at, size)


def sorted_files(df: DataFrame, tag: str) -> tuple[list, str]:
    """Long columns of df, sorted by the first, as files of KEYS rows in the shared folder: (file, rows, first key, last key) of each, and their folder."""
    spark, width = df.sparkSession, len(df.columns)
    folder = scratch(spark, tag)

    def put(held):
        table = np.concatenate(held, axis=1)
        name = f"{folder}/{uuid.uuid4().hex}"
        put_file(name, np.ascontiguousarray(table).tobytes())
        return pa.RecordBatch.from_pylist([{"file": name, "n": table.shape[1], "first": int(table[0, 0]), "last": int(table[0, -1])}])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(width)]))
            n += batch.num_rows
            if n >= KEYS:
                yield put(held)
                held, n = [], 0
        if held:
            yield put(held)

    key = df.columns[0]
    with cleared(spark):
        found = df.where(F.col(key).isNotNull()).repartitionByRange(partitions(spark), key).sortWithinPartitions(key).mapInArrow(run, "file string, n long, first long, last long").collect()
    return [tuple(r) for r in found], folder


class Keys:
    """Looks keys up in sorted_files()."""

    def __init__(self, index: list, width: int):
        self.index, self.width, self.spans = index, width, Spans()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row with one of these keys: the key's position, and the row's columns but the first."""
        order = np.argsort(keys, kind="stable")
        ordered, at, rows = keys[order], [np.empty(0, np.int64)], [np.empty((self.width - 1, 0), np.int64)]
        for file, n, first, last in self.index:
            i, j = np.searchsorted(ordered, first), np.searchsorted(ordered, last, "right")
            if i == j:
                continue
            table = np.frombuffer(self.spans(file, 0, 8 * n * self.width), np.int64).reshape(self.width, n)
            lo, hi = np.searchsorted(table[0], ordered[i:j]), np.searchsorted(table[0], ordered[i:j], "right")
            size = hi - lo
            at.append(np.repeat(order[i:j], size))
            rows.append(table[1:, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)])
        return np.concatenate(at), np.concatenate(rows, axis=1)


def among(rows: DataFrame, key: str, ids: DataFrame, there: bool) -> DataFrame:
    """The rows whose key is (or is not) among the ids, a table of one column: looked up in files, so that no row is shuffled for it. A null key is not among them."""
    index, _ = sorted_files(ids.select(F.col(ids.columns[0]).cast("long").alias("id")), "ids")

    def run(batches):
        known = Keys(index, 1)
        for batch in batches:
            given = batch.column(batch.num_columns - 1)
            valid = given.is_valid().to_numpy(zero_copy_only=False)
            which = np.flatnonzero(valid)
            found = np.zeros(len(valid), bool)
            found[which[known.find(given.drop_null().to_numpy(zero_copy_only=False))[0]]] = True
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(found == there))

    return rows.select(*rows.columns, F.col(key).cast("long").alias("__key")).mapInArrow(run, rows.schema)
