"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of its own over one vocabulary. Every count is a continuation count: a
bigram counts by how many different words it follows in the class, a word by how many, and neither more than the number of the
class's texts that hold it. Passages that are copied many times thus count once, and so do the words of a single odd text.

A word is reached from the root through its stems (the first 4, 5, 6 and 7 bytes): its probability is the product of those of each step, a
node given the one above; a bigram's is interpolated with its word's. Each class discounts its counts by DISCOUNT and, further, by what both
classes have in common (SHARED times, and twice its root), as if both had as many texts; what it discounts is dealt out by a distribution that the classes share, the
modified Kneser-Ney one of all discounted counts, which in turn falls back on an equal share of the known steps and one unknown. So rare expressions are what their stems are, and what both classes use, or neither knows, gets nearly the same
probability from either. Each of these is a distribution that sums to 1.

A text's evidence is the difference of its log-likelihoods under the two models over its distinct bigrams, beyond what is usual, divided by
their number and, to judge long texts as well, by the root of that; a logistic curve over both, fitted on labelled texts that were kept out of the counts,
turns it into a score.

Learning reads a bounded sample: at most PER_CLASS labelled texts of each class, those with the smallest hash of the id. Everything in it
counts, whichever class is larger: nothing is cut by frequency, and where counts of the classes are compared, the ordinary ones are taken in
proportion to the numbers of texts. Counts are made and stored by tasks, as sorted hash arrays that scorers map; the driver gets sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwork.llm import _shared as S
from driftwork.llm import _text as T
from driftwork.llm.hash_arrays import Tables, added, discounts, runs

#: Bound of the training sample, a class.
PER_CLASS = 6000
STEMS = (4, 5, 6, 7)
#: What a class discounts: of a word's or stem's count, of a bigram's, and, of either, times what both classes have. Chosen by held-out labels (README).
DISCOUNT, PAIR_DISCOUNT, SHARED = 6, 12, 1
#: Bytes of sample text that a part of the model is made of.
PART = 4 << 20
#: Every so many sample texts are kept for the logistic curve.
CURVE = 4

BEGIN, ROOT = 1, 2
CLASSES = ("toxic", "ordinary")


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return T.mix(u * np.uint64(0x9E3779B97F4A7C15) + w)


class Block:
    """The distinct bigrams of each text of a block: word w, u before it (or BEGIN), doc, x before u; n: their number by text."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        words = T.Words(data, at, T.ALNUM)
        w, doc = words.hash, words.doc
        u, x = np.empty_like(w), np.empty_like(w)
        start = words.first[:-1][words.first[:-1] < len(w)]
        u[1:] = w[:-1]
        u[start] = BEGIN
        x[1:] = u[:-1]
        x[start] = BEGIN
        _, once = np.unique(pair_key(u, w) + T.mix(doc.astype(np.uint64) + np.uint64(7)), return_index=True)
        once.sort()
        self.w, self.u, self.x, self.doc = w[once], u[once], x[once], doc[once]
        self.first = np.searchsorted(self.doc, np.arange(len(at)))
        self.n = np.diff(self.first)
        self.begin, self.end, self.data = words.begin[once], words.end[once], T.LOWER[data]

    def stems(self, some: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the stems (hashes) of these words, 0 where the word is shorter."""
        begin, size = self.begin[some], self.end[some] - self.begin[some]
        total, out, power = np.zeros(len(some), np.uint64), {}, T.powers(16)
        for k in range(max(STEMS)):
            letter = self.data[np.minimum(begin + k, len(self.data) - 1)]
            total = total + T._BYTE[letter] * power[k]
            if k + 1 in STEMS:
                out[k + 1] = np.where(size > k, T.mix(total + np.uint64((k + 1) << 32)), np.uint64(0))
        return out


def _trigrams(parts: int, seats: np.ndarray):
    """Packs the distinct trigrams of a block (each text's first of a bigram), and which classes have them, for the part of their bigram."""

    def run(batches):
        for batch, data, at in T.blocks(batches, size=3 << 20):
            b = Block(data, at)
            if not len(b.w):
                continue
            toxic = _marks(batch)[b.doc]
            _, first, inverse = np.unique(T.mix(b.x) + pair_key(b.u, b.w), return_index=True, return_inverse=True)
            t, n = np.bincount(inverse, toxic), np.bincount(inverse)
            part = (pair_key(b.u[first], b.w[first]).view(np.int64) % parts).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows = np.zeros(len(order), [("x", "<u8"), ("u", "<u8"), ("w", "<u8"), ("f", "u1")])
            rows["x"], rows["u"], rows["w"] = (k[first][order] for k in (b.x, b.u, b.w))
            rows["f"] = (2 * (t > 0) + (t < n))[order]
            cuts = runs(part[order])
            yield pa.RecordBatch.from_arrays([pa.array(seats[[part[order[i]] for i, _ in cuts]]), pa.array([rows[i:j].tobytes() for i, j in cuts], pa.binary())], names=["seat", "rows"])

    return run


def _marks(batch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False).astype(np.int64)


def _nodes(batches):
    """Of a block, its distinct words with their stems, and each word's and stem's number of toxic and ordinary texts; a stem's row has w = 0."""
    for batch, data, at in T.blocks(batches, size=3 << 20):
        b = Block(data, at)
        toxic = _marks(batch)
        words, some, inverse = np.unique(b.w, return_index=True, return_inverse=True)
        stems = b.stems(some)
        chain = [words, *stems.values()]
        for level, nodes in enumerate(chain):
            distinct, first, which = np.unique(nodes, return_index=True, return_inverse=True)
            held = np.unique(which.reshape(-1)[inverse.reshape(-1)] * np.int64(batch.num_rows) + b.doc)
            node, bad = held // batch.num_rows, toxic[held % batch.num_rows]
            t = np.bincount(node, bad, len(distinct)).astype(np.int64)
            n = np.bincount(node, minlength=len(distinct))
            keep = np.flatnonzero(distinct)
            way = [k[first[keep]].view(np.int64) if not level else np.zeros(len(keep), np.int64) for k in chain]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (distinct[keep].view(np.int64), *way, t[keep], (n - t)[keep]))], names=["key", "w", *(f"s{k}" for k in STEMS), "t", "o"])


def kept(n: np.ndarray, discount: int, ratio: float = 1.0) -> np.ndarray:
    """What a class keeps of its counts (2, n) after its discount; the rest goes to what the classes share.

    ratio: toxic texts for each ordinary one. Counts are compared, and discounted, as if there were as many ordinary texts as toxic ones.
    """
    common = np.minimum(n[0], n[1] * ratio)
    less = discount + np.ceil(SHARED * common) + np.ceil(2 * np.sqrt(common))
    return np.maximum(np.stack([n[0] - less, np.floor(n[1] - less / ratio)]), 0).astype(np.int64)


def _kept_sql(discount: int, ratio: float) -> dict[str, str]:
    """The same in SQL, of counts t and o, and what is left of both."""
    common = f"least(cast(t as double), o * {ratio!r}D)"
    less = f"({discount} + ceil({SHARED} * {common}) + ceil(2 * sqrt({common})))"
    t, o = f"cast(greatest(t - {less}, 0) as long)", f"cast(greatest(floor(o - {less} / {ratio!r}D), 0) as long)"
    return {"kt": t, "ko": o, "left": f"(t + o - {t} - {o})"}

_WORDS, _CONTEXTS = range(2)
_COUNTS = "kind byte, key long, " + ", ".join(f"n{i} long" for i in range(4))


def _rows(kind: int, keys: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
    n = len(keys)
    counts = [*counts, *[np.zeros(n, np.int64)] * (4 - len(counts))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(keys.view(np.int64)), *(pa.array(np.asarray(c, np.int64)) for c in counts)], names=["kind", "key", *(f"n{i}" for i in range(4))])


def _merge(tables: Tables, ratio: float):
    """Adds up a part's bigrams and writes them; passes on what they say of words and of contexts."""

    def run(batches):
        kind = [("x", "<u8"), ("u", "<u8"), ("w", "<u8"), ("f", "u1")]
        held: dict[int, list] = {}
        for batch in batches:
            for seat, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(seat, []).append(np.frombuffer(raw.as_buffer(), kind))
        for seat in sorted(held):
            rows = np.concatenate(held.pop(seat))
            _, at, t, o = added(T.mix(rows["x"]) + pair_key(rows["u"], rows["w"]), rows["f"] >> 1, rows["f"] & 1)
            u, w = rows["u"][at], rows["w"][at]
            keys, at, t, o = added(pair_key(u, w), (t > 0).astype(np.int64), (o > 0).astype(np.int64))
            u, w = u[at], w[at]
            # where a class keeps nothing of a bigram it is as unseen
            used = kept(np.stack([t, o]), PAIR_DISCOUNT, ratio).any(0)
            if used.any():
                tables.put("pairs", int(keys[0].view(np.int64) % tables.shards), keys[used], [t[used], o[used]])
            k, _, wt, wo = added(w, (t > 0).astype(np.int64), (o > 0).astype(np.int64))
            yield _rows(_WORDS, k, [wt, wo])
            k, _, *sums = added(u, t, o, *kept(np.stack([t, o]), PAIR_DISCOUNT, ratio))
            yield _rows(_CONTEXTS, k, sums)

    return run


def _write(tables: Tables, table: str, columns: int):
    """Writes the rows (key, counts) of a task's shards."""

    def run(batches):
        held = [np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns + 1)]) for batch in batches]
        rows = np.concatenate([np.empty((columns + 1, 0), np.int64), *held], axis=1)
        shard = rows[0] % tables.shards
        rows = rows[:, np.lexsort((rows[0].view(np.uint64), shard))]
        done = runs(rows[0] % tables.shards)
        for i, j in done:
            tables.put(table, int(rows[0, i] % tables.shards), rows[0, i:j].view(np.uint64), list(rows[1:, i:j]))
        yield pa.RecordBatch.from_arrays([pa.array([len(done)])], names=["n"])

    return run


class Signed(Tables):
    """Tables whose shards Spark can tell too: pmod(key, shards)."""

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.int64) % self.shards


def _stored(rows: DataFrame, tables: Tables, table: str, columns: list[str]) -> None:
    dealt = rows.select("key", *columns).repartition(tables.shards, F.expr(f"pmod(key, {tables.shards})"))
    dealt.mapInArrow(_write(tables, table, len(columns)), "n long").agg(F.sum("n")).collect()


class Model:
    """Two models in tables of one folder, and the curve from evidence to a score.

    pairs: bigrams' counts (toxic, ordinary), of those of which something is kept. contexts: of a word as context, the sums of its bigrams' counts and
    of what is kept of them, where that is anything; other contexts' probabilities are those of their words, by the formula too. nodes: of a
    word or stem its counts; of the nodes below it the sums of their counts, of what is kept of them, and how many have 1, 2 and more that is not.
    """

    def __init__(self, tables: Tables | None, sizes: list[int] = [0] * 4, ratio: float = 1.0):
        """sizes: how many nodes have 1, 2, 3 and 4 discounted counts; ratio: toxic texts for each ordinary one."""
        self.tables, self.d, self.ratio = tables, discounts(*sizes), ratio
        #: The usual evidence of a bigram in ordinary texts (the classes keep unequal shares), and the curve's weights.
        self.usual, self.curve = 0.0, np.zeros(3)

    def shared(self, n: np.ndarray, total: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The probability of a step that the classes share: modified Kneser-Ney by what they discount."""
        below = 1 / (sizes.sum(0) + 1)
        rest = self.d[1] * sizes[0] + self.d[2] * sizes[1] + self.d[3] * sizes[2]
        return np.where(total > 0, (np.maximum(n - self.d[np.minimum(n, 3)], 0) + rest * below) / np.maximum(total, 1), below)

    @staticmethod
    def own(own_kept: np.ndarray, total: np.ndarray, sum_kept: np.ndarray, below) -> list[np.ndarray]:
        """Each class's probability: what it keeps of its counts, and the rest of its total as below says."""
        return [np.where(t > 0, (k + (t - s) * b) / np.maximum(t, 1), b) for k, t, s, b in zip(own_kept, total, sum_kept, below, strict=True)]

    def steps(self, chain: list[np.ndarray]) -> list[np.ndarray]:
        """The classes' probabilities of words, each given by its nodes from the root down (0: none at that level)."""
        q = [np.ones(len(chain[0])) for _ in CLASSES]
        keys, at = np.unique(np.concatenate([np.array([ROOT], np.uint64), *chain]), return_inverse=True)
        found, at = np.stack(self.tables.find("nodes", keys, 9)), at.reshape(-1)
        parent, known, place = np.full(len(chain[0]), at[0]), np.ones(len(chain[0]), bool), 1
        for c in chain:
            node, here = at[place : place + len(c)], known & (c > 0)
            place += len(c)
            n, above = found[:2, node], found[:, parent]
            mine = kept(n, DISCOUNT, self.ratio)
            both = self.shared((n - mine).sum(0), (above[2:4] - above[4:6]).sum(0), above[6:9])
            q = [np.where(here, x * p, x) for x, p in zip(q, self.own(mine, above[2:4], above[4:6], [both, both]), strict=True)]
            known &= (c == 0) | (n.sum(0) > 0)
            parent = np.where(here, node, parent)
        return q

    def probabilities(self, u: np.ndarray, w: np.ndarray, q: list[np.ndarray]) -> list[np.ndarray]:
        """The classes' probabilities of words after others; q: those of the words alone."""
        keys, at = np.unique(u, return_inverse=True)
        above = np.stack(self.tables.find("contexts", keys, 4))
        some = np.flatnonzero(above.any(0)[at])
        if not len(some):
            return q
        above, out = above[:, at[some]], [x.copy() for x in q]
        n = np.stack(self.tables.find("pairs", pair_key(u[some], w[some]), 2))
        for x, p in zip(out, self.own(kept(n, PAIR_DISCOUNT, self.ratio), above[:2], above[2:4], [x[some] for x in q]), strict=True):
            x[some] = p
        return out

    def evidence(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(difference of the log-likelihoods, number) of each text's distinct bigrams."""
        b = Block(data, at)
        if not len(b.w) or self.tables is None:
            return np.zeros(len(at) - 1), b.n
        words, some, inverse = np.unique(b.w, return_index=True, return_inverse=True)
        q = self.steps([*b.stems(some).values(), words])
        toxic, ordinary = self.probabilities(b.u, b.w, [x[inverse] for x in q])
        return T.by_text(np.log(toxic) - np.log(ordinary), b.first), b.n

    def score(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(total, n) @ self.curve, -40, 40)))

    def features(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 1)
        more = total - self.usual * n
        return np.stack([np.ones(len(n)), 20 * more / n, more / np.sqrt(n)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, lightly shrunk."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 1e-2 * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b)), grad)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def _count(texts: DataFrame, spark) -> Model:
    """The two models of texts(text, toxic)."""
    size, toxic, every = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    parts, ratio = max(1, -(-size // PART)), max(toxic, 1) / max(every - toxic, 1)
    tables = Signed(S.scratch(spark, "classes"), parts)
    merged = texts.mapInArrow(_trigrams(parts, S.seats(spark, parts)), "seat long, rows binary").repartition(parts, "seat").mapInArrow(_merge(tables, ratio), _COUNTS)
    found, path = S.written(merged, "toxic")
    added_up = lambda kind, n: found.where(f"kind = {kind}").groupBy("key").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(n)))
    _stored(added_up(_CONTEXTS, 4).where("n2 + n3 > 0"), tables, "contexts", [f"n{i}" for i in range(4)])
    levels = ["w", *(f"s{k}" for k in STEMS)]
    nodes = texts.mapInArrow(_nodes, ", ".join(["key long", *(f"{k} long" for k in levels), "t long", "o long"]))
    held, held_path = S.written(nodes.groupBy("key").agg(*(F.max(k).alias(k) for k in levels), F.sum("t").alias("dt"), F.sum("o").alias("do")), "toxic")
    # each step of a word's way: from the root through its stems to itself
    way = F.concat(F.array(F.lit(ROOT).cast("long")), F.filter(F.array(*levels[1:]), lambda x: x != 0), F.array("w"))
    steps = added_up(_WORDS, 2).join(held.where("w <> 0").drop("key"), F.col("key") == F.col("w")).withColumn("way", way)
    steps = steps.select(F.explode(F.arrays_zip(F.slice("way", 1, F.size("way") - 1).alias("up"), F.slice("way", 2, F.size("way") - 1).alias("key"))).alias("e"), "n0", "n1")
    steps = steps.groupBy("e.up", "e.key").agg(F.sum("n0").alias("t"), F.sum("n1").alias("o")).join(held.select("key", "dt", "do"), "key")
    edges, edge_path = S.written(steps.select("up", "key", F.least("t", "dt").alias("t"), F.least("o", "do").alias("o")), "steps")
    sql = _kept_sql(DISCOUNT, ratio)
    left = sql.pop("left")
    sums = {"t": "t", "o": "o", **sql} | {f"b{k}": f"cast({left} {test} as long)" for k, test in ((1, "= 1"), (2, "= 2"), (3, "> 2"))}
    down = edges.groupBy(F.col("up").alias("key")).agg(*(F.sum(F.expr(e)).alias(f"d{c}") for c, e in sums.items()))
    columns = ["t", "o", *(f"d{c}" for c in sums)]
    both = edges.select("key", "t", "o").unionByName(down, allowMissingColumns=True).groupBy("key").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))
    _stored(both, tables, "nodes", columns)
    sizes = edges.agg(*(F.coalesce(F.sum(F.expr(f"cast({left} = {k} as long)")), F.lit(0)) for k in (1, 2, 3, 4))).first()
    S.drop(spark, path, held_path, edge_path)
    return Model(tables, list(sizes), ratio)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the texts that labels mark 0 or 1, of ids for which learn (over `doc_id`) holds.

    A doc marked twice has the larger mark; of rows that repeat a doc_id the largest text counts, once; null ids and marks are left out, a null
    text is empty. Other columns are not read. Without any mark of a class the model knows nothing and every score is near 0, or near 1
    where all marks are 1.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = (marks.where(learn) if learn is not None else marks).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    number = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    ids = {c: [r.doc_id for r in marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS).collect()] for c in (0, 1)}
    sample = spark.createDataFrame([(i, c, k % CURVE == 0) for c in (0, 1) for k, i in enumerate(ids[c])], "doc_id long, toxic int, curve boolean")  # 2 * PER_CLASS rows at most
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts, texts_path = S.written(some.groupBy("doc_id", "toxic", "curve").agg(F.max("text").alias("text")).select("text", "toxic", "curve"), "sample")
    model = _count(texts.where("not curve").select("text", "toxic"), spark) if ids[0] and ids[1] else Model(None)
    seen = with_evidence(texts.where("curve"), model, ["toxic"]).toPandas()  # a quarter of the sample, numbers only
    S.drop(spark, texts_path)
    y = seen.toxic.to_numpy(float)
    if not len(y) or y.min() == y.max():
        model.curve = np.array([-20.0 if not number.get(1) or number.get(0) else 20.0, 0, 0])
        return model
    # the sample's classes count as much as among all marks
    weight = np.where(y > 0, number[1] / y.sum(), number[0] / (len(y) - y.sum()))
    total, n = seen.total.to_numpy(), seen.n_tokens.to_numpy()
    model.usual = float(np.median((total / np.maximum(n, 1))[y == 0]))
    model.curve = logistic(model.features(total, n), y, weight * len(y) / weight.sum())
    return model


def with_evidence(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns keep of docs (default: all) with total (log-likelihood ratio), n_tokens (distinct bigrams) and score, in one scan.

    A null text is empty and has no evidence; columns of docs named like a result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = S.Carried(docs, keep, text_col, "total double, n_tokens long, score double")

    def run(batches):
        S.lean()
        m = shared.value
        for batch, data, at in T.blocks(batches, rows.text):
            total, n = m.evidence(data, at)
            yield rows.batch(batch, [pa.array(total), pa.array(n.astype(np.int64)), pa.array(m.score(total, n))])

    return rows.scan(run)


def toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns keep of docs (default: all) with toxic_score (0 to 1) and toxic (1 from 0.5 on), in one scan.

    Null and empty texts have no evidence and get the curve's value there. Equal texts get equal scores; repeated rows give a row each; columns of
    docs named toxic_score or toxic are replaced, others may have any name. An empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = S.Carried(docs, keep, text_col, "toxic_score double, toxic int")

    def run(batches):
        S.lean()
        m = shared.value
        for batch, data, at in T.blocks(batches, rows.text):
            score = m.score(*m.evidence(data, at))
            yield rows.batch(batch, [pa.array(score), pa.array((score >= 0.5).astype(np.int32))])

    return rows.scan(run)
