"""A trie of conversations: every distinct sequence of first turns is a node, with what lies below it; by pointer jumping.

Turns are numbered within their conversation and named by two 64-bit hashes of number, role and text; the running exclusive-or
of these names each prefix, so a node's key is a digest and its parent's key is the digest without the last turn. Both runs go over
rows that are dealt by ranges, so a conversation of any length is shared by tasks, and texts stay behind after the first.

Subtree totals take doubling rounds. After k of them a node holds the totals of its descendants nearer than 2^k and points at its
ancestor at distance 2^k; a round adds up what points at a node and lets each pointer jump to its target's pointer. A trie of
depth d needs log2(d) rounds. Sums are partial before they are exchanged; the root, where very many pointers end, is never joined.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwork.llm import _shared as S

#: Bytes of a node's ids that one row holds while they are hashed.
CHUNK = 1 << 18


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n, t, u, words): turns numbered from 1 by turn (null first; ties by role, then text), two hashes of role and text, and the text's words.

    A null role or text is empty; rows with a null conv_id are left out; repeated rows are turns of their own; other columns are not read.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.lit(1).cast("long").alias("one"),
    )
    # the order needs whole texts, what follows only their hashes
    begun = [F.substring("role", 1, 16), F.substring("text", 1, 32)]
    rows = rows.withColumns({"t": F.xxhash64("role", "text"), "u": F.xxhash64("text", F.lit(1), "role"), "words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})
    found, _ = S.running(rows, "conv_id", ["turn", *begun], ["turn", "role", "text"], {"n": "one"}, keep=["conv_id", "t", "u", "words", "one"])
    return found.drop("one")


def rebased(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (of numbered turns) whose first turns are those of another: conversation c begins with the first h turns of c - c % every
    (all if it has fewer, none if it is absent), h = crc32(decimal c) % most, and goes on with its own turns after its first h.

    Returns (conv_id, n, t, u, words) and (conv_id, total), the number of turns, which may be 0.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.where((F.col("n") < most) & (F.col("conv_id") == base)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("n", "t", "u", "words"))).alias("heads"))  # below `most` rows each
    own = turns.groupBy("conv_id").agg(F.max("n").alias("own")).withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string")) % most})
    own = own.join(heads, "base", "left").withColumn("heads", F.coalesce(F.slice("heads", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["heads"].dataType)))
    own = own.withColumn("k", F.size("heads").cast("long")).withColumn("total", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    own, _ = S.written(own.select("conv_id", "h", "k", "total", "heads"), "convs")
    begin = own.select("conv_id", F.explode("heads").alias("x")).select("conv_id", "x.*")
    rest = turns.join(own.select("conv_id", "h", "k"), "conv_id").where("n > h").select("conv_id", (F.col("n") - F.col("h") + F.col("k")).alias("n"), "t", "u", "words")
    return begin.unionByName(rest), own.select("conv_id", "total")


def _packed(batches):
    """Rows (a, b, conv_id), sorted, to rows (a, b, first, ids): the decimal ids of a node, comma-joined, CHUNK bytes at most in one row."""
    now, held, size = None, [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*now, held[0])] + [pa.array([",".join(map(str, held))])], names=["a", "b", "first", "ids"])

    for batch in batches:
        for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and ((a, b) != now or size > CHUNK):
                yield row()
                held, size = [], 0
            now = (a, b)
            held.append(c)
            size += len(str(c)) + 1
    if held:
        yield row()


def _hashed(batches):
    """Sorted rows (a, b, first, ids) to one digest for each (a, b); a chunk at a time, since SHA-256 runs in order."""
    now, state, out = None, None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["a", "b", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (a, b) == now:
                state.update(b"," + ids.encode())
                continue
            if state:
                out.append((*now, state.hexdigest()))
            now, state = (a, b), hashlib.sha256(ids.encode())
        yield flush()
        out = []
    if state:
        out.append((*now, state.hexdigest()))
    yield flush()


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """Nodes of numbered turns (conv_id, n, t, u, words): conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (of its subtree, what n_convs - 1 members need not repeat of each node's
    last turn), ends_sha256 (of the decimal ids of members that end there).

    convs (conv_id, total) also names conversations without turns, which are members of the root. Equal conversations share all nodes. Without
    conversations there is no node, not even a root.
    """
    spark = turns.sparkSession
    if convs is None:
        convs = turns.groupBy("conv_id").agg(F.max("n").alias("total"))
    convs, convs_path = S.written(convs, "convs")
    rows = turns.join(convs, "conv_id").withColumns({"a": F.xxhash64("n", "t", "u"), "b": F.xxhash64("u", "n", "t", F.lit(7))})
    rows, rows_path = S.running(rows.select("conv_id", "n", "words", "total", "a", "b"), "conv_id", ["n"], ["n"], xors={"pa": "a", "pb": "b"})
    # pa, pb name the prefix with this turn; without it, they name the parent
    rows = rows.select("conv_id", "n", "words", "total", F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("pa").bitwiseXOR(F.col("a")).alias("pa"), F.col("pb").bitwiseXOR(F.col("b")).alias("pb"))
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy("a", "b", F.col("n").alias("depth")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("words").alias("words"))
    nodes = nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")).drop("words")
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), "conv_id", "n_convs", none.alias("pa"), none.alias("pb"), zero.alias("saved_tokens"))
    nodes, nodes_path = S.written(nodes.unionByName(root), "nodes")
    deepest, top = nodes.agg(F.coalesce(F.max("depth"), zero), F.min("conv_id")).first()  # the root has the smallest of all

    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    # a node's parent gives its conv_id, and its own parent as the next pointer; the root's children know theirs
    above = nodes.where("depth > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.when(F.col("depth") > 0, F.col("pa")).alias("ja"), F.when(F.col("depth") > 0, F.col("pb")).alias("jb"))
    linked = nodes.where("depth > 1").join(above, ["pa", "pb"])
    near = nodes.where("depth <= 1").select("*", F.when(F.col("depth") == 1, F.lit(top)).cast("long").alias("parent_conv_id"), none.alias("ja"), none.alias("jb"))
    state = linked.select(*near.columns).unionByName(near).join(children, ["a", "b"], "left")
    state = state.withColumns({"n_children": F.coalesce("n_children", zero), "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")})
    state, path = S.written(state.withColumnsRenamed({"pa": "ua", "pb": "ub"}), "trie")
    reach = 1
    while reach <= deepest:
        gain = state.where("ua is not null").groupBy(F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        grown = state.join(gain, ["a", "b"], "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", zero), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", zero)}).drop("more_leaves", "more_saved", "ua", "ub")
        grown = grown.withColumnsRenamed({"ja": "ua", "jb": "ub"})
        reach *= 2
        if reach <= deepest:
            # pointers of twice the reach: of nodes whose target is not above the root
            targets = grown.where(f"depth >= {reach}").select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("ua").alias("ja"), F.col("ub").alias("jb"))
            far = grown.where(f"depth >= {2 * reach}").join(targets, ["ua", "ub"])
            grown = far.unionByName(grown.where(f"depth < {2 * reach}").withColumns({"ja": none, "jb": none}))
        else:
            grown = grown.withColumns({"ja": none, "jb": none})
        before, (state, path) = path, S.written(grown, "trie")
        S.drop(spark, before)

    ends = rows.where("n = total").select("a", "b", "conv_id").unionByName(convs.where("total = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    ends = ends.repartitionByRange(S.partitions(spark), "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_packed, "a long, b long, first long, ids string")
    ends = ends.repartition(S.partitions(spark), "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_hashed, "a long, b long, ends_sha256 string")
    out = state.join(ends, ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: op13 with whole prefixes as strings, over the view conversations; crc32 by its table.
ORACLE = """
WITH crc AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, own,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id), crc
),
d AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = c.base AND t.n <= c.h) AS k FROM c),
r AS (
  SELECT d.conv_id, t.n, role, text FROM d JOIN t ON t.conv_id = d.base AND t.n <= d.h
  UNION ALL SELECT d.conv_id, t.n - d.h + d.k, role, text FROM d JOIN t ON t.conv_id = d.conv_id AND t.n > d.h
),
p AS (
  SELECT conv_id, n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY n) AS prefix,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY conv_id) AS total
  FROM r
),
m AS (
  SELECT conv_id, n AS depth, prefix, coalesce(lag(prefix) OVER (PARTITION BY conv_id ORDER BY n), '') AS up, words, n = total AS ends FROM p
  UNION ALL SELECT conv_id, 0, '', NULL, 0, k + greatest(own - h, 0) = 0 FROM d
),
nodes AS (
  SELECT prefix, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY prefix, depth
),
kids AS (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.up = n.prefix AND k.depth > 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.prefix = n.up AND n.depth > 0)
SELECT a.conv_id, a.depth::BIGINT AS depth, a.parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
       count(*) FILTER (b.n_children = 0)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, a.ends_sha256
FROM kids a JOIN kids b ON starts_with(b.prefix, a.prefix) AND b.depth >= a.depth
GROUP BY ALL
"""
