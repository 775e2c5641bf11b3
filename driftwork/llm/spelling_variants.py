"""Groups of spelling variants without pairs of words: wildcard groups for replacements, deletions that are words for insertions and deletions.

Words that differ by one replaced code point share exactly one (position, prefix, suffix). Such a group keeps its size and its two most frequent
words, which is all that a member needs: its neighbours there are the others, and the best of them is the first, or the second for the first
itself. A word that misses one code point of another is among that one's deletions, so distinct deletions join the vocabulary and
each side counts the other. What a word gathers is a count and a best candidate, summed up by word. Only words of one group are held together,
and a group has at most one word for each letter of the alphabet.

Roots come from pointer jumping over the forms; a form has at least `times` the occurrences, so chains are short and have no cycle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwork.llm import _shared as S

#: Distinct words that a task counts before it sends them on.
HELD = 400_000
#: Runs of letters: a-z (of lower-cased Latin-1 bytes) and U+00C0 to U+00FF.
_RUN = re.compile(rb"[a-z\xC0-\xFF]+")


def _counted(least: int, every: int):
    """Words of at least so many code points with their occurrences in a task; every: in runs whose hash this divides, one letter is deleted (0: in none)."""

    def run(batches):
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                # code points beyond Latin-1 become a sign that is no letter; lower() of bytes is that of ASCII
                runs = Counter(_RUN.findall(text.as_py().encode("latin-1", "replace").lower()))
                begun = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                for w, n in runs.items():
                    if every:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
                        if h % every == 0:
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                    if len(w) >= least:
                        total[w] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    return run


def vocabulary(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters of whole texts, A-Z in lower case: at least least_length code points and least_n occurrences.

    In a run whose h = crc32("<doc_id>:<run>") every divides, code point h % length is deleted first. A null text has no run; a null id is
    written as nothing; repeated rows count again; other columns are not read; an empty table gives no word.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted(least_length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """For distinct words (word, n) of any letters: form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. form: the near word of the largest n (ties: the smallest in
    code-point order) if that is at least times the word's n, else null; root: where following forms ends. An empty word has no near word
    but those of one code point; no words give no row.
    """
    spark = words.sparkSession
    words, _ = S.written(words.select("word", "n"), "words")
    each = words.select("word", "n", F.explode(F.expr("sequence(1, length(word))")).alias("at")).where("length(word) > 0")
    parts = each.select("word", "n", "at", F.expr("substring(word, 1, at - 1)").alias("prefix"), F.expr("substring(word, at + 1)").alias("suffix"))
    named = F.struct((-F.col("n")).alias("m"), "word")  # the smallest is the most frequent, then the first
    groups = parts.groupBy("at", "prefix", "suffix").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(named)).alias("members")).where("size > 1")  # a word for each letter at most
    top = groups.select(F.explode("members").alias("x"), (F.col("size") - 1).alias("near"), F.slice("members", 1, 2).alias("top"))
    replaced = top.select("x.word", "near", F.when(F.col("x") == F.get("top", F.lit(0)), F.get("top", F.lit(1))).otherwise(F.get("top", F.lit(0))).alias("best"))
    shorter = parts.select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.concat("prefix", "suffix").alias("word")).distinct().join(words, "word")
    both = F.array(*(F.struct(F.col(w).alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col(n)).alias("m"), F.col(v).alias("word")).alias("best")) for w, v, n in (("word", "long", "long_n"), ("long", "word", "n"))))
    moved = shorter.select(F.explode(both).alias("y")).select("y.*")
    near = replaced.unionByName(moved).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    near = words.join(near, "word", "left").withColumn("forms", -F.col("best.m") >= times * F.col("n"))
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("forms"), F.col("best.word")).alias("form"), F.when(F.col("forms"), -F.col("best.m")).alias("form_n"))
    near, _ = S.written(near, "near")
    up, path = S.written(near.where("form is not null").select("word", F.col("form").alias("root")), "root")
    while True:
        jump = up.join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        before, (found, path) = path, S.written(jump.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "root")
        S.drop(spark, before)
        up = found.select("word", "root")
        if not found.where("moved").limit(1).count():
            break
    return near.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199, times: int = 5) -> DataFrame:
    """The variants of the vocabulary of docs, by their functions' rules."""
    return variants(vocabulary(docs, least_length, least_n, every), times)


#: The same by deletions and wildcards in SQL, over the view documents; crc32 by its table. UTF-8 of a letter is its code or two bytes.
ORACLE = """
WITH crc AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
),
runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  GROUP BY doc_id, run
),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                   lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))),
                   lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM runs, crc
),
v AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
),
d AS (SELECT DISTINCT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM d x JOIN d y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, v.word, v.n FROM d x JOIN v ON v.word = x.a || x.b
  UNION SELECT v.word, x.word, x.n FROM d x JOIN v ON v.word = x.a || x.b
),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (WITH RECURSIVE r(word, top) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.top WHERE f.form IS NOT NULL) SELECT r.word, r.top FROM r JOIN f ON f.word = r.top WHERE f.form IS NULL)
SELECT f.word, form, top AS root, n, n_near, form_n FROM f JOIN up USING (word)
"""
