"""Chat formatting: logged snapshots of growing conversations collapse to the maximal ones, which are rendered; SQL functions only.

A conversation's turns are numbered by turn (ties by role, then text). Each turn has two 64-bit hashes of its number, role and text; their
running exclusive-or names every prefix of turns. A conversation goes if its whole is a proper prefix of another, by an anti-join
with the distinct prefixes, or if it equals one with a smaller conv_id. Prefixes are made distinct before they are exchanged, so
a first turn that very many conversations share is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwork.llm import _shared as S


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each maximal conversation: conv_id, n_turns, n_copies (equal conversations, itself included), rendered.

    rendered joins <|role|>, line end, text, <|end|>, line end of each turn. A null role is `unknown`, a null text is empty, and both
    count as such when conversations are compared; a null turn comes first; rows with a null conv_id are left out; repeated rows are turns of
    their own; other columns are not read; an empty table gives no row.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order))
    rows = rows.withColumns({"a": F.xxhash64("n", "role", "text"), "b": F.xxhash64("text", F.lit(1), "role", "n")})
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"a": F.expr("bit_xor(a)").over(upto), "b": F.expr("bit_xor(b)").over(upto)})
    shown = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    rows = rows.withColumn("after", F.lead("n").over(order).isNotNull()).select("conv_id", "n", "a", "b", "after", shown.alias("shown"))
    rows, _ = S.written(rows, "turns")  # numbered once, read three times
    whole = rows.where("not after").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = rows.where("after").select("n", "a", "b").distinct()
    kept = whole.join(prefixes, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")
    turn = rows.select("conv_id", "n", "shown").join(kept.select("conv_id"), "conv_id", "left_semi")
    text = turn.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "shown"))), lambda x: x.shown), "").alias("rendered"))
    return kept.join(text, "conv_id")


#: The same with whole prefixes as strings, over the view conversations.
ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
p AS (
  SELECT conv_id, n, count(*) OVER (PARTITION BY conv_id) AS total,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY n) AS prefix,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY n) AS rendered
  FROM t
),
w AS (SELECT prefix, total AS n_turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(rendered) AS rendered FROM p WHERE n = total GROUP BY prefix, total)
SELECT conv_id, n_turns::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, rendered
FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.total AND p.prefix = w.prefix)
"""
