"""The opN queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwork.llm import _shared as S
from driftwork.llm import chat_format as _chat
from driftwork.llm import license_scan as _license
from driftwork.llm import prefix_trie as _trie
from driftwork.llm import spelling_variants as _spelling


def op7_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwork.llm.vector_join import vector_links

    return vector_links(S.table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwork.llm.chat_format import chat_format

    return chat_format(S.table(spark, sf_dir, "conversations"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from driftwork.llm.token_shards import read_shards, write_shards

    shards, _ = S.written(write_shards(S.table(spark, sf_dir, "documents"), S.scratch(spark, "shards"), public_tokenizers.path("byte_bpe_50k.json"), end=0), "index")
    return read_shards(spark, shards)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwork.llm.jaccard_join import jaccard_join

    return jaccard_join(S.table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwork.llm.lm_scoring import scored, train

    docs = S.table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = train(docs, ~held)
    return scored(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from driftwork.llm.bpe_codec import digests

    return digests(S.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwork.llm.license_scan import license_scan

    found = license_scan(S.table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwork.llm.toxicity import fit, toxicity

    docs, labels = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = toxicity(docs, fit(docs, labels, ~held), keep=["doc_id"])
    return rows.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwork.llm.decontaminate import contamination

    found = contamination(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwork.llm.language_id import fit, with_language

    docs = S.table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = with_language(docs, fit(docs, ~held), keep=["doc_id"])
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelling.spelling_variants(S.table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from driftwork.llm.packing import packed

    return packed(S.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=1024, end=0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trie.prefix_trie(*_trie.rebased(_trie.numbered(S.table(spark, sf_dir, "conversations")), every=20, most=4))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_bpe_codec, op3_license_scan, op4_toxicity, op5_decontaminate, op6_language_id, op7_vector_join, op8_jaccard_join, op9_chat_format, op10_token_shards, op11_spelling_variants, op12_packing, op13_prefix_trie)}

ORACLES: dict[str, str] = {"op3_license_scan": _license.ORACLE, "op9_chat_format": _chat.ORACLE, "op11_spelling_variants": _spelling.ORACLE, "op13_prefix_trie": _trie.ORACLE}
