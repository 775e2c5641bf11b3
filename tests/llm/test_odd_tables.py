"""Every operator on tables whose other columns have the names that it uses inside, and on texts longer than a block."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwork.llm import chat_format, decontaminate, jaccard_join, language_id, license_scan, lm_scoring, packing, prefix_trie, spelling_variants, token_shards, toxicity, vector_join
from driftwork.llm import _text as T

#: Names of columns and results within the operators, in no order.
NAMES = "score n_tokens n_known base_score cluster blocks block chunks of m sig shard kind a b x y key length start tail at ids width tail_crc windows component_id n_shingles licenses n_units lines units items n_hit n_words spans lang_pred rank id best word n root form near offset sequence_id file base v low total part number doc".split()
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
#: Longer than the blocks of every scan but one, which has one text in a block of its own.
LONG = " ".join(f"w{i % 5000}x{i % 7}" for i in range(330_000)) + " " + PASSAGE


def plain(spark):
    texts = [None, "", "the quick brown fox jumps over the lazy dog " * 3, "the quick brown fox jumps over the lazy dog " * 3, "der schnelle braune Fuchs springt über den faulen Hund " * 4, f"as we said {PASSAGE} and on", "Released under the MIT License.\nvariant variants variant variant variant variants variatns variant"]
    return spark.createDataFrame([(i, t, "de" if i == 4 else "en") for i, t in enumerate(texts * 2)], "doc_id long, text string, lang string")


def runs(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    path, benchmark = public.path("byte_bpe_50k.json"), spark.createDataFrame([(1, PASSAGE, 3, "k")], "item_id long, text string, doc_id long, window string")
    marks = spark.createDataFrame([(i, i % 2, 1) for i in range(14)], "doc_id long, toxic int, text int")
    read = lambda d, name: token_shards.read_shards(spark, token_shards.write_shards(d, f"file://{tmp_path}/{name}-{len(d.columns)}", path).collect())
    lm = lambda d: lm_scoring.scored(d, lm_scoring.train(d)).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6))
    return {
        "op1": lm,
        "op3": license_scan.license_scan,
        "op4": lambda d: toxicity.toxicity(d, toxicity.fit(d, marks), keep=["doc_id"]),
        "op5": lambda d: decontaminate.contamination(d, benchmark).select("doc_id", "n_words", "n_hit", "items"),
        "op6": lambda d: language_id.with_language(d, language_id.fit(d), keep=["doc_id"]).select("doc_id", "lang_pred", F.round("score", 4)),
        "op8": lambda d: jaccard_join.jaccard_join(d, 4, 85),
        "op10": lambda d: read(d, "s"),
        "op11": lambda d: spelling_variants.spelling_variants(d, least_n=2),
        "op12": lambda d: packing.packed(d, path, window=16),
    }


def by_value(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("op", ["op1", "op3", "op4", "op5", "op6", "op8", "op10", "op11"])
def test_clashing_names(spark, tmp_path, op):
    """No result changes."""
    d, run = plain(spark), runs(spark, tmp_path)[op]
    wide = d.select(*(F.lit(f"<{n}>").alias(n) for n in NAMES), "*").select(*sorted([*NAMES, "doc_id", "text", "lang"], reverse=True))
    assert by_value(run(wide)) == by_value(run(d))


def test_clashing_names_of_other_tables(spark, tmp_path):
    d = plain(spark)
    wide = d.select(*(F.lit(7).alias(n) for n in NAMES), "*")
    pieces = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows.collect())
    run = runs(spark, tmp_path)["op12"]
    assert Counter(p[0] for p in pieces(run(wide)) for _ in range(p[2])) == Counter(p[0] for p in pieces(run(d)) for _ in range(p[2]))
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert by_value(vector_join.vector_links(vectors.select("*", *(F.lit(7).alias(n) for n in NAMES)))) == by_value(vector_join.vector_links(vectors))
    turns = spark.createDataFrame([(c, t, "user", f"turn {t}") for c in range(45) for t in range(c % 4 + 1)], "conv_id long, turn long, role string, text string")
    wide = turns.select("*", *(F.lit(7).alias(n) for n in NAMES), F.lit(3).alias("h"), F.lit(3).alias("words"))
    trie = lambda rows: prefix_trie.prefix_trie(*prefix_trie.rebased(prefix_trie.numbered(rows)))
    assert by_value(trie(wide)) == by_value(trie(turns)) and by_value(chat_format.chat_format(wide)) == by_value(chat_format.chat_format(turns))


def test_texts_longer_than_a_block(spark, tmp_path, lower):
    """A text of several MB, a copy of it with one word more, and short ones around them."""
    assert len(LONG) > T.BLOCK
    texts = ["short text one", LONG, "ein kurzer Text für das Modell", f"{LONG} more", "short text one"]
    d = spark.createDataFrame([(i, t, "de" if i == 2 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    ops = runs(spark, tmp_path)
    found = {n: {r[0]: tuple(r) for r in ops[n](d).collect()} for n in ("op1", "op4", "op5", "op6", "op8", "op10")}
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    count = Counter(w for s in words for w in [*s, None])
    total, distinct = sum(count.values()), len(count)
    for i, s in enumerate(words):
        assert found["op1"][i][1:3] == (len(s) + 1, len(s) + 1)
        assert abs(found["op1"][i][3] - sum(np.log10((count[w] + 1) / (total + distinct + 1)) for w in [*s, None])) < 1e-3
        assert found["op8"][i][1:] == (len({tuple(s[k : k + 4]) for k in range(max(1, len(s) - 3))}), {0: 0, 1: 1, 2: 2, 3: 1, 4: 0}[i])
        assert found["op5"][i][1:3] == (len(s), 12 if i in (1, 3) else 0) and found["op6"][i][1] == ("de" if i == 2 else "en") and 0 <= found["op4"][i][1] <= 1
    from tokenizers import Tokenizer

    import public_tokenizers

    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert found["op10"][i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline_stage_without_a_benchmark(spark, tmp_path):
    """An empty benchmark cuts nothing."""
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = plain(spark)
    assert by_value(corpus_pipeline.without_benchmark(spark, d, str(tmp_path))) == by_value(d)


def test_ties_of_votes():
    """Where each of three languages beats one other by as much, the first has it, or the first that the family allows."""
    m = language_id.Model([], [])
    best, score = m._vote(np.array([[1.0, -1.0, 1.0]] * 2), [(0, 1), (0, 2), (1, 2)], 3, np.array([[True] * 3, [False, True, True]]))
    assert best.tolist() == [0, 1] and np.allclose(score, 0.5)
