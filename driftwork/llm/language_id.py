"""Language identification by hierarchical discrimination.

A text is its counts of hashed byte trigrams, in lower case, with every run of other than letters as one blank; the counts are scaled to
unit length. The first level is linear support vector machines for the language families (one against one, decided by votes
and margins); within the family, one-versus-one linear support vector machines separate its languages. Each machine is
trained by dual coordinate descent in a task of its own, over a sample of labelled rows: every language that they have, and at most
PER_LANGUAGE texts of each, those with the smallest hash of the id. The driver gets the machines' weights, and no text or features. Prediction is a scan.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwork.llm import _shared as S
from driftwork.llm import _text as T

#: Bound of the training sample: texts of a language.
PER_LANGUAGE = 500
FEATURES = 1 << 14

#: Language families by ISO 639-1 code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro", "sc"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt", "ti"),
}

# letters of ASCII in lower case and all bytes of UTF-8's longer forms stay; anything else is a blank
_FOLD = T.LOWER.copy()
_FOLD[~np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])] = 32
_LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes), lang)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight) of each position of a block: hashed trigrams that stay within a text and hold no double blank."""
    x = _FOLD[data]
    # the second byte of Latin-1 capitals in UTF-8 (C3 80..C3 9E) to that of the small letters
    upper = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)) + 1
    x[upper] += 32
    n = len(x)
    code = np.zeros(n, np.uint32)
    if n < 3:
        return code.astype(np.int32), np.zeros(n, np.float32)
    wide = x.astype(np.uint32)
    code[2:] = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - FEATURES.bit_length() + 1)
    blank = x == 32
    use = np.zeros(n, np.float32)
    use[2:] = ~((blank[2:] & blank[1:-1]) | (blank[1:-1] & blank[:-2]))
    for k in (0, 1):
        use[np.minimum(at[:-1][at[:-1] < n] + k, n - 1)] = 0
    return code.astype(np.int32), use


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """A linear machine (hinge loss, L2) by dual coordinate descent; the last weight is the bias. rows: (features, weights) of unit length."""
    w, a = np.zeros(FEATURES + 1), np.zeros(len(rows))
    # the classes weigh the same together
    most = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(a[i] - g / 2, 0.0), most[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                a[i] = new
    return w.astype(np.float32)


def _features(batches):
    """(id, lang, missing, features, weights) of whole texts: at most FEATURES numbers each, whatever a text's length. missing: there is no text."""
    for batch, data, at in T.blocks(batches):
        found, weights = [], []
        for lo, hi in zip(at, at[1:], strict=False):
            feature, use = trigrams(data[lo:hi], np.array([0, hi - lo]))
            count = np.bincount(feature, use, FEATURES)
            found.append(np.flatnonzero(count))
            v = np.sqrt(count[found[-1]])
            weights.append(v / max(np.linalg.norm(v), 1e-9))
        columns = [batch.column(0), batch.column(1), batch.column(2).is_null(), pa.array(found, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "missing", "found", "weights"])


def _machine(rows: pd.DataFrame) -> pd.DataFrame:
    """One machine, of the sample's rows on its two sides."""
    rows = rows.sort_values(["lang", "id"])
    w = svm([(np.asarray(f, np.int64), np.asarray(v)) for f, v in zip(rows.found, rows.weights, strict=True)], rows.side.to_numpy())
    return pd.DataFrame({"machine": [rows.machine.iloc[0]], "w": [w.tobytes()]})


class Model:
    """Machines as columns of one weight table: each separates class p (positive) from class q."""

    def __init__(self, langs: list[str], weights=()):
        """langs: the codes that were learned; weights: (machine, its weights as bytes) of each."""
        self.langs = sorted(set(langs))
        self.groups = sorted({family(x) for x in self.langs})
        self.of = [self.groups.index(family(x)) for x in self.langs]
        self.family_pairs = list(itertools.combinations(range(len(self.groups)), 2))
        self.lang_pairs = [(p, q) for p, q in itertools.combinations(range(len(self.langs)), 2) if self.of[p] == self.of[q]]
        self.weights = np.zeros((FEATURES + 1, len(self.family_pairs) + len(self.lang_pairs)), np.float32)
        for machine, w in weights:
            self.weights[:, machine] = np.frombuffer(w, np.float32)

    def sides(self) -> list[tuple[str, int, float]]:
        """(language, machine, side) for each machine in which a language takes part."""
        classes = [(self.of, *pair) for pair in self.family_pairs] + [(list(range(len(self.langs))), *pair) for pair in self.lang_pairs]
        return [(lang, k, 1.0 if of[i] == p else -1.0) for k, (of, p, q) in enumerate(classes) for i, lang in enumerate(self.langs) if of[i] in (p, q)]

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of each text of a block."""
        n = len(at) - 1
        feature, use = trigrams(data, at)
        slot = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(at)) + feature
        lang, score = np.zeros(n, int), np.zeros(n)
        step, first = 256, len(self.family_pairs)
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            part = slice(at[lo], at[hi])
            x = np.sqrt(np.bincount(slot[part] - lo * FEATURES, use[part], (hi - lo) * FEATURES).astype(np.float32).reshape(hi - lo, FEATURES))
            norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            margin = ((x @ self.weights[:-1]) / norm + self.weights[-1]).astype(np.float64)
            group, p1 = self._vote(margin[:, :first], self.family_pairs, len(self.groups), None)
            lang[lo:hi], p2 = self._vote(margin[:, first:], self.lang_pairs, len(self.langs), np.array(self.of)[None] == group[:, None])
            score[lo:hi] = p1 * p2
        return lang, score

    @staticmethod
    def _vote(margin, pairs, classes, allowed):
        """The class with most pairwise wins (the margins settle ties), and the mean logistic of its margins."""
        wins, sums, count = (np.zeros((len(margin), classes)) for _ in range(3))
        for k, (p, q) in enumerate(pairs):
            m = margin[:, k]
            sure = 1 / (1 + np.exp(-np.clip(3 * m, -50, 50)))
            wins[:, p] += m > 0
            wins[:, q] += m <= 0
            sums[:, p] += sure
            sums[:, q] += 1 - sure
            count[:, [p, q]] += 1
        rank = wins + sums / np.maximum(count, 1) * 0.5
        if allowed is not None:
            rank = np.where(allowed, rank, -1)
        best = rank.argmax(1)
        row = np.arange(len(margin))
        return best, np.where(count[row, best] > 0, sums[row, best] / np.maximum(count[row, best], 1), 1.0)


def _sampled(rows: DataFrame) -> set[str]:
    """Ids of at most PER_LANGUAGE rows(id, lang) of each language, those with the smallest hashes."""
    # those whose hash lies under a limit that leaves about twice what is wanted of each language, so no language is ranked whole
    place = F.xxhash64("id") / F.lit(2.0**64) + F.lit(0.5)
    left = {r.lang: r["count"] for r in rows.where("id is not null").groupBy("lang").count().collect()}
    times, ids = 2, set()
    while left:
        limits = rows.sparkSession.createDataFrame([(lang, times * PER_LANGUAGE / n) for lang, n in left.items()], "lang string, most double")  # a row for each language
        some = rows.select("id", "lang").join(F.broadcast(limits), "lang").where(place < F.col("most")).select("id", "lang").distinct()
        top = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
        found = some.withColumn("rank", F.row_number().over(top)).where(f"rank <= {PER_LANGUAGE}").groupBy("lang").agg(F.collect_list("id").alias("ids")).collect()
        ids |= {i for r in found for i in r.ids}
        whole = {r.lang for r in found if len(r.ids) == PER_LANGUAGE} | {lang for lang, n in left.items() if times * PER_LANGUAGE >= n}
        left, times = {lang: n for lang, n in left.items() if lang not in whole}, times * 8
    return ids


def _texts(rows: DataFrame, ids: set[str]) -> tuple[DataFrame, str]:
    """The features of these ids, in the shared folder. Of rows that share an id the largest with a text counts."""
    wanted = rows.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "id string")  # PER_LANGUAGE ids of a language at most
    some = rows.join(F.broadcast(wanted), "id", "left_semi").groupBy("id").agg(F.max(F.when(F.col("text").isNotNull(), F.struct("lang", "text"))).alias("r"), F.max("lang").alias("lang"))
    some = some.select("id", F.coalesce("r.lang", "lang").alias("lang"), "r.text")
    return S.written(some.mapInArrow(_features, "id string, lang string, missing boolean, found array<int>, weights array<double>"), "languages")


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Machines from the sample of rows where learn holds and id, text and language are not null.

    Of rows that share an id the one with the largest language and text counts, once; other columns are not read; no rows, no language. Ids are sampled
    without reading a text; only where some of a language's sample turn out to have none are its rows with texts sampled again.
    """
    rows = docs.where(learn) if learn is not None else docs
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sample, path = _texts(rows, _sampled(rows))
    told = sample.groupBy("lang").agg(F.max("missing").alias("missing"), F.collect_list("id").alias("ids"))
    lost = {r.lang for r in told.select("lang", "missing").collect() if r.missing}
    if lost:
        ids = {i for r in told.where("not missing").collect() for i in r.ids}
        again = _sampled(rows.where(F.col("lang").isin(sorted(lost)) & F.col("text").isNotNull()))
        S.drop(docs.sparkSession, path)
        sample, path = _texts(rows.where("text is not null"), ids | again)
    empty = Model([r.lang for r in sample.select("lang").distinct().collect()])  # a row for each language
    sides = empty.sides()
    if not sides:
        S.drop(docs.sparkSession, path)
        return empty
    dealt = docs.sparkSession.createDataFrame(sides, "lang string, machine int, side double")  # a row for each language and machine
    # a machine's task holds the features of its two sides, bounded as the sample is
    trained = sample.join(F.broadcast(dealt), "lang").groupBy("machine").applyInPandas(_machine, "machine int, w binary").collect()
    S.drop(docs.sparkSession, path)
    return Model(empty.langs, [(r.machine, r.w) for r in trained])


def with_language(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all) with lang_pred and score, in one scan.

    lang_pred is one of the learned languages; `und` with score 0 where the text is null or has no letter, or where nothing was
    learned. score is the product of the levels' mean logistic margins (0 to 1). Ties of votes and margins go to the first code. Equal texts get
    equal results; repeated rows give a row each; columns of docs named lang_pred or score are replaced; an empty table gives no row. A text is
    read whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = S.Carried(docs, keep, text_col, "lang_pred string, score double")

    def run(batches):
        S.lean()
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch, data, at in T.blocks(batches, rows.text):
            x = data | 32
            plain = (x >= 97) & (x <= 122)
            letter = T.by_text(plain.astype(np.int64), at) > 0
            for i in np.flatnonzero(~letter & (np.diff(at) > 0)):  # others than ASCII's letters
                letter[i] = bool(_LETTER.search(data[at[i] : at[i + 1]].tobytes().decode()))
            lang, score = m.predict(data, at) if m.langs else (np.zeros(batch.num_rows, int), np.zeros(batch.num_rows))
            known = letter & bool(m.langs)
            yield rows.batch(batch, [pa.array(names[np.where(known, lang, len(m.langs))], pa.string()), pa.array(np.where(known, score, 0.0))])

    return rows.scan(run)
