"""Every query of the llm operators, as it is registered, against brute force, the library, SQL, or floors on held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from driftwork.llm import language_id, lm_scoring, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, sf=SF):
    return {r[0]: r for r in queries.QUERIES[name](spark, sf).collect()}


def test_op1(spark, documents, crc, lower):
    got = rows(spark, "op1_lm_scoring")
    seqs = {i: [*re.findall(WORD, lower(r.text)), None] for i, r in documents.items()}
    count = Counter(w for i, s in seqs.items() if crc(i) % 7 != 2 for w in s)
    n, v = sum(count.values()), len(count)
    assert got.keys() == documents.keys()
    for i, s in seqs.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 7 == 2, len(s), sum(w in count for w in s), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s), rel_tol=1e-9) and r.score < 0
    seen = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_op2(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = rows(spark, "op2_bpe_codec")
    assert got.keys() == documents.keys()
    for i, r in documents.items():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        shown = t.decode(ids, skip_special_tokens=False)
        assert tuple(got[i])[1:4] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, wanted = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    key = lambda rows: sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    a, b = key(found.select(names).collect()), key(wanted.select(", ".join(names)).fetchall())
    assert a == b and len(a)


def test_op4(spark, crc):
    sf = "/root/testdata/sf0.1"
    got, marks = rows(spark, "op4_toxicity", sf), {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 10_000
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in marks.items() if crc(i) % 5 == 0]
    assert sum(p and y for p, y in held) >= 89 / 97 * sum(y for _, y in held) > 80
    assert sum(p and not y for p, y in held) == 0


def test_op5(spark, documents, lower):
    got = rows(spark, "op5_decontaminate")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(ALNUM, lower(r.text))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    for i, r in documents.items():
        w, hit, items = re.findall(ALNUM, lower(r.text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[x]
        assert tuple(got[i]) == (i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    assert any(r.contaminated for r in got.values())


def test_op6(spark, crc):
    sf = "/root/testdata/sf0.01"
    got = rows(spark, "op6_language_id", sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and all(r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[d.doc_id].lang_pred, d.lang) for d in docs if crc(d.doc_id) % 4 == 2 and d.lang and re.search(r"[^\W\d_]", d.text or "")]
    assert sum(a == b for a, b in held) >= 0.99 * len(held) > 100


def test_op6_by_the_weights(spark, crc):
    """Votes, ties and scores of the query, from the machines' weights and each text's trigrams one by one."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = language_id.fit(docs, ~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    got = rows(spark, "op6_language_id", sf)

    def vote(margins, pairs, classes, allowed):
        wins, sums, count = ([0.0] * classes for _ in range(3))
        for x, (p, q) in zip(margins, pairs):
            sure = 1 / (1 + math.exp(-max(-50, min(50, 3 * x))))
            for c, won, s in ((p, x > 0, sure), (q, x <= 0, 1 - sure)):
                wins[c] += won
                sums[c] += s
                count[c] += 1
        rank = [wins[c] + 0.5 * sums[c] / max(count[c], 1) if c in allowed else -1 for c in range(classes)]
        best = rank.index(max(rank))
        return best, sums[best] / count[best] if count[best] else 1.0

    for r in docs.collect():
        text = r.text or ""
        if not any(c.isalpha() for c in text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        x = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
        x = [b + 32 if k and x[k - 1] == 0xC3 and 0x80 <= b <= 0x9E else b for k, b in enumerate(x)]
        count = Counter()
        for a, b, c in zip(x, x[1:], x[2:]):
            if not (b == 32 and 32 in (a, c)):
                count[((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 18] += 1
        size = math.sqrt(sum(count.values()))
        margins = [sum(math.sqrt(n) * float(m.weights[f, k]) for f, n in count.items()) / max(size, 1e-9) + float(m.weights[-1, k]) for k in range(m.weights.shape[1])]
        first = len(m.family_pairs)
        group, p1 = vote(margins[:first], m.family_pairs, len(m.groups), range(len(m.groups)))
        lang, p2 = vote(margins[first:], m.lang_pairs, len(m.langs), [k for k, g in enumerate(m.of) if g == group])
        assert got[r.doc_id].lang_pred == m.langs[lang] and math.isclose(got[r.doc_id].score, p1 * p2, abs_tol=1e-4)


def test_op4_by_direct_probabilities(spark, crc, lower):
    """The query's scores from counts that plain dictionaries make of the same sample, and the curve from its kept-out texts."""
    sf = "/root/testdata/sf0.01"
    got = rows(spark, "op4_toxicity", sf)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if crc(r.doc_id) % 5}
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in marks], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    order = {c: sorted((i for i, y in marks.items() if y == c), key=lambda i: (hashes[i], i)) for c in (1, 0)}
    curve = [i for c in (1, 0) for k, i in enumerate(order[c]) if k % 4 == 0 and i in docs]
    counted = [[i for k, i in enumerate(order[c]) if k % 4 and i in docs] for c in (1, 0)]  # toxic first
    ratio = len(counted[0]) / len(counted[1])
    way = lambda w: [b"", *(w[:k] for k in toxicity.STEMS if len(w) >= k), w + b"."]

    def bigrams(text):
        """Each distinct bigram of a text with the word before it."""
        w = [b"<s>", b"<s>", *(x.encode() for x in re.findall(ALNUM, lower(text)))]
        out = {}
        for x, u, v in zip(w, w[1:], w[2:]):
            out.setdefault((u, v), x)
        return out

    seen, held = [set(), set()], [defaultdict(set), defaultdict(set)]
    for c in (0, 1):
        for i in counted[c]:
            for (u, v), x in bigrams(docs[i]).items():
                seen[c].add((x, u, v))
                for node in way(v)[1:]:
                    held[c][node].add(i)
    pairs = [Counter((u, v) for _, u, v in s) for s in seen]
    types = [Counter(v for _, v in p) for p in pairs]
    n = defaultdict(lambda: [0, 0])
    for c in (0, 1):
        for v, k in types[c].items():
            for e in zip(way(v), way(v)[1:]):
                n[e][c] += k
    n = {e: [min(k[c], len(held[c][e[1]])) for c in (0, 1)] for e, k in n.items()}

    def kept(t, o, d):
        common = min(t, o * ratio)
        less = d + math.ceil(toxicity.SHARED * common) + math.ceil(2 * math.sqrt(common))
        return max(t - less, 0), max(math.floor(o - less / ratio), 0)

    own = {e: kept(*k, toxicity.DISCOUNT) for e, k in n.items()}
    left = {e: sum(n[e]) - sum(own[e]) for e in n}
    d = lm_scoring.discounts(*(sum(x == k for x in left.values()) for k in (1, 2, 3, 4)))
    down = defaultdict(list)
    for e in n:
        down[e[0]].append(e)
    sums = {up: ([sum(n[e][c] for e in es) for c in (0, 1)], [sum(own[e][c] for e in es) for c in (0, 1)], sum(left[e] for e in es), sum(d[min(left[e], 3)] for e in es) / (len(es) + 1)) for up, es in down.items()}
    after = [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for (u, v), k in pairs[c].items():
            after[0][c][u] += k
            after[1][c][u] += kept(*(p[u, v] for p in pairs), toxicity.PAIR_DISCOUNT)[c]

    def word(v):
        q, up, known = [1.0, 1.0], b"", True
        for node in way(v)[1:]:
            if not known:
                break
            if up in sums:
                total, keeps, rest, extra = sums[up]
                x = left.get((up, node), 0)
                share = (max(x - d[min(x, 3)], 0) + extra) / rest if rest else 1 / (len(down[up]) + 1)
                q = [z * ((own.get((up, node), (0, 0))[c] + (total[c] - keeps[c]) * share) / total[c] if total[c] else share) for c, z in enumerate(q)]
            known = (up, node) in n
            up = node
        return q

    words = {}

    def evidence(text):
        b, total = bigrams(text), 0.0
        for u, v in b:
            q = words.setdefault(v, word(v))
            mine = kept(*(p[u, v] for p in pairs), toxicity.PAIR_DISCOUNT)
            if any(after[1][c][u] for c in (0, 1)):
                q = [(mine[c] + (after[0][c][u] - after[1][c][u]) * q[c]) / after[0][c][u] if after[0][c][u] else q[c] for c in (0, 1)]
            total += math.log(q[0]) - math.log(q[1])
        return total, len(b)

    found = {i: evidence(t) for i, t in docs.items()}
    y = np.array([marks[i] for i in curve], float)
    total, size = (np.array([found[i][k] for i in curve]) for k in (0, 1))
    usual = float(np.median((total / np.maximum(size, 1))[y == 0]))
    features = lambda t, k: np.stack([np.ones(len(k)), 20 * (t - usual * np.maximum(k, 1)) / np.maximum(k, 1), (t - usual * np.maximum(k, 1)) / np.sqrt(np.maximum(k, 1))], axis=1)
    weight = np.where(y > 0, sum(marks.values()) / y.sum(), (len(marks) - sum(marks.values())) / (len(y) - y.sum()))
    b = toxicity.logistic(features(total, size), y, weight * len(y) / weight.sum())
    score = 1 / (1 + np.exp(-features(*(np.array([found[i][k] for i in docs]) for k in (0, 1))) @ b))
    assert all(math.isclose(got[i].score, s, abs_tol=1e-6) for i, s in zip(docs, score))


def test_op7(spark):
    got = rows(spark, "op7_vector_join")
    found = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    ids = [i for i, _ in found]
    x = np.array([v for _, v in found], float)
    size = np.linalg.norm(x, axis=1)
    links = (x @ x.T) / np.maximum(np.outer(size, size), 1e-300) >= 0.9
    links[:, size == 0] = links[size == 0] = False
    np.fill_diagonal(links, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(links, label[None], len(ids)).min(1))
        if (new == label).all():
            break
        label = new
    assert [tuple(got[i]) for i in ids] == [(i, int(links[k].sum()), ids[label[k]], label[k] == k) for k, i in enumerate(ids)]


def test_op8(spark, documents, lower):
    got = rows(spark, "op8_jaccard_join")
    ids = sorted(documents)
    sets = {}
    for i in ids:
        w = re.findall(WORD, lower(documents[i].text))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert {i: tuple(got[i]) for i in ids} == {i: (i, len(sets[i]), root(i)) for i in ids}


def test_op10(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0
    got = rows(spark, "op10_token_shards")
    for i in sorted(documents):
        ids = [*t.encode(documents[i].text or "", add_special_tokens=False).ids, 0]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(documents)
