"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftwork.llm import bpe_codec, chat_format, decontaminate, jaccard_join, language_id, license_scan, lm_scoring, token_shards, toxicity
from driftwork.llm.hash_arrays import HashArray

KIND = "doc_id long, text string, lang string, source string, n_chars long, cluster string, shard string, score string"
LONG = "word " * 30000 + "x" * 100_000
TEXTS = [None, "", "   ", "one", "a b c", "a b c", "The quick brown fox jumps over the lazy dog again and again today", "the quick brown fox jumps over the lazy dog again and again TODAY", "é à la Über-maß 漢字 12 <|endoftext|> it's", LONG, "\x00\x1f\n"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", None, None, "c", "s", "x") for i, t in enumerate(texts)], KIND)


def words(pattern, text, lower):
    return re.findall(pattern, lower(text))


@pytest.mark.parametrize(("order", "part"), [(3, 2_000_000), (3, 40), (2, 40)])
def test_lm(spark, lower, monkeypatch, order, part):
    monkeypatch.setattr(lm_scoring, "PART", part)
    texts = [*TEXTS[:9], *TEXTS[10:], "the quick red fox jumps over a lazy dog", "the quick brown dog"]
    d = docs(spark, texts)
    model = lm_scoring.train(d, order=order)
    got = {r.doc_id: r for r in lm_scoring.scored(d, model).collect()}
    seqs = [[*words(r"[^\x20\x09-\x0D]+", t, lower), None] for t in texts]
    uni = Counter(w for s in seqs for w in s)
    tri = Counter(x for s in seqs for x in zip([0, 0, *s], [0, *s], s))
    pairs = Counter((v, w) for _, v, w in tri) if order == 3 else Counter(p for s in seqs for p in zip([0, *s], s))
    n, v = sum(uni.values()), len(uni)
    follows = Counter(w for _, w in pairs)

    def below(counts):
        out = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in counts.items():
            out[g[:-1]][0] += c
            out[g[:-1]][min(c, 3)] += 1
        return out, lm_scoring.discounts(*(sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)))

    after, d2 = below(pairs)
    after3, d3 = below(tri)
    e = lm_scoring.discounts(*(sum(c == k for c in follows.values()) for k in (1, 2, 3, 4)))
    rest = sum(e[min(c, 3)] for c in follows.values()) / len(pairs)

    def level(c, x, d, low):
        return max(c - d[min(c, 3)], 0) / x[0] + (d[1] * x[1] + d[2] * x[2] + d[3] * x[3]) / x[0] * low if x[0] else low

    def p(u, m, w):
        low = max(follows[w] - e[min(follows[w], 3)], 0) / len(pairs) + rest / (v + 1)
        low = level(pairs[m, w], after.get((m,), [0]), d2, low)
        return level(tri[u, m, w], after3.get((u, m), [0]), d3, low) if order == 3 else low

    assert abs(sum(p("the", "quick", w) for w in [*uni, "unseen"]) - 1) < 1e-9
    for i, s in enumerate(seqs):
        assert got[i].n_tokens == len(s) == got[i].n_known
        assert math.isclose(got[i].score, sum(math.log10(p(*x)) for x in zip([0, 0, *s], [0, *s], s)), rel_tol=1e-9)
        assert math.isclose(got[i].base_score, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s), rel_tol=1e-9)
    new = lm_scoring.scored(docs(spark, ["the unseen fox unseen"]), model).first()
    s = ["the", "unseen", "fox", "unseen", None]
    assert new.n_known == 3 and math.isclose(new.score, sum(math.log10(p(*x)) for x in zip([0, 0, *s], [0, *s], s)), rel_tol=1e-9)
    assert part > 40 or len(model.hot) > 1


def test_lm_of_nothing(spark):
    empty = docs(spark).limit(0)
    assert lm_scoring.scored(empty, lm_scoring.train(empty)).count() == 0
    assert all(r.score == 0 for r in lm_scoring.scored(docs(spark), lm_scoring.train(empty)).collect())


@pytest.mark.parametrize("low", [0, 1, 4])
@pytest.mark.parametrize("grouped", [False, True])
def test_hash_array(low, grouped):
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    counts = np.arange(len(keys)) % 400 + 1
    more = [counts, counts * 7 % 3, np.where(counts == 7, 2**40, 0)]
    table = HashArray(b"".join(HashArray.parts(keys, more, low, grouped)))
    assert all((a == b).all() for a, b in zip(table.find(keys), more, strict=True))
    assert not any(x.any() for x in table.find(keys + np.uint64(1 << 40)))
    if low == 4:
        assert not table.find(keys + np.uint64(1))[0].any()
    one = HashArray(b"".join(HashArray.parts(keys[:1], [counts[:1]], low)))
    assert one.find(keys[:2])[0].tolist() == [1, 0] and HashArray(b"").find(keys) == []


def test_bpe(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = bpe_codec.encoded(docs(spark), path, keep=["doc_id"]).collect()
    for r in rows:
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.bpe_ids) == ids and r.bpe_text == t.decode(ids, skip_special_tokens=False)
    assert bpe_codec.encoded(docs(spark).limit(0), path).count() == 0


def test_bpe_fuzz():
    public = pytest.importorskip("public_tokenizers")
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t, w = Tokenizer.from_file(path), bpe_codec.Worker(bpe_codec.Codec(path))

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.text("aeinrst'HIJ 12!?.é", max_size=80), st.lists(st.sampled_from(["haha", "ing", "<|endoftext|>", "'ll", " ", "Σ"])).map("".join)))
    def check(text):
        (ids, shown), e = next(w.run([text])), t.encode(text, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids and shown.decode() == t.decode(e.ids, skip_special_tokens=False)

    check()


def test_shards(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(-5, "x"), (7, None), (3, "a  b\n\n c"), (3, "again"), (2**40, LONG), (11, "it's <|endoftext|> é漢 "), (None, "no key"), (5, "")]
    shards = token_shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/s", path).collect()
    got = sorted(map(tuple, token_shards.read_shards(spark, shards, with_ids=True).collect()), key=lambda r: r[1])
    wanted = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x in sorted(((d, x or "") for d, x in rows if d is not None))]
    assert [(r[0], list(r[4])) for r in got] == wanted
    assert [r[1] for r in got] == np.cumsum([0, *(len(x) for _, x in wanted)])[:-1].tolist()
    with open(next(s.file for s in shards if s.first <= 3 <= s.last)[7:], "rb") as f:
        shard = token_shards.Shard(f.read())
    assert len(shard.find(3)) == 2 and shard.find(4) == [] and not sum(shard.may_hold(k) for k in range(10**6, 10**6 + 200)) > 20
    assert token_shards.read_shards(spark, token_shards.write_shards(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", path).collect()).count() == 0


def test_many_shards_few_tasks(spark, tmp_path, monkeypatch):
    """Ten thousand files are read by as many tasks as their ids need, and each starts where the files before it end."""
    public = pytest.importorskip("public_tokenizers")
    one = token_shards.write_shards(spark.createDataFrame([(7, "a b c")], "doc_id long, text string"), f"file://{tmp_path}/s", public.path("byte_bpe_50k.json")).first()
    shards = spark.range(10_000).selectExpr(f"'{one.file}' as file", "id div 100 as part", "id % 100 as number", f"{one.n_ids}L as n_ids")
    read = token_shards.read_shards(spark, shards.repartition(7))
    assert read.rdd.getNumPartitions() == 1
    assert sorted(r.start for r in read.collect()) == [one.n_ids * k for k in range(10_000)]
    monkeypatch.setattr(token_shards, "READ_BYTES", 16 * one.n_ids * 1000)
    assert 2 <= token_shards.read_shards(spark, shards).rdd.getNumPartitions() <= 3


def test_cuts_as_the_library():
    public = pytest.importorskip("public_tokenizers")
    from hypothesis import given, settings
    from hypothesis import strategies as st

    e = token_shards.Encoder(public.path("byte_bpe_50k.json"))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.text("ab1. \n\tÀé-", max_size=40), st.text(max_size=20)), max_size=5))
    def check(texts):
        for t, x in zip(texts, e.encode(texts, None)):
            assert np.frombuffer(x, "<u2").tolist() == e.library.encode(t, add_special_tokens=False).ids

    check()


def test_license(spark):
    texts = [None, "", "text\nReleased under the MIT License.\nmore words here", "released UNDER the mit licence, really", license_scan.TEMPLATES["mit-text"].replace(", to deal", "\nto deal"), LONG]
    got = [(r.doc_id, r.n_units, list(r.licenses), r.best_dice) for r in license_scan.license_scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[0][1:] == got[1][1:] == got[5][1:] == (0, [], 0.0)
    assert got[2][1:] == (1, ["mit"], 1.0) and got[4][2] == ["mit-text"] and got[3][2] == []


def test_whole_licence_texts_in_files(spark):
    """Licence texts wrapped as comments between code and prose, with other names in the copyright line."""
    names = ("mit-whole", "isc-text", "bsd-2-clause-text", "bsd-3-clause-text")
    texts = ["import os\n\n# Copyright (c) 2001, A. Person\n#\n" + "\n".join(f"# {line}" for line in textwrap.wrap(license_scan.TEMPLATES[n], 70)) + "\n\ndef run(path):\n    return os.stat(path)\n" for n in names]
    texts.append("\n".join(textwrap.wrap(license_scan.TEMPLATES["mit-whole"], 70)[:3]))
    got = license_scan.license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert all(n in r.licenses and r.best_dice > 0.99 for n, r in zip(names, got)) and "mit-text" in got[0].licenses
    assert "mit-whole" not in got[-1].licenses and not {"isc-text", "bsd-2-clause-text"} & set(got[0].licenses)


def test_license_passages(spark, lower):
    names = ["apache-2.0-header", "gpl-3.0-header", "mit-text"]
    wrapped = ["Some prose before it,\nof two lines.\n" + "\n".join(textwrap.wrap(license_scan.TEMPLATES[n], 76)) + "\nand much more prose after it\nthat goes on." for n in names]
    mit = license_scan.TEMPLATES["mit"]
    inside = f"see notes below. {mit} Contact the authors for more."
    texts = [*wrapped, inside, f"{inside}\n{mit}\n{inside}", "\n".join([wrapped[2]] * 3), "see notes released under the mit licence by them"]
    rng = np.random.default_rng(4)
    pool = [license_scan.TEMPLATES[n].split() for n in ("mit", "apache-2.0", "cc-by-nc-4.0", "all-rights-reserved", "gpl-3.0")]
    for _ in range(60):  # notices with words left out or put in, wrapped anywhere
        w = ["prose"] * rng.integers(0, 6)
        for k in rng.integers(0, len(pool), 2):
            part = [v for v in pool[k] if rng.random() > 0.06]
            part.insert(rng.integers(0, len(part) + 1), rng.choice(["new", "", "the"]))
            w += [*part, *["end", "of", "it"][: rng.integers(0, 4)]]
        texts.append("".join(v + rng.choice([" ", " ", " ", "\n"]) for v in w))

    def pairs(x):
        w = words("[a-z0-9]+", x, lower)
        return [*zip(w, w[1:], strict=False)]

    def brute(text):
        out = {}
        lines = [words("[a-z0-9]+", x, lower) for x in text.split("\n")]
        flat = pairs(text)
        for name, body in license_scan.TEMPLATES.items():
            all_, best = pairs(body), 0
            t, span = set(all_), len(all_) * 3 // 2
            sets = [set(flat), *(set(zip(x, x[1:], strict=False)) for x in lines)]
            for a in range(len(lines)):
                for b in range(a + 1, len(lines) + 1):
                    w = [v for x in lines[a:b] for v in x]
                    if len(w) - 1 <= span:
                        sets.append(set(zip(w, w[1:], strict=False)))
            for a in range(len(flat)):
                for b in range(a + 1, min(len(flat), a + span) + 1):
                    if len(g := set(flat[a:b])) >= len(t):
                        sets.append(g)
            best = max(2 * len(g & t) / (len(g) + len(t)) for g in sets)
            if best >= 0.8 - 1e-12:
                out[name] = best
        return out

    got = license_scan.license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        wanted = brute(text)
        assert (list(r.licenses), r.best_dice) == (sorted(wanted), pytest.approx(max(wanted.values(), default=0.0))), text
    assert all(n in r.licenses and r.best_dice == 1 for n, r in zip(names, got, strict=False))
    assert [(r.n_units, list(r.licenses)) for r in got[3:7]] == [(1, ["mit"]), (3, ["mit"]), (3, ["mit-text"]), (0, [])]


def test_decontaminate(spark, lower):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (10, "short one"), (3, None), (4, "..."), (None, "quick brown"), (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    texts = [*TEXTS, "x Alpha, beta gamma delta epsilon zeta eta theta iota kappa LAMBDA mu y", "short", "one short one short one", "alpha beta gamma delta epsilon zeta eta theta iota", items[0][1] * 2]
    d = spark.createDataFrame([(i % 14, t) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = words(pattern, t, lower)
        for k in range(max(1, len(w) - 9)) if w and i is not None else ():
            windows[tuple(w[k : k + 10])].add(str(i))
    wanted = []
    for i, t in enumerate(texts):
        w = words(pattern, t, lower)
        hits = [(k, x) for x in windows for k in range(len(w) - len(x) + 1) if tuple(w[k : k + len(x)]) == x]
        wanted.append((i % 14, len(w), len({p for k, x in hits for p in range(k, k + len(x))}), sorted({i for _, x in hits for i in windows[x]})))
    rows = decontaminate.contamination(d, b).collect()
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in rows), key=key) == sorted(wanted, key=key)
    clean = decontaminate.decontaminated(d, b)
    assert clean.count() == len(texts) and all(r.n_hit == 0 for r in decontaminate.contamination(clean, b).collect())
    assert all(r.n_hit == 0 for r in decontaminate.contamination(d, b.limit(0)).collect())


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "QUERY_BYTES", 1)
    d = spark.createDataFrame([(0, "a b c d")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "x")], "item_id long, text string")
    assert decontaminate.contamination(d, b).first()[1:4] == (4, 3, ["1", "2"])


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard(spark, lower, size, percent):
    rng = np.random.default_rng(size)
    base = [[f"w{x}" for x in rng.integers(0, 400, n)] for n in (6, 7, 12, 30, 60, 200) for _ in range(6)]
    texts = list(TEXTS)
    for b in base:
        for _ in range(5):
            w = list(b)
            for k in rng.integers(0, len(w), rng.integers(0, 3)):
                w[k] = "new" + str(rng.integers(0, 99))
            texts.append(" ".join(w[: len(w) - rng.integers(0, 2)]))
    sets = []
    for t in texts:
        w = words(r"[^\x20\x09-\x0D]+", t, lower)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs(spark, texts), size, percent).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_jaccard_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    words_ = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words_[:k], f"x{k}", *words_[k + 1 :]]) for k in range(30)] + [" ".join(words_)]
    got = {r.component_id for r in jaccard_join.jaccard_join(docs(spark, texts), 2, 80).collect()}
    assert got == {0}
    assert jaccard_join.jaccard_join(docs(spark).limit(0)).count() == 0


def test_unlike_documents_in_a_chain(spark, monkeypatch):
    """Texts that each share words with the next ones only, so that equal parts close them all to one cluster: rows of sets grow with the
    number of texts, no group is much above a block, and the few links among them are found."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    seen = {}
    for n in (300, 600):
        made = {}

        def written(df, tag, keep=jaccard_join.S.written.__wrapped__ if hasattr(jaccard_join.S.written, "__wrapped__") else jaccard_join.S.written, made=made):
            found = keep(df, tag)
            made.setdefault(tag, []).append(found[0].count())
            return found

        grouped = []
        monkeypatch.setattr(jaccard_join.S, "written", written)
        original = jaccard_join._grouped
        monkeypatch.setattr(jaccard_join, "_grouped", lambda sets, percent, f=original, g=grouped: (g.append(sets.groupBy("cluster", "block").count().agg({"count": "sum"}).first()[0]), g.append(sets.groupBy("cluster", "block").count().agg({"count": "max"}).first()[0]), f(sets, percent))[-1])
        texts = [" ".join(f"w{10 * k + j}" for j in range(100)) for k in range(n)]
        copies = {n + c: k for c, k in enumerate(range(5, n, 40))}
        texts += [f"{texts[k]} more" for k in copies.values()]
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs(spark, texts), 4, 85).collect()}
        monkeypatch.undo()
        monkeypatch.setattr(jaccard_join, "BLOCK", 32)
        assert got == {i: copies.get(i, i) for i in range(len(texts))}
        seen[n] = sum(grouped[::2]), max(grouped[1::2])
    assert seen[600][0] < 2.3 * seen[300][0] and seen[600][1] < 4 * 32, seen


def test_documents_of_common_words(monkeypatch):
    """Sets that are mostly common tokens: those that link share a signature, by their prefixes where every dealing leaves too many small parts."""
    monkeypatch.setattr(jaccard_join, "SEEDS", 1)
    rng = np.random.default_rng(4)
    common = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = []
    for n in (20, 60, 150):
        for _ in range(12):
            base = [*rng.choice(common, int(0.8 * n), replace=False), *rng.integers(0, 2**63, n - int(0.8 * n)).astype(np.uint64)]
            for k in (0, 1, 3):
                sets.append(np.unique(np.array([*base[k:], *rng.integers(0, 2**63, k // 2).astype(np.uint64)], np.uint64)))
    sizes = np.array([len(x) for x in sets])
    scheme = jaccard_join.Scheme(85)
    sig, who = jaccard_join._parts(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes, scheme.of(sizes), scheme, common)
    held = defaultdict(set)
    for x, i in zip(sig.tolist(), who.tolist()):
        held[i].add(x)
    linked = alike = 0
    for i in range(len(sets)):
        for j in range(i):
            if jaccard_join.linked(sets[i], sets[j], 85) and not np.array_equal(sets[i], sets[j]):
                linked += 1
                assert held[i] & held[j]
            elif held[i] & held[j]:
                alike += 1
    assert linked >= 36 and alike < linked


def test_meetings_grow_with_the_documents(spark):
    """However many near copies a group has, a task leaves one row for each at most."""
    base = [f"w{i}" for i in range(120)]
    made = {}
    for k in (40, 160):
        texts = [" ".join([*base[: i % 110], f"x{i}", *base[i % 110 + 1 :]]) for i in range(k)]
        sent = docs(spark, texts).select("doc_id", "text").repartition(3).mapInArrow(jaccard_join._sketch(5, 80, np.arange(16), np.empty(0, np.uint64)), jaccard_join._OUT)
        made[k] = sent.repartition(4, "shard").mapInArrow(jaccard_join._meet, jaccard_join._OUT).where(f"kind = {jaccard_join._PAIR}").count()
        assert made[k] <= (3 + 4) * k
    assert made[160] < 5 * made[40]


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", ""), (2, 2, "user", "more"), (3, 0, "user", "hi"), (4, 0, "user", "other"), (5, 0, "user", "other"), (6, None, None, "x"), (None, 0, "user", "hi"), (7, 1, "user", "hi!"), (7, 0, "user", "hi")]
    t = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, n string, a long")
    got = [(r.conv_id, r.n_turns, r.n_copies) for r in chat_format.chat_format(t).orderBy("conv_id").collect()]
    assert got == [(2, 3, 1), (4, 1, 2), (6, 1, 1), (7, 2, 1)]
    assert chat_format.chat_format(t).where("conv_id = 6").first().rendered == "<|unknown|>\nx<|end|>\n"
    assert chat_format.chat_format(t.limit(0)).count() == 0


def test_language(spark):
    rng = np.random.default_rng(1)
    sounds = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "é", "oi", "que"], "es": ["ción", "ll", "ado", "ñ"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(30)), lang) for i, lang in enumerate(list(sounds) * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d)
    got = language_id.with_language(d, model).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    odd = language_id.with_language(docs(spark), model, keep=["doc_id"]).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {0, 1, 2, 10}
    none = language_id.with_language(d, language_id.fit(d.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_more_than_64_languages(spark):
    langs = [f"x{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(70)]
    rows = [(i, " ".join(f"{lang}{lang[::-1]}" for _ in range(4 + i % 3)), lang) for i, lang in enumerate(langs * 3)]
    rows += [(1000 + i, t, lang) for i, (_, t, lang) in enumerate(rows[:140])]  # the last ones are the rarest
    d = spark.createDataFrame([r for r in rows if r[2] < "xci" or r[0] < 210], "doc_id long, text string, lang string")
    model = language_id.fit(d)
    assert model.langs == langs
    assert all(r.lang == r.lang_pred for r in language_id.with_language(d, model).collect())


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = [f"word{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(600):
        w, bad = list(rng.choice(plain, 60)), i % 4 == 0
        for k in rng.integers(0, 60, 4) if bad else ():
            w[k] = rng.choice(["vileness", "nastyish", "horridly"])
        rows.append((i, " ".join(w)))
        marks.append((i, None, int(bad)))
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.fit(d, m, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(d, model).collect()}
    assert np.mean([got[i] == (i % 4 == 0) for i in range(0, 600, 3)]) > 0.97
    odd = toxicity.toxicity(docs(spark), model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.toxic_score <= 1 for r in odd)
    blank = toxicity.fit(d, m.limit(0))
    assert {r.toxic for r in toxicity.toxicity(d, blank).collect()} == {0}


def test_toxic_distributions(spark, lower):
    """Each class's steps, and its bigrams after a word, sum to 1 with what is unknown, and equal direct computation."""
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}{c}" for a in ("mild", "vile", "so") for b in ("ness", "", "ly") for c in ("x", "yz", "")]
    texts = [(" ".join(rng.choice(vocabulary[9 * (i % 2) : 18 + 9 * (i % 2)], 40)) + f" {rng.choice(vocabulary)} vile so" * (i % 2), int(i % 2)) for i in range(80)]
    m = toxicity._count(spark.createDataFrame(texts, "text string, toxic int"), spark)
    seen = [set(), set()]  # (x, u, w) of the first time that a text has (u, w)
    held = [defaultdict(set), defaultdict(set)]  # texts that hold a word or stem
    for i, (t, y) in enumerate(texts):
        w = ["<s>", "<s>", *words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t, lower)]
        had = set()
        for x, u, v in zip(w, w[1:], w[2:]):
            if (u, v) not in had:
                had.add((u, v))
                seen[1 - y].add((x, u, v))
            for k in (4, 5, 6, 7, 99):
                if k == 99 or len(v) >= k:
                    held[1 - y][v[:k], k].add(i)
    pairs = [Counter((u, v) for _, u, v in s) for s in seen]
    types = [Counter(v for _, v in p) for p in pairs]
    ways = {v: [("", 0), *((v[:k], k) for k in (4, 5, 6, 7) if len(v) >= k), (v, 99)] for v in {*types[0], *types[1]}}
    edges = [Counter(), Counter()]
    for c in (0, 1):
        for v, n in types[c].items():
            for e in zip(ways[v], ways[v][1:]):
                edges[c][e] += n
    every = sorted({*edges[0], *edges[1]})
    n = {e: [min(edges[c][e], len(held[c][e[1]])) for c in (0, 1)] for e in every}

    def kept(a, b, d):
        return max(a - d - toxicity.SHARED * min(a, b) - math.ceil(2 * math.sqrt(min(a, b))), 0)

    kept_of = {e: [kept(*x, toxicity.DISCOUNT), kept(*x[::-1], toxicity.DISCOUNT)] for e, x in n.items()}
    left = {e: sum(n[e]) - sum(kept_of[e]) for e in every}
    d = lm_scoring.discounts(*(sum(x == k for x in left.values()) for k in (1, 2, 3, 4)))

    def step(c, e):
        below = [f for f in every if f[0] == e[0]]
        b = sum(left[f] for f in below)
        share = (max(left.get(e, 0) - d[min(left.get(e, 0), 3)], 0) + sum(d[min(left[f], 3)] for f in below) / (len(below) + 1)) / b
        total = sum(n[f][c] for f in below)
        return (kept_of.get(e, (0, 0))[c] + (total - sum(kept_of[f][c] for f in below)) * share) / total if total else share

    some = sorted(ways)
    data = " ".join(some).encode()
    b = toxicity.Block(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    names = [data[i:j].decode() for i, j in zip(b.begin, b.end)]
    q = m.steps([*b.stems(np.arange(len(b.w))).values(), b.w])
    for c in (0, 1):
        assert all(math.isclose(x, math.prod(step(c, e) for e in zip(ways[v], ways[v][1:])), rel_tol=1e-9) for v, x in zip(names, q[c]))
        for up in {e[0] for e in every}:
            assert math.isclose(sum(step(c, e) for e in every if e[0] == up) + step(c, (up, ("?", -1))), 1)
    u = next(u for (u, _), k in pairs[0].items() if k > toxicity.PAIR_DISCOUNT + 1)
    p = m.probabilities(np.full(len(b.w), b.w[names.index(u)]), b.w, q)
    assert any(not math.isclose(x, y) for x, y in zip(p[0], q[0]))
    for c in (0, 1):
        total = sum(k for (a, _), k in pairs[c].items() if a == u)
        mine = {v: kept(pairs[c][u, v], pairs[1 - c][u, v], toxicity.PAIR_DISCOUNT) for v in names}
        assert all(math.isclose(x, (mine[v] + (total - sum(mine.values())) * y) / total if total else y, rel_tol=1e-9) for v, x, y in zip(names, p[c], q[c]))


def test_unequal_classes_are_compared_in_proportion(spark):
    """What a class keeps does not depend on how many texts the other has, if they say the same; and SQL and numpy keep alike."""
    t, o = (x.ravel() for x in np.meshgrid(np.arange(0, 60), np.arange(0, 60)))
    for ratio in (1.0, 0.125, 0.3, 7 / 3):
        a = toxicity.kept(np.stack([t, o]), 6, ratio)
        sql = toxicity._kept_sql(6, ratio)
        df = spark.createDataFrame(list(zip(t.tolist(), o.tolist())), "t long, o long").selectExpr("t", "o", f"{sql['kt']} as kt", f"{sql['ko']} as ko", f"{sql['left']} as rest")
        got = {(r.t, r.o): (r.kt, r.ko, r.rest) for r in df.collect()}
        assert all(got[i, j] == (x, y, i + j - x - y) for i, j, x, y in zip(t.tolist(), o.tolist(), *a.tolist()))
    assert (toxicity.kept(np.stack([t, 8 * o]), 6, 0.125)[0] == toxicity.kept(np.stack([t, o]), 6)[0]).all()
    assert (toxicity.kept(np.stack([t, 8 * o]), 6, 0.125)[1] == 8 * toxicity.kept(np.stack([t, o]), 6)[1]).all()


def test_rare_expressions_lean_on_their_stems(spark):
    """A word that only one text has counts through its stem."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join([*rng.choice([f"plain{k}" for k in range(40)], 30), *([f"vilest{i}", f"vilest{i}b"] if i % 2 else [f"kinder{i}"])])) for i in range(160)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.fit(d, spark.createDataFrame([(i, i % 2) for i, _ in rows] * 2, "doc_id long, toxic int"))
    new = docs(spark, ["plain1 plain2 vilestnew plain3", "plain1 plain2 kindernew plain3"])
    a, b = (r.toxic_score for r in toxicity.toxicity(new, m).orderBy("doc_id").collect())
    assert a > 0.5 > b
    again = toxicity.fit(d.unionByName(d), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert [r.toxic_score for r in toxicity.toxicity(new, again).orderBy("doc_id").collect()] == [a, b]
    assert toxicity.toxicity(docs(spark).limit(0), m).count() == 0


def test_names_that_clash(spark):
    """Columns named like results are replaced, others come through, whatever they are called."""
    public = pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame([(1, "the first", 5, "a", "b", 7, 8, 9, 10, "p", 11, 12)], "doc_id long, text string, score int, lang_pred string, Toxic string, total int, n_tokens int, __before int, __0 int, bpe_text string, __text int, toxic_score int")
    model = language_id.fit(d.selectExpr("doc_id", "text", "'en' lang"))
    got = language_id.with_language(d, model)
    assert got.columns == [*(c for c in d.columns if c not in ("score", "lang_pred")), "lang_pred", "score"]
    r = got.first()
    assert (r["lang_pred"], r["Toxic"], r["total"], r["__before"], r["__0"], r["__text"]) == ("en", "b", 7, 9, 10, 11)
    r = toxicity.toxicity(d, toxicity.Model(None)).first()
    assert r.asDict().keys() == {*d.columns, "toxic"} - {"Toxic"} and (r["score"], r["total"], r["n_tokens"], r["toxic"]) == (5, 7, 8, 1)
    r = bpe_codec.encoded(d, public.path("word_bpe_49k.json")).first()
    assert (r["bpe_text"], r["n_tokens"], r["__text"]) == ("the</w> first</w>", 8, 11)
    r = decontaminate.decontaminated(d, spark.createDataFrame([(1, "first")], "item_id long, text string")).first()
    assert (r["text"], r["__before"], r["__0"]) == ("the ", 9, 10)
    twice = d.select("doc_id", "text", "total", "total")
    assert decontaminate.decontaminated(twice, spark.createDataFrame([], "item_id long, text string")).columns == twice.columns
    assert language_id.with_language(twice, model).count() == 1


def test_empty_tables_and_repeats(spark):
    public = pytest.importorskip("public_tokenizers")
    none, twice = docs(spark).limit(0), docs(spark).unionByName(docs(spark))
    assert license_scan.license_scan(none).count() == 0 and license_scan.license_scan(twice).count() == 2 * len(TEXTS)
    model = language_id.fit(none)
    assert language_id.with_language(none, model).count() == 0 and model.langs == []
    assert language_id.fit(twice).langs == ["en"] and len(language_id.with_language(twice, language_id.fit(twice)).distinct().collect()) == len(TEXTS)
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(none, toxicity.fit(none, marks)).count() == 0
    assert {r.toxic for r in toxicity.toxicity(twice, toxicity.fit(twice, marks)).collect()} == {0}
    assert decontaminate.decontaminated(none, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    rows = bpe_codec.encoded(twice, public.path("word_bpe_49k.json"), ["doc_id"]).collect()
    assert len(rows) == 2 * len(TEXTS) and len({(r.doc_id, tuple(r.bpe_ids)) for r in rows}) == len(TEXTS)
    twice_scored = lm_scoring.scored(twice, lm_scoring.train(twice)).collect()
    assert len(twice_scored) == 2 * len(TEXTS) and len({(r.doc_id, r.score) for r in twice_scored}) == len(TEXTS)


def test_long_texts_in_blocks(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame([(i, f"text number {i} " * (20000 if i == 3 else 2)) for i in range(7)], "doc_id long, text string")
    path = public.path("word_bpe_49k.json")
    whole = sorted(map(tuple, bpe_codec.digests(d, path, ["doc_id"]).collect()))
    monkeypatch.setattr(bpe_codec, "BLOCK_BYTES", 64)
    assert sorted(map(tuple, bpe_codec.digests(d, path, ["doc_id"]).collect())) == whole


def test_shards_roll_over(spark, tmp_path, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    d = spark.createDataFrame([(i // 3, f"text {i} " * 40) for i in range(60)], "doc_id long, text string")
    read = lambda name: sorted(map(tuple, token_shards.read_shards(spark, token_shards.write_shards(d, f"file://{tmp_path}/{name}", path).collect()).collect()))
    whole = read("a")
    monkeypatch.setattr(token_shards, "SHARD_BYTES", 700)
    assert read("b") == whole and len(list((tmp_path / "b").iterdir())) > 2 * len(list((tmp_path / "a").iterdir()))


def test_chat_of_many_turns(spark):
    turns = [(1, k, "user", f"turn {k}") for k in range(3000)] + [(2, k, "user", f"turn {k}") for k in range(2999)]
    got = chat_format.chat_format(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 3000)]


def test_digest_of_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    r = bpe_codec.digests(docs(spark, ["ab"]), public.path("word_bpe_49k.json"), ["doc_id"]).first()
    ids = bpe_codec.encoded(docs(spark, ["ab"]), public.path("word_bpe_49k.json")).first().bpe_ids
    assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_language_sample_without_texts(spark, monkeypatch):
    """Where texts of sampled ids are null, the rows with texts are sampled again: as if the others were not there."""
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 20)
    d = spark.range(300).selectExpr("id as doc_id", "case when id % 3 <> 0 then concat('the word ', id, case when id % 2 = 0 then ' und der' else ' et les' end) end as text", "case when id % 2 = 0 then 'de' else 'fr' end as lang")
    one, two = language_id.fit(d), language_id.fit(d.where("text is not null"))
    assert one.langs == two.langs == ["de", "fr"] and (one.weights == two.weights).all() and one.weights.any()
    assert language_id.fit(d.selectExpr("doc_id", "cast(null as string) as text", "lang")).langs == []
