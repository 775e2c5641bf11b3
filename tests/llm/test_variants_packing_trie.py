"""Spelling variants, packing and the conversation trie against brute force; running totals; odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwork.llm import _shared as S
from driftwork.llm import packing, prefix_trie, queries, spelling_variants

SF = "/root/testdata/sf0.001"


def test_running_totals_of_groups_over_many_tasks(spark):
    """One group holds nearly all rows, others lie around it; ties are rows that repeat."""
    rng = np.random.default_rng(3)
    rows = [(7, int(k), int(v)) for k, v in zip(rng.integers(0, 300, 900), rng.integers(-(2**62), 2**62, 900))] + [(g, 1, g) for g in (-5, 3, 8, 9, 9)]
    df = spark.createDataFrame(rows, "g long, k long, v long").withColumn("one", F.lit(1).cast("long"))
    got, _ = S.running(df.repartition(9), "g", ["k", "v"], ["k", "v"], {"n": "one"}, {"x": "v"})
    assert len({r[0] for r in spark.read.parquet(_).where("g = 7").select("__part").distinct().collect()}) > 1
    wanted, last = [], None
    for g, k, v in sorted(rows):
        n, x = (n + 1, x ^ v) if g == last else (1, v)
        last = g
        wanted.append((g, k, v, 1, n, x))
    assert sorted(map(tuple, got.collect())) == wanted
    assert S.running(df.limit(0), "g", ["k"], ["k"], {"n": "one"})[0].count() == 0


# ---- spelling variants


def near_pairs(n):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        others = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form = others[0] if others and n[others[0]] >= 5 * n[w] else None
        out[w] = (form, len(others))
    return {(w, f, root(out, w), n[w], k, n[f] if f else None) for w, (f, k) in out.items()}


def root(out, w):
    while out[w][0]:
        w = out[w][0]
    return w


def counted(docs, lower, least=6):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def test_op11(spark, lower):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r) for r in queries.QUERIES["op11_spelling_variants"](spark, SF).collect()}
    assert got == near_pairs(counted(docs, lower)) and len(got) > 300 and any(r[1] for r in got)


def test_variants_of_odd_texts(spark, lower, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 3)
    words = ["abcdef", "abcdeg", "ABCDEF", "abcdefg", "aabcdef", "abcdéf", "Ünïcödé", "ünïcöd×", "aaaaaaa", "aaaaaa", "abcde"]
    rng = np.random.default_rng(5)
    docs = [(int(i), " ".join(rng.choice(words, 40, p=[0.4, *[0.06] * 10]))) for i in range(60)] + [(None, "abcdef" + "Ā" + "abcdef \U0001f600abcdef1abcdef"), (4, None), (5, ""), (6, "abcdeg " * 20_000), (6, "x"), (6, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "doc_id", "'w' as word", "1 as n", "2 as best")
    assert {tuple(r) for r in spelling_variants.spelling_variants(df).collect()} == near_pairs(counted(docs, lower))
    assert spelling_variants.spelling_variants(df.limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=1, max_size=5), st.integers(1, 400), min_size=1, max_size=40))
def test_variants_of_any_words(spark, n):
    """Short words of three letters: repeated letters, ties, chains of forms."""
    got = spelling_variants.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == near_pairs(n)


# ---- packing


def laid(plan, counts):
    """Sequences of a plan as lists of (offset, length); every id of every tail lies in one piece."""
    out = defaultdict(list)
    for k in np.flatnonzero(counts):
        seen = np.zeros((counts[k], k), int)
        for row, p in zip(*plan.find(int(k), np.arange(counts[k]))):
            bin, lo, hi, start, length, seq, offset = plan.places[p]
            assert bin == k and lo <= row < hi
            seen[row, start : start + length] += 1
            out[seq + row - lo].append((offset, length))
        assert (seen == 1).all()
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 17).flatmap(lambda w: st.tuples(st.lists(st.integers(0, 9), min_size=w, max_size=w), st.integers(1, 4))))
def test_plans_lose_nothing_and_pad_nothing(case):
    counts, depth = np.array(case[0]), case[1]
    counts[0] = 0
    window = len(counts)
    plan = packing.Plan(counts, window, depth)
    found = laid(plan, counts)
    assert sorted(found) == list(range(plan.sequences))
    for pieces in found.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end == window or end & (end - 1) == 0


def test_solver_finds_what_fits():
    """Counts that whole combinations make up are met, so hardly a tail is cut."""
    rng = np.random.default_rng(1)
    combos = packing.combinations(64, np.arange(64))
    assert (combos.sum(1) == 64).all() and len({tuple(c) for c in combos}) == len(combos)
    assert len(combos) == 32 + sum(1 for a in range(1, 64) for b in range(a, 64) if 64 - a - b >= b)
    counts = np.zeros(64, np.int64)
    for c, n in zip(combos[rng.choice(len(combos), 40, replace=False)], rng.integers(50, 500, 40)):
        np.add.at(counts, c, n)
    counts[0] = 0
    x = packing.repeats(combos, counts)
    assert (x >= 0).all()
    taken = np.bincount(combos.ravel(), np.repeat(x, 3), 64)
    assert np.abs(taken - counts)[1:].sum() < 0.02 * counts.sum()
    plan = packing.Plan(counts, 64)
    assert len(laid(plan, counts)) == plan.sequences == -(-int((counts * np.arange(64)).sum()) // 64)
    assert sum(map(len, laid(plan, counts).values())) < 1.02 * counts.sum()


def brute_pieces(docs, rows, window, library, end=0):
    """Checks rows against whole ids; returns the share of pieces that a plain cut at every window would not have."""
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, end] for i, t in docs}
    sequences, cover = defaultdict(list), {i: np.zeros(len(v), int) for i, v in ids.items()}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        cover[r.doc_id][r.start : r.start + r.length] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all((c == 1).all() for c in cover.values())
    for pieces in sequences.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total == window or total & (total - 1) == 0 and total < window
    assert sum(sum(n for _, n in p) < window for p in sequences.values()) <= window.bit_length()
    return len(rows) / sum(-(-len(v) // window) for v in ids.values())


def test_op12(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    brute_pieces(docs, queries.QUERIES["op12_packing"](spark, SF).collect(), 1024, library)


def test_packing_of_odd_tables(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "ENCODE_BYTES", 2000)
    docs = [(i, "word " * (i * 7 % 50)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "long text, " * 30_000), (1003, "éĀ x"), (1004, " ".join(["word"] * 15))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "doc_id", "'k' as key", "3 as tail", "1 as start").repartition(5)
    rows = packing.packed(df, path, window=16).collect()
    brute_pieces(docs, rows, 16, library)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    key = lambda rows: sorted((r.sequence_id, r.offset, r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    again = packing.packed(df, path, window=16, with_ids=True).collect()
    brute_pieces(docs, again, 16, library)
    whole = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    assert all(r.ids == whole[r.doc_id][r.start : r.start + r.length] for r in again) and len(key(again)) == len(key(rows))
    nulls = packing.packed(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string"), path, window=8).collect()
    assert Counter(r.doc_id for r in nulls for _ in range(r.length)) == {None: 6, 3: 6}
    assert packing.packed(df.limit(0), path).count() == 0 and packing.packed(df.where("doc_id = 1000"), path, end=None).count() == 0


# ---- conversation trie


def brute_trie(rows, every=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        own[c].append((role, text))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, every))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if whole[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def test_op13(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    got = queries.QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == brute_trie(rows)


def trie(df):
    return sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.rebased(prefix_trie.numbered(df))).collect()))


def test_trie_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    rng = np.random.default_rng(9)
    texts, roles = ["", None, "a", "a b", " x \t yĀ", "long " * 3000], ["user", "", None]
    rows = [(int(c), int(t) if t < 5 else None, roles[rng.integers(3)], texts[rng.integers(6)]) for c in range(-45, 90) for t in range(rng.integers(1, 7))]
    rows += [(None, 1, "user", "x"), (200, None, None, None), (200, None, None, None), *((c, 1, "user", "same") for c in range(300, 380)), *((c, 2, "user", "same") for c in range(300, 380))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("text", "role", "conv_id", "turn", "1 as n", "2 as a", "3 as total").repartition(6)
    assert trie(df) == brute_trie(rows)
    assert trie(df.limit(0)) == [] and trie(df.where("conv_id = 200")) == brute_trie([r for r in rows if r[0] == 200])


def test_trie_of_one_long_conversation(spark):
    """Most rows belong to one conversation, which several tasks number; its depth needs many doubling rounds."""
    rows = [(40, k, "user", f"turn {k}") for k in range(700)] + [(c, k, "user", f"turn {k}") for c in (41, 42, 60) for k in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert trie(df) == brute_trie(rows)
    plain = prefix_trie.prefix_trie(prefix_trie.numbered(df)).where("depth = 0").first()
    assert (plain.conv_id, plain.n_convs, plain.n_leaves, plain.saved_tokens) == (40, 4, 1, 2 * 3 * 200)
