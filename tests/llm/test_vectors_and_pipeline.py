"""Vectors against brute force, components, and the pipeline."""

import numpy as np

from driftwork.llm import _shared as S
from driftwork.llm import bpe_codec, decontaminate, jaccard_join, vector_join

SF = "/root/testdata/sf0.001"


def brute(vectors, threshold):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n, up = np.zeros(len(vectors), int), list(range(len(vectors)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(vectors)):
        for j in range(i):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    return [(i, n[i], root(i)) for i in range(len(vectors))]


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    vectors = [(b + rng.standard_normal(16) * s).tolist() for b in base for s in (0, 0.1, 0.3, 0.5)] + [base[0].tolist()] * 5
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [None, *[1.0] * 15], [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 3.0], [5.0]]
    vectors += [[1e200] * 16, [2e200] * 16, [1e-200] * 16, [5e-324, *[0.0] * 15], [1e-300, *[0.0] * 15]]
    d = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, block int, cell string")
    wanted = brute([v and [x and x * 2.0 ** (600 if 0 < abs(x) < 1e-100 else -600 if abs(x) > 1e100 else 0) for x in v] for v in vectors], 0.9)
    for slot, copy in ((8192, 0), (20, 0), (8192, 1e9), (20, 1e9)):
        monkeypatch.setattr(vector_join, "SLOT", slot)
        monkeypatch.setattr(vector_join, "COPY", copy)
        got = [(r.vec_id, r.n_links, r.component_id) for r in vector_join.vector_links(d).orderBy("vec_id").collect()]
        assert got == wanted
    assert vector_join.vector_links(d.limit(0)).count() == 0


def test_grid_by_work():
    """Vectors alike in all directions need no grid; where a closer limit lets cells part them, they do."""
    wide = list(np.random.default_rng(1).standard_normal((1500, 64)))
    assert vector_join.plan(wide, 0.9, 50_000) == {64: 0}
    assert vector_join.plan(wide, 0.999, 10**8)[64] == 3
    assert vector_join.plan([], 0.9, 5) == {}


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + k) for k in range(1, 50)]
    got, _ = S.components(spark.createDataFrame(pairs, "a long, b long").repartition(7))
    v, m = S.contracted(*np.array([p for p in pairs if p[0] != p[1]]).T)
    assert sorted(map(tuple, got.collect())) == sorted(zip(v.tolist(), m.tolist()))


def test_pipeline(spark):
    import corpus_pipeline

    kept = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        df, _ = S.written(stage(spark, kept[-1], SF), f"test-{name}")
        kept.append(df)
    docs, clean, spoken, single, cut, tokens = kept
    assert all(k.columns == docs.columns for k in kept[:5])
    assert {r.doc_id for r in clean.collect()} <= {r.doc_id for r in docs.collect()}
    groups = jaccard_join.jaccard_join(spoken, 5, 80)
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in groups.collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contamination(cut, bench).where("n_hit > 0").count() == 0
    before = {r.doc_id: r.n_hit for r in decontaminate.contamination(single, bench).collect()}
    texts = {r.doc_id: r.text for r in single.collect()}
    assert all(r.text == texts[r.doc_id] for r in cut.collect() if not before[r.doc_id])
    assert tokens.count() == cut.count() and "n_tokens" in tokens.columns
    assert bpe_codec is not None


def test_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b = "one two three four five six seven eight", "some other words that nothing else here has at all"
    rows = [(1, a), (1, a), (2, a), (2, a), (3, b), (3, None), (4, None), (None, a), (None, a), (5, "alone")]
    d = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, d, SF)
    assert got.columns == d.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == [(0, a), (0, a), (1, a), (3, b), (4, ""), (5, "alone")]


def test_stages_on_odd_tables(spark):
    """Clashing names, extra columns of any type, nulls and empty tables, through every stage."""
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = base.selectExpr("*", "-7L as `__before`", "1 as score", "'x' as lang_pred", "2 as toxic", "3L as component_id", "map('a', doc_id) as count", "4 as c0", "'t' as `__text`", "5 as total", "6 as n_tokens", "array(1) as row")
    blank = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "\n \n", None, None, None)], base.schema)
    odd = odd.unionByName(blank, allowMissingColumns=True)
    plain = base.unionByName(blank)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got, _ = S.written(stage(spark, odd, SF), f"test-{name}")
        want, _ = S.written(stage(spark, plain, SF), f"test-{name}")
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        if k < 4:
            assert got.columns == odd.columns
            assert got.where("doc_id >= 0 and (`__before` <> -7 or score <> 1 or lang_pred <> 'x' or toxic <> 2 or c0 <> 4 or `__text` <> 't' or total <> 5 or n_tokens <> 6 or count['a'] <> doc_id)").count() == 0
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    import pytest

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "yarn", "x"

            class getConf:  # noqa: N801
                get = staticmethod(lambda key: None)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        S.shared_dir(Cluster)
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        Cluster.sparkContext.master = master
        assert S.shared_dir(Cluster).startswith("file:/")
    Cluster.sparkContext.master = "local-cluster[3,2,1024]"
    Cluster.sparkContext.applicationId = "y"
    with pytest.raises(ValueError, match="checkpoint.dir"):
        S.shared_dir(Cluster)


def test_seats(spark):
    n = 7
    seats = S.seats(spark, n)
    d = spark.createDataFrame([(int(s),) for s in seats], "seat long").repartition(n, "seat").selectExpr("seat", "spark_partition_id() p").collect()
    assert len({r.p for r in d}) == n


def test_folders_of_another_store(spark, tmp_path, monkeypatch):
    """Where the shared folder is not mounted, files go through Arrow's file systems."""
    monkeypatch.setattr(S, "local_path", lambda url: None)
    url = f"file://{tmp_path}/deep/x"
    S.put_file(url, [b"ab", b"cd"])
    S.put_file(url, b"abcde")
    assert bytes(S.mapped(url)) == b"abcde" and [p.name for p in (tmp_path / "deep").iterdir()] == ["x"]


def test_near_duplicates_shuffle_no_texts_or_sets(spark, monkeypatch):
    """However many documents there are in clusters or dropped, their texts and sets are not shuffled: ids are looked up, sets lie in files, each once."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(0, 200, 5)] + [" ".join(f"y{10 * k + j}" for j in range(60)) for k in range(40)] + [None, "", "alone"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (45, texts[45]), (None, texts[7])]
    d = spark.createDataFrame([(i, t, "en", None, 1, {"a": i}) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, m map<string,long>")
    want = sorted(map(repr, corpus_pipeline.one_of_each_group(spark, d, SF).collect()))
    assert len(want) == 45
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
    for most, block in ((0, 256), (0, 4), (500_000, 4)):
        kinds = []
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", most)
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "FILE", 500, raising=False)
        monkeypatch.setattr(S, "KEYS", 7, raising=False)
        monkeypatch.setattr(jaccard_join, "_grouped", lambda sets, percent, f=jaccard_join._grouped: (kinds.extend(sets.dtypes), f(sets, percent))[-1])
        found = jaccard_join.jaccard_join(d, shingle=5, percent=80)
        assert {r.doc_id: r.component_id for r in found.collect() if r.doc_id != r.component_id} == {i: 0 for i in range(1, 40)}
        assert kinds and "binary" not in dict(kinds).values()
    got = corpus_pipeline.one_of_each_group(spark, d.where("doc_id is null or doc_id not in (3, 45) or text is null"), SF)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, corpus_pipeline.one_of_each_group(spark, d, SF).collect())) == want


def test_files_of_a_shuffle_go_when_its_table_is_written(spark):
    import time

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().mkString("\n").count("/shuffle_")
    before = files()
    S.written(spark.range(1000).repartition(3, "id").groupBy("id").count(), "test")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before
    assert spark.conf.get(S.CLEANUP) == "false"


def test_looking_keys_up(spark, monkeypatch):
    """Sorted files, mounted or not, of repeated keys that reach over several files."""
    monkeypatch.setattr(S, "KEYS", 5)
    monkeypatch.setattr(S, "OPEN", 2)
    rng = np.random.default_rng(3)
    keys = rng.integers(-40, 40, 120)
    index, _ = S.sorted_files(spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)] + [(None, 5)], "k long, v long").repartition(3), "test")
    asked = rng.integers(-60, 60, 70)
    wanted = sorted((i, v) for i, a in enumerate(asked) for v in np.flatnonzero(keys == a).tolist())
    for local in (S.local_path, lambda url: None):
        monkeypatch.setattr(S, "local_path", local)
        at, (values,) = S.Keys(index, 2).find(asked)
        assert sorted(zip(at.tolist(), values.tolist(), strict=True)) == wanted
    assert len(S.Keys([], 2).find(asked)[0]) == 0


def test_vectors_lie_on_disk_once(spark, monkeypatch):
    """However many slots there are, pairs of them are dealt by name; with cells of a grid, large and small ones, links are those of brute force."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((30, 12)) * [5, 5, 5, *[1] * 9]
    vectors = [(b + rng.standard_normal(12) * s).tolist() for b in base for s in (0, 0.1, 0.4)] + [base[0].tolist()] * 9 + [None, [0.0] * 12, [1.0, 2.0], [2.0, 4.0]]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    wanted = brute(vectors, 0.9)
    given = {}

    def written(df, tag, keep=S.written):
        found = keep(df, tag)
        given.setdefault(tag, []).append((df._jdf.queryExecution().optimizedPlan().toString(), found[0].count()))
        return found

    monkeypatch.setattr(vector_join.S, "written", written)
    for slot, grid in ((7, False), (7, True), (30, True), (8192, True)):
        given.clear()
        monkeypatch.setattr(vector_join, "SLOT", slot)
        monkeypatch.setattr(vector_join, "COPY", 0 if grid else 1e9)
        monkeypatch.setattr(vector_join, "WORTH", 9 if grid else 0.5, raising=False)
        assert [(r.vec_id, r.n_links, r.component_id) for r in vector_join.vector_links(d).orderBy("vec_id").collect()] == wanted
        if not grid:
            assert all("embedding" not in plan for plan, _ in given["links"])
            assert given["index"][0][1] >= 13
        else:
            assert "cells" in given


def test_a_grid_saves_half():
    """A grid that leaves most comparisons is not worth its copies on disk, however many vectors there are."""
    assert vector_join.plan(list(np.random.default_rng(1).standard_normal((1500, 64))), 0.9, 10**8) == {64: 0}
