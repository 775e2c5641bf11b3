"""Solver, trackers, cleaning, interpolation: boundary cases and properties."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwork.config import ReidConfig
from driftwork.functions import scalars
from driftwork.operators import clean, draw, frames, reid, tracks
from driftwork.operators.assignment import assign, solved
from driftwork.operators.reid import Tracker, run_video
from driftwork.operators.segments import reid_segmented, renumbering

NUMBERS = st.one_of(st.integers(0, 6).map(float), st.just(1e6), st.floats(0, 100))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_solver_is_optimal(n, m, data):
    c = np.array(data.draw(st.lists(st.lists(NUMBERS, min_size=m, max_size=m), min_size=n, max_size=n)))
    i, j = assign(c)
    k = min(n, m)
    assert len(set(i.tolist())) == len(set(j.tolist())) == k
    best = min(sum(c[a, b] for a, b in zip(p, q)) for p in itertools.combinations(range(n), k) for q in itertools.permutations(range(m), k))
    assert abs(c[i, j].sum() - best) < 1e-6


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.data())
def test_potentials_prove_the_optimum(n, m, data):
    c = np.array(data.draw(st.lists(st.lists(NUMBERS, min_size=m, max_size=m), min_size=n, max_size=n)))
    i, j, u, v = solved(c)
    assert ((u[:, None] + v[None]) <= c + 1e-6).all() and np.allclose(u[i] + v[j], c[i, j], atol=1e-6)
    side, used = (u, i) if n > m else (v, j)
    free = np.setdiff1d(np.arange(len(side)), used)
    assert (side <= 1e-9).all() and (side[free] == 0).all() and abs(u.sum() + v.sum() - c[i, j].sum()) < 1e-5


def broken(certificates, tracks, config):
    rows = reid.violations(certificates, tracks, config)
    names = ("dear", "unpaid", "positive", "unmatched", "drifted", "wrong")
    return {k: v for k, v in rows.agg(*(F.sum(n).alias(n) for n in names)).first().asDict().items() if v}


@pytest.mark.parametrize("predictor", ["constant_velocity", "last_position", "damped_velocity"])
def test_certificates_hold_and_tell_what_is_wrong(spark, predictor):
    rng = np.random.default_rng(2)
    rows = [(v, f, k, *map(float, rng.random(2) * 200)) for v in (0, 7) for f in range(40) if f % 9 != 5 for k in range(rng.integers(0, 7) if f else 4)]
    d = spark.createDataFrame(rows, "video_id long, frame long, ord long, x double, y double")
    config = ReidConfig(objects=4, predictor=predictor, max_move=60)
    found, proof = reid.reid(d, config).cache(), reid.certificates(d, config).cache()
    assert broken(proof, found, config) == {} and proof.where("mate is not null").count() > 100
    some = proof.where("side = 0 and mate is not null and potential is not null and frame > 20").orderBy("video_id", "frame", "k").first()
    at = (F.col("video_id") == some.video_id) & (F.col("frame") == some.frame) & (F.col("side") == 0) & (F.col("k") == some.k)
    changed = lambda **c: proof.withColumns({k: F.when(at, v).otherwise(F.col(k)) for k, v in c.items()})
    assert broken(changed(potential=F.col("potential") + 5.0), found, config).keys() >= {"dear", "unpaid"}
    assert broken(changed(potential=F.col("potential") - 5.0), found, config).keys() >= {"unpaid"}
    assert broken(changed(mate=F.lit(None).cast("long")), found, config).keys() >= {"unmatched"}
    assert broken(changed(mate=F.col("mate") + 1), found, config)
    assert broken(changed(x=F.col("x") + 0.5), found, config).keys() >= {"drifted"}
    # a track that takes another detection than the cheapest
    assert broken(proof, found.withColumn("id", 3 - F.col("id")), config).keys() == {"wrong"}
    assert broken(proof, found.where("frame <> 20 or id <> 2"), config).keys() <= {"wrong"}
    assert reid.violations(reid.certificates(d.limit(0), config), found, config).count() == 0


def test_solver_of_nothing():
    assert len(assign(np.empty((0, 3)))[0]) == 0


def steps(config, *points):
    t = Tracker(config)
    return t, [t.step(k, np.array(p, float).reshape(-1, 2)) for k, p in enumerate(points)]


def test_gate_is_inclusive_and_miss_changes_nothing():
    for predictor in ("constant_velocity", "last_position"):
        c = ReidConfig(objects=1, predictor=predictor, max_move=5)
        _, out = steps(c, [(0, 0)], [(3, 4)])
        assert out[1] == [(0, 3.0, 4.0)]
        t, out = steps(c, [(0, 0)], [(3, 4.001)])
        assert out[1] == [] and t.last.tolist() == [[0, 0]]


def test_predictors_differ_after_a_step():
    path = [[(0, 0)], [(10, 0)], [(20, 0), (10.5, 0)]]
    assert steps(ReidConfig(objects=1), *path)[1][2] == [(0, 20.0, 0.0)]
    assert steps(ReidConfig(objects=1, predictor="last_position"), *path)[1][2] == [(0, 10.5, 0.0)]


def test_smooth_paths_agree():
    path = [[(5.0 * k, 10.0), (5.0 * k, 400.0)] for k in range(20)]
    outs = [steps(ReidConfig(objects=2, predictor=p), *path)[1] for p in ("constant_velocity", "last_position", "damped_velocity")]
    assert outs[0] == outs[1] == outs[2]


def test_most_matches_come_first():
    c = ReidConfig(objects=2, predictor="last_position", max_move=10)
    _, out = steps(c, [(0, 0), (8, 0)], [(4, 0), (-9, 0)])
    assert len(out[1]) == 2


def test_retired_after_sixty_misses():
    c = ReidConfig(objects=1, predictor="damped_velocity")
    assert steps(c, [(0, 0)], *[[]] * 60, [(1, 0)])[1][-1]
    assert not steps(c, [(0, 0)], *[[]] * 61, [(1, 0)])[1][-1]


def test_damped_seeds_by_y_and_ages_missing_frames():
    t, out = steps(ReidConfig(objects=2, predictor="damped_velocity"), [(0, 9), (0, 1), (0, 5)])
    assert [r[2] for r in out[0]] == [1.0, 5.0]
    got = run_video(ReidConfig(objects=1, predictor="damped_velocity"), 0, np.array([0, 70]), np.array([[0.0, 0], [0, 0]]))
    assert len(got) == 1


def test_no_start_frame_is_an_error():
    with pytest.raises(ValueError):
        run_video(ReidConfig(objects=3), 0, np.array([0]), np.array([[0.0, 0]]))
    with pytest.raises(ValueError):
        ReidConfig(max_move=2e6)


def test_dedup_and_topk(spark):
    kind = "video_id long, frame long, ord long, x double, y double, conf double, track_id int"
    p = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0.5, 1), (0, 0, 1, 15.0, 0.0, 0.5, 2), (0, 0, 2, 30.0, 0.0, 0.9, 3), (0, 0, 3, 16.0, 0.0, 0.7, 4), (0, 1, 0, 1.0, 1.0, 0.1, -1)], kind)
    got = [(r.frame, r.ord, r.x, r.track_id) for r in clean.dedup_leaders(p, 15.0).orderBy("frame", "ord").collect()]
    # 15 joins 0 (the limit counts) and does not replace it on a tie; 30 leads; 16 joins 30 as the first leader in reach
    assert got == [(0, 0, 0.0, 1), (0, 1, 30.0, 3), (1, 0, 1.0, -1)]
    top = [(r.ord, r.track_id) for r in clean.top_by_confidence(p, 2).where("frame = 0").orderBy("ord").collect()]
    assert top == [(0, 3), (1, 4)]
    assert clean.drop_untracked(p).count() == 4


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(0, 5)), min_size=1, max_size=25))
def test_dedup_properties(spark, points):
    kind = "video_id long, frame long, ord long, x double, y double, conf double, track_id int"
    p = spark.createDataFrame([(0, 0, i, float(x), float(y), c / 10, i) for i, (x, y, c) in enumerate(points)], kind)
    got = clean.dedup_leaders(p, 15.0).collect()
    leaders, best = [], []
    for i, (x, y, c) in enumerate(points):
        k = next((k for k, (a, b) in enumerate(leaders) if np.hypot(np.float32(x - a), np.float32(y - b)) <= 15), None)
        if k is None:
            leaders.append((x, y))
            best.append(i)
        elif c > points[best[k]][2]:
            best[k] = i
    assert [r.track_id for r in sorted(got, key=lambda r: r.ord)] == best


def test_interpolation(spark):
    t = spark.createDataFrame([(0, 0, 1, 0.0, 0.0), (0, 1, 1, 1.0, 1.0), (0, 4, 1, 7.0, 4.0), (0, 9, 2, 5.0, 5.0)], "video_id long, frame long, id int, x double, y double")
    got = [(r.id, r.frame, r.x, r.y) for r in tracks.interpolate(t).orderBy("id", "frame").collect()]
    assert got == [(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0), (1, 2, 3.0, 2.0), (1, 3, 5.0, 3.0), (1, 4, 7.0, 4.0), (2, 9, 5.0, 5.0)]
    trail = {r.frame: len(r.trail) for r in tracks.trails(t, 2).where("id = 1").collect()}
    assert trail == {0: 1, 1: 2, 4: 2}


def test_repeated_frames_of_a_track(spark):
    t = spark.createDataFrame([(0, 0, 1, 0.0, 0.0), (0, 0, 1, 2.0, 0.0), (0, 2, 1, 4.0, 4.0)], "video_id long, frame long, id int, x double, y double")
    got = sorted((r.frame, r.x) for r in tracks.interpolate(t).collect())
    assert len(got) == 4 and [g for g in got if g[0] != 1] == [(0, 0.0), (0, 2.0), (2, 4.0)]


def test_draw_list(spark):
    t = spark.createDataFrame([(0, 0, 3, 10.7, -3.7), (0, 1, 450, 3.2, 11.5), (0, 2, 0, 99.9, 99.9)], "video_id long, frame long, id int, x double, y double")
    meta = spark.createDataFrame([(0, 30.0, 100, 100, 1)], "video_id long, fps double, frame_w int, frame_h int, total_frames long")
    r, s, u = draw.draw_list(t, meta).orderBy("frame").collect()
    # anchors are cut towards zero after the offset: 10.7 - 4.5, -3.7 - 12, 11.5 - 12
    assert (r.cx, r.cy, r.label, r.label_x, r.label_y, r.radius) == (10, -3, "3", 6, -15, 3) and tuple(r.box) == (2, 0, 19, -11)
    assert (s.label_x, s.label_y, tuple(s.box)) == (-10, 0, (0, 0, 21, 4)) and tuple(s.color) == scalars.colour_of(450)
    assert tuple(u.color) == (148, 244, 157) and u.box.x2 == 99
    r, s, u = draw.draw_list(t, meta, style="plain", trail=5).orderBy("frame").collect()
    assert (r.label, r.label_x, r.label_y, r.box) == ("ID: 3", 15, 14, None) and (u.label_x, u.label_y) == (100 - 45 - 1, 94)
    o = draw.overlays(t.select("video_id", (t.frame + 1).alias("frame")).where("frame = 3"), t).first()
    assert (o.text, o.x, o.y, o.scale, tuple(o.color)) == ("Count: 0", 20, 40, 1.0, (0, 255, 0))


def exhaustive(cost):
    """Most matches first, then least cost, by trying every injection of rows into columns (or none)."""
    best = None
    n, m = cost.shape
    for cols in itertools.product(range(-1, m), repeat=n):
        used = [c for c in cols if c >= 0]
        if len(set(used)) == len(used) and all(cost[r, c] < 1e6 for r, c in enumerate(cols) if c >= 0):
            key = (-len(used), sum(cost[r, c] for r, c in enumerate(cols) if c >= 0))
            if best is None or key < best[0]:
                best = (key, cols)
    return best[1]


@pytest.mark.parametrize("predictor", ["constant_velocity", "last_position", "damped_velocity"])
def test_steps_as_by_trying_all(predictor):
    rng = np.random.default_rng(11)
    for objects in (3, 4):
        config = ReidConfig(objects=objects, predictor=predictor, max_move=45)
        t = Tracker(config)
        path = [rng.random((objects + 1, 2)) * 100] + [rng.random((rng.integers(0, 6), 2)) * 100 for _ in range(25)]
        t.step(0, path[0])
        last, before = t.last.copy(), [None] * objects
        v, miss = np.zeros((objects, 2)), [0] * objects
        for k, points in enumerate(path[1:], 1):
            cost = np.full((objects, len(points)), 1e6)
            for i in range(objects):
                for j, p in enumerate(points):
                    if predictor == "damped_velocity":
                        scale = sum(0.9**q for q in range(miss[i] + 1))
                        off, speed = np.linalg.norm(p - last[i] - v[i] * scale), np.linalg.norm(v[i])
                        gate, way = min(max(130 + 2 * speed, 50), 600), p - last[i]
                        turn = 0 if speed < 1 or np.linalg.norm(way) < 1 else 1 - v[i] @ way / (speed * np.linalg.norm(way))
                        cost[i, j] = off + turn * gate * 2 if off <= gate else 1e6
                    else:
                        ahead = last[i] - before[i] if predictor == "constant_velocity" and before[i] is not None else 0
                        off = np.linalg.norm(p - last[i] - ahead)
                        cost[i, j] = off if off <= 45 else 1e6
            cols = exhaustive(cost)
            wanted = [(i, *points[c]) for i, c in enumerate(cols) if c >= 0]
            assert t.step(k, points) == [(i, float(x), float(y)) for i, x, y in wanted]
            for i, c in enumerate(cols):
                if c >= 0:
                    v[i] = 0.3 * v[i] + 0.7 * (points[c] - last[i])
                    before[i], last[i], miss[i] = last[i].copy(), points[c], 0
                else:
                    v[i] *= 0.95
                    miss[i] += 1


@pytest.mark.parametrize("predictor", ["constant_velocity", "last_position", "damped_velocity"])
def test_segments_give_the_sequential_tracks(spark, predictor):
    """Three videos by segments: smooth paths, where a guess holds but for its numbers; wild ones, which are repaired; one with empty stretches."""
    rng = np.random.default_rng(8)
    rows = []
    for f in range(240):
        for k, i in enumerate(rng.permutation(4)):
            if rng.random() < 0.9 or f == 0:
                rows.append((0, f, k, float(200 * i + 3 * np.sin(f / 9 + i) + rng.random()), float(50 * i + f / 2 + rng.random())))
        rows += [(1, f, k, *map(float, rng.random(2) * 120)) for k in range(4 if f == 3 else rng.integers(0, 6))]
        rows += [(2, f, k, *map(float, rng.random(2) * 90)) for k in range(4 if f == 0 else rng.integers(0, 5))] if not 60 <= f < 140 else []
    d = spark.createDataFrame(rows, "video_id long, frame long, ord long, x double, y double")
    config = ReidConfig(objects=4, predictor=predictor, max_move=30)
    wanted = sorted(map(tuple, reid.reid(d, config).collect()))
    got, seen = reid_segmented(d, config, frames_per_segment=60, warm_up=12, every=4)
    assert sorted(map(tuple, got.collect())) == wanted
    repaired = {r.video_id: (r.segments, r.repaired) for r in seen.collect()}
    assert repaired[0][0] == 4 and repaired[0][1] < 120 and repaired[1][1] > 0 and repaired[2][0] == 3


def test_segments_of_odd_videos(spark):
    d = spark.createDataFrame([(0, 5, 0, 1.0, 1.0), (0, 90, 0, 2.0, 2.0), (4, 1, 0, 0.0, 0.0)], "video_id long, frame long, ord long, x double, y double")
    assert sorted(map(tuple, reid_segmented(d, ReidConfig(objects=1), 10, 3)[0].collect())) == sorted(map(tuple, reid.reid(d, ReidConfig(objects=1)).collect()))
    assert reid_segmented(d.limit(0))[0].count() == 0 and reid_segmented(d, ReidConfig(objects=2), strict=False)[0].count() == 0
    with pytest.raises(Exception, match="no frame with at least 2"):
        reid_segmented(d, ReidConfig(objects=2))
    assert renumbering([0.0] * 14, [0.0] * 14) is None and renumbering([1.0] + [0.0] * 13, [0.0] * 7 + [1.0] + [0.0] * 6) == [1, 0]


def test_batch_reid_and_checks(spark):
    d = spark.createDataFrame([(0, 0, 0, 0.0, 0.0), (0, 1, 0, 1.0, 0.0), (0, 3, 0, 2.0, 0.0)], "video_id long, frame long, ord long, x double, y double")
    assert [(r.frame, r.x) for r in reid.ordered(reid.reid(d, ReidConfig(objects=1))).collect()] == [(0, 0.0), (1, 1.0), (3, 2.0)]
    with pytest.raises(Exception, match="no frame with at least 2"):
        frames.checked_start_frames(d, 2).collect()
    assert reid.reid(d, ReidConfig(objects=2), strict=False).count() == 0
    bad = spark.createDataFrame([(0, 0, 0, float("inf"), 0.0)], d.schema)
    with pytest.raises(Exception, match="finite"):
        reid.reid(bad, ReidConfig(objects=1)).collect()
    assert reid.reid(d.limit(0)).count() == 0 and frames.frame_totals(d).first().frames == 3


def test_batches_within_a_frame(spark):
    """A frame and a video may span Arrow batches."""
    rows = [(v, f, k, float(100 * k + f), float(v)) for v in (0, 1) for f in range(6) for k in range(5)]
    d = spark.createDataFrame(rows, "video_id long, frame long, ord long, x double, y double")
    config = ReidConfig(objects=5)
    wanted = sorted(map(tuple, reid.reid(d, config).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, reid.reid(d, config).collect())) == wanted and len(wanted) == 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
