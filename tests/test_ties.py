"""Matchings that cost the same: the choice is a rule, and that of the SQL, on tables in which events occur several times."""

import itertools

import duckdb
import numpy as np
import pandas as pd
import pytest

from driftwork.config import ReidConfig
from driftwork.operators.assignment import latest, preferred, solved
from driftwork.operators.reid import run_video
from driftwork.plans.fixture import SQL
from driftwork.plans.queries import reid_sql
from driftwork.plans.video_queries import ORACLES, QUERIES
from test_queries import SF, rows


def test_choice_among_cheapest_matchings_is_a_rule():
    rng, ties = np.random.default_rng(1), 0
    for _ in range(400):
        n, m = int(rng.integers(1, 5)), int(rng.integers(1, 6))
        cost = np.where(rng.random((n, m)) < 0.3, 1e6, rng.integers(0, 4, (n, m)))
        i, j, tied = preferred(cost, *solved(cost), 1e6)
        pairs = [list(zip(range(n), p)) for p in itertools.permutations(range(m), n)] if n <= m else [list(zip(p, range(m))) for p in itertools.permutations(range(n), m)]
        total = lambda p: sum(cost[k] for k in p)
        rank = lambda p: sum((1 - 2 * a) * (b - m) for a, b in p if cost[a, b] < 1e6)
        least = min(map(total, pairs))
        assert total(zip(i, j)) == least and rank(zip(i, j)) == min(rank(p) for p in pairs if total(p) == least)
        ties += tied
    assert ties > 50


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Six copies of the events with keys shifted, dealt over the videos: two objects begin at one place and meet points that are there once."""
    path = tmp_path_factory.mktemp("copies")
    duckdb.sql(f"COPY (SELECT event_id + 100000 * k AS event_id, ts, user_id + k AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(6) r(k)) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


def same_as_sql(spark, name, path):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql("SET threads = 1")  # with more, the SQL takes one or the other of such matchings from run to run
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return rows(QUERIES[name](spark, path).toPandas()) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["reid_constant_velocity_n2", "reid_constant_velocity_tight_n2", "reid_last_position_n2", "reid_damped_n2", "segmented_constant_velocity_n2", "run_interactive_n2"])
def test_copies_as_in_sql(spark, copies, name):
    assert same_as_sql(spark, name, copies)


def test_copies_as_in_sql_offline_run(spark, copies):
    assert same_as_sql(spark, "run_offline_n2", copies)


@pytest.mark.parametrize("predictor, gate", [("constant_velocity", 100), ("last_position", 5), ("last_position", 100), ("damped_velocity", 0)])
def test_ties_of_two_objects_as_in_sql(predictor, gate):
    """Few places, or points of one line whose sums differ in rounding only: nearly every step has several cheapest matchings."""
    rng = np.random.default_rng(7)
    for line in (False, True):
        found = []
        for video, frame in itertools.product(range(4), range(40)):
            n = max(2 if not frame else 0, int(rng.integers(0, 30)))
            places = np.stack([rng.integers(0, 6000, n) / 100, np.zeros(n)] if line else [rng.integers(0, 12, n), rng.integers(0, 12, n) * 5.0], axis=1)
            if not frame:
                places[1] = places[0]
            found += [(video, frame, k, *p) for k, p in enumerate(places)]
        points = pd.DataFrame(found, columns=["video_id", "frame", "ord", "x", "y"])
        con = duckdb.connect()
        con.sql("SET threads = 1")
        con.sql("CREATE TABLE fx AS SELECT * FROM points")
        config = ReidConfig(objects=2, predictor=predictor, max_move=float(gate or 1000))
        ours = pd.concat(run_video(config, v, p.frame.to_numpy(), p[["x", "y"]].to_numpy(), False) for v, p in points.groupby("video_id"))
        assert rows(ours) == rows(con.sql(reid_sql(predictor, gate).replace(SQL + ",", "")).df())


def test_least_sum_in_double_precision():
    """Both choices cost the same on paper; their sums in double precision do not."""
    x, at = np.array([17.95, 28.77, 32.59]), np.array([0.0, -7.4])
    cost = np.array([[17.95, 28.77, 32.59], [25.349999999999998, 36.17, 39.989999999999995]])
    assert np.allclose(cost, x - at[:, None])
    i, j, tied = latest(cost, np.stack([x, 0 * x], axis=1), 1e6)
    assert list(zip(i, j)) == [(0, 1), (1, 0)] and not tied


def test_copies_of_a_place_are_no_ties_of_places():
    points = np.array([[1.0, 0], [1, 0], [1, 0], [9, 0]])
    i, j, tied = latest(np.array([[1.0, 1, 1, 9], [2, 2, 2, 9]]), points, 1e6)
    assert list(zip(i, j)) == [(0, 1), (1, 2)] and not tied
    i, j, tied = latest(np.full((2, 4), 1e6), points, 1e6)
    assert sorted(i) == [0, 1] and len(set(j)) == 2 and not tied
