"""Queries over the fixture, and their SQL."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwork import shared
from driftwork.config import CleanConfig, ReidConfig
from driftwork.functions import scalars
from driftwork.operators import clean, draw, frames, reid, segments, tracks
from driftwork.plans import fixture
from driftwork.plans.fixture import SQL, TRACKS_SQL
from driftwork.sources import tables
from driftwork.streaming.gap_stream import interpolate_stream
from driftwork.streaming.reid_stream import reid_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_D, _T = fixture.detections, fixture.tracks


@_query(f"WITH {SQL} SELECT video_id, frame, ord, x, y, conf, track_id FROM fx")
def fixture_rows(spark: SparkSession, d: str) -> DataFrame:
    return _D(spark, d)


@_query(f"WITH {SQL} SELECT video_id, frame, ord, ((x - 1.5) + (x + 2.5)) / 2.0 AS x, ((y - 2.0) + (y + 2.0)) / 2.0 AS y FROM (SELECT video_id, frame, ord, (x::FLOAT - 1.5::FLOAT)::FLOAT::DOUBLE + 1.5 AS x, y FROM fx)")
def box_centroid(spark: SparkSession, d: str) -> DataFrame:
    p = _D(spark, d)
    x = (F.col("x").cast("float") - F.lit(1.5).cast("float")).cast("float")
    boxes = p.withColumn("b", F.struct(x.alias("x1"), F.col("y").alias("y1"), (x.cast("double") + 4).alias("x2"), F.col("y").alias("y2"), F.col("conf").cast("float").alias("conf"), "track_id"))
    nested = boxes.groupBy("video_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "b"))), lambda s: s["b"]).alias("boxes"))
    return clean.box_centroids(nested).select("video_id", "frame", "ord", "x", "y")


@_query(f"WITH {SQL} SELECT video_id, frame, ord, x, y, conf, track_id FROM fx WHERE track_id <> -1")
def drop_untracked(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_untracked(_D(spark, d))


@_query(f"WITH {SQL} SELECT video_id, frame, count(*) AS n FROM fx GROUP BY ALL")
def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_counts(_D(spark, d))


@_query(f"WITH {SQL} SELECT video_id, string_agg(ord || ':' || track_id, ',' ORDER BY ord) AS dets, frame FROM fx GROUP BY video_id, frame")
def frame_arrays(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_arrays(_D(spark, d)).select("video_id", "frame", F.array_join(F.transform("dets", lambda p: F.concat(p["ord"].cast("string"), F.lit(":"), p["track_id"].cast("string"))), ",").alias("dets"))


@_query(f"WITH {SQL} SELECT video_id, min(frame) AS start_frame FROM (SELECT video_id, frame FROM fx GROUP BY ALL HAVING count(*) >= 3) GROUP BY video_id")
def start_frame(spark: SparkSession, d: str) -> DataFrame:
    return frames.start_frames(_D(spark, d), 3)


@_query(f"WITH {SQL}, s AS (SELECT video_id, unnest(range(0, max(frame) + 1)) AS frame FROM fx GROUP BY video_id) SELECT s.video_id, s.frame, count(fx.ord) AS n FROM s LEFT JOIN fx USING (video_id, frame) GROUP BY ALL")
def frame_spine_counts(spark: SparkSession, d: str) -> DataFrame:
    return frames.counts_on_spine(_D(spark, d))


@_query(f"WITH {SQL}, s AS (SELECT video_id, min(frame) AS f FROM (SELECT video_id, frame FROM fx GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL) SELECT video_id, frame, ord, x, y FROM fx JOIN s USING (video_id) WHERE frame > f")
def after_start(spark: SparkSession, d: str) -> DataFrame:
    p = _D(spark, d)
    return frames.after_start(p, frames.start_frames(p, 3)).select("video_id", "frame", "ord", "x", "y")


@_query(f"WITH {SQL} SELECT video_id, frame, n - 1 AS ord, x, y, conf, track_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY conf DESC, ord) AS n FROM fx) WHERE n <= 4")
def topk_per_frame(spark: SparkSession, d: str) -> DataFrame:
    return clean.top_by_confidence(_D(spark, d), 4)


_SEED = "WITH {sql}, s AS (SELECT video_id, min(frame) AS frame FROM (SELECT video_id, frame FROM fx GROUP BY ALL HAVING count(*) >= 3) GROUP BY video_id) SELECT video_id, frame, n - 1 AS id, x, y FROM (SELECT fx.*, row_number() OVER (PARTITION BY video_id ORDER BY {order}) AS n FROM fx JOIN s USING (video_id, frame)) WHERE n <= 3"


@_query(_SEED.format(sql=SQL, order="y, ord"))
def seed_by_y(spark: SparkSession, d: str) -> DataFrame:
    return frames.seeds(_D(spark, d), 3, by_y=True)


@_query(_SEED.format(sql=SQL, order="ord"))
def seed_by_order(spark: SparkSession, d: str) -> DataFrame:
    return frames.seeds(_D(spark, d), 3)


@_query(f"WITH {TRACKS_SQL} SELECT video_id, frame, tr.id, fx.ord, round(sqrt((fx.x - tr.x) * (fx.x - tr.x) + (fx.y - tr.y) * (fx.y - tr.y)), 6) AS cost FROM tr JOIN fx USING (video_id, frame) WHERE sqrt((fx.x - tr.x) * (fx.x - tr.x) + (fx.y - tr.y) * (fx.y - tr.y)) <= 100")
def distance_gate_candidates(spark: SparkSession, d: str) -> DataFrame:
    return frames.candidates(_T(spark, d), _D(spark, d), 100).withColumn("cost", F.round("cost", 6))


@_query(f"WITH {TRACKS_SQL} SELECT video_id, frame, a.id AS a, b.id AS b FROM tr a JOIN tr b USING (video_id, frame) WHERE a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 60")
def crowded_pairs(spark: SparkSession, d: str) -> DataFrame:
    return frames.crowded_pairs(_T(spark, d))


@_query(f"WITH {TRACKS_SQL} SELECT video_id, frame, ord FROM fx WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.video_id = fx.video_id AND tr.frame = fx.frame AND tr.x = fx.x AND tr.y = fx.y)")
def unused_detections(spark: SparkSession, d: str) -> DataFrame:
    return frames.unused_detections(_D(spark, d), _T(spark, d)).select("video_id", "frame", "ord")


#: One point after the other: state is the list of clusters (leader's place, best member).
_DEDUP = f"""WITH RECURSIVE {SQL},
p AS (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id, frame ORDER BY ord) AS n, x::FLOAT AS x, y::FLOAT AS y, conf::FLOAT AS conf, track_id FROM fx),
r AS (
  SELECT video_id, frame, n, [{{'lx': x, 'ly': y, 'x': x, 'y': y, 'conf': conf, 'track_id': track_id}}] AS c FROM p WHERE n = 1
  UNION ALL
  SELECT video_id, frame, n, CASE WHEN pos IS NULL THEN list_append(c, {{'lx': x, 'ly': y, 'x': x, 'y': y, 'conf': conf, 'track_id': track_id}})
    WHEN conf > c[pos].conf THEN list_concat(list_concat(c[1:pos-1], [{{'lx': c[pos].lx, 'ly': c[pos].ly, 'x': x, 'y': y, 'conf': conf, 'track_id': track_id}}]), c[pos+1:]) ELSE c END
  FROM (SELECT p.*, r.c, list_position(list_transform(r.c, lambda k: sqrt(((p.x - k.lx) * (p.x - k.lx) + (p.y - k.ly) * (p.y - k.ly))::FLOAT)::FLOAT <= 40::FLOAT), true) AS pos FROM r JOIN p ON p.video_id = r.video_id AND p.frame = r.frame AND p.n = r.n + 1)
),
w AS (SELECT video_id, frame, arg_max(c, n) AS c FROM r GROUP BY ALL)
SELECT video_id, frame, (i - 1)::BIGINT AS ord, k.x::DOUBLE AS x, k.y::DOUBLE AS y, k.track_id AS track_id FROM (SELECT video_id, frame, unnest(c) AS k, generate_subscripts(c, 1) AS i FROM w)"""


@_query(_DEDUP)
def dedup_leaders(spark: SparkSession, d: str) -> DataFrame:
    return clean.dedup_leaders(_D(spark, d), 40.0).drop("conf")


#: Tracked points of _DEDUP's kind, then the four most confident clusters of each frame, from the most confident on.
_CLEAN = _DEDUP.replace("track_id FROM fx)", "track_id FROM fx WHERE track_id <> -1)").replace("SELECT video_id, frame, (i - 1)::BIGINT AS ord, k.x::DOUBLE AS x, k.y::DOUBLE AS y, k.track_id AS track_id FROM (", "SELECT video_id, frame, n - 1 AS ord, k.x::DOUBLE AS x, k.y::DOUBLE AS y, k.track_id AS track_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY k.conf DESC, i) AS n FROM (") + ") WHERE n <= 4"


@_query(_CLEAN)
def clean_within_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cleaning as a stream does it: the boxes of a frame lie in one row."""
    side = lambda c, k: F.col(c).cast("float").alias(f"{c}{k}")
    box = F.struct(side("x", 1), side("y", 1), side("x", 2), side("y", 2), F.col("conf").cast("float").alias("conf"), F.when(F.col("track_id") >= 0, F.col("track_id")).alias("track_id"))
    boxes = _D(spark, d).groupBy("video_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", box.alias("b")))), lambda s: s["b"]).alias("boxes"))
    return clean.clean_frames(boxes, CleanConfig(eps=40.0, objects=2, extra=2)).select("video_id", "frame", F.explode("dets").alias("p")).select("video_id", "frame", "p.ord", "p.x", "p.y", "p.track_id")


@_query(f"WITH {SQL} SELECT video_id, frame, ord, x, y FROM fx")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Detections through CSV files of all videos: the files' order is the detections' order again."""
    path, rows = shared.scratch(spark, "csv"), _D(spark, d)
    tables.write_detections(rows, path)
    videos = sorted(r.video_id for r in rows.select("video_id").distinct().collect())  # four
    return reduce(DataFrame.unionByName, [tables.load_detections(spark, f"{path}/video_id={v}", v) for v in videos])


@_query(f"WITH {TRACKS_SQL} SELECT video_id, frame, id, x, y FROM tr")
def tracks_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared.scratch(spark, "csv")
    tables.write_tracks(_T(spark, d), path)
    return tables.load_tracks(spark, path)


def _streamed(spark, rows: DataFrame, run) -> DataFrame:
    """What a stream makes of rows that come in two parts by frame, a micro-batch each, with its state between them: it stops after the first and goes on."""
    path = shared.scratch(spark, "stream")
    half = rows.agg(F.percentile_approx("frame", 0.5)).first()[0]
    for where in (f"frame <= {half}", f"frame > {half}"):
        rows.where(where).write.mode("append").parquet(f"{path}/in")
        made = run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        q = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out")


@_query(f"WITH {TRACKS_SQL} SELECT video_id, id, frame, coalesce(lead(frame) OVER w, -1) AS next_frame, coalesce(lead(x) OVER w, -1) AS next_x, coalesce(frame - lag(frame) OVER w - 1, 0) AS missed FROM tr WINDOW w AS (PARTITION BY video_id, id ORDER BY frame)")
def track_lead_gap(spark: SparkSession, d: str) -> DataFrame:
    return tracks.gaps(_T(spark, d)).select("video_id", "id", "frame", F.coalesce("next_frame", F.lit(-1)).cast("long").alias("next_frame"), F.coalesce("next_x", F.lit(-1.0)).alias("next_x"), "missed")


@_query(f"""WITH {TRACKS_SQL}, g AS (SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM tr WINDOW w AS (PARTITION BY video_id, id ORDER BY frame)),
e AS (SELECT *, unnest(range(0, coalesce(nf - frame, 1))) AS k FROM g)
SELECT video_id, id, frame + k AS frame, CASE WHEN k = 0 THEN x ELSE x + (k::DOUBLE / (nf - frame)) * (nx - x) END AS x, CASE WHEN k = 0 THEN y ELSE y + (k::DOUBLE / (nf - frame)) * (ny - y) END AS y FROM e""")
def interpolate_tracks(spark: SparkSession, d: str) -> DataFrame:
    return tracks.interpolate(_T(spark, d))


ORACLES["stream_gaps"] = ORACLES["interpolate_tracks"]


@_query()
def stream_gaps(spark: SparkSession, d: str) -> DataFrame:
    """interpolate_tracks over a stream."""
    return _streamed(spark, _T(spark, d), interpolate_stream)


@_query(f"""WITH {TRACKS_SQL}, t AS (SELECT video_id, id, frame, string_agg(trunc(x)::INT || ':' || trunc(y)::INT, ' ') OVER (PARTITION BY video_id, id ORDER BY frame ROWS 4 PRECEDING) AS trail FROM tr) SELECT * FROM t""")
def trail_rows(spark: SparkSession, d: str) -> DataFrame:
    shown = F.array_join(F.transform("trail", lambda p: F.concat(p["x"].cast("string"), F.lit(":"), p["y"].cast("string"))), " ")
    return tracks.trails(_T(spark, d), 5).select("video_id", "id", "frame", shown.alias("trail"))


@_query(f"WITH {TRACKS_SQL} SELECT video_id, id, max(m)::BIGINT AS longest_miss, count(*) AS n FROM (SELECT video_id, id, coalesce(frame - lag(frame) OVER (PARTITION BY video_id, id ORDER BY frame) - 1, 0) AS m FROM tr) GROUP BY ALL")
def miss_runs(spark: SparkSession, d: str) -> DataFrame:
    return tracks.miss_runs(_T(spark, d))


@_query(f"""WITH RECURSIVE {TRACKS_SQL}, s AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id, id ORDER BY frame) AS n, x - lag(x) OVER (PARTITION BY video_id, id ORDER BY frame) AS dx, y - lag(y) OVER (PARTITION BY video_id, id ORDER BY frame) AS dy FROM tr),
r AS (SELECT video_id, id, 1::BIGINT AS n, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM s WHERE n = 1 UNION ALL SELECT s.video_id, s.id, s.n, (1 - 0.7::DOUBLE) * vx + 0.7::DOUBLE * dx, (1 - 0.7::DOUBLE) * vy + 0.7::DOUBLE * dy FROM r JOIN s ON s.video_id = r.video_id AND s.id = r.id AND s.n = r.n + 1)
SELECT video_id, id, round(arg_max(vx, n), 6) AS vx, round(arg_max(vy, n), 6) AS vy FROM r GROUP BY ALL HAVING max(n) > 1""")
def velocity_ema(spark: SparkSession, d: str) -> DataFrame:
    return tracks.velocities(_T(spark, d)).select("video_id", "id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


@_query(f"WITH {SQL}, u AS (SELECT *, 0 AS run FROM fx UNION ALL SELECT *, 1 FROM fx WHERE track_id <> -1) SELECT video_id, frame, row_number() OVER (PARTITION BY video_id, frame ORDER BY run, ord) - 1 AS ord, x, y FROM u")
def latest_k_union(spark: SparkSession, d: str) -> DataFrame:
    p = _D(spark, d)
    return tracks.appended(p, clean.drop_untracked(p)).select("video_id", "frame", "ord", "x", "y")


def _reid(spark, d, predictor, objects, gate=1000.0):
    found = reid.reid(_D(spark, d), ReidConfig(objects=objects, predictor=predictor, max_move=gate), strict=False)
    return found.withColumn("id", F.col("id").cast("long"))


def reid_sql(predictor: str, gate: float) -> str:
    """Two objects by a recursive query: each step takes the cheapest of all pairs of a detection, or none, for either."""
    plain = predictor != "damped_velocity"
    spine = "SELECT video_id, frame FROM fx JOIN st USING (video_id) WHERE frame > f0 GROUP BY ALL" if plain else "SELECT video_id, unnest(range(f0 + 1, f1 + 1)) AS frame FROM st"
    names = [f"{k}{i}" for i in (0, 1) for k in ("x", "y", "p", "q", "m")]
    first = ", ".join(f"max(CASE WHEN n = {i + 1} THEN x END) AS x{i}, max(CASE WHEN n = {i + 1} THEN y END) AS y{i}, {'NULL::DOUBLE' if plain else '0.0::DOUBLE'} AS p{i}, {'NULL::DOUBLE' if plain else '0.0::DOUBLE'} AS q{i}, 0::BIGINT AS m{i}" for i in (0, 1))
    cost, extra = [], ""
    for i, t in ((0, "a"), (1, "b")):
        if predictor == "damped_velocity":
            k = f"((1 - pow(0.9::DOUBLE, r.m{i} + 1)) / (1 - 0.9::DOUBLE))"
            off = f"sqrt(pow({t}.x - (r.x{i} + r.p{i} * {k}), 2) + pow({t}.y - (r.y{i} + r.q{i} * {k}), 2))"
            speed = f"sqrt(r.p{i} * r.p{i} + r.q{i} * r.q{i})"
            way = f"sqrt(pow({t}.x - r.x{i}, 2) + pow({t}.y - r.y{i}, 2))"
            limit = f"greatest(50, least(130 + 2 * {speed}, 600))"
            turn = f"CASE WHEN {speed} < 1 OR {way} < 1 THEN 0 ELSE 1 - (r.p{i} * ({t}.x - r.x{i}) + r.q{i} * ({t}.y - r.y{i})) / ({speed} * {way}) END"
            cost.append(f"CASE WHEN {t}.ord < 0 THEN 1e6 ELSE ({off} + ({turn}) * {limit} * 2.0)::FLOAT::DOUBLE END")
            extra += f" AND ({t}.ord < 0 OR (r.m{i} <= 60 AND {off} <= {limit}))"
        else:
            px = f"coalesce(r.x{i} + (r.x{i} - r.p{i}), r.x{i})" if predictor == "constant_velocity" else f"r.x{i}"
            py = f"coalesce(r.y{i} + (r.y{i} - r.q{i}), r.y{i})" if predictor == "constant_velocity" else f"r.y{i}"
            off = f"sqrt(({t}.x - {px}) * ({t}.x - {px}) + ({t}.y - {py}) * ({t}.y - {py}))"
            cost.append(f"CASE WHEN {t}.ord < 0 THEN 1e6 ELSE {off} END")
            extra += f" AND ({t}.ord < 0 OR {off} <= {gate})"
    state = []
    for i, t in ((0, "a"), (1, "b")):
        hit = f"best.{t}o >= 0"
        if plain:
            state.append(f"CASE WHEN {hit} THEN best.{t}x ELSE x{i} END AS x{i}, CASE WHEN {hit} THEN best.{t}y ELSE y{i} END AS y{i}, CASE WHEN {hit} THEN x{i} ELSE p{i} END AS p{i}, CASE WHEN {hit} THEN y{i} ELSE q{i} END AS q{i}, CASE WHEN {hit} THEN 0 ELSE m{i} + 1 END AS m{i}")
        else:
            v = "CASE WHEN {hit} THEN (1 - 0.7::DOUBLE) * {p} + 0.7::DOUBLE * (best.{t}{c} - {c}{i}) ELSE {p} * 0.95::DOUBLE END AS {p}"
            state.append(f"CASE WHEN {hit} THEN best.{t}x ELSE x{i} END AS x{i}, CASE WHEN {hit} THEN best.{t}y ELSE y{i} END AS y{i}, {v.format(hit=hit, p=f'p{i}', t=t, c='x', i=i)}, {v.format(hit=hit, p=f'q{i}', t=t, c='y', i=i)}, CASE WHEN {hit} THEN 0 ELSE m{i} + 1 END AS m{i}")
    return f"""WITH RECURSIVE {SQL},
st AS (SELECT video_id, min(frame) FILTER (n >= 2) AS f0, max(frame) AS f1 FROM (SELECT video_id, frame, count(*) AS n FROM fx GROUP BY ALL) GROUP BY video_id HAVING f0 IS NOT NULL),
fr AS (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS s FROM ({spine})),
o AS (SELECT fr.video_id, s, ord, x, y FROM fx JOIN fr USING (video_id, frame) UNION ALL SELECT video_id, s, -1, NULL, NULL FROM fr),
r AS (
  SELECT video_id, 0::BIGINT AS s, {first} FROM (SELECT fx.*, row_number() OVER (PARTITION BY video_id ORDER BY {"ord" if plain else "y, ord"}) AS n FROM fx JOIN st USING (video_id) WHERE frame = f0) GROUP BY video_id
  UNION ALL
  SELECT video_id, s + 1 AS s, {", ".join(state)} FROM (
    SELECT r.video_id, r.s, {", ".join(f"r.{n}" for n in names)}, arg_min({{'ao': a.ord, 'ax': a.x, 'ay': a.y, 'bo': b.ord, 'bx': b.x, 'by': b.y}}, {cost[0]} + {cost[1]}) AS best
    FROM r JOIN o a ON a.video_id = r.video_id AND a.s = r.s + 1 JOIN o b ON b.video_id = r.video_id AND b.s = r.s + 1
    WHERE (a.ord <> b.ord OR a.ord < 0){extra}
    GROUP BY r.video_id, r.s, {", ".join(f"r.{n}" for n in names)}
  )
)
SELECT r.video_id, coalesce(fr.frame, st.f0) AS frame, i::BIGINT AS id, CASE WHEN i = 0 THEN x0 ELSE x1 END AS x, CASE WHEN i = 0 THEN y0 ELSE y1 END AS y
FROM r JOIN st USING (video_id) LEFT JOIN fr ON fr.video_id = r.video_id AND fr.s = r.s JOIN (VALUES (0), (1)) v(i) ON true WHERE CASE WHEN i = 0 THEN m0 ELSE m1 END = 0"""


@_query(reid_sql("constant_velocity", 1000))
def reid_constant_velocity_n2(spark: SparkSession, d: str) -> DataFrame:
    return _reid(spark, d, "constant_velocity", 2)


@_query(reid_sql("constant_velocity", 100))
def reid_constant_velocity_tight_n2(spark: SparkSession, d: str) -> DataFrame:
    return _reid(spark, d, "constant_velocity", 2, 100.0)


@_query(reid_sql("last_position", 100))
def reid_last_position_n2(spark: SparkSession, d: str) -> DataFrame:
    return _reid(spark, d, "last_position", 2, 100.0)


@_query(reid_sql("damped_velocity", 0))
def reid_damped_n2(spark: SparkSession, d: str) -> DataFrame:
    return _reid(spark, d, "damped_velocity", 2)


@_query()
def reid_constant_velocity_n10(spark: SparkSession, d: str) -> DataFrame:
    return _reid(spark, d, "constant_velocity", 10)


@_query()
def reid_last_position_n10(spark: SparkSession, d: str) -> DataFrame:
    return _reid(spark, d, "last_position", 10)


@_query()
def reid_damped_n10(spark: SparkSession, d: str) -> DataFrame:
    return _reid(spark, d, "damped_velocity", 10)


def _segmented(spark, d, predictor, gate=1000.0):
    config = ReidConfig(objects=2, predictor=predictor, max_move=gate)
    return segments.reid_segmented(_D(spark, d), config, frames_per_segment=120, warm_up=24, every=4, strict=False)[0].withColumn("id", F.col("id").cast("long"))


@_query(reid_sql("constant_velocity", 100))
def segmented_constant_velocity_n2(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d, "constant_velocity", 100.0)


@_query(reid_sql("last_position", 100))
def segmented_last_position_n2(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d, "last_position", 100.0)


@_query(reid_sql("damped_velocity", 0))
def segmented_damped_n2(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d, "damped_velocity")


@_query(reid_sql("damped_velocity", 0))
def stream_reid_damped_n2(spark: SparkSession, d: str) -> DataFrame:
    """reid_damped_n2 over a stream of frames, empty ones too."""
    p = _D(spark, d)
    spine = frames.spine(frames.last_frames(p).selectExpr("video_id", "0L as start_frame", "last_frame"))
    nested = frames.frame_arrays(p, spine).select("video_id", "frame", "dets")
    return _streamed(spark, nested, lambda s: reid_stream(s, ReidConfig(objects=2, predictor="damped_velocity"))).withColumn("id", F.col("id").cast("long"))


def certified_sql(objects: int, damped: bool) -> str:
    """Every step after the start frame, with nothing broken; damped tracks step through empty frames too."""
    spine = "SELECT video_id, unnest(range(f0 + 1, f1 + 1)) AS frame FROM st" if damped else "SELECT DISTINCT video_id, frame FROM fx JOIN st USING (video_id) WHERE frame > f0"
    broken = ", ".join(f"0::BIGINT AS {c}" for c in ("dear", "unpaid", "positive", "unmatched", "drifted", "wrong"))
    return f"""WITH {SQL},
st AS (SELECT video_id, min(frame) FILTER (n >= {objects}) AS f0, max(frame) AS f1 FROM (SELECT video_id, frame, count(*) AS n FROM fx GROUP BY ALL) GROUP BY video_id HAVING f0 IS NOT NULL),
s AS ({spine})
SELECT s.video_id, s.frame, count(fx.ord) AS detections, {broken} FROM s LEFT JOIN fx USING (video_id, frame) GROUP BY ALL"""


def _certified(spark, d, predictor):
    config = ReidConfig(objects=10, predictor=predictor)
    # read by several checks, so the state machine runs once for it
    proof = shared.written(reid.certificates(_D(spark, d), config), "certificates")
    return reid.violations(proof, reid.reid(_D(spark, d), config, strict=False), config)


@_query(certified_sql(10, False))
def certified_constant_velocity_n10(spark: SparkSession, d: str) -> DataFrame:
    return _certified(spark, d, "constant_velocity")


@_query(certified_sql(10, False))
def certified_last_position_n10(spark: SparkSession, d: str) -> DataFrame:
    return _certified(spark, d, "last_position")


@_query(certified_sql(10, True))
def certified_damped_n10(spark: SparkSession, d: str) -> DataFrame:
    return _certified(spark, d, "damped_velocity")


def _meta(spark, d):
    videos = _D(spark, d).select("video_id").distinct()
    return videos.select("video_id", F.lit(30.0).alias("fps"), F.lit(500).alias("frame_w"), F.lit(500).alias("frame_h"), F.lit(720).cast("long").alias("total_frames"))


def _marks(tracks: DataFrame, spark: SparkSession, d: str, style: str, trail: int) -> DataFrame:
    """A draw list with its nested columns as text."""
    text = lambda c: F.concat_ws(",", *(F.col(c)[k].cast("string") for k in (("b", "g", "r") if c == "color" else ("x1", "y1", "x2", "y2"))))
    line = F.array_join(F.transform("trail", lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return draw.draw_list(tracks, _meta(spark, d), style, trail).select("video_id", "frame", "id", "cx", "cy", "radius", text("color").alias("color"), "label", "label_x", "label_y", text("box").alias("box"), line.alias("trail"))


def _colour_values(n: int) -> str:
    """Colours of the fixture's ids, from the rule itself: a seeded generator, each part 50..255."""
    rows = []
    for i in range(n):
        rng = random.Random(i)
        rows.append(f"({i}, '{','.join(str(rng.randint(50, 255)) for _ in range(3))}')")
    return f"(VALUES {', '.join(rows)}) c(id, color)"


#: Anchors by the unrounded place (boxed), by whole pixels within the frame (plain); frames are 500 x 500, a character 9 x 12.
_BOXED = f"""WITH {TRACKS_SQL}, m AS (SELECT tr.*, color, length(tr.id::VARCHAR) * 9 AS w, trunc(x - length(tr.id::VARCHAR) * 9 / 2.0)::INT AS lx, trunc(y - 12)::INT AS ly FROM tr JOIN {_colour_values(20)} USING (id))
SELECT video_id, frame, id, trunc(x)::INT AS cx, trunc(y)::INT AS cy, 3::INT AS radius, color, id::VARCHAR AS label, lx AS label_x, ly AS label_y,
  greatest(0, lx - 4) || ',' || greatest(0, ly - 12 - 4) || ',' || least(499, lx + w + 4) || ',' || least(499, ly + 4) AS box, '' AS trail FROM m"""

_PLAIN = f"""WITH {TRACKS_SQL}, m AS (SELECT tr.*, color, length('ID: ' || tr.id) * 9 AS w, trunc(x)::INT AS cx, trunc(y)::INT AS cy,
    string_agg(trunc(x)::INT || ':' || trunc(y)::INT, ' ') OVER l AS line, count(*) OVER l AS n FROM tr JOIN {_colour_values(20)} USING (id) WINDOW l AS (PARTITION BY video_id, tr.id ORDER BY frame ROWS 4 PRECEDING))
SELECT video_id, frame, id, cx, cy, 3::INT AS radius, color, 'ID: ' || id AS label, greatest(0, least(cx + 5, 500 - w - 1))::INT AS label_x, greatest(14, least(cy - 5, 499))::INT AS label_y, '' AS box, CASE WHEN n > 1 THEN line ELSE '' END AS trail FROM m"""


@_query(_BOXED)
def draw_list(spark: SparkSession, d: str) -> DataFrame:
    return _marks(_T(spark, d), spark, d, "boxed", 0)


@_query(_PLAIN)
def draw_list_plain(spark: SparkSession, d: str) -> DataFrame:
    return _marks(_T(spark, d), spark, d, "plain", 5)


@_query(f"WITH {SQL} SELECT video_id, count(DISTINCT frame) AS frames FROM fx GROUP BY ALL")
def frame_totals(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_totals(_D(spark, d))


@_query(f"WITH {TRACKS_SQL} SELECT video_id, frame, string_agg(id || ':' || trunc(x)::INT, ' ' ORDER BY id) AS tracks FROM tr GROUP BY ALL")
def tracks_by_frame(spark: SparkSession, d: str) -> DataFrame:
    shown = F.array_join(F.transform("tracks", lambda t: F.concat_ws(":", t["id"].cast("string"), t["x"].cast("int").cast("string"))), " ")
    return tracks.by_frame(_T(spark, d)).select("video_id", "frame", shown.alias("tracks"))


_STATES = "SELECT video_id, frame, id, x, y, coalesce(x - lag(x) OVER w, 0) AS vx, coalesce(y - lag(y) OVER w, 0) AS vy, coalesce(frame - lag(frame) OVER w - 1, 0) AS miss FROM tr WINDOW w AS (PARTITION BY video_id, id ORDER BY frame)"


@_query(f"""WITH {TRACKS_SQL}, s AS ({_STATES}), p AS (SELECT *, (1 - pow(0.9::DOUBLE, miss + 1)) / (1 - 0.9::DOUBLE) AS k, sqrt(vx * vx + vy * vy) AS speed FROM s WHERE miss <= 60),
c AS (SELECT p.video_id, p.frame, p.id, fx.ord, speed, vx, vy, fx.x - p.x AS dx, fx.y - p.y AS dy, sqrt(pow(fx.x - (p.x + vx * k), 2) + pow(fx.y - (p.y + vy * k), 2)) AS dist, greatest(50, least(130 + 2 * speed, 600)) AS reach FROM p JOIN fx USING (video_id, frame)),
a AS (SELECT *, sqrt(dx * dx + dy * dy) AS way FROM c WHERE dist <= reach)
SELECT video_id, frame, id, ord, round(dist + 2.0::DOUBLE * reach * CASE WHEN speed < 1 OR way < 1 THEN 0 ELSE 1 - (vx * dx + vy * dy) / (speed * way) END, 5) AS cost FROM a""")
def damped_candidates(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("video_id", "id").orderBy("frame")
    moved = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    states = _T(spark, d).select("video_id", "frame", "id", "x", "y", moved("x").alias("vx"), moved("y").alias("vy"), F.coalesce(F.col("frame") - F.lag("frame").over(w) - 1, F.lit(0)).alias("miss"))
    return frames.damped_candidates(states, _D(spark, d)).withColumn("cost", F.round("cost", 5))


@_query(f"WITH {SQL} SELECT video_id, frame, trunc(frame / 720.0::DOUBLE * 100)::INT AS percent, CASE WHEN video_id = 0 THEN 30.0::DOUBLE ELSE video_id * 10.0::DOUBLE END AS fps FROM (SELECT DISTINCT video_id, frame FROM fx)")
def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.frame_counts(_D(spark, d))
    return rows.select("video_id", "frame", scalars.percent(F.col("frame"), F.lit(720)).alias("percent"), scalars.frames_per_second(F.col("video_id") * F.lit(10.0)).alias("fps"))


@_query(f"WITH {TRACKS_SQL}, s AS (SELECT video_id, unnest(range(0, max(frame) + 1)) AS frame FROM fx GROUP BY video_id) SELECT s.video_id, s.frame, 'Count: ' || count(tr.id) AS text, 20::INT AS x, 40::INT AS y, 1.0::DOUBLE AS scale, '0,255,0' AS color FROM s LEFT JOIN tr USING (video_id, frame) GROUP BY ALL")
def frame_overlay(spark: SparkSession, d: str) -> DataFrame:
    p = _D(spark, d)
    rows = draw.overlays(frames.spine(frames.last_frames(p).withColumn("start_frame", F.lit(0).cast("long"))), _T(spark, d))
    return rows.withColumn("color", F.concat_ws(",", *(F.col("color")[k].cast("string") for k in "bgr")))
