"""Queries over the fixture's videos, kept as reels: scans, detection, tracking, drawing, streams and whole runs, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwork import shared
from driftwork.config import CleanConfig, ReidConfig, RunConfig
from driftwork.operators import clean, draw, frames
from driftwork.plans import fixture, runs
from driftwork.plans.fixture import SEEN_SQL, SQL, TRACKS_SQL
from driftwork.plans.queries import ORACLES, QUERIES, _query, _streamed, reid_sql
from driftwork.sources import reels, tables, video
from driftwork.streaming.track_stream import track_stream
from driftwork.streaming.trail_stream import trail_stream

_SPINE = "s AS (SELECT video_id, unnest(range(0, max(frame) + 1)) AS frame FROM raw GROUP BY video_id)"


def _all(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _videos(spark: SparkSession, d: str, scan) -> DataFrame:
    """scan(path, video_id) of each video of the fixture."""
    path, ids = fixture.reels(spark, d)
    return _all(scan(f"{path}/{v}", v) for v in ids)


@_query(f"WITH {SQL} SELECT video_id, CASE WHEN video_id = 0 THEN 30.0::DOUBLE ELSE video_id * 10.0::DOUBLE END AS fps, 500::INT AS frame_w, 500::INT AS frame_h, max(frame) + 1 AS total_frames FROM fx GROUP BY video_id")
def video_probe(spark: SparkSession, d: str) -> DataFrame:
    return _videos(spark, d, lambda path, v: video.video_meta(spark, path, reels.DECODER, v))


@_query(f"WITH {SQL}, s AS (SELECT video_id, unnest(range(0, max(frame) + 1)) AS frame FROM fx GROUP BY video_id) SELECT s.video_id, s.frame, count(fx.ord) AS n, round(coalesce(sum(fx.conf), 0), 6) AS conf FROM s LEFT JOIN fx USING (video_id, frame) GROUP BY ALL")
def video_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every frame of every video, by ranges of 50; what its image shows."""
    images = _videos(spark, d, lambda path, v: video.frames(spark, path, reels.DECODER, v, 50))
    points = F.coalesce(F.from_json(F.col("image").cast("string"), "array<struct<conf:double>>"), F.array().cast("array<struct<conf:double>>"))
    shown = images.withColumn("p", points)
    return shown.select("video_id", "frame", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, p: a + p["conf"]), 6).alias("conf"))


@_query(f"WITH {SEEN_SQL} SELECT video_id, frame, ord, x, y, conf::FLOAT::DOUBLE AS conf FROM fx")
def video_detections(spark: SparkSession, d: str) -> DataFrame:
    images = _videos(spark, d, lambda path, v: video.frames(spark, path, reels.DECODER, v, 100))
    return clean.box_centroids(video.detect(images, fixture.point_model)).select("video_id", "frame", "ord", "x", "y", F.col("conf").cast("double").alias("conf"))


_TRACKED = f"WITH {SEEN_SQL}, {_SPINE} SELECT s.video_id, s.frame, coalesce(ord, -1) AS ord, coalesce(x, -1) AS x, coalesce(y, -1) AS y, coalesce(track_id, -1)::BIGINT AS track_id FROM s LEFT JOIN fx USING (video_id, frame)"


def _tracked(boxes: DataFrame) -> DataFrame:
    """Boxes as rows; a frame without any has one row of -1."""
    rows = boxes.select("video_id", "frame", F.posexplode_outer("boxes").alias("ord", "b"))
    middle = lambda a, b: F.coalesce((F.col(f"b.{a}").cast("double") + F.col(f"b.{b}").cast("double")) / 2, F.lit(-1.0))
    return rows.select("video_id", "frame", F.coalesce("ord", F.lit(-1)).cast("long").alias("ord"), middle("x1", "x2").alias("x"), middle("y1", "y2").alias("y"), F.coalesce("b.track_id", F.lit(-1)).cast("long").alias("track_id"))


@_query(_TRACKED)
def video_tracked(spark: SparkSession, d: str) -> DataFrame:
    """A tracker whose numbers depend on all frames before; frames without boxes have rows too."""
    return _tracked(_videos(spark, d, lambda path, v: video.track_videos(video.video_meta(spark, path, reels.DECODER, v), {v: path}, reels.DECODER, fixture.PointTracker)))


@_query(_TRACKED)
def stream_video_tracked(spark: SparkSession, d: str) -> DataFrame:
    """video_tracked, its frames as a stream in two micro-batches."""
    images = _videos(spark, d, lambda path, v: video.frames(spark, path, reels.DECODER, v, 100))
    return _tracked(_streamed(spark, images, lambda s: track_stream(s, fixture.PointTracker)))


@_query(f"WITH {SEEN_SQL} SELECT video_id, frame, track_id::BIGINT AS track_id, x, y, conf::FLOAT::DOUBLE AS conf FROM fx WHERE track_id <> -1")
def tracker_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tracker output through its CSV files."""
    boxes = _videos(spark, d, lambda path, v: video.track_videos(video.video_meta(spark, path, reels.DECODER, v), {v: path}, reels.DECODER, fixture.PointTracker))
    path = shared.scratch(spark, "csv")
    tables.write_tracker(clean.drop_untracked(clean.box_centroids(boxes)), path)
    rows = spark.read.option("header", True).option("basePath", path).schema("frame long, track_id long, x double, y double, conf float, video_id long").csv(path)
    return rows.select("video_id", "frame", "track_id", "x", "y", F.col("conf").cast("double").alias("conf"))


@_query(f"""WITH {TRACKS_SQL}, s AS (SELECT video_id, unnest(range(0, max(frame) + 1)) AS frame FROM fx GROUP BY video_id),
p AS (SELECT video_id, frame, count(*) AS n FROM fx GROUP BY ALL)
SELECT s.video_id, s.frame, coalesce(any_value(p.n), 0) AS n, coalesce(string_agg(tr.id || ':' || trunc(x)::INT || ':' || trunc(y)::INT, ' ' ORDER BY tr.id), '') AS marks, 'Count: ' || count(tr.id) AS text
FROM s LEFT JOIN p USING (video_id, frame) LEFT JOIN tr USING (video_id, frame) GROUP BY ALL""")
def video_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The fixture's tracks drawn on its videos, in segments of 100 frames that are joined to new reels; the new reels by their decoder, with what was drawn."""
    path, ids = fixture.reels(spark, d)
    made, found = shared.scratch(spark, "drawn"), fixture.tracks(spark, d)
    meta = _all(video.video_meta(spark, f"{path}/{v}", reels.DECODER, v) for v in ids)
    numbers = frames.spine(meta.selectExpr("video_id", "0L as start_frame", "total_frames - 1 as last_frame"))
    parts = video.write_segments(draw.draw_list(found, meta), draw.overlays(numbers, found), meta, {v: f"{path}/{v}" for v in ids}, reels.DECODER, reels.segments_of(made, 100), 100)
    names = {r.video_id: r.name for r in video.join_segments(parts, reels.joined_in(made)).collect()}  # a row for each video
    images = _all(video.frames(spark, name, reels.DECODER, v, 70) for v, name in names.items())
    drawn = spark.read.parquet(f"{made}/frames").select("video_id", "frame", F.from_json("marks", "array<struct<id:long,cx:int,cy:int>>").alias("marks"), F.from_json("texts", "array<struct<text:string>>").alias("texts"))
    shown = F.array_join(F.transform("marks", lambda m: F.concat_ws(":", *(m[k].cast("string") for k in ("id", "cx", "cy")))), " ")
    count = F.coalesce(F.json_array_length(F.col("image").cast("string")), F.lit(0)).cast("long")
    return images.join(drawn.withColumn("video_id", F.col("video_id").cast("long")), ["video_id", "frame"]).select("video_id", "frame", count.alias("n"), shown.alias("marks"), F.col("texts")[0]["text"].alias("text"))


ORACLES["stream_trails"] = ORACLES["trail_rows"]


@_query()
def stream_trails(spark: SparkSession, d: str) -> DataFrame:
    """trail_rows over a stream."""
    shown = F.array_join(F.transform("trail", lambda p: F.concat(p["x"].cast("string"), F.lit(":"), p["y"].cast("string"))), " ")
    rows = _streamed(spark, fixture.tracks(spark, d), lambda s: trail_stream(s, 5))
    return rows.select("video_id", F.col("id").cast("long").alias("id"), "frame", shown.alias("trail"))


@_query(f"WITH {SQL} SELECT video_id, frame, ord, x, y FROM fx")
def csv_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Detections of CSV files with other columns, another order, names in capitals with blanks, and rows of empty cells between."""
    path, rows = shared.scratch(spark, "csv"), fixture.detections(spark, d)
    cells = rows.select("video_id", "frame", "ord", F.explode(F.array(F.lit(True), F.lit(False))).alias("full")).where("full or ord % 3 = 0")
    cells = cells.join(rows.select("video_id", "frame", "ord", "x", "y", "conf"), ["video_id", "frame", "ord"])
    cell = lambda c: F.when(F.col("full"), F.col(c).cast("string")).alias(f" {c.upper()} ")
    cells.orderBy("video_id", "frame", "ord", "full").select("video_id", cell("y"), cell("conf"), cell("frame"), cell("x")).write.partitionBy("video_id").mode("overwrite").option("header", True).csv(path)
    ids = [r.video_id for r in rows.select("video_id").distinct().collect()]  # a row for each video
    return _all(tables.load_detections(spark, f"{path}/video_id={v}", v) for v in ids)


def _run(spark: SparkSession, d: str, kind: str, config: ReidConfig, **more) -> DataFrame:
    """Tracks of a whole run over every video, with all its files."""
    path, ids = fixture.reels(spark, d)
    found = []
    for v in ids:
        own = shared.scratch(spark, f"run-{v}")
        settings = RunConfig(model_path="points", video_path=f"{path}/{v}", raw_path=f"{own}/raw", tracks_path=f"{own}/tracks", interpolated_path=f"{own}/filled", frames_per_task=200)
        model = fixture.PointTracker if kind == "online" else fixture.point_model
        parts = runs.Parts(reels.DECODER, model, reels.segments_of(f"{own}/drawn", settings.frames_per_task), reels.joined_in(f"{own}/drawn"))
        made = runs.run(spark, kind, settings, parts, config, video_id=v, **more)
        # what was filled holds the tracks, what was drawn has as many frames as the video
        held = made.tracks if made.filled is None else made.tracks.join(made.filled, ["video_id", "frame", "id", "x", "y"], "left_semi")
        drawn = video.video_meta(spark, made.video, reels.DECODER, v).select("video_id", F.col("total_frames").alias("drawn_frames"))
        found.append(held.join(drawn, "video_id").withColumn("id", F.col("id").cast("long")))
    return _all(found)


def _run_sql(predictor: str, gate: float, where: str = "") -> str:
    """reid_sql over what the detector sees, with the length of the drawn video."""
    seen = reid_sql(predictor, gate).replace(SQL, SEEN_SQL.replace("FROM raw WHERE", f"FROM raw WHERE {where}"))
    return f"SELECT t.*, v.drawn_frames FROM ({seen}) t JOIN (WITH {SQL} SELECT video_id, max(frame) + 1 AS drawn_frames FROM fx GROUP BY video_id) v USING (video_id)"


@_query(_run_sql("constant_velocity", 1000))
def run_offline_n2(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "offline", ReidConfig(objects=2))


@_query(_run_sql("last_position", 100))
def run_interactive_n2(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "interactive", ReidConfig(objects=2, predictor="last_position", max_move=100.0))


@_query(_run_sql("damped_velocity", 0, "track_id >= 0 AND "))
def run_online_n2(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "online", ReidConfig(objects=2, predictor="damped_velocity"), cleaning=CleanConfig(objects=2, dedup=False))


__all__ = ["ORACLES", "QUERIES"]
