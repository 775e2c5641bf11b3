"""Detections made of the events table: hours are frames, four videos, values are places. The same in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwork import shared
from driftwork.sources.reels import write_reels


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(
        (F.col("user_id") % 4).alias("video_id"),
        F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("frame"),
        "ts", "event_id",
        F.col("value").alias("x"),
        (F.lit(5.0) * F.get_json_object("props", "$.k").cast("double")).alias("y"),
        (((F.col("event_id") * 37) % 100) / F.lit(100.0)).alias("conf"),
        F.when(F.col("event_type") == "error", F.lit(-1)).otherwise((F.col("user_id") % 20).cast("int")).alias("track_id"),
    )
    order = Window.partitionBy("video_id", "frame").orderBy("ts", "event_id")
    return rows.withColumn("ord", (F.row_number().over(order) - 1).cast("long")).select("video_id", "frame", "ord", "x", "y", "conf", "track_id")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain tracks for what needs no tracker: each user group's first event of an hour."""
    e = detections(spark, sf_dir).where("track_id >= 0")
    first = Window.partitionBy("video_id", "track_id", "frame").orderBy("ord")
    return e.withColumn("n", F.row_number().over(first)).where("n = 1").select("video_id", "frame", F.col("track_id").alias("id"), "x", "y")


SQL = """fx AS (
  SELECT user_id % 4 AS video_id, (epoch_us(ts) // 3600000000 - 473352)::BIGINT AS frame,
         row_number() OVER (PARTITION BY user_id % 4, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) - 1 AS ord,
         value AS x, 5.0::DOUBLE * json_extract_string(props, '$.k')::DOUBLE AS y, ((event_id * 37) % 100) / 100.0::DOUBLE AS conf,
         CASE WHEN event_type = 'error' THEN -1 ELSE (user_id % 20)::INT END AS track_id
  FROM events
)"""

TRACKS_SQL = SQL + """, tr AS (
  SELECT video_id, frame, track_id AS id, x, y
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id, frame ORDER BY ord) AS n FROM fx WHERE track_id >= 0) WHERE n = 1
)"""


def reels(spark: SparkSession, sf_dir: str) -> tuple[str, list[int]]:
    """The fixture's videos as reels in the shared folder, and their numbers: a frame's image is the JSON list of its detections, and video 0 tells no speed."""
    path, rows = shared.scratch(spark, "reels"), detections(spark, sf_dir)
    points = F.array_sort(F.collect_list(F.struct("ord", "x", "y", "conf", "track_id")))
    meta = rows.groupBy("video_id").agg((F.max("frame") + 1).alias("total_frames")).select("video_id", (F.col("video_id") * 10.0).alias("fps"), F.lit(500).alias("frame_w"), F.lit(500).alias("frame_h"), "total_frames")
    write_reels(rows.groupBy("video_id", "frame").agg(F.to_json(points).cast("binary").alias("image")), meta, path)
    return path, sorted(r.video_id for r in spark.read.parquet(f"{path}/meta").select("video_id").collect())  # a row for each video


def _boxes(image: bytes, confidence: float) -> list[tuple]:
    points = json.loads(image) if image else []
    return [(p["x"] - 2, p["y"] - 3, p["x"] + 2, p["y"] + 3, p["conf"], p["track_id"]) for p in points if p["conf"] >= confidence]


def point_model():
    """A detector for the reels: boxes around the points that are sure enough."""
    return lambda images, confidence, **_: [[(*b[:5], None) for b in _boxes(i, confidence)] for i in images]


class PointTracker:
    """A tracker for the reels: it numbers what it sees by how much it has seen; what the fixture leaves untracked has no number."""

    def __init__(self, _name: str = ""):
        self.seen = 0

    def __call__(self, image, confidence, **_):
        found = _boxes(image, confidence)
        self.seen += len(found)
        return [(*b[:5], None if b[5] < 0 else self.seen - len(found) + i + 1) for i, b in enumerate(found)]

    def save(self) -> bytes:
        return str(self.seen).encode()

    def restore(self, saved: bytes) -> None:
        self.seen = int(saved)


#: What the detector sees of the fixture, under its name: centres of boxes in single precision; the rest is in `raw`.
SEEN_SQL = SQL.replace("fx AS (", "raw AS (", 1) + """, fx AS (
  SELECT video_id, frame, row_number() OVER (PARTITION BY video_id, frame ORDER BY ord) - 1 AS ord, ((x - 2)::FLOAT::DOUBLE + (x + 2)::FLOAT::DOUBLE) / 2.0 AS x,
         ((y - 3)::FLOAT::DOUBLE + (y + 3)::FLOAT::DOUBLE) / 2.0 AS y, conf, CASE WHEN track_id < 0 THEN -1 ELSE row_number() OVER (PARTITION BY video_id ORDER BY frame, ord) END AS track_id
  FROM raw WHERE conf >= 0.15::DOUBLE
)"""
