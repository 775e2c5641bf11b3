"""Finished tracks: gaps, interpolation, trails, velocities, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _track():
    return Window.partitionBy("video_id", "id").orderBy("frame")


def gaps(tracks: DataFrame) -> DataFrame:
    """Each point with the next one of its track, and the missed frames before it."""
    rows = tracks.select("video_id", "id", "frame", "x", "y", F.lead("frame").over(_track()).alias("next_frame"), F.lead("x").over(_track()).alias("next_x"), F.lead("y").over(_track()).alias("next_y"), F.lag("frame").over(_track()).alias("before"))
    return rows.withColumn("missed", F.coalesce(F.col("frame") - F.col("before") - 1, F.lit(0)).cast("long")).drop("before")


def interpolate(tracks: DataFrame) -> DataFrame:
    """Tracks without gaps between their first and last points: straight lines, frame by frame; observed points as they are, those that
    repeat a track's frame too."""
    rows = gaps(tracks).withColumn("gap", F.greatest(F.coalesce(F.col("next_frame") - F.col("frame"), F.lit(1)), F.lit(1)))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gap") - 1)))
    on = lambda a, b: F.when(F.col("k") == 0, F.col(a)).otherwise(F.col(a) + (F.col("k") / F.col("gap")) * (F.col(b) - F.col(a)))
    return rows.select("video_id", "id", (F.col("frame") + F.col("k")).alias("frame"), on("x", "next_x").alias("x"), on("y", "next_y").alias("y"))


def by_frame(tracks: DataFrame) -> DataFrame:
    """One row for each frame that has a track, with its tracks (id, x, y) from the smallest id on."""
    return tracks.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("tracks"))


def trails(tracks: DataFrame, length: int = 30) -> DataFrame:
    """Each point with the last `length` whole-pixel points of its track up to it; gaps do not shorten it."""
    window = _track().rowsBetween(-(max(1, int(length)) - 1), 0)
    return tracks.withColumn("trail", F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))).over(window))


def velocities(tracks: DataFrame, gain: float = 0.7) -> DataFrame:
    """Each track's last smoothed velocity over its steps (not divided by gaps), from zero."""
    steps = tracks.withColumns({"dx": F.col("x") - F.lag("x").over(_track()), "dy": F.col("y") - F.lag("y").over(_track())}).where("dx is not null")
    listed = steps.groupBy("video_id", "id").agg(F.array_sort(F.collect_list(F.struct("frame", "dx", "dy"))).alias("steps"))
    ema = lambda k: F.aggregate("steps", F.lit(0.0), lambda v, s: (1 - gain) * v + gain * s[k])
    return listed.select("video_id", "id", ema("dx").alias("vx"), ema("dy").alias("vy"))


def miss_runs(tracks: DataFrame) -> DataFrame:
    """The longest run of missed frames of each track."""
    return gaps(tracks).groupBy("video_id", "id").agg(F.max("missed").alias("longest_miss"), F.count("*").alias("n"))


def appended(*detections: DataFrame) -> DataFrame:
    """Detections of several runs together, renumbered within each frame in the order given."""
    rows = None
    for k, d in enumerate(detections):
        d = d.withColumn("run", F.lit(k))
        rows = d if rows is None else rows.unionByName(d)
    order = Window.partitionBy("video_id", "frame").orderBy("run", "ord")
    return rows.withColumn("ord", (F.row_number().over(order) - 1).cast("long")).drop("run")
