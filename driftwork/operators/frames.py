"""Frame-level aggregates, spines, seeds and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwork.config import ReidConfig
from driftwork.functions import scalars


def frame_counts(detections: DataFrame) -> DataFrame:
    """Detections of each frame that has any."""
    return detections.groupBy("video_id", "frame").agg(F.count("*").alias("n"))


def frame_arrays(detections: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """One row for each frame with its detections in order. With frames (video_id, frame), empty frames have an empty array."""
    columns = [c for c in ("ord", "x", "y", "conf", "track_id") if c in detections.columns]
    found = detections.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("dets"))
    if frames is None:
        return found
    return frames.select("video_id", "frame").join(found, ["video_id", "frame"], "left").withColumn("dets", F.coalesce("dets", F.array().cast(found.schema["dets"].dataType)))


def start_frames(detections: DataFrame, objects: int) -> DataFrame:
    """The first frame of each video with at least so many detections."""
    return frame_counts(detections).where(F.col("n") >= objects).groupBy("video_id").agg(F.min("frame").alias("start_frame"))


def checked_start_frames(detections: DataFrame, objects: int) -> DataFrame:
    """As start_frames, with an error for a video that has none."""
    starts = detections.groupBy("video_id").agg(F.count("*").alias("any")).join(start_frames(detections, objects), "video_id", "left")
    return starts.select("video_id", F.coalesce("start_frame", F.raise_error(F.lit(f"no frame with at least {objects} detections")).cast("long")).alias("start_frame"))


def frame_totals(frames: DataFrame) -> DataFrame:
    """Number of frames of each video, whether or not anything was found in them; no frame at all is an error of the run."""
    return frames.groupBy("video_id").agg(F.count_distinct("frame").alias("frames"))


def last_frames(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id").agg(F.max("frame").alias("last_frame"))


def spine(limits: DataFrame, first: str = "start_frame", last: str = "last_frame") -> DataFrame:
    """Every frame from first to last of each video."""
    return limits.select("video_id", F.explode(F.sequence(first, last)).alias("frame"))


def counts_on_spine(detections: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Each frame from 0 to the last, with its number of detections (or of placed tracks); 0 where there is none."""
    frames = spine(last_frames(detections).withColumn("start_frame", F.lit(0).cast("long")))
    return frames.join(frame_counts(tracks if tracks is not None else detections), ["video_id", "frame"], "left").select("video_id", "frame", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def after_start(detections: DataFrame, starts: DataFrame) -> DataFrame:
    """Detections of frames after the start frame."""
    return detections.join(starts, "video_id").where("frame > start_frame").drop("start_frame")


def seeds(detections: DataFrame, objects: int, by_y: bool = False) -> DataFrame:
    """Ids 0.. of the start frame's first detections, in detector order or from small to large y."""
    order = Window.partitionBy("video_id").orderBy(*(["y", "ord"] if by_y else ["ord"]))
    there = detections.join(start_frames(detections, objects), "video_id").where("frame = start_frame")
    return there.withColumn("id", (F.row_number().over(order) - 1).cast("long")).where(F.col("id") < objects).select("video_id", "frame", "id", "x", "y")


def candidates(tracks: DataFrame, detections: DataFrame, max_move: float) -> DataFrame:
    """Pairs of a predicted track and a detection of the same frame within reach (the limit included)."""
    pairs = tracks.select("video_id", "frame", "id", F.col("x").alias("px"), F.col("y").alias("py")).join(detections.select("video_id", "frame", "ord", "x", "y"), ["video_id", "frame"])
    return pairs.withColumn("cost", scalars.distance(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where(F.col("cost") <= max_move).select("video_id", "frame", "id", "ord", "cost")


def damped_candidates(states: DataFrame, detections: DataFrame, config: ReidConfig = ReidConfig(predictor="damped_velocity")) -> DataFrame:
    """Pairs of a track's state (video_id, frame, id, x, y, vx, vy, miss) and a detection of that frame which the damped predictor would
    weigh against each other, with their cost: distance from the damped prediction within a gate that grows with speed, and a price for turning."""
    steps, speed = scalars.damped_steps(F.col("miss"), config.damping), scalars.distance(F.col("vx"), F.col("vy"))
    reach = scalars.gate(speed, config.base_gate, config.gate_speed, config.min_gate, config.max_gate)
    active = states.where(F.col("miss") <= config.max_miss).select("video_id", "frame", "id", F.col("x").alias("lx"), F.col("y").alias("ly"), "vx", "vy", (F.col("x") + F.col("vx") * steps).alias("px"), (F.col("y") + F.col("vy") * steps).alias("py"), reach.alias("reach"))
    pairs = active.join(detections.select("video_id", "frame", "ord", "x", "y"), ["video_id", "frame"])
    pairs = pairs.withColumn("off", scalars.distance(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where("off <= reach")
    turn = scalars.direction_cost(F.col("vx"), F.col("vy"), F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))
    return pairs.select("video_id", "frame", "id", "ord", (F.col("off") + turn * F.col("reach") * config.direction_weight).alias("cost"))


def crowded_pairs(tracks: DataFrame, limit: float = 60.0) -> DataFrame:
    """Pairs of tracks of a frame nearer than limit (an analysis; no tracker uses it)."""
    a = tracks.select("video_id", "frame", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = tracks.select("video_id", "frame", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = scalars.distance(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return a.join(b, ["video_id", "frame"]).where((F.col("a") < F.col("b")) & (near < limit)).select("video_id", "frame", "a", "b")


def unused_detections(detections: DataFrame, tracks: DataFrame) -> DataFrame:
    """Detections where no track was placed."""
    return detections.join(tracks.select("video_id", "frame", "x", "y"), ["video_id", "frame", "x", "y"], "left_anti")
