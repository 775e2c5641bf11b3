"""Runs from their settings: a video is read, its detections, tracks and filled tracks are written, and what is drawn goes to a new video.

Each table is written once and read back for what follows, so no model runs twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from driftwork.config import CleanConfig, DetectorConfig, ReidConfig, RunConfig
from driftwork.operators import clean, draw, frames, reid, tracks
from driftwork.sources import progress, tables, video

#: What the three kinds of run take if nothing else is said: predictor, objects, style of the labels.
KINDS = {"offline": ("constant_velocity", 10, "boxed"), "interactive": ("last_position", 19, "plain"), "online": ("damped_velocity", 10, "boxed")}


@dataclass
class Parts:
    """What a run plugs in. model: offline and interactive, load() of a detector; online, start(name) of a tracker. writer, join: of segments; None: no video."""

    decoder: str
    model: Callable
    writer: Callable | None = None
    join: Callable | None = None
    report: Callable[[str, int, int], None] | None = None


@dataclass
class Result:
    meta: DataFrame
    detections: DataFrame
    tracks: DataFrame
    filled: DataFrame | None
    marks: DataFrame
    video: str | None


def _detections(spark: SparkSession, kind: str, config: RunConfig, parts: Parts, detector: DetectorConfig, cleaning: CleanConfig, video_id: int, meta: DataFrame, total: int) -> DataFrame:
    """The saved detections where they are wanted, else those of the model, which are saved."""
    folder = f"{config.raw_path}/video_id={video_id}"
    if config.use_existing:
        return tables.detections_or(spark, folder, None, video_id=video_id)
    mode = "overwrite" if config.overwrite_raw else "error"
    with progress.BatchProgress(spark, parts.report or (lambda *_: None), total, config.report_every, "detection") as p:
        if kind == "online":
            boxes = video.track_videos(meta, {video_id: config.video_path}, parts.decoder, parts.model, detector, p.frames)
            tables.write_tracker(clean.clean(clean.box_centroids(boxes), cleaning), config.raw_path, mode)
        else:
            boxes = video.detect(video.frames(spark, config.video_path, parts.decoder, video_id, config.frames_per_task), parts.model, detector, counter=p.frames)
            tables.write_detections(clean.box_centroids(boxes), config.raw_path, mode)
    return tables.detections_or(spark, folder, None, video_id=video_id)


def run(spark: SparkSession, kind: str, config: RunConfig, parts: Parts, reid_config: ReidConfig | None = None, detector: DetectorConfig = DetectorConfig(), cleaning: CleanConfig | None = None, video_id: int = 0) -> Result:
    """One run of a kind (offline, interactive, online) over one video, by its settings.

    A video in which no frame has enough detections is an error, before anything is matched. parts.report is told of progress while the model,
    the matching and the video's writer run.
    """
    predictor, objects, style = KINDS[kind]
    config = config.checked() if not config.use_existing else config
    reid_config = reid_config or ReidConfig(objects=objects, predictor=predictor)
    cleaning = cleaning or replace(CleanConfig(), objects=reid_config.objects)
    meta = video.video_meta(spark, config.video_path, parts.decoder, video_id)
    total = int(meta.first().total_frames)
    detections = _detections(spark, kind, config, parts, detector, cleaning, video_id, meta, total)
    frames.checked_start_frames(detections, reid_config.objects).collect()  # a row: one video
    watch = lambda phase: progress.BatchProgress(spark, parts.report or (lambda *_: None), total, config.report_every, phase)
    with watch("matching"):
        tables.write_tracks(reid.reid(detections, reid_config), config.tracks_path)
    found, filled = tables.load_tracks(spark, config.tracks_path), None
    if config.interpolate and kind != "online":
        tables.write_tracks(tracks.interpolate(found), config.interpolated_path)
        filled = tables.load_tracks(spark, config.interpolated_path)
    marks = draw.draw_list(found, meta, style, config.trail_length if config.trails else 0)
    name = None
    if parts.writer:
        numbers = frames.spine(meta.selectExpr("video_id", "0L as start_frame", "total_frames - 1 as last_frame").where("last_frame >= 0"))
        with watch("drawing"):
            written = video.write_segments(marks, draw.overlays(numbers, found), meta, {video_id: config.video_path}, parts.decoder, parts.writer, config.frames_per_task)
            done = video.join_segments(written, parts.join).collect() if parts.join else []  # a row: one video
        name = done[0].name if done else None
    return Result(meta, detections, found, filled, marks, name)
