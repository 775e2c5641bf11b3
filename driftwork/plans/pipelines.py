"""Whole runs, from detections to tracks, interpolated tracks and draw lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from driftwork.config import CleanConfig, ReidConfig
from driftwork.operators import clean, draw, reid, tracks


@dataclass
class Run:
    tracks: DataFrame
    interpolated: DataFrame | None
    marks: DataFrame


def offline(detections: DataFrame, meta: DataFrame, config: ReidConfig = ReidConfig(objects=10)) -> Run:
    """Constant velocity, interpolation, boxed labels; what is drawn is not interpolated."""
    found = reid.reid(detections, config)
    return Run(found, tracks.interpolate(found), draw.draw_list(found, meta))


def interactive(detections: DataFrame, meta: DataFrame, config: ReidConfig = ReidConfig(objects=19, predictor="last_position"), trail: int = 30) -> Run:
    """Last position, interpolation, plain labels with trails."""
    found = reid.reid(detections, config)
    return Run(found, tracks.interpolate(found), draw.draw_list(found, meta, style="plain", trail=trail))


def online(points: DataFrame, meta: DataFrame, config: ReidConfig = ReidConfig(objects=10, predictor="damped_velocity"), cleaning: CleanConfig = CleanConfig()) -> Run:
    """Tracker output is cleaned, then matched anew by place alone; no interpolation."""
    found = reid.reid(clean.clean(points, cleaning), config)
    return Run(found, None, draw.draw_list(found, meta))
