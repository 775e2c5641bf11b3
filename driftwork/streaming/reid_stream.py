"""Stable identities over a stream of frames, with the batch tracker's state machine.

The stream has one row for each frame, with its detections as an array (empty frames too), so a frame is whole by construction. State is typed:
a list with a row for each object of a video, and where the video is. So it can be read as a table (format "statestore") and outlives
changes of the tracker's class. Frames of a micro-batch are put in order; a frame at or before the last one is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftwork.config import ReidConfig
from driftwork.operators.reid import _TRACKS, Tracker, Video
from driftwork.streaming.state import in_order, use_rocksdb

#: seen: the last frame that came; frame: the last one that the tracker stepped to, null until it has started.
_PLACE = "seen long, frame long"
_OBJECT = "x double, y double, before_x double, before_y double, vx double, vy double, miss long"


def _table(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["video_id", "frame", "id", "x", "y"]).astype({"video_id": "int64", "frame": "int64", "id": "int32", "x": float, "y": float})


class _Reid(StatefulProcessor):
    def __init__(self, config: ReidConfig, tracker: type[Tracker]):
        self.config, self.tracker = config, tracker

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place, self.objects = handle.getValueState("place", _PLACE), handle.getListState("objects", _OBJECT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        seen, frame = self.place.get() if self.place.exists() else (None, None)
        held = [tuple(r) for r in self.objects.get()] if frame is not None else []
        video = Video(self.config, self.tracker.of(self.config, frame, held))
        out = []
        # x and y of a frame's points, which are 16 bytes each; a frame's are held at once
        packed = ((int(f), np.stack([np.asarray(x, float), np.asarray(y, float)]).tobytes()) for pdf in rows for f, x, y in zip(pdf.frame, pdf.x, pdf.y, strict=True))
        for now, data in in_order(packed):
            if seen is not None and now <= seen:
                continue
            out += [(int(key[0]), now, *row) for row in video.feed(now, np.frombuffer(data).reshape(2, -1).T)]
            seen = now
            if len(out) >= 20_000:
                yield _table(out)
                out = []
        self.place.update((seen, video.tracker.frame))
        if video.tracker.started:
            self.objects.put(video.tracker.rows())
        yield _table(out)

    def close(self) -> None:
        pass


def reid_stream(frames: DataFrame, config: ReidConfig = ReidConfig(), tracker: type[Tracker] = Tracker) -> DataFrame:
    """tracks from a stream of frames(video_id, frame, dets array<struct<ord, x, y, ...>>), in append mode.

    Coordinates must be finite numbers, as in the batch. For damped_velocity every frame must come, since missing ones age the tracks; frames that are
    skipped count as empty. tracker: another class with the same rows() and of(). Sets the session's state store to RocksDB.
    """
    use_rocksdb(frames.sparkSession)
    points = F.array_sort(F.transform("dets", lambda d: F.struct(d["ord"].alias("ord"), d["x"].cast("double").alias("x"), d["y"].cast("double").alias("y"))))
    rows = frames.select("video_id", "frame", points.alias("p")).select("video_id", "frame", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return rows.groupBy("video_id").transformWithStateInPandas(_Reid(config, tracker), _TRACKS, "Append", "None")
