"""Trails over a stream of tracks: each point with the last whole-pixel points of its track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ROWS = "video_id long, frame long, id int, x double, y double, trail array<struct<x:int,y:int>>"
_STATE = "frame long, xs array<int>, ys array<int>"


def trail_stream(tracks: DataFrame, length: int = 30) -> DataFrame:
    """tracks(video_id, frame, id, x, y) with trail, in append mode; equal to the batch's trails.

    State is a track's last `length` points. Points of a micro-batch are put in order; one at or before the track's last frame is dropped.
    """
    length = max(1, int(length))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, xs, ys = state.get if state.exists else (None, [], [])
        line = list(zip(xs, ys, strict=True))
        out = []
        for r in pd.concat(list(batches)).sort_values("frame", kind="stable").itertuples(index=False):
            if seen is not None and r.frame <= seen:
                continue
            line = [*line, (int(r.x), int(r.y))][-length:]
            seen = int(r.frame)
            out.append((int(key[0]), seen, int(key[1]), r.x, r.y, [{"x": x, "y": y} for x, y in line]))
        state.update((seen, [x for x, _ in line], [y for _, y in line]))
        yield pd.DataFrame(out, columns=["video_id", "frame", "id", "x", "y", "trail"])

    rows = tracks.select("video_id", "frame", F.col("id").cast("int").alias("id"), "x", "y")
    return rows.groupBy("video_id", "id").applyInPandasWithState(step, _ROWS, _STATE, "append", GroupStateTimeout.NoTimeout)
