"""Gaps of tracks filled over a stream: straight lines from each point to the next, once the next has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ROWS = "video_id long, id int, frame long, x double, y double"


def interpolate_stream(tracks: DataFrame) -> DataFrame:
    """tracks(video_id, frame, id, x, y) without gaps, in append mode; the same rows as interpolate() of the batch.

    State is a track's last point. A point comes out as it comes in, and before it the frames that are missing since the last; so a gap's rows
    are late by the gap, and after a track's last point there is nothing. Points of a micro-batch are put in order; one before the track's last
    frame is dropped.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        video, number = int(key[0]), int(key[1])
        last, out = (state.get if state.exists else None), []
        for r in pd.concat(list(batches)).sort_values("frame", kind="stable").itertuples(index=False):
            now = int(r.frame)
            if last is not None:
                if now < last[0]:
                    continue
                gap = now - last[0]
                out += [(video, number, last[0] + k, last[1] + (k / gap) * (r.x - last[1]), last[2] + (k / gap) * (r.y - last[2])) for k in range(1, gap)]
            last = (now, float(r.x), float(r.y))
            out.append((video, number, *last))
        state.update(last)
        yield pd.DataFrame(out, columns=["video_id", "id", "frame", "x", "y"]).astype({"id": "int32"})

    rows = tracks.select("video_id", "frame", F.col("id").cast("int").alias("id"), "x", "y")
    return rows.groupBy("video_id", "id").applyInPandasWithState(step, _ROWS, "frame long, x double, y double", "append", GroupStateTimeout.NoTimeout)
