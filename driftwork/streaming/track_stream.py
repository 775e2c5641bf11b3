"""A detector that tracks, over a stream of frames: its state goes on from micro-batch to micro-batch and over restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftwork.config import DetectorConfig
from driftwork.sources.video import _BOXES, BOXES, _boxes, _settings
from driftwork.streaming.state import in_order, use_rocksdb


class _Track(StatefulProcessor):
    def __init__(self, start: Callable, config: DetectorConfig):
        self.start, self.config = start, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("tracker", "seen long, saved binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        tracker, seen = self.start(self.config.tracker), None
        if self.place.exists():
            seen, saved = self.place.get()
            tracker.restore(bytes(saved))
        settings, out, held = _settings(self.config), [], 0
        images = ((int(f), b"" if i is None else b"+" + i) for pdf in rows for f, i in zip(pdf.frame, pdf.image, strict=True))
        for frame, image in in_order(images):
            if seen is not None and frame <= seen:
                continue
            seen = frame
            out.append((int(key[0]), seen, _boxes(tracker(image[1:] if image else None, **settings))))
            held += 1 + len(out[-1][2])
            if held >= BOXES:
                yield pd.DataFrame(out, columns=["video_id", "frame", "boxes"])
                out, held = [], 0
        self.place.update((seen, tracker.save()))
        yield pd.DataFrame(out, columns=["video_id", "frame", "boxes"])

    def close(self) -> None:
        pass


def track_stream(images: DataFrame, start: Callable[[str], Callable], config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """boxes(video_id, frame, boxes) of a stream of frames(video_id, frame, image), in append mode; every frame has a row, as in the batch.

    start(config.tracker) makes a tracker as for track(); here it also has save(), which gives its state as bytes, and restore(bytes). A video's frames
    of a micro-batch meet in one task, in order; one at or before the last is dropped. Sets the session's state store to RocksDB.
    """
    use_rocksdb(images.sparkSession)
    return images.select("video_id", "frame", "image").groupBy("video_id").transformWithStateInPandas(_Track(start, config), _BOXES, "Append", "None")
