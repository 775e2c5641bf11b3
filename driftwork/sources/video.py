"""Videos as Spark data sources over a pluggable decoder, and detection over a pluggable model.

Trackers and video writers are pluggable too. A decoder is named "module:object"; it has probe(path) -> (fps, width, height, frames) and read(path, first, stop) -> images as bytes, in order.
No decoder, model, tracker or writer comes with this package.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from driftwork import schema
from driftwork.config import DetectorConfig
from driftwork.sources import models


#: Bytes of images that a reader or a model's call holds beyond one image, and boxes that are held before they go on.
BYTES, BOXES = 4 << 20, 20_000


def _decoder(name: str):
    module, _, member = name.partition(":")
    return getattr(importlib.import_module(module), member)


class _Range(InputPartition):
    def __init__(self, first: int, stop: int):
        super().__init__((first, stop))
        self.first, self.stop = first, stop


class _Frames(DataSourceReader):
    def __init__(self, options):
        self.path, self.decoder, self.video = options["path"], options["decoder"], int(options.get("video_id", 0))
        self.size = int(options.get("frames_per_partition", 256))

    def partitions(self):
        total = int(_decoder(self.decoder).probe(self.path)[3] or 0)
        size = self.size or max(1, total)
        return [_Range(i, min(i + size, total)) for i in range(0, total, size)] or [_Range(0, 0)]

    def read(self, partition):
        images, held = [], 0
        if partition.stop > partition.first:
            for k, image in enumerate(_decoder(self.decoder).read(self.path, partition.first, partition.stop)):
                images.append(bytes(image))
                held += len(images[-1])
                if held >= BYTES:
                    yield self._batch(partition.first + k + 1, images)
                    images, held = [], 0
            if images:
                yield self._batch(partition.stop, images)

    def _batch(self, stop: int, images: list[bytes]) -> pa.RecordBatch:
        numbers = pa.array(range(stop - len(images), stop), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([self.video] * len(images), pa.int64()), numbers, pa.array(images, pa.binary())], names=["video_id", "frame", "image"])


class _FrameStream(DataSourceStreamReader):
    """Offsets are frame numbers: a micro-batch has the frames from the last one's end to what the decoder now tells that there are."""

    def __init__(self, options):
        self.frames = _Frames(options)

    def initialOffset(self):
        return {"frame": 0}

    def latestOffset(self):
        return {"frame": int(_decoder(self.frames.decoder).probe(self.frames.path)[3] or 0)}

    def partitions(self, start, end):
        first, stop = start["frame"], end["frame"]
        size = self.frames.size or max(1, stop - first)
        return [_Range(i, min(i + size, stop)) for i in range(first, stop, size)]

    def read(self, partition):
        return self.frames.read(partition)

    def commit(self, end):
        pass


class FrameSource(DataSource):
    """format("driftwork_frames") with options path, decoder, video_id, frames_per_partition; partitions are ranges of frames, 0: the whole video.

    As a stream, the video may grow: what the decoder's probe tells as the number of frames is there to be read.
    """

    @classmethod
    def name(cls):
        return "driftwork_frames"

    def schema(self):
        return schema.FRAMES

    def reader(self, schema):
        return _Frames(self.options)

    def streamReader(self, schema):
        return _FrameStream(self.options)


class _Meta(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, _partition):
        fps, width, height, total = _decoder(self.options["decoder"]).probe(self.options["path"])
        yield int(self.options.get("video_id", 0)), float(fps or 30.0), int(width), int(height), int(total or 0)


class MetaSource(DataSource):
    """format("driftwork_video"): one row with fps (30 where unknown), size and number of frames."""

    @classmethod
    def name(cls):
        return "driftwork_video"

    def schema(self):
        return schema.VIDEO_META

    def reader(self, schema):
        return _Meta(self.options)


def frames(spark: SparkSession, path: str, decoder: str, video_id: int = 0, frames_per_partition: int = 256) -> DataFrame:
    """frames(video_id, frame, image); frames_per_partition 0 keeps the video in one partition, in order, as trackers and writers want it."""
    spark.dataSource.register(FrameSource)
    return spark.read.format("driftwork_frames").options(path=path, decoder=decoder, video_id=str(video_id), frames_per_partition=str(frames_per_partition)).load()


def frame_stream(spark: SparkSession, path: str, decoder: str, video_id: int = 0, frames_per_partition: int = 256) -> DataFrame:
    """A stream of frames(video_id, frame, image) that goes on where its checkpoint ends."""
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("driftwork_frames").options(path=path, decoder=decoder, video_id=str(video_id), frames_per_partition=str(frames_per_partition)).load()


def video_meta(spark: SparkSession, path: str, decoder: str, video_id: int = 0) -> DataFrame:
    spark.dataSource.register(MetaSource)
    return spark.read.format("driftwork_video").options(path=path, decoder=decoder, video_id=str(video_id)).load()


_NAMES = ("x1", "y1", "x2", "y2", "conf", "track_id")
_BOXES = "video_id long, frame long, boxes array<struct<x1:float,y1:float,x2:float,y2:float,conf:float,track_id:int>>"


def _gpus() -> int:
    """GPUs that Spark assigned to this task."""
    context = TaskContext.get()
    found = context.resources().get("gpu") if context else None
    return len(found.addresses) if found else 0


def _settings(config: DetectorConfig) -> dict:
    """What a model is called with; the device is the worker's."""
    return {"confidence": config.confidence, "iou": config.iou, "image_size": config.image_size, "agnostic_nms": config.agnostic_nms, "device": config.device(_gpus()), "half": config.half(_gpus())}


def _boxes(found: list | None) -> list[dict]:
    return [dict(zip(_NAMES, b, strict=True)) for b in found or []]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list, list]]:
    """Rows of (video_id, frame, image) as lists, a few megabytes of images or one image at a time: what is found in them takes many times their bytes."""
    for pdf in batches:
        first, held = 0, 0
        for k, image in enumerate(pdf.image):
            held += len(image) if image is not None else 0
            if held >= BYTES or k + 1 == len(pdf):
                part = pdf.iloc[first : k + 1]
                yield list(part.video_id), list(part.frame), list(part.image)
                first, held = k + 1, 0


def detect(images: DataFrame, load: Callable[[], Callable], config: DetectorConfig = DetectorConfig(), counter=None) -> DataFrame:
    """boxes(video_id, frame, boxes) of frames. load() makes a model; it maps a list of images, with the settings of config as
    keywords (confidence, iou, image_size, agnostic_nms, device, half), to lists of (x1, y1, x2, y2, conf, track_id or None).

    A worker holds the model from task to task, until it serves another loader; a closure is as good as a module's function. counter: an accumulator of frames done.
    """
    name = models.name_of(load)

    def run(batches: Iterator) -> Iterator:
        settings = _settings(config)
        for videos, numbers, some in _pieces(batches):
            model = models.held(name, load)
            yield pd.DataFrame({"video_id": videos, "frame": numbers, "boxes": [_boxes(b) for b in model(some, **settings)]})
            if counter is not None:
                counter.add(len(some))

    return images.mapInPandas(run, _BOXES)


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Videos, frames and images of batches; of a batch's images one is taken out at a time."""
    for batch in batches:
        for v, frame, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            yield v, frame, image.as_py()


def _decoded(batches: Iterator[pa.RecordBatch], paths: dict[int, str], decoder: str) -> Iterator[tuple]:
    """Videos, frames and images of rows (video_id, total_frames), as the decoder gives them."""
    for batch in batches:
        for v, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for frame, image in enumerate(_decoder(decoder).read(paths[v], 0, total) if total else ()):
                yield v, frame, bytes(image)


def _followed(rows: Iterator[tuple], start: Callable[[str], Callable], config: DetectorConfig) -> Iterator[tuple[list, list, list]]:
    """Videos, frames and their boxes, some BOXES at a time, of (video, frame, image), of which one is held."""
    video, tracker, settings = None, None, _settings(config)
    videos, numbers, found, held = [], [], [], 0
    for v, frame, image in rows:
        if tracker is None or v != video:
            video, tracker = v, start(config.tracker)
        videos.append(v)
        numbers.append(frame)
        found.append(tracker(image, **settings) or [])
        held += 1 + len(found[-1])
        if held >= BOXES:
            yield videos, numbers, found
            videos, numbers, found, held = [], [], [], 0
    if videos:
        yield videos, numbers, found


def _track(batches: Iterator[pa.RecordBatch], start: Callable[[str], Callable], config: DetectorConfig) -> Iterator[tuple[list, list, list]]:
    """_followed() of batches of images."""
    return _followed(_images(batches), start, config)


def _table(videos: list, numbers: list, found: list[list]) -> pa.RecordBatch:
    """Rows of _BOXES, column by column: a dict for each box would take several times the bytes."""
    ends = pa.array(accumulate(map(len, found), initial=0), pa.int32())
    columns = list(zip(*(b for boxes in found for b in boxes), strict=True)) or [()] * len(_NAMES)
    kinds = {n: pa.int32() if n == "track_id" else pa.float32() for n in _NAMES}
    fields = [pa.array(c, kinds[n], from_pandas=True) for n, c in zip(_NAMES, columns, strict=True)]
    boxes = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=list(_NAMES)))
    return pa.RecordBatch.from_arrays([pa.array(videos, pa.int64()), pa.array(numbers, pa.int64()), boxes], names=["video_id", "frame", "boxes"])


def track(images: DataFrame, start: Callable[[str], Callable], config: DetectorConfig = DetectorConfig(), in_order: bool = False, counter=None) -> DataFrame:
    """boxes(video_id, frame, boxes) of frames by a detector that tracks: every frame has a row, empty ones too.

    start(config.tracker) makes a fresh tracker for each video; it is called with one image after the other, in frame order, with the settings
    as for detect, and keeps its state from frame to frame. in_order: the frames of a video already lie in one partition, in order
    (frames(..., frames_per_partition=0)), so that no image is shuffled. counter: an accumulator of frames done.
    """
    rows = images.select("video_id", "frame", "image")
    rows = rows if in_order else rows.repartition("video_id").sortWithinPartitions("video_id", "frame")

    return rows.mapInArrow(_boxed(lambda batches: _track(batches, start, config), counter), _BOXES)


def track_videos(meta: DataFrame, paths: dict[int, str], decoder: str, start: Callable[[str], Callable], config: DetectorConfig = DetectorConfig(), counter=None) -> DataFrame:
    """boxes(video_id, frame, boxes) as of track(), of the videos of meta, whose paths are by video_id.

    Each task decodes its videos itself, and tracks an image as it is decoded: no image leaves the task, and none but the decoder's own are held.
    """
    return meta.select("video_id", "total_frames").mapInArrow(_boxed(lambda batches: _followed(_decoded(batches, paths, decoder), start, config), counter), _BOXES)


def _boxed(follow: Callable[[Iterator], Iterator], counter) -> Callable[[Iterator], Iterator]:
    """What a task does with its batches: pieces of follow() as rows of _BOXES, counted as they go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in follow(batches):
            yield _table(*found)
            if counter is not None:
                counter.add(len(found[0]))

    return run


def _drawn(marks: DataFrame, overlays: DataFrame) -> DataFrame:
    """(video_id, frame, marks, texts): what is drawn on each frame, as JSON lists."""
    lists = lambda df, name: df.groupBy("video_id", "frame").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*(c for c in df.columns if c not in ("video_id", "frame")))))).alias(name))
    return lists(marks, "marks").join(lists(overlays, "texts"), ["video_id", "frame"], "full")


def _listed(text: str | None) -> list[dict]:
    return json.loads(text) if isinstance(text, str) else []


def write_segments(marks: DataFrame, overlays: DataFrame, meta: DataFrame, paths: dict[int, str], decoder: str, start: Callable, frames_per_segment: int = 256) -> DataFrame:
    """Write the videos of paths (by video_id) in segments, and return (video_id, segment, name); no image leaves the task that decodes it.

    What is drawn is dealt by ranges of frames, and each task decodes its range itself and writes it as a segment of its own. start(video_id, segment, fps,
    frame_w, frame_h) makes a segment's writer; write(image, marks, texts) gets each frame, whatever was found in it; close() ends it and gives the
    segment's name. A task that fails half-way runs again, so start must begin its segment anew. The segments are written once the rows are read.
    """
    size = max(1, int(frames_per_segment))
    spans = meta.select("video_id", "fps", "frame_w", "frame_h", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total_frames") / size) - 1)).alias("segment"), "total_frames").where("total_frames > 0")
    drawn = _drawn(marks, overlays).withColumn("segment", F.floor(F.col("frame") / size))
    rows = spans.join(drawn, ["video_id", "segment"], "left")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        video, segment = int(head.video_id), int(head.segment)
        first, stop = segment * size, min((segment + 1) * size, int(head.total_frames))
        there = {int(f): (m, t) for f, m, t in zip(pdf.frame, pdf.marks, pdf.texts, strict=True) if f == f and f is not None}
        writer = start(video, segment, float(head.fps), int(head.frame_w), int(head.frame_h))
        for k, image in enumerate(_decoder(decoder).read(paths[video], first, stop)):
            writer.write(bytes(image), *map(_listed, there.get(first + k, (None, None))))
        return pd.DataFrame({"video_id": [video], "segment": [segment], "name": [str(writer.close())]})

    return rows.groupBy("video_id", "segment").applyInPandas(write, "video_id long, segment long, name string")


def join_segments(segments: DataFrame, join: Callable[[int, list[str]], str]) -> DataFrame:
    """(video_id, name): join(video_id, names of its segments in order) makes one video of them; names only are moved."""
    listed = segments.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "name"))), lambda s: s["name"]).alias("names"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pd.DataFrame({"video_id": pdf.video_id, "name": [str(join(int(v), list(names))) for v, names in zip(pdf.video_id, pdf.names, strict=True)]})

    return listed.mapInPandas(run, "video_id long, name string")


def write_videos(images: DataFrame, marks: DataFrame, overlays: DataFrame, meta: DataFrame, start: Callable) -> None:
    """Write each video of images with its marks (a draw list) and overlays, frames in order, whatever was found in them.

    start(video_id, fps, frame_w, frame_h) makes a video's writer; write(image, marks, texts) gets each frame with lists of rows as dicts, close()
    ends it. A task that fails half-way runs again, so start must begin the file anew.
    """
    drawn = _drawn(marks, overlays)
    rows = images.select("video_id", "frame", "image").join(drawn, ["video_id", "frame"], "left").join(F.broadcast(meta.select("video_id", "fps", "frame_w", "frame_h")), "video_id")  # a row for each video
    rows = rows.repartition("video_id").sortWithinPartitions("video_id", "frame")

    def run(part: Iterator) -> None:
        video, writer = None, None
        for r in part:
            if writer is None or r.video_id != video:
                if writer is not None:
                    writer.close()
                video, writer = r.video_id, start(r.video_id, r.fps, r.frame_w, r.frame_h)
            writer.write(bytes(r.image), *map(_listed, (r.marks, r.texts)))
        if writer is not None:
            writer.close()

    rows.foreachPartition(run)
