"""Reels: videos kept as Parquet, a row for each frame, where no codec is at hand. A decoder, a writer of segments and their joining.

A folder of reels has meta/video_id=N (one row: fps, frame_w, frame_h, total_frames) and frames/video_id=N (files of consecutive frames, numbered in their
order). The path of a video is folder/N, its decoder DECODER. Frames that were drawn on carry what was drawn as JSON beside the image; no pixel is changed.
Workers reach the folder by its path or through Arrow's file systems.
"""

from __future__ import annotations

import bisect
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

DECODER = "driftwork.sources.reels:reels"
#: Rows that a reader or a segment's writer holds, and bytes of images, beyond one image.
BATCH, BYTES = 64, 4 << 20
_DRAWN = pa.schema([("frame", pa.int64()), ("image", pa.binary()), ("marks", pa.string()), ("texts", pa.string())])


def write_reels(images: DataFrame, meta: DataFrame, path: str) -> None:
    """images(video_id, frame, image) and meta(video_id, fps, frame_w, frame_h, total_frames) as reels.

    Frames are dealt by ranges, so a video may take many tasks and files. Of rows that share a frame one is read back; a frame without a row, or without
    an image, is read back empty. Row groups are small, since tasks read ranges of frames.
    """
    rows = images.select("video_id", "frame", "image").where("video_id is not null and frame is not null").orderBy("video_id", "frame")
    rows.write.partitionBy("video_id").mode("overwrite").option("parquet.block.size", 8 << 20).option("parquet.block.size.row.check.min", 4).option("parquet.page.size.row.check.min", 4).parquet(f"{path}/frames")
    meta.select("video_id", "fps", "frame_w", "frame_h", "total_frames").write.partitionBy("video_id").mode("overwrite").parquet(f"{path}/meta")


def _files(path: str, kind: str) -> tuple[fs.FileSystem, list[str]]:
    """Files of one kind of a video's path, in their order."""
    folder, _, video = path.rstrip("/").rpartition("/")
    store, inner = fs.FileSystem.from_uri(f"{folder}/{kind}/video_id={video}")
    found = [f.path for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.base_name.startswith("part-")]
    return store, sorted(found, key=lambda f: (int(posixpath.basename(f).split("-")[1].split(".")[0]), f))


def _few(file: str, store: fs.FileSystem) -> int:
    """Rows of a file that take some megabytes."""
    footer = pq.read_metadata(file, filesystem=store)
    size = sum(footer.row_group(k).total_byte_size for k in range(footer.num_row_groups))
    return max(1, min(BATCH, BYTES * footer.num_rows // max(1, size)))


class Reels:
    """The decoder of reels, see video.py."""

    @staticmethod
    def probe(path: str):
        store, files = _files(path, "meta")
        rows = ds.dataset(files, filesystem=store, format="parquet").to_table().to_pylist() if files else []
        if not rows:
            raise FileNotFoundError(path)
        return tuple(rows[0][k] for k in ("fps", "frame_w", "frame_h", "total_frames"))

    @staticmethod
    def read(path: str, first: int, stop: int) -> Iterator[bytes]:
        store, files = _files(path, "frames")

        def begins(file: str) -> int:
            footer = pq.read_metadata(file, filesystem=store)
            return footer.row_group(0).column(footer.schema.names.index("frame")).statistics.min if footer.num_rows else stop

        # few footers of many files are read: the one in which the range begins is looked for, and none after its end
        at, wanted = max(0, bisect.bisect_right(files, first, key=begins) - 1), first
        inside = (ds.field("frame") >= first) & (ds.field("frame") < stop)
        for file in files[at:]:
            if begins(file) >= stop:
                break
            part = ds.dataset(file, filesystem=store, format="parquet")
            for batch in part.to_batches(columns=["frame", "image"], filter=inside, batch_size=_few(file, store), batch_readahead=1, use_threads=False):
                for frame, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if frame < wanted:
                        continue
                    yield from (b"" for _ in range(frame - wanted))
                    yield image.as_py() or b""
                    wanted = frame + 1
        yield from (b"" for _ in range(stop - wanted))


reels = Reels()


class _Segment:
    """A segment's file. It gets its name when it is whole, so a task that is run again leaves the same one."""

    def __init__(self, path: str, first: int, video: int, segment: int, fps: float, width: int, height: int):
        self.store, inner = fs.FileSystem.from_uri(f"{path}/frames/video_id={video}")
        self.store.create_dir(inner)
        self.final, self.made = f"{inner}/part-{segment:05d}.parquet", f"{inner}/_{uuid.uuid4().hex}"
        size = {"fps": str(fps), "frame_w": str(width), "frame_h": str(height)}
        self.out = pq.ParquetWriter(self.made, _DRAWN.with_metadata(size), filesystem=self.store)
        self.frame, self.rows, self.held = first, [], 0

    def write(self, image: bytes, marks: list[dict], texts: list[dict]) -> None:
        self.rows.append({"frame": self.frame, "image": image, "marks": json.dumps(marks), "texts": json.dumps(texts)})
        self.frame += 1
        self.held += len(image)
        if len(self.rows) == BATCH or self.held >= BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.rows:
            self.out.write_table(pa.Table.from_pylist(self.rows, self.out.schema))
            self.rows, self.held = [], 0

    def close(self) -> str:
        self._flush()
        self.out.close()
        if self.store.get_file_info(self.final).type == fs.FileType.File:
            self.store.delete_file(self.made)  # another run of this task was first
        else:
            self.store.move(self.made, self.final)
        return self.final


def segments_of(path: str, frames_per_segment: int) -> Callable:
    """start(video_id, segment, fps, frame_w, frame_h) for video.write_segments: segments of drawn reels in an empty folder."""
    size = max(1, int(frames_per_segment))
    return lambda video, segment, *shape: _Segment(path, segment * size, video, segment, *shape)


def joined_in(path: str) -> Callable[[int, list[str]], str]:
    """join(video_id, names) for video.join_segments: the segments lie in their places already, so the video's row is written; its path is returned."""

    def join(video: int, names: list[str]) -> str:
        store, inner = fs.FileSystem.from_uri(f"{path}/meta/video_id={video}")
        first, last = (pq.read_metadata(n, filesystem=store) for n in (names[0], names[-1]))
        told = {k.decode(): v.decode() for k, v in (first.metadata or {}).items()}
        at = last.schema.names.index("frame")
        total = 1 + max(last.row_group(i).column(at).statistics.max for i in range(last.num_row_groups))
        row = {"fps": [float(told["fps"])], "frame_w": [int(told["frame_w"])], "frame_h": [int(told["frame_h"])], "total_frames": [total]}
        schema = pa.schema([("fps", pa.float64()), ("frame_w", pa.int32()), ("frame_h", pa.int32()), ("total_frames", pa.int64())])
        store.create_dir(inner)
        pq.write_table(pa.table(row, schema), f"{inner}/part-00000.parquet", filesystem=store)
        return f"{path}/{video}"

    return join
