"""What a worker holds of images does not grow with the video."""

import pandas as pd
import pyarrow as pa
import pytest

from driftwork.operators import segments
from driftwork.plans.video_queries import QUERIES
from driftwork.sources import reels, video
from driftwork.streaming.state import in_order
from test_queries import SF


class Big:
    def probe(self, _path):
        return 25.0, 64, 48, 40

    def read(self, _path, first, stop):
        return (bytes([k]) * (1 << 20) for k in range(first, stop))


big = Big()


def test_a_reader_holds_some_megabytes():
    read = video._Frames({"path": "", "decoder": "test_memory:big", "frames_per_partition": "0"})
    batches = list(read.read(read.partitions()[0]))
    assert max(b.nbytes for b in batches) < 6 << 20
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["frame"] for r in rows] == list(range(40)) and all(r["image"] == bytes([r["frame"]]) * (1 << 20) for r in rows)


def test_models_get_some_megabytes():
    pdf = pd.DataFrame({"video_id": 1, "frame": range(40), "image": [b"x" * (1 << 20)] * 39 + [None]})
    pieces = list(video._pieces([pdf, pdf[:0]]))
    assert [f for p in pieces for f in p[1]] == list(range(40)) and max(len(p[2]) for p in pieces) == 4


def test_a_tracker_s_boxes_go_on_in_pieces():
    """Also where images are small and have many boxes."""
    batch = pa.RecordBatch.from_pydict({"video_id": [1] * 40 + [2], "frame": [*range(40), 0], "image": [b"x"] * 39 + [None, b"y"]})
    start = lambda _name: lambda image, **_: [(0.5, 1, 2, 3, 0.25, None if k else 7) for k in range(5000)] if image else None
    pieces = list(video._track([batch, batch[:0]], start, video.DetectorConfig()))
    assert max(sum(map(len, p[2])) for p in pieces) <= video.BOXES + 5000
    tables = [video._table(*p) for p in pieces]
    rows = [r for t in tables for r in t.to_pylist()]
    assert [(r["video_id"], r["frame"]) for r in rows] == [(1, k) for k in range(40)] + [(2, 0)]
    assert [len(r["boxes"]) for r in rows] == [5000] * 39 + [0, 5000]
    assert rows[40]["boxes"][:2] == [{"x1": 0.5, "y1": 1.0, "x2": 2.0, "y2": 3.0, "conf": 0.25, "track_id": k} for k in (7, None)]
    assert video._table([1], [0], [[]]).to_pylist() == [{"video_id": 1, "frame": 0, "boxes": []}]


class Counted:
    """Five images of each video, decoded as they are asked for."""

    given = 0

    def read(self, path, first, stop):
        for k in range(first, stop):
            Counted.given += 1
            yield memoryview(path.encode() * (k + 1))


counted = Counted()


def test_a_tracker_gets_an_image_as_it_is_decoded():
    """No image is waiting, whatever the video's length."""
    ahead, seen = [], []

    def start(_name):
        def call(image, **_):
            seen.append(image)
            ahead.append(Counted.given - len(seen))
            return [(0, 0, 1, 1, 0.5, len(seen))] if len(seen) % 2 else None

        return call

    meta = pa.RecordBatch.from_pydict({"video_id": [7, 8, 9], "total_frames": [5, 0, 5]})
    (videos, numbers, found), = video._followed(video._decoded([meta], {7: "a", 8: "b", 9: "c"}, f"{__name__}:counted"), start, video.DetectorConfig())
    assert ahead == [0] * 10 and seen == [c * k for c in (b"a", b"c") for k in range(1, 6)]
    assert videos == [7] * 5 + [9] * 5 and numbers == [*range(5)] * 2 and [len(b) for b in found] == [1, 0] * 5


def test_images_stay_in_the_task_that_decodes_them(spark):
    plan = QUERIES["video_tracked"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "image" not in plan


def test_an_online_run_moves_no_images(spark, monkeypatch):
    def frames(*_):
        raise AssertionError("images as rows")

    monkeypatch.setattr(video, "frames", frames)
    assert QUERIES["run_online_n2"](spark, SF).count()


def test_frames_in_order_through_a_file():
    assert list(in_order([(3, b"c"), (1, b"a"), (3, b"d"), (2, b"")])) == [(1, b"a"), (2, b""), (3, b"c"), (3, b"d")]


def test_rows_of_a_file_by_their_bytes(spark, tmp_path):
    rows = spark.range(40).selectExpr("0L as video_id", "id as frame", "cast(repeat(cast(uuid() as string), 30000) as binary) as image")
    reels.write_reels(rows, spark.sql("select 0L as video_id, 25D as fps, 64 as frame_w, 48 as frame_h, 40L as total_frames"), f"file://{tmp_path}")
    store, files = reels._files(f"file://{tmp_path}/0", "frames")
    assert max(reels._few(f, store) for f in files) <= 8
    assert [len(i) for i in reels.reels.read(f"file://{tmp_path}/0", 0, 40)] == [36 * 30000] * 40


def test_a_segment_s_frames_go_on_as_they_come():
    """Of a segment's points only the last frame is held, whatever the segment's length."""
    taken, done = 0, []

    def batches():
        nonlocal taken
        for k in range(50):
            taken += 1
            n = 10
            yield pa.RecordBatch.from_pydict({"video_id": [1] * n, "segment": [0] * n, "frame": [k] * n, "ord": [*range(n)], "x": [1.0] * n, "y": [float(k)] * n, "kind": [segments._POINT] * n, "id": [0] * n, "state": pa.nulls(n, pa.list_(pa.float64()))})

    class One:
        rows = []

        def points(self, frame, points, warm):
            done.append((frame, len(points), taken - frame))

        def end(self):
            pass

    list(segments._segments(batches(), lambda *_: One()))
    assert [d[:2] for d in done] == [(k, 10) for k in range(50)] and max(d[2] for d in done) <= 2
