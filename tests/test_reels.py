"""Reels: ranges of frames over several files, frames that are missing, segments that are written twice."""

import pytest
from pyspark.sql import functions as F

from driftwork.sources import reels, video


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two videos of 40 frames; of video 1 the frames 7, 8 and from 35 on are missing, frame 9 has no image."""
    path = f"file://{tmp_path_factory.mktemp('reels')}"
    rows = spark.range(80).select((F.col("id") % 2).alias("video_id"), F.floor(F.col("id") / 2).alias("frame"))
    rows = rows.where("video_id = 0 or frame not in (7, 8) and frame < 35").withColumn("image", F.when((F.col("video_id") == 0) | (F.col("frame") != 9), F.encode(F.col("frame").cast("string"), "utf-8")))
    meta = spark.sql("select id as video_id, 25D * id as fps, 64 as frame_w, 48 as frame_h, 40L as total_frames from range(2)")
    reels.write_reels(rows, meta, path)
    return path


def expected(v, first, stop):
    return [b"" if v == 1 and (k in (7, 8, 9) or k >= 35) else str(k).encode() for k in range(first, stop)]


@pytest.mark.parametrize("span", [(0, 40), (0, 1), (7, 9), (8, 10), (5, 36), (36, 40), (39, 40), (12, 12)])
@pytest.mark.parametrize("v", [0, 1])
def test_any_range(folder, v, span):
    assert list(reels.reels.read(f"{folder}/{v}", *span)) == expected(v, *span)


def test_frames_and_meta_by_spark(spark, folder):
    for v in (0, 1):
        rows = video.frames(spark, f"{folder}/{v}", reels.DECODER, v, 7).orderBy("frame").collect()
        assert [(r.video_id, r.frame, bytes(r.image)) for r in rows] == [(v, k, i) for k, i in enumerate(expected(v, 0, 40))]
    assert video.video_meta(spark, f"{folder}/0", reels.DECODER, 0).first().fps == 30.0
    assert video.video_meta(spark, f"{folder}/1", reels.DECODER, 1).first().fps == 25.0
    with pytest.raises(FileNotFoundError):
        reels.reels.probe(f"{folder}/2")


def test_only_footers_near_the_range_are_read(spark, tmp_path, monkeypatch):
    rows = spark.range(640).repartition(7).select(F.lit(0).cast("long").alias("video_id"), F.col("id").alias("frame"), F.encode(F.col("id").cast("string"), "utf-8").alias("image"))
    path = f"file://{tmp_path}"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        reels.write_reels(rows, spark.sql("select 0L as video_id, 25D as fps, 64 as frame_w, 48 as frame_h, 640L as total_frames"), path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(list((tmp_path / "frames" / "video_id=0").glob("part-*"))) > 40
    read, inner = [], reels.pq.read_metadata
    monkeypatch.setattr(reels.pq, "read_metadata", lambda f, **k: read.append(f) or inner(f, **k))
    assert list(reels.reels.read(f"{path}/0", 300, 310)) == [str(k).encode() for k in range(300, 310)]
    assert len(read) < 16


def test_a_segment_written_twice_is_one(tmp_path):
    start, path = reels.segments_of(f"file://{tmp_path}", 100), f"file://{tmp_path}"
    names = []
    for segment, n in ((0, 100), (0, 100), (1, 30)):
        writer = start(5, segment, 25.0, 64, 48)
        for k in range(n):
            writer.write(str(segment * 100 + k).encode(), [{"id": k}], [])
        names.append(writer.close())
    abandoned = start(5, 1, 25.0, 64, 48)  # a task that ends half-way leaves no segment
    abandoned.write(b"x", [], [])
    assert names[0] == names[1] != names[2]
    assert reels.joined_in(path)(5, [names[0], names[2]]) == f"{path}/5"
    assert reels.reels.probe(f"{path}/5") == (25.0, 64, 48, 130)
    assert list(reels.reels.read(f"{path}/5", 90, 130)) == [str(k).encode() for k in range(90, 130)]
