"""CSV binding, sinks, frame source, detector, stream equal to batch."""

import os
import time
from dataclasses import replace

import fake_video
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwork.config import CleanConfig, DetectorConfig, ReidConfig, RunConfig
from driftwork.operators import clean, draw, frames
from driftwork.operators.reid import Tracker, reid
from driftwork.operators.tracks import interpolate, trails
from driftwork.plans import fixture, runs
from driftwork.sources import progress, tables, video
from driftwork.streaming.gap_stream import interpolate_stream
from driftwork.streaming.reid_stream import reid_stream
from driftwork.streaming.track_stream import track_stream
from driftwork.streaming.trail_stream import trail_stream


def load(spark, tmp_path, text):
    p = tmp_path / "d.csv"
    p.write_text(text)
    return [(r.frame, r.ord, r.x, r.y) for r in tables.load_detections(spark, str(p)).orderBy("frame", "ord").collect()]


def test_bound_by_name(spark, tmp_path):
    assert load(spark, tmp_path, "y, X ,conf,FRAME,x\n1.5,7,0.5,2,9\n\n,,,,\n 2.5 ,8,0.1,1,9\n3.5,6,0.1,2,9\n") == [(1, 0, 8.0, 2.5), (2, 0, 7.0, 1.5), (2, 1, 6.0, 3.5)]


@pytest.mark.parametrize("text", ["frame,x\n1,2\n", "frame,x,y\n1,2\n", "frame,x,y\n1,2,z\n", "frame,x,y\n3.0,1,2\n", "frame,x,y\n3,nan,2\n"])
def test_bad_files(spark, tmp_path, text):
    with pytest.raises(Exception):
        load(spark, tmp_path, text)


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_detections(spark, str(tmp_path / "none.csv"))
    assert tables.detections_or(spark, str(tmp_path / "none.csv"), lambda: 5, must_exist=False) == 5


def test_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(0, 2, 0, 1e7, 0.1), (0, 1, 0, 1.0, 2.0), (3, 1, 0, 5.0, 5.0), *((0, 7, k, float(-k), 1.0) for k in range(50))], "video_id long, frame long, ord long, x double, y double")
    tables.write_detections(d.repartition(5), str(tmp_path / "out"))
    got = [r for v in (0, 3) for r in tables.load_detections(spark, str(tmp_path / "out" / f"video_id={v}"), v).collect()]
    assert sorted(map(tuple, got)) == sorted(map(tuple, d.collect()))


def test_order_across_files_and_splits(spark, tmp_path):
    """A frame that crosses files, of which the later is larger and thus packed first; names sort by their numbers; a file is read in many splits."""
    folder = tmp_path / "d"
    folder.mkdir()
    sizes, rows = {"part-2.csv": 5, "part-10.csv": 400, "part-9.csv": 60}, []
    for name in sorted(sizes, key=lambda n: int(n[5:-4])):
        own = [(k // 150 + (name == "part-10.csv"), float(len(rows) + k), 1.5) for k in range(sizes[name])]
        (folder / name).write_text("frame,x,y\n" + "".join(f"{f},{x},{y}\n" for f, x, y in own))
        rows += own
    wanted, seen = [], {}
    for f, x, y in rows:
        wanted.append((f, seen.setdefault(f, 0), x, y))
        seen[f] += 1
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = tables.load_detections(spark, str(folder))
            assert sorted((r.frame, r.ord, r.x, r.y) for r in got.collect()) == sorted(wanted)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_in_many_tasks(spark, tmp_path):
    """What eight tasks write comes back with the same order, also within a frame that two of them share."""
    d = spark.range(4000).selectExpr("id % 2 as video_id", "cast(id > 3000 as long) as frame", "id div 2 as ord", "cast(hash(id) as double) as x", "1.0D as y")
    d = d.withColumn("ord", F.row_number().over(Window.partitionBy("video_id", "frame").orderBy("ord")) - 1).withColumn("ord", F.col("ord").cast("long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        tables.write_detections(d, str(tmp_path / "out"))
        assert len(list((tmp_path / "out").rglob("part-*.csv"))) > 4
        got = [tuple(r) for v in (0, 1) for r in tables.load_detections(spark, str(tmp_path / "out" / f"video_id={v}"), v).collect()]
        assert sorted(got) == sorted(map(tuple, d.select("video_id", "frame", "ord", "x", "y").collect()))
        t = d.selectExpr("video_id", "frame * 2000 + ord as frame", "cast(ord % 5 as int) as id", "x", "y")
        tables.write_tracks(t, str(tmp_path / "tracks"))
        files = sorted((tmp_path / "tracks" / "video_id=1").glob("part-*.csv"))
        assert len(files) > 1 and sorted(map(tuple, tables.load_tracks(spark, str(tmp_path / "tracks")).collect())) == sorted(map(tuple, t.collect()))
        ids = [[int(x) for x in line.split(",")[:2]][::-1] for f in files for line in f.read_text().split("\n")[1:] if line]
        assert ids == sorted(ids) and all(f.read_text().startswith("frame,id,x,y\n") for f in files)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_worker_holds_its_model(spark, tmp_path):
    """A closure is loaded once by each worker, over the tasks of several actions."""
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda images, **settings: [[] for _ in images]

    boxes = video.detect(spark.range(20).selectExpr("0L as video_id", "id as frame", "cast('x' as binary) as image").repartition(20), load)
    for _ in range(2):
        assert boxes.count() == 20
        boxes.write.format("noop").mode("overwrite").save()
    with open(log) as f:
        loads = f.read().split()
    assert len(loads) == len(set(loads)) <= 8


def test_frames_and_detector(spark):
    images = video.frames(spark, "any", "fake_video:decoder", 3)
    assert [bytes(r.image) for r in images.orderBy("frame").collect()] == [str(k).encode() for k in range(10)]
    meta = video.video_meta(spark, "any", "fake_video:decoder").first()
    assert (meta.fps, meta.total_frames) == (30.0, 10)
    points = clean.box_centroids(video.detect(images, fake_video.load)).orderBy("frame").collect()
    assert [(p.frame, p.x, p.y, p.track_id) for p in points][:2] == [(1, 2.0, 2.0, -1), (3, 4.0, 2.0, -1)] and len(points) == 5


def test_tracker_keeps_its_state(spark):
    for images, whole in ((video.frames(spark, "any", "fake_video:decoder", 3, 4), False), (video.frames(spark, "any", "fake_video:decoder", 3, 0), True)):
        got = {r.frame: [b.track_id for b in r.boxes] for r in video.track(images, fake_video.start, in_order=whole).collect()}
        assert got == {k: [k + 1] if k % 3 else [] for k in range(10)}


def test_device_and_half():
    assert DetectorConfig().device(1) == "cuda" and DetectorConfig().half(1) and not DetectorConfig().half(0)
    assert DetectorConfig(use_gpu=False).device(1) == "cpu" and not DetectorConfig(half_precision=False).half(1)
    for bad in ({"confidence": 0.0}, {"iou": 1.1}, {"image_size": 100}):
        with pytest.raises(ValueError):
            DetectorConfig(**bad)
    with pytest.raises(ValueError):
        RunConfig(trail_length=0)
    with pytest.raises(ValueError, match="video_path"):
        RunConfig(model_path="m").checked()


def test_video_is_written_in_order(spark, tmp_path):
    images = video.frames(spark, "any", "fake_video:decoder", 3, 4)
    meta = video.video_meta(spark, "any", "fake_video:decoder", 3)
    tracks = spark.createDataFrame([(3, 2, 0, 1.0, 2.0), (3, 2, 1, 5.0, 6.0)], "video_id long, frame long, id int, x double, y double")
    folder = str(tmp_path)
    video.write_videos(images, draw.draw_list(tracks, meta), draw.overlays(images, tracks), meta, lambda *a: fake_video.Writer(folder, *a))
    lines = (tmp_path / "3").read_text().split("\n")
    assert lines[0] == "(30.0, 64, 48)" and lines[1] == "0 [] ['Count: 0']" and lines[3] == "2 ['0', '1'] ['Count: 2']" and len(lines) == 11


def test_progress(spark, tmp_path):
    rows, seen = progress.observed(spark.range(5).selectExpr("id as frame"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 5, "last_frame": 4} and progress.percent_of(1, 0) == 0 and progress.percent_of(2, 3) == 66
    told = []
    listener = progress.StreamProgress(lambda *a: told.append(a), 5, "watched")
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(100):
            if told and told[-1][1] == 5:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[0] == ("watched", 0, 5) and told[-1] == ("watched", 5, 5)


def test_trails_of_a_stream(spark, tmp_path):
    t = fixture.tracks(spark, "/root/testdata/sf0.001").selectExpr("video_id", "frame", "cast(id as int) as id", "x", "y")
    for part, where in enumerate(("frame < 300", "frame >= 300")):
        t.where(where).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = trail_stream(stream, 4).writeStream.format("memory").queryName("trails").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.video_id, r.id, r.frame, [tuple(p) for p in r.trail]) for r in rows)
    assert key(spark.table("trails").collect()) == key(trails(t, 4).collect())


def test_stream_rejects_what_is_no_place(spark, tmp_path):
    kind = "video_id long, frame long, dets array<struct<ord:long,x:double,y:double>>"
    spark.createDataFrame([(0, 0, [(0, float("nan"), 1.0)])], kind).write.parquet(str(tmp_path / "in"))
    q = reid_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), ReidConfig(objects=1)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="finite"):
        q.awaitTermination(60)


class Renamed(Tracker):
    """The tracker after a change of its class: it has more attributes, and the same rows."""

    def __init__(self, config):
        super().__init__(config)
        self.another = {"attribute": 1}


def test_state_outlives_its_class(spark, tmp_path):
    """A stream that is stopped and goes on with another tracker class gives the batch's tracks; its state is a table."""
    d = fixture.detections(spark, "/root/testdata/sf0.001")
    spine = frames.spine(frames.last_frames(d).selectExpr("video_id", "0L as start_frame", "last_frame"))
    nested = frames.frame_arrays(d, spine).select("video_id", "frame", "dets")
    config, got = ReidConfig(objects=2, predictor="damped_velocity"), []
    for part, (where, tracker) in enumerate((("frame < 400", Tracker), ("frame >= 400", Renamed))):
        nested.where(where).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
        stream = reid_stream(spark.readStream.schema(nested.schema).parquet(str(tmp_path / "in" / "*")), config, tracker)
        q = stream.writeStream.foreachBatch(lambda rows, _: got.extend(map(tuple, rows.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(got) == sorted(map(tuple, reid(d, config).collect()))
    state = spark.read.format("statestore").option("stateVarName", "objects").load(str(tmp_path / "cp"))
    assert {f.name for f in state.schema["list_element"].dataType} == {"x", "y", "before_x", "before_y", "vx", "vy", "miss"} and state.count() == 8


def test_gaps_of_a_stream(spark, tmp_path):
    t = fixture.tracks(spark, "/root/testdata/sf0.001").selectExpr("video_id", "frame", "cast(id as int) as id", "x", "y")
    got = []
    for part, where in enumerate(("frame < 300", "frame >= 300")):
        t.where(where).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
        stream = interpolate_stream(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in" / "*")))
        q = stream.writeStream.foreachBatch(lambda rows, _: got.extend(map(tuple, rows.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(got) == sorted(map(tuple, interpolate(t).select("video_id", "id", "frame", "x", "y").collect()))


def test_cleaning_within_frames(spark):
    """The same rows as cleaning by groups of frames."""
    d = fixture.detections(spark, "/root/testdata/sf0.001")
    box = F.struct((F.col("x") - 1).cast("float").alias("x1"), F.col("y").cast("float").alias("y1"), (F.col("x") + 1).cast("float").alias("x2"), F.col("y").cast("float").alias("y2"), F.col("conf").cast("float").alias("conf"), F.when(F.col("track_id") >= 0, F.col("track_id")).alias("track_id"))
    boxes = d.groupBy("video_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", box.alias("b")))), lambda s: s["b"]).alias("boxes"))
    for config in (CleanConfig(eps=60.0, objects=1, extra=1), CleanConfig(dedup=False)):
        flat = clean.clean_frames(boxes, config).select("video_id", "frame", F.explode("dets").alias("p")).select("video_id", "frame", "p.*")
        key = lambda rows: sorted((r.video_id, r.frame, r.ord, r.x, r.y, r.conf, r.track_id) for r in rows)
        wanted = clean.clean(clean.box_centroids(boxes), config)
        if config.dedup:
            assert key(flat.collect()) == key(wanted.collect())
        else:
            assert sorted((r.video_id, r.frame, r.x, r.y) for r in flat.collect()) == sorted((r.video_id, r.frame, r.x, r.y) for r in wanted.collect())


def test_a_video_that_is_read_while_it_grows(spark, tmp_path):
    """Frames, tracker, cleaning and identities as streams, stopped in mid-video and begun again: the batch's boxes and tracks."""
    path = tmp_path / "frames"
    cleaning, config = CleanConfig(eps=5.0, objects=3), ReidConfig(objects=3, predictor="damped_velocity")
    boxes, tracked = [], []
    for count in (23, 23, 60):
        path.write_text(str(count))
        images = video.frame_stream(spark, str(path), "fake_video:walker_stream", 3, 8)
        for kind, got, rows in (("boxes", boxes, lambda s: s), ("tracks", tracked, None)):
            stream = track_stream(images, fake_video.WalkerTracker) if rows else None
            if stream is None:
                seen = str(tmp_path / "boxes-table")
                stream = reid_stream(clean.clean_frames(spark.readStream.schema("video_id long, frame long, boxes array<struct<x1:float,y1:float,x2:float,y2:float,conf:float,track_id:int>>").parquet(seen), cleaning), config)
                q = stream.writeStream.foreachBatch(lambda df, _, got=got: got.extend(map(tuple, df.collect())))
            else:
                q = stream.writeStream.format("parquet").option("path", str(tmp_path / "boxes-table"))
            q = q.option("checkpointLocation", str(tmp_path / f"cp-{kind}")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    batch = video.track(video.frames(spark, str(path), "fake_video:walkers", 3, 0), fake_video.WalkerTracker, in_order=True)
    key = lambda rows: sorted((r.video_id, r.frame, [tuple(b) for b in r.boxes]) for r in rows)
    assert key(spark.read.parquet(str(tmp_path / "boxes-table")).collect()) == key(batch.collect())
    assert sorted(tracked) == sorted(map(tuple, reid(clean.clean(clean.box_centroids(batch), cleaning), config).collect())) and len(tracked) > 120


def test_progress_of_a_batch(spark):
    """Reports come while the action runs."""
    told = []
    images = video.frames(spark, "any", "fake_video:walkers", 0, 5)
    with progress.BatchProgress(spark, lambda *a: told.append(a), 60, 5, "detection") as p:
        assert video.detect(images, fake_video.walker_model, counter=p.frames).count() == 60
        early = len(told)
    assert early >= 2 and told[-1] == ("detection", 60, 60) and [t[1] for t in told] == sorted({t[1] for t in told})
    shares = []
    with progress.BatchProgress(spark, lambda *a: shares.append(a), 100, 10, "plain"):
        video.detect(images, fake_video.walker_model).count()
    assert shares and shares[-1][1] <= 100 and len(shares) >= 2


@pytest.mark.parametrize("kind", ["offline", "interactive", "online"])
def test_whole_runs(spark, tmp_path, kind):
    """From the settings to the tables and the video; a second run reads the first one's detections."""
    told, folder = [], str(tmp_path)
    config = RunConfig(model_path="m", video_path="any", raw_path=f"{folder}/raw", tracks_path=f"{folder}/tracks", interpolated_path=f"{folder}/filled", trails=kind == "interactive", trail_length=4, frames_per_task=7, report_every=10)
    parts = runs.Parts("fake_video:walkers", fake_video.WalkerTracker if kind == "online" else fake_video.walker_model, lambda *a: fake_video.Segment(folder, *a), lambda *a: fake_video.joined(folder, *a), lambda *a: told.append(a))
    reid_config = ReidConfig(objects=3, predictor=runs.KINDS[kind][0])
    result = runs.run(spark, kind, config, parts, reid_config, video_id=5)
    assert {t[0] for t in told} >= {"detection", "drawing"} and ("detection", 60, 60) in told
    paths = {i: {(r.frame, r.x, r.y) for r in result.tracks.where(F.col("id") == i).collect()} for i in range(3)}
    first = {i: min(p)[1] for i, p in paths.items()}
    assert all(x == first[i] + 2 * f for i, p in paths.items() for f, x, _ in p) and len(set(first.values())) == 3
    assert (result.filled is None) == (kind == "online")
    if result.filled is not None:
        assert result.filled.groupBy("id").count().where("count < 58").count() == 0
    lines = open(result.video).read().split("\n")
    assert lines[0] == "(25.0, 640, 480)" and len(lines) == 61 and lines[1].endswith("['Count: 3']")
    counts = [int(x.split("Count: ")[1].rstrip("']")) for x in lines[1:]]
    assert counts == [sum((f in {a for a, _, _ in p}) for p in paths.values()) for f in range(60)]
    trail = result.marks.where("frame = 30").first().trail
    assert len(trail) == (4 if kind == "interactive" else 0)
    again = runs.run(spark, kind, replace(config, use_existing=True, tracks_path=f"{folder}/again"), replace(parts, writer=None, model=None), reid_config, video_id=5)
    assert sorted(map(tuple, again.tracks.collect())) == sorted(map(tuple, result.tracks.collect())) and again.video is None
    with pytest.raises(Exception, match="no frame with at least 4"):
        runs.run(spark, kind, replace(config, use_existing=True), parts, ReidConfig(objects=4), video_id=5)
    with pytest.raises(Exception, match="already exists"):
        runs.run(spark, kind, replace(config, overwrite_raw=False), parts, reid_config, video_id=5)


def test_no_image_is_shuffled(spark, tmp_path):
    """Frames are decoded where their segment is written; segments are the same as the video that one task writes."""
    meta = video.video_meta(spark, "any", "fake_video:decoder", 3)
    tracks = spark.createDataFrame([(3, 2, 0, 1.0, 2.0), (3, 2, 1, 5.0, 6.0), (3, 9, 1, 5.0, 6.0)], "video_id long, frame long, id int, x double, y double")
    numbers = frames.spine(meta.selectExpr("video_id", "0L as start_frame", "total_frames - 1 as last_frame"))
    marks, texts, folder = draw.draw_list(tracks, meta), draw.overlays(numbers, tracks), str(tmp_path)
    segments = video.write_segments(marks, texts, meta, {3: "any"}, "fake_video:decoder", lambda *a: fake_video.Segment(folder, *a), 4)
    plan = segments._jdf.queryExecution().executedPlan().toString()
    assert "image" not in plan and "driftwork_frames" not in plan
    name = video.join_segments(segments, lambda *a: fake_video.joined(folder, *a)).first().name
    whole = open(name).read()
    (tmp_path / "one").mkdir()
    video.write_videos(video.frames(spark, "any", "fake_video:decoder", 3, 4), marks, texts, meta, lambda *a: fake_video.Writer(f"{folder}/one", *a))
    assert whole == (tmp_path / "one" / "3").read_text() and len(whole.split("\n")) == 11


@pytest.mark.parametrize("predictor", ["constant_velocity", "damped_velocity"])
def test_stream_is_batch(spark, tmp_path, predictor):
    d = fixture.detections(spark, "/root/testdata/sf0.001")
    spine = frames.spine(frames.last_frames(d).selectExpr("video_id", "0L as start_frame", "last_frame"))
    nested = frames.frame_arrays(d, spine)
    for part, where in enumerate(("frame < 300", "frame >= 300 and frame < 500", "frame >= 500")):
        nested.where(where).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    config = ReidConfig(objects=2, predictor=predictor)
    stream = spark.readStream.schema(nested.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = reid_stream(stream, config).writeStream.format("memory").queryName(f"s_{predictor}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table(f"s_{predictor}").collect())) == sorted(map(tuple, reid(d, config).collect()))
