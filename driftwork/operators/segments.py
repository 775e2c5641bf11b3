"""Stable identities in one long video by several tasks: segments start from guessed states, and are repaired until they follow from each other.

A tracker's state is small, and soon forgets where it came from. So a video is cut into segments of frames, and each is run at once from a guess: the
state of a tracker that was started some frames before. A segment is right if its first state is its predecessor's last one, but for the
numbering of the objects. Where it is not, it runs again from that state, until at some frame it has the state that it had before (again but
for numbers); from there on the rows of the first run hold. All such segments are repaired at once, in rounds, until all follow; the first k
segments are right after k rounds, and mostly one or two rounds do. In the end numbers are carried from segment to segment.

Of matchings of a frame that cost exactly the same, the numbers of objects decide. So segments with such frames run again until they began with the
numbers of the first segment. The result is that of reid().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwork import shared
from driftwork.config import ReidConfig
from driftwork.operators.frames import checked_start_frames, start_frames
from driftwork.operators.reid import Tracker, Video, _starts

_KEY = ["video_id", "segment"]
#: Rows of a segment by kind: a track's place; the state after a frame; the states that it began and ended with; frames that were run again; a frame
#: of several cheapest matchings, where the numbers of objects decide; the state that it is to begin with; a detection, its id 1 in warm-ups.
_PLACE, _STATE, _BEGIN, _END, _AGAIN, _TIED, _WANT, _POINT = range(8)
_HELD = "video_id long, segment long, kind int, frame long, id int, x double, y double, state array<double>"


def _flat(t: Tracker) -> list[float]:
    return [float(v) for row in t.rows() for v in row]


def _tracker(config: ReidConfig, frame: int, state) -> Tracker:
    return Tracker.of(config, int(frame), [tuple(r) for r in np.asarray(state, float).reshape(-1, 7)])


def renumbering(old, new) -> list[int] | None:
    """For each object of a state its number in another, where both have the same objects, all different; else None."""
    a, b = (np.nan_to_num(np.asarray(s, float).reshape(-1, 7), nan=np.inf) for s in (old, new))
    if a.shape != b.shape:
        return None
    i, j = np.lexsort(a.T), np.lexsort(b.T)
    if not np.array_equal(a[i], b[j]) or (len(i) > 1 and (a[i][1:] == a[i][:-1]).all(1).any()):
        return None
    out = np.empty(len(i), int)
    out[i] = j
    return out.tolist()


def _joins(old, new) -> list[int] | None:
    """renumbering(), also where objects are at one place in every number of a state: such are numbered in order, and part in a tied step only."""
    a, b = (np.nan_to_num(np.asarray(s, float).reshape(-1, 7), nan=np.inf) for s in (old, new))
    if a.shape != b.shape:
        return None
    i, j = np.lexsort(a.T), np.lexsort(b.T)
    if not np.array_equal(a[i], b[j]):
        return None
    out = np.empty(len(i), int)
    out[i] = j
    return out.tolist()


def _segments(batches: Iterator[pa.RecordBatch], start: Callable[[int, int], object]) -> Iterator[pa.RecordBatch]:
    """Rows (video_id, segment, frame, ord, x, y, kind, id, state), sorted by segment with those of a kind before points: start(video, segment) makes what
    takes a segment's held(kind, frame, id, x, y, state) and points(frame, points, warm), and at last end(), and has its rows in rows. A frame's points are held."""
    now, one, frame, warm, points = None, None, None, False, []

    def flush():
        if points:
            one.points(frame, np.concatenate(points), warm)
            points.clear()

    for batch in batches:
        c = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 6, 7)]
        places = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)], axis=1).astype(float)
        limit, done = np.append(_starts(*c[:4]), batch.num_rows), []
        for lo, hi in zip(limit, limit[1:], strict=False):
            at = int(c[0][lo]), int(c[1][lo])
            if at != now:
                if one is not None:
                    flush()
                    one.end()
                    done += one.rows
                now, one, frame = at, start(*at), None
            if c[3][lo] != _POINT:
                for r in batch.slice(lo, hi - lo).to_pylist():
                    one.held(r["kind"], r["frame"], r["id"], r["x"], r["y"], r["state"])
                continue
            if frame != c[2][lo]:
                flush()
                frame, warm = int(c[2][lo]), c[4][lo] == 1
            points.append(places[lo:hi])
        if done:
            yield _table(done)
    if one is not None:
        flush()
        one.end()
        yield _table(one.rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
    columns = zip(*rows, strict=True) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _HELD.split(", ")])


class _Rows:
    """Rows of one segment as they are made."""

    def __init__(self, video: int, segment: int):
        self.at, self.rows = (int(video), int(segment)), []

    def add(self, kind: int, frame, number=-1, x=np.nan, y=np.nan, state=None) -> None:
        self.rows.append((*self.at, kind, int(frame), number, x, y, state))

    def step(self, video: Video, frame: int, points: np.ndarray, every: int, n: int) -> None:
        video.tracker.tied = False
        for number, x, y in video.feed(frame, points):
            self.add(_PLACE, frame, number, x, y)
        if video.tracker.tied:
            self.add(_TIED, frame)
        if n % every == 0 and video.tracker.started:
            self.add(_STATE, frame, state=_flat(video.tracker))


class _Guess(_Rows):
    """A segment's rows from the state that its warm-up rows lead to; the first segment starts by itself. Without a state there are no rows but its begin."""

    def __init__(self, config: ReidConfig, every: int, video: int, segment: int):
        super().__init__(video, segment)
        self.video, self.every, self.n, self.began = Video(config), every, 0, False

    def points(self, frame: int, points: np.ndarray, warm: bool) -> None:
        if warm:
            self.video.feed(frame, points)
            return
        t = self.video.tracker
        if not self.began:
            self.began = True
            self.add(_BEGIN, t.frame if t.started else -1, state=_flat(t))
            self.works = t.started or self.at[1] == 0
        if self.works:
            self.step(self.video, frame, points, self.every, self.n)
            self.n += 1

    def end(self) -> None:
        if self.began and self.works:
            self.add(_END, self.video.tracker.frame, state=_flat(self.video.tracker))


class _Repair(_Rows):
    """A segment's rows from the state that its predecessor ended with; those of the run before from where both agree."""

    def __init__(self, config: ReidConfig, every: int, video: int, segment: int):
        super().__init__(video, segment)
        self.config, self.every, self.n, self.old, self.states, self.again, self.joined = config, every, 0, [], {}, 0, False

    def held(self, kind, frame, number, x, y, state) -> None:
        if kind == _WANT:
            self.video = Video(self.config, _tracker(self.config, frame, state))
            self.add(_BEGIN, frame, state=list(state))
        elif kind == _AGAIN:
            self.again += frame
        else:
            self.old.append((kind, frame, number, x, y, state))
            if kind == _STATE:
                self.states[frame] = state

    def points(self, frame: int, points: np.ndarray, warm: bool) -> None:
        if self.joined:
            return
        self.step(self.video, frame, points, self.every, self.n)
        self.n, self.again = self.n + 1, self.again + 1
        to = _joins(self.states[frame], _flat(self.video.tracker)) if frame in self.states else None
        # of tied matchings the numbers decide, so other numbers do not join before one
        if to is None or (to != sorted(to) and any(k == _TIED and f > frame for k, f, *_ in self.old)):
            return
        self.joined, back = True, np.argsort(to)
        turned = lambda state: np.asarray(state).reshape(-1, 7)[back].ravel().tolist()
        for kind, f, number, x, y, state in self.old:
            if kind == _END or (f > frame and kind in (_PLACE, _STATE, _TIED)):
                self.add(kind, f, to[number] if kind == _PLACE else -1, x, y, None if state is None else turned(state))

    def end(self) -> None:
        if not self.joined:
            self.add(_END, self.video.tracker.frame, state=_flat(self.video.tracker))
        self.add(_AGAIN, self.again)


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(video_id, segment, state, want) to (video_id, segment, numbers): how the objects of state are numbered in want, null where they differ."""
    for pdf in batches:
        found = [_joins(s, w) if s is not None and w is not None else None for s, w in zip(pdf.state, pdf.want, strict=True)]
        yield pd.DataFrame({"video_id": pdf.video_id, "segment": pdf.segment, "numbers": found})


def _carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers in the first segment's terms, along a video's segments (a row for each)."""
    pdf, now, out = pdf.sort_values("segment"), None, []
    for numbers in pdf.numbers:
        now = list(range(len(pdf.state.iloc[0]) // 7)) if now is None else [now[k] for k in numbers]
        out.append(now)
    return pd.DataFrame({"video_id": pdf.video_id, "segment": pdf.segment, "numbers": out})


def reid_segmented(detections: DataFrame, config: ReidConfig = ReidConfig(), frames_per_segment: int = 10_000, warm_up: int = 200, every: int = 16, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The tracks of reid(), from tasks that each hold a segment of a video, and (video_id, segments, repaired): how many frames ran again.

    every: frames from one stored state to the next, at which a repaired segment may join its first run. A task holds a frame and the tracks of a segment. Videos and
    errors are as for reid(); unlike there, work begins at once, and intermediate tables are written to the shared folder.
    """
    size, warm = max(1, int(frames_per_segment)), max(1, min(int(warm_up), int(frames_per_segment)))
    rows = detections.select(*(F.col(c).cast("long").alias(c) for c in ("video_id", "frame", "ord")), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("video_id is not null")
    starts = checked_start_frames(rows, config.objects) if strict else start_frames(rows, config.objects)
    rows = rows.join(starts, "video_id").where("frame >= start_frame").withColumn("segment", F.floor((F.col("frame") - F.col("start_frame")) / size))
    late = (F.col("frame") - F.col("start_frame")) % size >= size - warm
    both = F.when(late, F.array(F.struct("segment", F.lit(False).alias("warm")), F.struct((F.col("segment") + 1).alias("segment"), F.lit(True).alias("warm")))).otherwise(F.array(F.struct("segment", F.lit(False).alias("warm"))))
    column = lambda kind, number, state: (F.lit(kind).cast("int").alias("kind"), number.cast("int").alias("id"), state.cast("array<double>").alias("state"))
    dealt = rows.withColumn("to", F.explode(both)).select("video_id", "to.segment", "frame", "ord", "x", "y", *column(_POINT, F.col("to.warm"), F.lit(None)))

    def ran(taken: DataFrame, kind) -> DataFrame:
        """What kind(config, every, video, segment) makes of each segment, whose rows stream through a task."""
        start = lambda video, segment: kind(config, every, video, segment)
        return taken.repartition(*_KEY).sortWithinPartitions(*_KEY, F.col("kind") == _POINT, "frame", "ord").mapInArrow(lambda batches: _segments(batches, start), _HELD)

    held = shared.written(ran(dealt, _Guess), "segments")
    before = Window.partitionBy("video_id").orderBy("segment")
    while True:
        begin = held.where(F.col("kind") == _BEGIN).select(*_KEY, "state")
        end = held.where(F.col("kind") == _END).select(*_KEY, F.col("frame").alias("end_frame"), F.col("state").alias("end"))
        ways = begin.join(end, _KEY, "left").select(*_KEY, "state", F.lag("end_frame").over(before).alias("want_frame"), F.lag("end").over(before).alias("want"), (F.row_number().over(before) == 1).alias("first"))
        ways = shared.written(ways, "ways")  # a row for each segment
        fits = shared.written(ways.where("not first").mapInPandas(_checked, "video_id long, segment long, numbers array<int>"), "fits")
        # a segment whose predecessor has no end yet waits for it
        wrong = ways.join(fits.where("numbers is null"), _KEY).where("want is not null").select(*_KEY, "want_frame", "want")
        if not wrong.limit(1).count():
            numbers = ways.where("first").select(*_KEY, F.lit(None).cast("array<int>").alias("numbers")).unionByName(fits)
            ends = held.where(F.col("kind") == _END).select(*_KEY, "state")
            carried = shared.written(numbers.join(ends, _KEY).groupBy("video_id").applyInPandas(_carried, "video_id long, segment long, numbers array<int>"), "numbers")
            # where numbers decided and were not the first segment's
            other = carried.where(F.col("numbers") != F.array_sort("numbers")).join(held.where(F.col("kind") == _TIED).select(*_KEY).distinct(), _KEY, "left_semi").join(ways, _KEY)
            turned = F.flatten(F.transform(F.array_sort(F.transform("numbers", lambda n, k: F.struct(n.alias("n"), k.alias("k")))), lambda p: F.slice("state", p["k"] * 7 + 1, 7)))
            wrong = shared.written(other.select(*_KEY, "want_frame", turned.alias("want")), "wrong")
            if not wrong.limit(1).count():
                break
        old = held.join(wrong.select(*_KEY), _KEY, "left_semi").select(*_KEY, "frame", F.lit(0).cast("long").alias("ord"), "x", "y", "kind", "id", "state")
        want = wrong.select(*_KEY, F.col("want_frame").alias("frame"), F.lit(0).cast("long").alias("ord"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), *column(_WANT, F.lit(-1), F.col("want")))
        points = rows.join(wrong.select(*_KEY), _KEY, "left_semi").select(*_KEY, "frame", "ord", "x", "y", *column(_POINT, F.lit(0), F.lit(None)))
        again = ran(old.unionByName(want).unionByName(points), _Repair)
        held = shared.written(held.join(wrong.select(*_KEY), _KEY, "left_anti").unionByName(again), "segments")
    places = held.where(F.col("kind") == _PLACE).join(carried, _KEY)
    tracks = places.select("video_id", "frame", F.get("numbers", F.col("id")).alias("id"), "x", "y")
    seen = held.groupBy("video_id").agg(F.count_distinct("segment").alias("segments"), F.sum(F.when(F.col("kind") == _AGAIN, F.col("frame")).otherwise(0)).alias("repaired"))
    return tracks, seen
