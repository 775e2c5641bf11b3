"""Stable identities: a fixed number of objects is matched to each frame's detections, one video at a time.

Three predictors, three semantics. constant_velocity: the last match plus the step between the last two matches; a miss changes nothing.
last_position: the last match. Both only look at frames with detections, with one distance gate. damped_velocity: a smoothed velocity that is
damped with each missed frame, a gate that grows with speed, a price for turning, and retirement after too many misses; every frame
counts, empty ones too.

The recurrence can't be a window function. State is small (some numbers for each object) and is carried along a video's sorted
rows, so videos are the parallelism; the same step function serves batch and stream. Of matchings that cost the same one is taken by rule (see
assignment.latest for up to two objects, as in their SQL, and assignment.preferred), so a run does not depend on the solver's way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwork.config import BIG, ReidConfig
from driftwork.operators.assignment import latest, preferred, solved
from driftwork.operators.frames import candidates, damped_candidates

_TRACKS = "video_id long, frame long, id int, x double, y double"


class Tracker:
    """The state of one video. step() takes a frame and its (n, 2) points in order, and returns (id, x, y) rows."""

    def __init__(self, config: ReidConfig):
        self.config, self.frame, self.proof, self.tied = config, None, None, False

    def __getstate__(self):
        return self.__dict__

    @property
    def started(self) -> bool:
        return self.frame is not None

    def rows(self) -> list[tuple]:
        """The state of each object: its last place, the one before (NaN until it has one), velocity, missed frames."""
        return [(*map(float, (*self.last[i], *self.before[i], *self.velocity[i])), int(self.miss[i])) for i in range(len(self.last))] if self.started else []

    @classmethod
    def of(cls, config: ReidConfig, frame: int | None, rows: list[tuple]) -> Tracker:
        """The tracker that had these rows after this frame; None: not started."""
        out = cls(config)
        if frame is not None:
            numbers = np.array([r[:6] for r in rows], float).reshape(-1, 6)
            out.frame, out.last, out.before, out.velocity = int(frame), numbers[:, :2].copy(), numbers[:, 2:4].copy(), numbers[:, 4:].copy()
            out.miss = np.array([r[6] for r in rows], int)
        return out

    def step(self, frame: int, points: np.ndarray) -> list[tuple[int, float, float]]:
        if not self.started:
            if len(points) < self.config.objects:
                return []
            return self._seed(frame, points)
        self.frame = frame
        return self._damped(points) if self.config.predictor == "damped_velocity" else self._plain(points)

    def _seed(self, frame, points):
        n = self.config.objects
        if self.config.predictor == "damped_velocity":
            points = points[np.argsort(points[:, 1], kind="stable")]
        self.frame, self.last = frame, points[:n].astype(float).copy()
        self.before = np.full((n, 2), np.nan)
        self.velocity, self.miss = np.zeros((n, 2)), np.zeros(n, int)
        return [(i, *map(float, p)) for i, p in enumerate(self.last)]

    def _matched(self, rows, cost, points):
        few = self.config.objects <= 2
        i, j, u, v = solved(cost) if self.proof is not None or not few else (None,) * 4
        i, j, tied = latest(cost, points, BIG) if few else preferred(np.asarray(cost, float), i, j, u, v, BIG)
        self.tied = self.tied or tied
        if self.proof is not None:
            self.proof.update(rows=rows, u=u, v=v, i=i, j=j)
        good = cost[i, j] < BIG
        return rows[i[good]], j[good]

    def _plain(self, points):
        if not len(points):
            return []
        target = self.last
        if self.config.predictor == "constant_velocity":
            target = np.where(np.isnan(self.before), self.last, self.last + (self.last - self.before))
        dx, dy = points[None, :, 0] - target[:, None, 0], points[None, :, 1] - target[:, None, 1]
        with np.errstate(over="ignore"):
            d = np.sqrt(dx * dx + dy * dy)
        ids, at = self._matched(np.arange(len(target)), np.where(d <= self.config.max_move, d, BIG), points)
        self.before[ids] = self.last[ids]
        self.last[ids] = points[at]
        return [(int(i), float(points[j, 0]), float(points[j, 1])) for i, j in zip(ids, at, strict=True)]

    def _damped(self, points):
        c, ids, at = self.config, np.empty(0, int), np.empty(0, int)
        active = np.flatnonzero(self.miss <= c.max_miss)
        if len(points) and len(active):
            ids, at = self._matched(active, self._damped_costs(active, points), points)
        moved = points[at] - self.last[ids]
        self.miss += 1
        self.miss[ids] = 0
        decayed = self.velocity * c.miss_decay
        decayed[ids] = (1 - c.velocity_gain) * self.velocity[ids] + c.velocity_gain * moved
        self.velocity = decayed
        self.last[ids] = points[at]
        return [(int(i), float(points[j, 0]), float(points[j, 1])) for i, j in zip(ids, at, strict=True)]

    def _damped_costs(self, active, points):
        """(tracks, points) costs in single precision, BIG beyond a track's gate."""
        c, last, v = self.config, self.last[active], self.velocity[active]
        reached = last + v * ((1 - c.damping ** (self.miss[active] + 1.0)) / (1 - c.damping))[:, None]
        speed = np.hypot(*v.T)[:, None]
        gate = np.clip(c.base_gate + c.gate_speed * speed, c.min_gate, c.max_gate)
        off = np.hypot(*np.moveaxis(points[None] - reached[:, None], 2, 0))
        way = np.moveaxis(points[None] - last[:, None], 2, 0)
        length, along = np.hypot(*way), v[:, :1] * way[0] + v[:, 1:] * way[1]
        turn = np.where((speed < 1) | (length < 1), 0.0, 1 - along / np.maximum(speed * length, 1e-300))
        return np.where(off <= gate, off + turn * gate * c.direction_weight, BIG).astype(np.float32)


class Video:
    """A video's tracker fed with its frames in order; frames without detections count where they age tracks."""

    def __init__(self, config: ReidConfig, tracker: Tracker | None = None):
        self.tracker = tracker or Tracker(config)

    def feed(self, frame: int, points: np.ndarray) -> list[tuple[int, float, float]]:
        if not np.isfinite(points).all():
            raise ValueError("coordinates must be finite numbers")
        t = self.tracker
        if t.started and t.config.predictor == "damped_velocity":
            for empty in range(t.frame + 1, frame):
                t.step(empty, points[:0])
        return t.step(frame, points)

    def end(self, video: int, strict: bool) -> None:
        if strict and not self.tracker.started:
            raise ValueError(f"video {video}: no frame with at least {self.tracker.config.objects} detections")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def run_video(config: ReidConfig, video: int, frames: np.ndarray, points: np.ndarray, strict: bool = True) -> pd.DataFrame:
    """Tracks of one video from its detections, sorted by frame and order."""
    out, state = [], Video(config)
    limit = np.append(_starts(frames), len(frames))
    for lo, hi in zip(limit, limit[1:], strict=False):
        out += [(video, int(frames[lo]), *row) for row in state.feed(int(frames[lo]), points[lo:hi])]
    if len(frames):
        state.end(video, strict)
    return pd.DataFrame(out, columns=["video_id", "frame", "id", "x", "y"])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["video_id", "frame", "id", "x", "y"])


def _solve(config: ReidConfig, strict: bool):
    """Rows (video_id, frame, ord, x, y) sorted by these three: only a frame is held, and a tracker; both are carried on from batch to batch."""

    def run(batches):
        video, state, frame, held = None, None, None, []

        def flush():
            return [(video, frame, *row) for row in state.feed(frame, np.concatenate(held))] if held else []

        for batch in batches:
            videos, numbers = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            points = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)], axis=1).astype(float)
            limit, out = np.append(_starts(videos, numbers), len(videos)), []
            for lo, hi in zip(limit, limit[1:], strict=False):
                now = int(videos[lo]), int(numbers[lo])
                if now != (video, frame):
                    if state is not None:
                        out += flush()
                        held = []
                    if now[0] != video:
                        if state is not None:
                            state.end(video, strict)
                        state = Video(config)
                    video, frame = now
                held.append(points[lo:hi])
            yield _rows(out)
        if state is not None:
            yield _rows(flush())
            state.end(video, strict)

    return run


def reid(detections: DataFrame, config: ReidConfig = ReidConfig(), strict: bool = True) -> DataFrame:
    """tracks(video_id, frame, id, x, y) from detections(video_id, frame, ord, x, y).

    A video without a start frame is an error, or has no track if not strict. Coordinates must be finite numbers. A video's rows stream
    through one task in order; the task holds a frame and the tracker's state, not the video.
    """
    return _dealt(detections).mapInArrow(_solve(config, strict), _TRACKS)


def _dealt(detections: DataFrame) -> DataFrame:
    """(video_id, frame, ord, x, y) of each video in one task, sorted by these three."""
    rows = detections.select(*(F.col(c).cast("long").alias(c) for c in ("video_id", "frame", "ord")), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("video_id is not null")
    return rows.repartition("video_id").sortWithinPartitions("video_id", "frame", "ord")


_CERTIFICATES = "video_id long, frame long, side int, k long, x double, y double, ax double, ay double, miss long, potential double, mate long"


def _walked(batches, each):
    """Calls each(video, frame, ords, points) for the frames of rows sorted by video, frame and order, whole and in order; yields what it gives."""
    now, ords, held = None, [], []
    for batch in batches:
        videos, numbers, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        points = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)], axis=1).astype(float)
        limit = np.append(_starts(videos, numbers), len(videos))
        for lo, hi in zip(limit, limit[1:], strict=False):
            if held and (int(videos[lo]), int(numbers[lo])) != now:
                yield from each(*now, np.concatenate(ords), np.concatenate(held))
                ords, held = [], []
            now = int(videos[lo]), int(numbers[lo])
            ords.append(places[lo:hi])
            held.append(points[lo:hi])
    if held:
        yield from each(*now, np.concatenate(ords), np.concatenate(held))


def certificates(detections: DataFrame, config: ReidConfig = ReidConfig()) -> DataFrame:
    """What each step of reid() knew and chose, so that others can check it: a row for each track (side 0, k its id) and each detection (side 1, k its ord)
    of every step after a video's start frame.

    x, y: a track's last place before the step, a detection's place. ax, ay: a track's place before that (null until it has one; for
    damped_velocity its velocity), miss: its missed frames. potential: of the assignment problem, null for what took no part in it. mate: the
    partner, also where its cost is that of no match. The sequence of states and the optimum of each step are relations over these rows (see
    violations()).
    """
    damped = config.predictor == "damped_velocity"

    def run(batches):
        state, video_now, out = None, None, []

        def step(t, video, frame, ords, points):
            t.proof, n = {}, len(t.last)
            before = t.last.copy(), (t.velocity if damped else t.before).copy(), t.miss.copy()
            t.step(frame, points)
            u, v = np.full(n, np.nan), np.full(len(points), np.nan)
            mates = np.full(n, -1), np.full(len(points), -1)
            if t.proof:
                rows, i, j = t.proof["rows"], t.proof["i"], t.proof["j"]
                u[rows], v[:] = t.proof["u"], t.proof["v"]
                mates[0][rows[i]], mates[1][j] = ords[j], rows[i]
            for k in range(n):
                yield (video, frame, 0, k, *before[0][k], *before[1][k], before[2][k], u[k], mates[0][k])
            for k in range(len(points)):
                yield (video, frame, 1, ords[k], *points[k], np.nan, np.nan, 0, v[k], mates[1][k])

        def each(video, frame, ords, points):
            nonlocal state, video_now
            if video != video_now:
                state, video_now = Tracker(config), video
            if not np.isfinite(points).all():
                raise ValueError("coordinates must be finite numbers")
            if not state.started:
                state.step(frame, points)
                return
            for empty in range(state.frame + 1, frame) if damped else ():
                yield from step(state, video, empty, ords[:0], points[:0])
            yield from step(state, video, frame, ords, points)

        def batch(rows):
            names = [c.split()[0] for c in _CERTIFICATES.split(", ")]
            columns = []
            for name, c in zip(names, zip(*rows, strict=True), strict=True):
                c = np.array(c)
                kind = pa.float64() if name in ("x", "y", "ax", "ay", "potential") else pa.int32() if name == "side" else pa.int64()
                columns.append(pa.array(c, kind, mask=np.isnan(c) if kind == pa.float64() else c < 0 if name == "mate" else None))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for row in _walked(batches, each):
            out.append(row)
            if len(out) >= 20_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return _dealt(detections).mapInArrow(run, _CERTIFICATES)


def violations(certificates: DataFrame, tracks: DataFrame, config: ReidConfig = ReidConfig(), eps: float = 1e-6) -> DataFrame:
    """For each step of certificates: detections, and how many rows break a condition under which tracks are the cheapest matches, step by step.

    costs are computed anew, by expressions. dear: pairs that cost less than their potentials sum up to. unpaid: chosen pairs that do not cost just
    that. positive: potentials above 0 on the longer side, or not 0 without a partner. unmatched: pairs missing to as many as the shorter side
    has. drifted: tracks whose state at the next step does not follow from this step's state and match. wrong: matches that tracks does not
    have, or has beyond them. All are 0 where the matching is optimal and tracks is what it leads to. eps grows with the size of the numbers.
    """
    key, damped = ["video_id", "frame"], config.predictor == "damped_velocity"
    own = certificates.where("side = 0").withColumnRenamed("k", "id").drop("side")
    other = certificates.where("side = 1").select(*key, F.col("k").alias("ord"), F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("potential").alias("v"), F.col("mate").alias("owner"))
    near = lambda a, b: F.abs(a - b) <= eps * (1 + F.abs(a) + F.abs(b))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    # the costs of all pairs of a step
    if damped:
        gated = damped_candidates(own.select(*key, "id", "x", "y", F.col("ax").alias("vx"), F.col("ay").alias("vy"), "miss"), other.select(*key, "ord", F.col("dx").alias("x"), F.col("dy").alias("y")), config)
    else:
        ahead = lambda a, b: F.col(a) + F.coalesce(F.col(a) - F.col(b), F.lit(0.0)) if config.predictor == "constant_velocity" else F.col(a)
        gated = candidates(own.select(*key, "id", ahead("x", "ax").alias("x"), ahead("y", "ay").alias("y")), other.select(*key, "ord", F.col("dx").alias("x"), F.col("dy").alias("y")), config.max_move)
    pairs = own.where("potential is not null").select(*key, "id", "potential", "mate").join(other, key).join(gated, [*key, "id", "ord"], "left").withColumn("cost", F.coalesce("cost", F.lit(BIG)))
    total, chosen = F.col("potential") + F.col("v"), F.col("mate") == F.col("ord")
    dear = pairs.groupBy(key).agg(one((total > F.col("cost")) & ~near(total, F.col("cost"))).alias("dear"), one(chosen & ~near(total, F.col("cost"))).alias("unpaid"), one(chosen != F.coalesce(F.col("owner") == F.col("id"), F.lit(False))).alias("odd"))
    # the sides of each step
    part = certificates.where("potential is not null").groupBy(key).agg(*(one(F.col("side") == k).alias(f"n{k}") for k in (0, 1)), one((F.col("side") == 0) & F.col("mate").isNotNull()).alias("mates"))
    longer = certificates.where("potential is not null").join(part, key)
    is_long = F.when(F.col("n0") > F.col("n1"), F.col("side") == 0).otherwise(F.col("side") == 1)
    bad = (F.col("potential") > eps) | (F.col("mate").isNull() & (F.abs("potential") > eps))
    sides = longer.groupBy(key).agg(one(is_long & bad).alias("positive"), F.max(F.least("n0", "n1") - F.col("mates")).alias("unmatched"))
    # from step to step
    hit = own.join(other.select(*key, F.col("ord").alias("mate"), "dx", "dy"), [*key, "mate"], "left").join(gated.select(*key, "id", F.col("ord").alias("mate"), F.lit(True).alias("within")), [*key, "id", "mate"], "left").withColumn("hit", F.coalesce("within", F.lit(False)))
    order = Window.partitionBy("video_id", "id").orderBy("frame")
    after = {c: F.lead(c).over(order) for c in ("x", "y", "ax", "ay", "miss")}
    hit = hit.withColumns({f"next_{c}": e for c, e in after.items()}).withColumn("last", F.lead("frame").over(order).isNull())
    follows = F.lit(True)
    for c, a, d in (("x", "ax", "dx"), ("y", "ay", "dy")):
        follows &= F.col(f"next_{c}") == F.when(F.col("hit"), F.col(d)).otherwise(F.col(c))
        if damped:
            speed = F.when(F.col("hit"), (1 - config.velocity_gain) * F.col(a) + config.velocity_gain * (F.col(d) - F.col(c))).otherwise(F.col(a) * config.miss_decay)
            follows &= near(F.col(f"next_{a}"), speed)
        else:
            follows &= F.col(f"next_{a}").eqNullSafe(F.when(F.col("hit"), F.col(c)).otherwise(F.col(a)))
    if damped:
        follows &= F.col("next_miss") == F.when(F.col("hit"), 0).otherwise(F.col("miss") + 1)
    moves = hit.groupBy(key).agg(one(~F.col("last") & ~follows).alias("drifted"))
    # what the matches say of the tracks after the start frame
    starts = certificates.groupBy("video_id").agg(F.min("frame").alias("first"))
    said = hit.where("hit").select(*key, "id", "dx", "dy", F.lit(1).alias("said"))
    placed = tracks.join(F.broadcast(starts), "video_id").where("frame >= first").select(*key, F.col("id").cast("long").alias("id"), F.col("x").alias("dx"), F.col("y").alias("dy"), F.lit(1).alias("placed"))
    wrong = said.join(placed, [*key, "id", "dx", "dy"], "full").groupBy(key).agg(one(F.col("said").isNull() | F.col("placed").isNull()).alias("wrong"))
    out = certificates.groupBy(key).agg(one(F.col("side") == 1).alias("detections"))
    for found in (dear, sides, moves, wrong):
        out = out.join(found, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*key, "detections", (F.coalesce("dear", F.lit(0)) + F.coalesce("odd", F.lit(0))).cast("long").alias("dear"), *map(zero, ("unpaid", "positive", "unmatched", "drifted", "wrong")))


def ordered(tracks: DataFrame) -> DataFrame:
    return tracks.orderBy("video_id", F.col("id"), "frame")
