"""Progress of runs: reports while a batch runs, observed metrics once it has ended, a listener for streams."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def percent_of(done: int, total: int) -> int:
    """Whole percent, 0 where the total is unknown."""
    return int(done / total * 100) if total > 0 else 0


def observed(rows: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The same rows, and what an action on them saw, once it has ended: rows, last_frame. No second pass is made."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("rows"), F.max("frame").alias("last_frame")), seen


class BatchProgress:
    """Within `with BatchProgress(...) as p:`, report(phase, done, total) tells of actions while they run.

    done is p.frames, an accumulator that detect() and track() count frames in (it grows as tasks end), or, while nothing is counted, the share of
    tasks that have ended. It is told whenever `every` more frames are done, and once at the end; a report that fails ends nothing.
    """

    def __init__(self, spark: SparkSession, report: Callable[[str, int, int], None], total: int = 0, every: int = 1, phase: str = "", wait: float = 0.2):
        self.context, self.report, self.total, self.every, self.phase, self.wait = spark.sparkContext, report, total, max(1, every), phase, wait
        self.frames, self.told, self.over = self.context.accumulator(0), 0, threading.Event()
        self.group = f"driftwork-{uuid.uuid4().hex[:8]}"

    def done(self) -> int:
        if self.frames.value:
            return int(self.frames.value)
        tracker = self.context.statusTracker()
        stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup(self.group) for k in (getattr(tracker.getJobInfo(j), "stageIds", None) or [])]
        tasks = [(s.numCompletedTasks, s.numTasks) for s in stages if s]
        return self.total * sum(d for d, _ in tasks) // max(1, sum(n for _, n in tasks))

    def _tell(self, at_end: bool = False) -> None:
        now = self.done()
        if now - self.told >= self.every or (at_end and now != self.told):
            self.told = now
            self.report(self.phase, now, self.total)

    def _watch(self) -> None:
        while not self.over.wait(self.wait):
            self._tell()

    def __enter__(self) -> BatchProgress:
        self.context.setJobGroup(self.group, self.phase or "driftwork")
        self.thread = InheritableThread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.over.set()
        self.thread.join()
        self.context.setLocalProperty("spark.jobGroup.id", None)
        if kind is None:
            self._tell(at_end=True)


class StreamProgress(StreamingQueryListener):
    """Calls report(phase, rows so far, total) after each micro-batch of the query with this name."""

    def __init__(self, report: Callable[[str, int, int], None], total: int = 0, query: str | None = None):
        self.report, self.total, self.query, self.done = report, total, query, 0

    def onQueryStarted(self, event):
        if self._mine(event.name):
            self.report(event.name or "", 0, self.total)

    def onQueryProgress(self, event):
        if self._mine(event.progress.name):
            self.done += event.progress.numInputRows
            self.report(event.progress.name or "", self.done, self.total)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def _mine(self, name: str | None) -> bool:
        return self.query is None or name == self.query
