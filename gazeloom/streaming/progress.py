"""Progress of jobs and streams for those who wait, told no oftener than they can take, and the wish to stop."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Seconds between two reports, and shares of a run's passes.
PAUSE = 0.4
PASSES = (("detect", 0.45), ("render", 0.55))


class JobCancelled(Exception):
    """The work is no longer wanted."""


class Throttle:
    """Passes a share on if its whole percent has risen and `pause` seconds have gone since the last; 100 percent always, once."""

    def __init__(self, emit: Callable[[float], None], pause: float = PAUSE, clock: Callable[[], float] = time.monotonic):
        self.emit, self.pause, self.clock = emit, pause, clock
        self.percent, self.at = -1, float("-inf")

    def __call__(self, share: float) -> None:
        share = min(1.0, max(0.0, share))
        percent, now = int(share * 100 + 1e-9), self.clock()
        if percent <= self.percent or (now - self.at < self.pause and percent < 100):
            return
        self.percent, self.at = percent, now
        self.emit(round(share, 3))


def of_passes(emit: Callable[[float], None], passes: Sequence[tuple[str, float]] = PASSES) -> dict[str, Callable[[float], None]]:
    """For each pass of a run, a function that takes its own share and passes on that of the whole."""
    out, before = {}, 0.0
    for name, weight in passes:
        out[name] = lambda share, a=before, w=weight: emit(a + w * min(1.0, max(0.0, share)))
        before += weight
    return out


def job_share(spark: SparkSession, group: str) -> float:
    """Finished tasks of a group's jobs, each stage that is known counting alike; stages that have not begun count as nothing done."""
    tracker = spark.sparkContext.statusTracker()
    shares = []
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        if info is None:
            continue
        if info.status == "SUCCEEDED":
            shares += [1.0] * len(info.stageIds)  # skipped stages too
            continue
        for stage in info.stageIds:
            s = tracker.getStageInfo(stage)
            shares.append(s.numCompletedTasks / s.numTasks if s and s.numTasks else 0.0)
    return sum(shares) / len(shares) if shares else 0.0


def watched(spark: SparkSession, work: Callable[[], object], emit: Callable[[float], None], wanted: Callable[[], bool] = lambda: True, poll: float = 0.1, pause: float = PAUSE) -> object:
    """Runs work, whose jobs run on this thread, and tells their progress; ends at 1 if work does.

    Jobs that come later lower the share that is done, which is then not told until it rises again. Once `wanted` says no, running jobs are
    ended and JobCancelled is raised; what work did before stays. The group of jobs of the caller is gone afterwards.
    """
    group, over, unwanted = f"watched-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    told = Throttle(emit, pause)

    def look() -> None:
        while not over.wait(poll):
            if not wanted():
                unwanted.set()
                spark.sparkContext.cancelJobGroup(group)  # again while work goes on, as it may start another
                continue
            told(min(0.99, job_share(spark, group)))

    watcher = threading.Thread(target=look, daemon=True)
    spark.sparkContext.setJobGroup(group, "watched", interruptOnCancel=True)
    watcher.start()
    try:
        result = work()
    except Exception as e:
        if unwanted.is_set():
            raise JobCancelled(group) from e
        raise
    finally:
        over.set()
        watcher.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(name, None)
    if unwanted.is_set():
        raise JobCancelled(group)
    told(1.0)
    return result


class StreamProgress(StreamingQueryListener):
    """Tells the share of `total` rows that a query has read, by its name; 1 once it has ended without an error. Queries without that name are not told of."""

    def __init__(self, name: str, total: int, emit: Callable[[float], None], pause: float = PAUSE, clock: Callable[[], float] = time.monotonic):
        self.name, self.total, self.read = name, max(1, total), 0
        self.told, self.runs = Throttle(emit, pause, clock), set()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            self.read += p.numInputRows
            self.told(min(0.99, self.read / self.total))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.runs:
            self.runs.discard(str(event.runId))
            if event.exception is None:
                self.told(1.0)
