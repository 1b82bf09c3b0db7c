"""Tracks and smoothed points online: state by key in event time.

Detections of a key may come in any order within the watermark's delay. They wait in state until the
watermark has passed them, and are then taken frame by frame, so that tracks are those of the whole
recording whatever the triggers were. Open tracks are a list state: one goes as soon as a frame is more
than `max_gap` beyond its last box, and all go when a key has been quiet for that long in event time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gazeloom.config import Thresholds
from gazeloom.operators.folds import Tracker

T = Thresholds()
BOX = ("x0", "y0", "x1", "y1")


class TrackState(StatefulProcessor):
    """State: open tracks, the next track's number, and the detections that the watermark has not passed.

    One timer a key: the earliest detection that waits, or else the time by which nothing can go on with an open track.
    """

    def __init__(self, max_gap: int, match_iou: float = T.match_iou, expiry_ms: int | None = None):
        self.max_gap, self.match_iou, self.expiry_ms = max_gap, match_iou, expiry_ms

    def init(self, handle) -> None:
        box = ", ".join(f"{c} double" for c in BOX)
        self.handle = handle
        self.open = handle.getListState("open", f"track long, frame long, {box}")
        self.tracks = handle.getValueState("tracks", "n long")
        self.waiting = handle.getListState("waiting", f"frame long, ord long, ms long, {box}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows))
        held, first = list(self.handle.listTimers()), int(part["ms"].min())
        # a timer of detections that wait stands for the earliest; one of quiet tracks is set anew later
        if held and self.waiting.exists():
            first = min(first, *map(int, held))
        for t in held:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(first)
        self.waiting.appendList([tuple(r) for r in part[["frame", "ord", "ms", *BOX]].itertuples(index=False, name=None)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(r for r in waiting if r[2] <= passed)
        later = [r for r in waiting if r[2] > passed]
        tracker = Tracker(self.max_gap, self.match_iou)
        if self.tracks.exists():
            tracker.tracks = self.tracks.get()[0]
        if self.open.exists():
            tracker.open = [[t, frame, tuple(box)] for t, frame, *box in self.open.get()]
        out, at = [], 0
        while at < len(ready):
            end = at
            while end < len(ready) and ready[end][0] == ready[at][0]:
                end += 1
            found = tracker.frame(ready[at][0], [r[3:] for r in ready[at:end]])
            out += [(key[0], r[0], r[1], *r[3:], t) for r, t in zip(ready[at:end], found)]
            at = end
        newest = max((r[0] for r in ready), default=None)
        left = [t for t in tracker.open if newest is None or newest - t[1] <= self.max_gap]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        if not ready and not later:  # the key was quiet until nothing could go on
            left = []
        self.open.clear()
        if left:
            self.open.put([(t, frame, *box) for t, frame, box in left])
        self.tracks.update((tracker.tracks,))
        if later:
            self.handle.registerTimer(min(r[2] for r in later))
        elif left and self.expiry_ms is not None:
            self.handle.registerTimer(max(max(r[2] for r in ready) + self.expiry_ms, passed + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "frame", "ord", *BOX, "track"])

    def close(self) -> None:
        pass


def track_stream(df: DataFrame, key: str, max_gap: int, late: str = "2 seconds", fps: float | None = None, match_iou: float = T.match_iou) -> DataFrame:
    """df: key, frame, ord (order within a frame), ts (event time) and x0, y0, x1, y1. Appends key, frame, ord, the box and its track once the watermark has passed ts.

    Tracks are numbered by key from 0. Rows that come later than `late` are dropped, as for any watermark. fps: with it, a quiet key's open tracks end by event time.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.withWatermark("ts", late).select(F.col(key).alias("key"), F.col("frame").cast("long").alias("frame"), F.col("ord").cast("long").alias("ord"), "ts", F.unix_millis("ts").alias("ms"), *(F.col(c).cast("double").alias(c) for c in BOX))
    expiry = None if fps is None else math.ceil((max_gap + 1) * 1000 / fps)
    return rows.groupBy("key").transformWithStateInPandas(TrackState(max_gap, match_iou, expiry), outputStructType=f"key {kind}, frame long, ord long, {', '.join(f'{c} double' for c in BOX)}, track long", outputMode="append", timeMode="EventTime")


class PointsState(StatefulProcessor):
    """One-Euro smoothing of a vector per key, online: state is its values, their speeds and the time. One cutoff a row, from the speed of all values; a null resets it."""

    def __init__(self, min_cutoff: float = T.min_cutoff, beta: float = T.beta):
        self.min_cutoff, self.beta = min_cutoff, beta

    def init(self, handle) -> None:
        self.state = handle.getValueState("last", "x array<double>, speed array<double>, t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        def gain(cutoff: float, dt: float) -> float:
            return 1 / (1 + 1 / (2 * math.pi * cutoff) / dt)

        part, out = pd.concat(list(rows)).sort_values("t", kind="stable"), []
        held = self.state.get() if self.state.exists() else None
        last = None if held is None else (np.asarray(held[0], float), np.asarray(held[1], float), held[2])
        for t, v in part[["t", "v"]].itertuples(index=False, name=None):
            if v is None:
                last = None
                out.append((key[0], t, None))
                continue
            v = np.asarray(v, float)
            if last is None or len(last[0]) != len(v):
                x, speed = v, np.zeros(len(v))
            else:
                dt = max(1e-3, t - last[2])
                a = gain(1.0, dt)
                speed = a * (v - last[0]) / dt + (1 - a) * last[1]
                a = gain(self.min_cutoff + self.beta * float(np.linalg.norm(speed)), dt)
                x = (a * v + (1 - a) * last[0]).astype(np.float32)
            last = (x, speed, float(t))
            out.append((key[0], t, x.tolist()))
        if last is None:
            self.state.clear()
        else:
            self.state.update((last[0].tolist(), last[1].tolist(), last[2]))
        yield pd.DataFrame(out, columns=["key", "t", "smoothed"])

    def close(self) -> None:
        pass


def smooth_points_stream(df: DataFrame, key: str) -> DataFrame:
    """df: key, t (seconds), v (a vector, null where missing), in order of time over triggers. Appends key, t, smoothed."""
    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).transformWithStateInPandas(PointsState(), outputStructType=f"key {kind}, t double, smoothed array<double>", outputMode="append", timeMode="none")
