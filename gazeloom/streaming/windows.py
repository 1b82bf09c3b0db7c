"""Streams of observations: windowed counts, sessions, duplicates, and folds with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gazeloom.config import Thresholds
from gazeloom.operators.folds import alike

T = Thresholds()


def tumbling(events: DataFrame, ts: str, width: str, by: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts by window and column; the same for a batch and, with a watermark, a stream."""
    events = events.withWatermark(ts, late) if late else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    events = events.withWatermark(ts, late) if late else events
    return events.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def once(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def ingest(spark: SparkSession, source: str, schema, target: str, key: str, checkpoint: str) -> None:
    """All files of a folder that are new since the last call, replacing the keys they hold."""
    from gazeloom.operators.tables import replace_keys

    stream = spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.foreachBatch(lambda df, _: replace_keys(df, target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


class SmoothingState(StatefulProcessor):
    """One-Euro smoothing of a scalar per key, online: state is the value, its speed and its time. A null resets it."""

    def __init__(self, min_cutoff: float = 1.5, beta: float = 0.04):
        self.min_cutoff, self.beta = min_cutoff, beta

    def init(self, handle) -> None:
        self.state = handle.getValueState("last", "x double, speed double, t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import math

        gain = lambda c, dt: 1 / (1 + 1 / (2 * math.pi * c) / dt)
        for batch in rows:
            out = []
            for t, v in batch.sort_values("t")[["t", "v"]].itertuples(index=False, name=None):
                if pd.isna(v):
                    self.state.clear()
                    out.append((key[0], t, None))
                    continue
                if self.state.exists():
                    x, speed, before = self.state.get()
                    dt = max(1e-3, t - before)
                    a = gain(1.0, dt)
                    speed = a * (v - x) / dt + (1 - a) * speed
                    a = gain(self.min_cutoff + self.beta * abs(speed), dt)
                    x = a * v + (1 - a) * x
                else:
                    x, speed = v, 0.0
                self.state.update((x, speed, t))
                out.append((key[0], t, x))
            yield pd.DataFrame(out, columns=["key", "t", "smoothed"]).astype({"smoothed": "float64"})

    def close(self) -> None:
        pass


def smooth_stream(df: DataFrame, key: str) -> DataFrame:
    """df: key, t (seconds), v. Appends smoothed values as rows arrive."""
    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).transformWithStateInPandas(SmoothingState(), outputStructType=f"key {kind}, t double, smoothed double", outputMode="append", timeMode="none")


class SegmentState(StatefulProcessor):
    """Segments of labels alike to their segment's first, online. State: the open segment, and one count a label it holds.

    A segment is given once a label unlike its first arrives; the open one is given when its key is quiet for `idle` seconds of processing time.
    """

    def __init__(self, interval: float = 1.0, idle: float | None = None):
        self.interval, self.idle = interval, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start double, last double, first string, confidence double, n long, description string")
        self.labels = handle.getMapState("labels", "label string", "n long, seen long")

    def _close(self, key, end: float | None) -> tuple:
        start, last, _, confidence, n, description = self.open.get()
        # the commonest label, of equally common ones the first seen
        label = max(((n, -seen, label) for (label,), (n, seen) in self.labels.iterator()), default=(0, 0, ""))[2]
        self.open.clear()
        self.labels.clear()
        return (key[0], start, last + self.interval if end is None else end, label, round(confidence / n, 3), description)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # batches of one trigger come in no order of time
        part, out = pd.concat(list(rows)).sort_values("t", kind="stable"), []
        for t, label, confidence, description in part[["t", "label", "confidence", "description"]].itertuples(index=False, name=None):
            label, description = label or "", description or ""
            if self.open.exists() and not alike(self.open.get()[2], label):
                out.append(self._close(key, t))
            if self.open.exists():
                start, _, first, total, n, longest = self.open.get()
                self.open.update((start, t, first, total + confidence, n + 1, description if len(description) > len(longest) else longest))
            else:
                self.open.update((t, t, label, confidence, 1, description))
            n, seen = self.labels.getValue((label,)) if self.labels.containsKey((label,)) else (0, self.open.get()[4])
            self.labels.updateValue((label,), (n + 1, seen))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield pd.DataFrame(out, columns=["key", "start", "end", "label", "confidence", "description"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield pd.DataFrame([self._close(key, None)], columns=["key", "start", "end", "label", "confidence", "description"])

    def close(self) -> None:
        pass


def segment_stream(df: DataFrame, key: str, interval: float = 1.0, idle: float | None = None) -> DataFrame:
    """df: key, t (seconds), label, confidence, description, in order of time over triggers. Appends segments as they close."""
    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).transformWithStateInPandas(SegmentState(interval, idle), outputStructType=f"key {kind}, start double, end double, label string, confidence double, description string", outputMode="append", timeMode="none" if idle is None else "ProcessingTime")


class FillState(StatefulProcessor):
    """Linear fill of a scalar between valid rows `max_gap` seconds or less apart, online: rows without a value wait for the next valid one.

    State: the last valid row and the times that wait, of no more than `max_gap` seconds; times that waited longer are given unfilled.
    """

    def __init__(self, max_gap: float = T.max_fill_gap_seconds):
        self.max_gap = max_gap

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "t double, v double")
        self.waiting = handle.getListState("waiting", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part, out = pd.concat(list(rows)).sort_values("t", kind="stable"), []
        last = self.last.get() if self.last.exists() else None
        waiting = [t for (t,) in self.waiting.get()] if self.waiting.exists() else []
        for t, v in part[["t", "v"]].itertuples(index=False, name=None):
            gone = pd.isna(v)
            if not gone:
                near = last is not None and t - last[0] <= self.max_gap
                share = lambda w: (w - last[0]) / ((t - last[0]) or 1.0)
                out += [(key[0], w, (1 - share(w)) * last[1] + share(w) * v if near else None, near) for w in waiting]
                out.append((key[0], t, float(v), False))
                last, waiting = (float(t), float(v)), []
            elif last is None or t - last[0] > self.max_gap:
                # whatever comes next is too far from the last valid row
                out += [(key[0], w, None, False) for w in (*waiting, t)]
                waiting = []
            else:
                waiting.append(float(t))
        if last is not None:
            self.last.update(last)
        self.waiting.clear()
        if waiting:
            self.waiting.put([(t,) for t in waiting])
        yield pd.DataFrame(out, columns=["key", "t", "v", "is_filled"]).astype({"v": "float64"})

    def close(self) -> None:
        pass


def fill_stream(df: DataFrame, key: str, max_gap: float = T.max_fill_gap_seconds) -> DataFrame:
    """df: key, t (seconds), v (null where missing), in order of time over triggers. Appends key, t, v, is_filled once each row is decided."""
    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).transformWithStateInPandas(FillState(max_gap), outputStructType=f"key {kind}, t double, v double, is_filled boolean", outputMode="append", timeMode="none")
