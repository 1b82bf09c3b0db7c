"""Folds with state over several triggers against the same folds over the whole table."""

import os
import time

import pytest
from pyspark.sql import functions as F

from gazeloom.operators import folds, sequence
from gazeloom.streaming import windows

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, df, folder, make, until=None):
    """Rows of `make` over a stream that reads df's `part`s one trigger each; until: stop once this row is out, as timers go on without data."""
    parts = sorted(r.part for r in df.select("part").distinct().collect())
    for k in parts:
        df.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made = make(stream)
    q = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    ends = time.time() + 120
    while time.time() < ends and not q.awaitTermination(1):
        if until and os.path.isdir(f"{folder}/out/_spark_metadata") and until in [tuple(r) for r in spark.read.schema(made.schema).parquet(f"{folder}/out").collect()]:
            break
    q.stop()
    assert q.exception() is None
    return [tuple(r) for r in spark.read.schema(made.schema).parquet(f"{folder}/out").collect()]


def test_segments_close_as_in_the_batch(state, tmp_path):
    said = ["opens gate", "opens the gate", "opens gate", "walks on", "walks on", "", "rolls bin away", "rolls bin", "rolls bin away"]
    rows = [(v, float(k), s, 0.5 + k / 20, s * 2, k // 4) for v in ("a", "b") for k, s in enumerate(said[: 9 if v == "a" else 5])]
    df = state.createDataFrame(rows, "video_id string, t double, label string, confidence double, description string, part int")
    got = sorted(streamed(state, df, str(tmp_path), lambda s: windows.segment_stream(s, "video_id")))
    whole = sorted(tuple(r) for r in folds.open_segments(df, "video_id", "t", "label", "confidence", "description").collect())
    last = {v: max(r[1] for r in whole if r[0] == v) for v in ("a", "b")}  # the open ones wait for what comes
    assert got == [r for r in whole if r[1] != last[r[0]]] and len(got) == 4


def test_fills_wait_for_the_next_value(state, tmp_path):
    values = [None, 1.0, None, None, 4.0, None, None, None, None, 2.0, None, 3.0, None]
    df = state.createDataFrame([("a", k / 10, v, k // 3) for k, v in enumerate(values)], "video_id string, t double, v double, part int")
    got = sorted(streamed(state, df, str(tmp_path), lambda s: windows.fill_stream(s, "video_id", 0.31)))
    whole = sorted(tuple(r) for r in sequence.gap_fill(df.drop("part"), "video_id", "t", "v", max_gap=0.31).select("video_id", "t", "v", "is_filled").collect())
    assert [(r[1], r[3]) for r in got] == [(r[1], r[3]) for r in whole[:-1]]  # the last row still waits
    assert [r[2] for r in got] == [None if r[2] is None else pytest.approx(r[2]) for r in whole[:-1]]


def test_quiet_keys_close_their_segment(state, tmp_path):
    rows = [("b", 0.0, "waits", 0.5, "", 0), *(("a", float(k), "walks", 0.5, "", k) for k in range(1, 4))]
    df = state.createDataFrame(rows, "video_id string, t double, label string, confidence double, description string, part int")
    want = ("b", 0.0, 1.0, "waits", 0.5, "")
    assert want in streamed(state, df, str(tmp_path), lambda s: windows.segment_stream(s, "video_id", 1.0, 0.1), want)


def test_smoothing_goes_on_between_triggers(state, tmp_path):
    values = [None if k == 9 else float(k % 4) for k in range(20)]
    df = state.createDataFrame([("a", k / 10, v, k // 5) for k, v in enumerate(values)], "video_id string, t double, v double, part int")
    got = sorted(streamed(state, df, str(tmp_path), lambda s: windows.smooth_stream(s, "video_id")))
    want = folds.one_euro([None if v is None else [v] for v in values], [k * 100.0 for k in range(20)])
    assert [r[2] for r in got] == [None if x is None else pytest.approx(float(x[0]), rel=1e-4) for x in want]
