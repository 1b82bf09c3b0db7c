"""Online tracks over several triggers against tracks of the whole recording, and what is left in state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gazeloom.operators import folds
from gazeloom.streaming import tracking
from test_streams import state, streamed  # noqa: F401 - a fixture and a helper

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
SCHEMA = "video_id string, frame long, ord long, ts timestamp, x0 double, y0 double, x1 double, y1 double, part int"


def detections(rng, video, frames, parts, jitter=0):
    """Boxes that drift, vanish and jump; parts follow the clock but for `jitter` frames."""
    rows, at = [], [[rng.uniform(0, 300), rng.uniform(0, 200)] for _ in range(4)]
    for f in range(frames):
        for k, p in enumerate(at):
            p[0] += rng.uniform(-9, 9)
            p[1] += rng.uniform(-9, 9)
            if rng.random() < 0.02:
                p[:] = [rng.uniform(0, 300), rng.uniform(0, 200)]
            if rng.random() < 0.7 and not (f // 40 % 2 and k == 1):
                part = min(parts - 1, max(0, (f + rng.randint(-jitter, jitter)) * parts // frames))
                rows.append((video, f, k, START + dt.timedelta(seconds=f / 30), p[0], p[1], p[0] + 40, p[1] + 40, part))
    return rows


def ends(parts, seconds=3600):
    """Rows of another key that push the watermark past all others, then one more trigger for the timers."""
    return [("end", k, 0, START + dt.timedelta(seconds=seconds + k), 0.0, 0.0, 1.0, 1.0, parts + k) for k in range(2)]


@pytest.mark.parametrize("jitter", [0, 20])
def test_tracks_are_those_of_the_recording(state, tmp_path, jitter):  # noqa: F811
    rng = random.Random(jitter)
    rows = detections(rng, "a", 200, 5, jitter) + detections(rng, "b", 120, 5, jitter)
    df = state.createDataFrame(rows + ends(5), SCHEMA)
    got = sorted(r for r in streamed(state, df, str(tmp_path), lambda s: tracking.track_stream(s, "video_id", 10, late="2 seconds", fps=30)) if r[0] != "end")
    whole = folds.track_boxes(df.where("video_id <> 'end'").drop("ts", "part"), "video_id", "frame", "ord", 10)
    want = sorted(tuple(r) for r in whole.select("video_id", "frame", "ord", "x0", "y0", "x1", "y1", "track").collect())
    assert got == want and len({r[-1] for r in got if r[0] == "a"}) > 8


def held(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state").where(F.col("key.key") != "end")


def test_state_is_bounded(state, tmp_path):  # noqa: F811
    rng = random.Random(3)
    df = state.createDataFrame(detections(rng, "a", 300, 6) + ends(6, 12), SCHEMA)
    got = streamed(state, df, str(tmp_path), lambda s: tracking.track_stream(s, "video_id", 5, late="1 second"))
    tracks = {r[-1] for r in got if r[0] == "a"}
    # of many tracks only those stay open whose last box is within the gap, and no detection waits
    assert len(tracks) > 20
    assert held(state, tmp_path, "waiting").count() == 0
    assert held(state, tmp_path, "open").count() <= 5


def test_quiet_keys_lose_their_tracks(state, tmp_path):  # noqa: F811
    rows = [("a", 0, 0, START, 0.0, 0.0, 9.0, 9.0, 0), ("b", 0, 0, START, 0.0, 0.0, 9.0, 9.0, 0)]
    end = [("end", k, 0, START + dt.timedelta(seconds=60 * k), 0.0, 0.0, 1.0, 1.0, k) for k in (1, 2, 3)]
    df = state.createDataFrame(rows + end, SCHEMA)
    got = streamed(state, df, str(tmp_path), lambda s: tracking.track_stream(s, "video_id", 5, late="1 second", fps=30))
    assert {(r[0], r[-1]) for r in got if r[0] != "end"} == {("a", 0), ("b", 0)}
    assert held(state, tmp_path, "open").count() == 0


def test_smoothed_points_equal_the_batch(state, tmp_path):  # noqa: F811
    rng = random.Random(6)
    values = [None if k == 9 else [rng.random() for _ in range(6)] for k in range(20)]
    df = state.createDataFrame([("a", k / 10, v, k // 5) for k, v in enumerate(values)], "video_id string, t double, v array<double>, part int")
    got = sorted(streamed(state, df, str(tmp_path), lambda s: tracking.smooth_points_stream(s, "video_id")))
    want = folds.one_euro(values, [k * 100.0 for k in range(20)])
    assert [r[2] for r in got] == [None if x is None else pytest.approx(x, rel=1e-4) for x in want]
