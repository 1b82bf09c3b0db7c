"""Functions that no table stands in for: tolerant JSON, media, documents, text boxes, retries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.functions import geometry as g
from gazeloom.functions import text
from gazeloom.operators import folds, metrics, sequence, tables
from gazeloom.sources import tables as stored


def test_tolerant_hands(spark):
    points = [[k, k + 0.5] for k in range(21)]
    named = [{"x": k, "y": k + 0.5} for k in range(21)]
    replies = [
        json.dumps([{"keypoints": points, "is_right": False}]), json.dumps({"hands": [{"joints_2d": named, "side": "Left"}]}), json.dumps({"landmarks_2d": points}), "no json", None, json.dumps({"predictions": [{"keypoints": points[:5]}]}), json.dumps([points]),
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "k int, reply string").select("k", F.explode_outer(text.hands_of(F.col("reply"))).alias("hand"))
    got = {r.k: (r.points, r.right) for r in df.select("k", text.hand_points(F.col("hand")).alias("points"), text.is_right_hand(F.col("hand")).alias("right")).collect()}
    want = [[float(a), float(b)] for a, b in points]
    assert got[0] == (want, False) and got[1] == (want, False) and got[2] == (want, True) and got[6] == (want, True)
    assert got[3][0] is None and got[4][0] is None and got[5][0] is None


def test_media_reads_heads_and_ranges(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"\0\0\0\x18ftypisom" + bytes(range(100)))
    (tmp_path / "b.mp4").write_bytes(b"not a film at all")
    (tmp_path / "c.mp4").write_bytes(b"")
    files = stored.media(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["a.mp4"]
    assert [tuple(r)[1:] for r in stored.media_range(files, 4, 7).collect()] == [(b"ftyp", 206)]
    assert [tuple(r)[1:] for r in stored.media_range(files, 500, 600).collect()] == [(None, 416)]


def test_pose_documents_round_trip(spark):
    rows = [("v", 20.0, [1.0, 2.0, 3.0], True), ("v", 10.0, None, False), ("w", 0.0, [0.0, 0.0, 0.0], True)]
    frames = spark.createDataFrame(rows, "video string, timestamp_ms double, position array<double>, tracked boolean")
    docs = stored.pose_document(frames, "video", schema="head/1")
    first = json.loads(docs.where("video = 'v'").first().document)
    assert (first["schema"], first["frame_count"], [x["timestamp_ms"] for x in first["frames"]]) == ("head/1", 2, [10.0, 20.0])
    back = stored.read_poses(docs, "video", "document", "timestamp_ms double, position array<double>, tracked boolean")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))


def test_text_boxes(spark):
    scores, geometry = np.zeros((3, 4)), np.zeros((5, 3, 4))
    scores[1, 2], geometry[:, 1, 2] = 0.9, (2, 6, 3, 5, 0)
    boxes, sure = folds.text_boxes(scores, geometry, 0.5)
    assert boxes.tolist() == [[3.0, 2.0, 14.0, 7.0]] and sure.tolist() == [0.9]
    df = spark.createDataFrame([(3, 4, scores.ravel().tolist(), geometry.ravel().tolist())], "rows int, columns int, scores array<double>, geometry array<double>")
    assert [tuple(b) for b in folds.decode_text(df, "rows", "columns", "scores", "geometry", 0.5).first().text_boxes] == [(3.0, 2.0, 14.0, 7.0, 0.9)]


@pytest.mark.parametrize("seed", range(5))
def test_merging_short_segments_equals_its_definition(seed):
    rng = np.random.default_rng(seed)
    cuts = np.round(np.cumsum(rng.choice([0.5, 1.0, 2.0, 3.0], 40)), 3).tolist()
    segments = [{"start": a, "end": b, "label": str(k)} for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    want = [dict(s) for s in segments]
    span = lambda s: round(s["end"] - s["start"], 3)
    while len(want) > 1 and (short := [k for k, s in enumerate(want) if span(s) < 1.5]):
        i = short[0]
        if i == len(want) - 1 or (i and span(want[i - 1]) >= span(want[i + 1])):
            want[i - 1]["end"] = want[i]["end"]
        else:
            want[i + 1]["start"] = want[i]["start"]
        del want[i]
    assert folds.merge_short_list(segments, 1.5) == want


def test_retries_wait_and_stages_go_on(spark):
    tries = []

    def fails():
        tries.append(1)
        raise ValueError

    assert tables.run_stages(spark, [("a", fails), ("b", lambda: None)], attempts=2, wait=0.01) == {"a": "failed after 2: ValueError", "b": "ok"} and len(tries) == 2


def test_last_segment_ends_with_the_recording(spark):
    rows = spark.createDataFrame([("v", float(t), lab, 0.5, "d", 2.5) for t, lab in enumerate(["walk the dog", "walk the cat", "sit"])], "video string, t double, label string, confidence double, description string, whole double")
    got = folds.open_segments(rows, "video", "t", "label", "confidence", "description", duration="whole").collect()
    assert [(r.start, r.end, r.label) for r in got] == [(0.0, 2.0, "walk the dog"), (2.0, 2.5, "sit")]
    assert folds.open_segments(rows, "video", "t", "label", "confidence", "description").collect()[-1].end == 3.0


def test_tracker_follows_and_splits(spark):
    rows = [("v", 0, 0, 0.0), ("v", 1, 0, 2.0), ("v", 1, 1, 500.0), ("v", 9, 0, 2.0), ("w", 0, 0, 2.0)]
    df = spark.createDataFrame([(a, f, k, x, x, x + 40, x + 40) for a, f, k, x in rows], "video string, frame int, k int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.video, r.frame, r.k): r.track for r in folds.track_boxes(df, "video", "frame", "k", 5).collect()}
    assert got == {("v", 0, 0): 0, ("v", 1, 0): 0, ("v", 1, 1): 1, ("v", 9, 0): 2, ("w", 0, 0): 0}


def test_small_ones(spark):
    one = spark.range(1)
    r = one.select(g.next_multiple(F.lit(100)).alias("a"), g.next_multiple(F.lit(5)).alias("b"), text.money(F.lit(12500.0)).alias("c"), text.money(F.lit(1250.0)).alias("d"), text.money(F.lit(3.456)).alias("e")).first()
    assert tuple(r) == (96, 32, "$13k", "$1.3k", "$3.46")
    v = spark.createDataFrame([("a", "processed", "k"), ("b", "failed", "k"), ("c", "processed", None)], "id string, status string, raw_key string")
    assert [r.id for r in metrics.raw_to_delete(v).collect()] == ["a"] and metrics.ready(v).count() == 2
    t = spark.createDataFrame([("v", 1.0, 1.0), ("v", 2.0, None), ("v", 3.0, 3.0), ("v", 9.0, None)], "k string, t double, v double")
    assert [r.v for r in sequence.gap_fill(t, "k", "t", "v", max_gap=2.0).orderBy("t").collect()] == [1.0, 2.0, 3.0, None]
