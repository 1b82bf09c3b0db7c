"""The facade by values: ends by durations, whole contexts, answers by blocks, bundles in tasks, probes, cards and retention."""

import io
import json
import zipfile

import pyarrow.parquet as pq
import pytest

from gazeloom.api import Engine
from test_exports import bodies
from test_probe import clip


def test_segments_end_by_the_recording(spark, tmp_path):
    spark.createDataFrame([("a", 9.4), ("b", 0.0), ("c", None)], "id string, duration_seconds double").write.parquet(f"{tmp_path}/videos")
    rows = [(v, float(t), "walks" if t < 5 else "waits", 0.5, "sees a gate" if t < 5 else "rests idle now") for v in "abcd" for t in range(10)]
    labels = spark.createDataFrame(rows, "video_id string, ts double, task string, confidence double, description string")
    e = Engine(spark, str(tmp_path))
    for closed in (True, False):
        got = {(r.video_id, r.start): r.end for r in e.run_segments(labels, closed).collect()}
        assert got == {(v, s): x for v in "abcd" for s, x in ((0.0, 5.0), (5.0, 9.4 if v == "a" else 10.0))}
    short = labels.selectExpr("*", "8.5D as duration_seconds")
    assert {r.end for r in e.run_segments(short).where("start = 5").collect()} == {8.5}
    assert Engine(spark, f"{tmp_path}/none").run_segments(labels).count() == 8  # no table of videos


def test_blank_descriptions_are_none(spark, tmp_path):
    rows = [("a", float(t), "walks", 0.5, d) for t, d in enumerate(["\t\n", "opens a gate", " \r", "opens the gate", None, "opens gate"])]
    labels = spark.createDataFrame(rows, "video_id string, ts double, task string, confidence double, description string")
    e = Engine(spark, str(tmp_path))
    assert [(r.start, r.end) for r in e.run_segments(labels, closed=False).collect()] == [(1.0, 6.0)]
    assert e.run_segments(labels).first().description == "opens a gate"


def test_contexts_have_headers_and_metrics(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("video-one", "a.mov", "Maple", 61.0), ("video-two", "b.mov", "", 5.0)], "id string, original_filename string, property_tag string, duration_seconds double").write.parquet(f"{root}/videos")
    spark.createDataFrame([("video-one", 0.0, 40.0, "idle/waiting", "rests"), ("video-one", 40.0, 61.0, "moving container", " ")], "video_id string, start_time double, end_time double, task_label string, description string").write.parquet(f"{root}/segments")
    spark.createDataFrame([("video-one", "downtime", 0.0, 40.0, 40.0), ("video-one", "service", 40.0, 61.0, 21.0)], "video_id string, type string, start_time double, end_time double, duration_seconds double").write.parquet(f"{root}/events")
    hand = [[[0.1, 0.2, 0.3]] * 21, []]
    spark.createDataFrame([("video-one", k, 100.0 * k, hand[k % 2], None) for k in range(11)], "video_id string, frame_number int, timestamp_ms double, left_hand_landmarks array<array<double>>, right_hand_landmarks array<array<double>>").write.parquet(f"{root}/hand_pose")
    [r] = Engine(spark, root).build_context().collect()
    lines = r.context.split("\n")
    assert r.video_id == "video-one" and lines[0] == "VIDEO [video-on] file=a.mov, property=Maple, duration=61s"
    assert lines[1] == "  duration_active_hands=0.6s, service_events=1, downtime=40.0s, contamination=0"
    assert lines[3].strip() == "00:00–00:40: rests" and len(lines) >= 4


@pytest.mark.parametrize(("n", "most", "prompts"), [(0, 50, 1), (1, 50, 1), (50, 50, 1), (51, 50, 3), (7, 1, 14), (120, 10, 15)])
def test_answers_by_blocks(spark, tmp_path, n, most, prompts):
    rows = [(f"v{k:03}", 0.0, 1.0, "idle/waiting", f"sees thing {k:03}") for k in range(n)]
    spark.createDataFrame(rows, "video_id string, start_time double, end_time double, task_label string, description string").write.parquet(f"{tmp_path}/segments")
    asked = []
    found = Engine(spark, str(tmp_path)).answer("what?", lambda c, q: asked.append(c) or c, most=most)
    assert found["videos"] == n and found["answer"].count("sees thing") == n and len(asked) == prompts


def store(spark, root):
    videos = [("v", "a.mov", "op", 180, "processed", f"file://{root}/raw/v.mp4", None), ("w", "b.mov", None, None, "failed", f"file://{root}/raw/w.mp4", 4.0), ("x", "c.mov", None, None, "processed", f"file://{root}/raw/none.mp4", 0.0), ("y", "d.mov", None, None, "processed", None, 2.0)]
    spark.createDataFrame(videos, "id string, original_filename string, operator_id string, operator_height_cm int, status string, raw_key string, duration_seconds double").write.parquet(f"{root}/videos")
    spark.createDataFrame([("v", 1.0, 2.0, "idle/waiting", None), ("v", 0.0, 1.0, "moving container", "lifts"), ("y", 0.0, 2.0, "idle/waiting", "rests")], "video_id string, start_time double, end_time double, task_label string, description string").write.parquet(f"{root}/segments")
    spark.createDataFrame([("v", "idle", 1.0, 2.0, 1.0)], "video_id string, type string, start_time double, end_time double, duration_seconds double").write.parquet(f"{root}/events")
    spark.createDataFrame([("v", k, 100.0 * (3 - k)) for k in range(4)] + [("x", 0, 0.0)], "video_id string, frame_number int, timestamp_ms double").write.parquet(f"{root}/hand_pose")
    bodies(spark, {"v": 2}).write.parquet(f"{root}/body_pose")
    (root / "anonymized").mkdir(), (root / "raw").mkdir()
    (root / "anonymized/v.mp4").write_bytes(b"\0\0\0\x18ftypmp42" * 100_000)
    for name in "vw":
        (root / f"raw/{name}.mp4").write_bytes(clip())
    return Engine(spark, str(root))


def test_bundles_in_tasks_equal_single_ones(spark, tmp_path):
    e = store(spark, tmp_path)
    out = tmp_path / "out"
    assert {r.video_id: r.members for r in e.export_bundles(str(out)).collect()} == {"v": 8, "w": 2, "x": 3, "y": 3}
    for v in "vwxy":
        many, one = zipfile.ZipFile(out / f"bundles/{v}.zip"), zipfile.ZipFile(io.BytesIO(e.export_bundle(v)))
        assert many.testzip() is None and sorted(many.namelist()) == sorted(one.namelist()) and many.namelist()[-1] == "manifest.json", v
        for name in one.namelist():
            if name.endswith(".parquet"):
                assert pq.read_table(io.BytesIO(many.read(name))).to_pylist() == pq.read_table(io.BytesIO(one.read(name))).to_pylist()
            elif name == "manifest.json":
                a, b = json.loads(many.read(name)), json.loads(one.read(name))
                assert a["contents"] == b["contents"] and a["video"] == b["video"] and a["processing"]["events"]["event_count"] == b["processing"]["events"]["event_count"]
            elif name.endswith(".json"):
                assert json.loads(many.read(name)) == json.loads(one.read(name))
            else:
                assert many.read(name) == one.read(name)
    some = e.export_bundles(str(tmp_path / "some"), spark.createDataFrame([("w",), ("none",)], "video_id string"))
    assert [r.video_id for r in some.collect()] == ["w"] and [p.name for p in (tmp_path / "some/bundles").glob("*.zip")] == ["w.zip"]


def test_durations_come_from_containers(spark, tmp_path):
    e = store(spark, tmp_path)
    assert {r.id: r.duration_seconds for r in e.backfilled().collect()} == {"v": 10.01, "w": 4.0, "x": None, "y": 2.0}


def test_uploads_are_retired(spark, tmp_path):
    e = store(spark, tmp_path)
    assert e.retire_uploads(retain=True).count() == 0 and (tmp_path / "raw/v.mp4").exists()
    assert {r.id: r.outcome for r in e.retire_uploads().collect()} == {"v": "deleted", "x": "gone"}
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["w.mp4"]  # that of a failed video stays
    assert {r.id: r.outcome for r in e.retire_uploads().collect()} == {"v": "gone", "x": "gone"}


def test_cards_are_made_of_tables(spark, tmp_path):
    e = store(spark, tmp_path)
    runs = spark.createDataFrame([(1.0, "ego", 400, None, 84.69, 22.6), (2.0, "ego", 601, None, 69.97, 22.63), (1.0, "synthetic-selftest", None, 200, 0.0, 21.1), (3.0, "body", None, 50, 70.0, 30.0)], "ts double, dataset string, n bigint, n_samples bigint, mpjpe_mm double, pa_mpjpe_mm double")
    lines = e.card(runs, "Set").splitlines()
    assert lines[0] == "# Set" and "- Episodes: 2" in lines and "- Frames: 5" in lines and "- Hours: 0.0" in lines
    assert [x for x in lines if x.startswith("| body") or x.startswith("| ego")] == ["| body | 50 | 70.0 | 30.0 |", "| ego | 601 | 69.97 | 22.63 |"] and "selftest" not in "".join(lines)
