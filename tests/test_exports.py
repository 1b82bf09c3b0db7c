import io
import json
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gazeloom.api import Engine
from gazeloom.operators import body
from gazeloom.sources import export


def bodies(spark, counts):
    """Skeletons of recordings with so many frames; a count of 0 is a row without joints."""
    at = [F.struct(F.array(F.lit(0.1 * k), F.lit(0.2), F.lit(0.3)).alias("pos"), F.lit(k / 20).alias("confidence"), F.lit("ik").alias("source")) for k in range(17)]
    joints = F.map_from_arrays(F.array(*[F.lit(n) for n in body.JOINTS]), F.array(*at))
    rows = [(v, k, 100.0 * k, n > 0) for v, n in counts.items() for k in range(max(n, 1))]
    df = spark.createDataFrame(rows, "video_id string, frame_number int, timestamp_ms double, some boolean")
    return df.withColumn("joints", F.when(F.col("some"), joints).otherwise(F.create_map().cast(df.select(joints.alias("j")).schema["j"].dataType))).withColumn("root_quaternion", F.array(*[F.lit(1.0)] * 4)).withColumn("root_tracked", F.lit(True)).drop("some")


def test_episode_dataset_layout_and_faults(spark, tmp_path):
    df, out = bodies(spark, {"a": 3, "b": 0, "c": 2, "d": 1}), str(tmp_path / "set")
    for _ in range(2):  # a second writing replaces the first
        info = export.write_episodes(export.episodes(df, "video_id"), out, "a task", chunk=2)
    assert (info["total_episodes"], info["total_frames"], info["fps"], info["total_chunks"]) == (3, 6, 10.0, 2)
    files = sorted(str(p.relative_to(out)) for p in (tmp_path / "set").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert files == ["data/chunk-000/episode_000000.parquet", "data/chunk-000/episode_000001.parquet", "data/chunk-001/episode_000002.parquet", "meta/episodes.jsonl", "meta/info.json", "meta/stats.json", "meta/tasks.jsonl"]
    second = pq.read_table(f"{out}/data/chunk-000/episode_000001.parquet").to_pylist()
    assert [(r["frame_index"], r["index"], r["episode_index"]) for r in second] == [(0, 3, 1), (1, 4, 1)]
    assert [json.loads(x)["length"] for x in open(f"{out}/meta/episodes.jsonl")] == [3, 2, 1]
    stats = json.load(open(f"{out}/meta/stats.json"))
    assert stats["timestamp"]["max"][0] == pytest.approx(0.2) and stats["frame_index"]["count"] == [6] and len(stats["action"]["std"]) == 6
    assert stats["observation.confidence"]["mean"][10] == pytest.approx(0.5)
    assert export.validate_episodes(spark, out) == []
    (tmp_path / "set/meta/tasks.jsonl").unlink()
    pq.write_table(pq.read_table(f"{out}/data/chunk-000/episode_000001.parquet").slice(0, 1), f"{out}/data/chunk-000/episode_000001.parquet")
    assert export.validate_episodes(spark, out) == ["missing meta/tasks.jsonl", "5 frames, 6 described", "index isn't 0..frames-1", "1 episodes differ from their described length"]


def test_empty_episode_dataset(spark, tmp_path):
    out = str(tmp_path / "set")
    info = export.write_episodes(export.episodes(bodies(spark, {"b": 0}), "video_id"), out, "a task")
    assert (info["total_episodes"], info["fps"]) == (0, 10.0) and export.validate_episodes(spark, out) == []
    assert export.validate_episodes(spark, str(tmp_path / "none")) == ["missing meta/info.json"]


def test_clips_go_to_their_episodes(spark, tmp_path):
    (tmp_path / "x.mp4").write_bytes(b"clip" * 1000)
    numbered = spark.createDataFrame([(1, str(tmp_path / "x.mp4")), (2, None)], "episode_index long, path string")
    assert [tuple(r) for r in export.copy_clips(numbered, str(tmp_path / "set"), "path").collect()] == [(1, 4000)]
    assert (tmp_path / "set/videos/chunk-000/observation.images.ego/episode_000001.mp4").read_bytes() == b"clip" * 1000
    [r] = export.checksums(spark, str(tmp_path / "set/videos")).collect()
    import hashlib

    assert (r.bytes, r.sha256_16) == (4000, hashlib.sha256(b"clip" * 1000).hexdigest()[:16])


def test_body_model_targets_and_fit(spark):
    targets = export.body_model_targets(bodies(spark, {"a": 2, "b": 0}), "video_id")
    rows = targets.collect()
    assert len(rows) == 2 and rows[0].model_joints == sorted(export.BODY_MODEL_INDEX.values())
    assert rows[0].targets[rows[0].model_joints.index(15)][0] == pytest.approx(0.4)  # the head
    made = export.fit_body_model(targets, "video_id", lambda: lambda part: [[float(len(part))]] * len(part)).collect()
    assert [r.params for r in made] == [[2.0], [2.0]]


def test_contents_follow_what_is_there(spark):
    df = spark.createDataFrame([(1, True, True, True), (2, False, True, None), (3, False, False, True)], "id int, b boolean, h boolean, s boolean")
    got = {r.id: [m.path for m in r.c] for r in df.select("id", export.bundle_contents(body=F.col("b"), hands=F.col("h"), segments=F.col("s")).alias("c")).collect()}
    assert got[1] == [m[0] for m in export.MEMBERS]
    assert got[2] == ["anonymized.mp4", "hand_pose.parquet", "events.json", "manifest.json"]
    assert got[3] == ["anonymized.mp4", "segments.json", "events.json", "manifest.json"]


def test_bundle_of_everything(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("v", "a.mov", "op", 180), ("w", "b.mov", None, None)], "id string, original_filename string, operator_id string, operator_height_cm int").write.parquet(f"{root}/videos")
    spark.createDataFrame([("v", 1.0, 2.0, "idle/waiting")], "video_id string, start_time double, end_time double, task_label string").write.parquet(f"{root}/segments")
    spark.createDataFrame([("v", "idle", 1.0, 2.0, 1.0)], "video_id string, type string, start_time double, end_time double, duration_seconds double").write.parquet(f"{root}/events")
    spark.createDataFrame([("v", 0, 0.0)], "video_id string, frame_number int, timestamp_ms double").write.parquet(f"{root}/hand_pose")
    bodies(spark, {"v": 2}).write.parquet(f"{root}/body_pose")
    (tmp_path / "anonymized").mkdir()
    (tmp_path / "anonymized/v.mp4").write_bytes(b"\0\0\0\x18ftypmp42")
    e = Engine(spark, root)
    z = zipfile.ZipFile(io.BytesIO(e.export_bundle("v")))
    manifest = json.loads(z.read("manifest.json"))
    assert sorted(z.namelist()) == sorted(m["path"] for m in manifest["contents"]) == sorted(m[0] for m in export.MEMBERS)
    assert pq.read_table(io.BytesIO(z.read("pose_joints.parquet"))).num_rows == 34
    assert manifest["capture_metadata"]["operator"] == {"anonymized_id": "op", "height_cm": 180} and manifest["processing"]["body"]["frame_count"] == 2
    assert manifest["capture_metadata"]["camera"]["assumed_fov_deg"] == 90 and manifest["processing"]["events"]["event_count"] == 1
    bare = zipfile.ZipFile(io.BytesIO(e.export_bundle("w")))
    assert bare.namelist() == ["events.json", "manifest.json"] and json.loads(bare.read("events.json")) == []
    with pytest.raises(KeyError):
        e.export_bundle("none")
    assert [(bytes(r.body), r.status) for r in e.media_range("v", 4, 7).collect()] == [(b"ftyp", 206)]
    assert e.media_range("w", 0, 1).count() == 0 and e.body_pose("v").count() == 2
    [up] = e.ingest(f"{root}/anonymized", operator_id="op").collect()
    assert (up.original_filename, up.status, up.operator_id, up.bytes) == ("v.mp4", "uploaded", "op", 12)
