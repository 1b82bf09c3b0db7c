import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.functions import geometry as g
from gazeloom.operators import body, folds
from gazeloom.sources import export, frames, tables


def test_alignment_recovers_a_similarity():
    rng = np.random.default_rng(0)
    truth = rng.normal(size=(17, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert np.allclose(folds.similarity_aligned(1.4 * truth @ q + 3, truth), truth)


def test_skeleton_confidence_and_provenance(spark):
    hand = [[0.5, 0.5, 0.0]] * 21
    hands = spark.createDataFrame([("v", 100.0, None, hand), ("w", 0.0, None, None)], "video string, timestamp_ms double, left_hand_landmarks array<array<double>>, right_hand_landmarks array<array<double>>")
    heads = spark.createDataFrame([("v", 90.0, [1.0, 0.0, 0.0, 0.0], True), ("v", 110.0, [0.0, 1.0, 0.0, 0.0], False)], "video string, timestamp_ms double, quaternion array<double>, tracked boolean")
    got = {r.video: r for r in body.fuse(hands, heads, "video").collect()}
    j = got["v"].joints
    assert got["v"].root_tracked and got["v"].root_quaternion[0] == 1  # the earlier of two equally near
    assert j["head"].confidence == 0.2 and j["head"].pos == pytest.approx([0, 0.68, 0.034], abs=1e-4)
    assert (j["l_wrist"].confidence, j["l_wrist"].source) == (0.225, "inferred") and j["r_wrist"].source == "measured"
    assert got["w"].joints["head"].confidence == pytest.approx(0.08)


def test_quaternions_round_trip(spark):
    r = spark.createDataFrame([([0.5, 0.5, 0.5, 0.5],), ([0.0, 0.0, 0.0, 1.0],)], "q array<double>").select("q", g.matrix_quaternion(g.quaternion_matrix(F.col("q"))).alias("b")).collect()
    for x in r:
        assert np.allclose(x.q, x.b)


def test_episodes_written_and_validated(spark, tmp_path):
    joints = F.map_from_arrays(F.array(*[F.lit(n) for n in body.JOINTS]), F.array(*[F.struct(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)).alias("pos"), F.lit(0.5).alias("confidence"), F.lit("ik").alias("source")) for _ in body.JOINTS]))
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 100.0), ("b", 0, 0.0)], "video string, frame_number int, timestamp_ms double").withColumn("joints", joints).withColumn("root_quaternion", F.array(*[F.lit(1.0)] * 4)).withColumn("root_tracked", F.lit(True))
    assert export.long_joints(df, "video").count() == 3 * 17
    info = export.write_episodes(export.episodes(df, "video"), str(tmp_path / "set"), "task", 10.0)
    assert (info["total_frames"], info["total_episodes"], len(info["stats"]["observation.state"]["mean"])) == (3, 2, 51)
    assert export.validate_episodes(spark, str(tmp_path / "set"), info) == []


def test_clip_source_and_fakes(spark):
    df = frames.clips(spark, clips=2, fps=30, seconds=2, stride=3, size=4)
    assert df.count() == 40
    assert "detections" in frames.detect(df, frames.provider("fake")).columns
    with pytest.raises(ValueError):
        frames.provider("none")


def test_hand_pose_metadata_and_guard(spark, tmp_path):
    hand = [[float(i), i + 0.1, i - 0.1] for i in range(21)]
    df = spark.createDataFrame([(0, 0.0, hand, None, 0.9, None), (3, 100.0, None, None, None, None)], "frame_number int, timestamp_ms double, left_hand_landmarks array<array<float>>, right_hand_landmarks array<array<float>>, left_confidence float, right_confidence float")
    tables.write_hand_pose(df, str(tmp_path / "h"), {"model": "m", "landmark_count": "21"})
    assert tables.hand_pose_metadata(spark, str(tmp_path / "h"))["landmark_count"] == "21"
    back = tables.read_hand_pose(spark, str(tmp_path / "h")).orderBy("frame_number").collect()
    assert back[1].left_hand_landmarks is None and np.allclose(back[0].left_hand_landmarks, hand)
    with pytest.raises(ValueError):
        tables.storage_path("/root", "../x")


def test_streaming_counts_match_batch(spark, tmp_path):
    from gazeloom.streaming import windows

    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), (F.col("id") % 2).cast("string").alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", "10 minutes", "kind", "1 minute").writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = set(map(tuple, spark.table("counts").collect())), set(map(tuple, windows.tumbling(rows, "ts", "10 minutes", "kind").collect()))
    assert got and got <= want
