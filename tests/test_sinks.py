"""Sinks in two phases: all of a dataset or nothing, also when a task fails midway; clips of frames are read by the probe."""

import json
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gazeloom.sources import export, frames, sink
from gazeloom.sources.probe import probe


@pytest.fixture
def registered(spark):
    for s in (sink.EpisodeSink, sink.ClipCopySink, sink.FrameSink):
        spark.dataSource.register(s)
    return spark


def rows(spark, n=6, length=4, first=0):
    return spark.range(n * length).select((F.col("id") / length).cast("long").alias("e"), "id").select((F.col("e") + first).alias("episode_index"), (F.col("id") % length).alias("frame_index"), (F.col("id") * 1.5).alias("v")).repartition(3, "episode_index").sortWithinPartitions("episode_index", "frame_index")


def save(df, path, mode="overwrite", **options):
    df.write.format("episodes").mode(mode).options(place="data/{episode_chunk:03d}/{episode_index:06d}.parquet", task="t", **options).save(str(path))


def listing(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.startswith("."))


def test_all_episodes_are_shown(registered, tmp_path):
    save(rows(registered), tmp_path / "d", chunk=4)
    assert listing(tmp_path / "d") == [*(f"data/{k // 4:03d}/{k:06d}.parquet" for k in range(6)), "meta/episodes.jsonl"]
    assert pq.read_table(tmp_path / "d/data/001/000005.parquet").column("v").to_pylist() == [30.0, 31.5, 33.0, 34.5]
    assert [json.loads(x) for x in open(tmp_path / "d/meta/episodes.jsonl")] == [{"episode_index": k, "tasks": ["t"], "length": 4} for k in range(6)]


def test_names_may_have_dots(registered, tmp_path):
    save(rows(registered, 2), tmp_path / "d", names=json.dumps(["episode_index", "frame_index", "a.v"]))
    assert pq.read_table(tmp_path / "d/data/000/000001.parquet").column_names == ["episode_index", "frame_index", "a.v"]


def failing(df):
    """Fails in the middle of an episode that comes late in its task, after others were written whole."""
    return df.withColumn("v", F.when((F.col("episode_index") == 5) & (F.col("frame_index") == 2), F.raise_error(F.lit("stop"))).otherwise(F.col("v")))


def test_a_failed_task_leaves_no_file(registered, tmp_path):
    with pytest.raises(Exception, match="stop"):
        save(failing(rows(registered)), tmp_path / "d")
    assert listing(tmp_path / "d") == [] and not (tmp_path / "d" / sink.STAGING).exists()


def test_a_failed_job_leaves_the_last_dataset(registered, tmp_path):
    save(rows(registered, 3), tmp_path / "d")
    before = listing(tmp_path / "d")
    with pytest.raises(Exception, match="stop"):
        save(failing(rows(registered)), tmp_path / "d")
    assert listing(tmp_path / "d") == before
    save(rows(registered, 2), tmp_path / "d")  # and a whole one replaces it
    assert listing(tmp_path / "d") == ["data/000/000000.parquet", "data/000/000001.parquet", "meta/episodes.jsonl"]


def test_episodes_are_added(registered, tmp_path):
    save(rows(registered, 2), tmp_path / "d")
    save(rows(registered, 2, first=2), tmp_path / "d", "append")
    assert [json.loads(x)["episode_index"] for x in open(tmp_path / "d/meta/episodes.jsonl")] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="is there already"):
        save(rows(registered, 2, first=3), tmp_path / "d", "append")
    assert len(listing(tmp_path / "d")) == 5 and not (tmp_path / "d" / sink.STAGING).exists()


def test_episodes_in_several_tasks_are_refused(registered, tmp_path):
    split = rows(registered, 2, 40).repartition(3, "frame_index").sortWithinPartitions("episode_index", "frame_index")
    with pytest.raises(Exception, match="several tasks"):
        save(split, tmp_path / "d")
    assert listing(tmp_path / "d") == []


def test_files_of_lost_attempts_are_not_shown(tmp_path):
    """A writer by itself: two attempts of a task wrote, one of them counts."""
    import pyarrow as pa

    w = sink.EpisodeWriter({"path": str(tmp_path / "d"), "place": "data/{episode_index}.parquet"}, True)
    batch = pa.RecordBatch.from_pydict({"episode_index": [0, 0, 1], "frame_index": [0, 1, 0]})
    w.write(iter([batch.slice(0, 2)]))  # lost before its message came
    messages = [w.write(iter([batch])), None]
    assert not (tmp_path / "d/data").exists()
    w.commit(messages)
    assert listing(tmp_path / "d") == ["data/0.parquet", "data/1.parquet", "meta/episodes.jsonl"]


def test_a_missing_clip_leaves_no_copies(spark, tmp_path):
    (tmp_path / "x.mp4").write_bytes(b"clip")
    numbered = spark.createDataFrame([(1, str(tmp_path / "x.mp4")), (2, str(tmp_path / "none.mp4"))], "episode_index long, path string")
    with pytest.raises(Exception, match="none.mp4"):
        export.copy_clips(numbered, str(tmp_path / "set"), "path")
    assert listing(tmp_path / "set") == []


def test_clips_of_frames_are_probed(spark, tmp_path):
    made = frames.clips(spark, clips=3, seconds=3, size=8)
    out = sink.write_clips(made, str(tmp_path / "v"), fps=25, width=640, height=480, encoder=lambda: lambda image: b"\xff\xd8" + image)
    assert {r.video_id: r.frames for r in out.collect()} == {f"clip{k}": 90 for k in range(3)}
    assert listing(tmp_path / "v") == ["clips/clip0.mp4", "clips/clip1.mp4", "clips/clip2.mp4", "clips/clips.jsonl"]
    files = spark.createDataFrame([(f"file://{tmp_path}/v/clips/clip{k}.mp4",) for k in range(3)], "path string")
    for r in probe(files).collect():
        assert (r.width, r.height, r.fps, r.frame_count, r.duration_seconds, r.codec, r.error) == (640, 480, 25.0, 90, 3.6, "jpeg", None)
    first = made.where("video_id = 'clip0'").orderBy("frame_number").first().image
    assert b"\xff\xd8" + first in (tmp_path / "v/clips/clip0.mp4").read_bytes()


def test_an_encoder_that_fails_leaves_no_clip(spark, tmp_path):
    def broken():
        seen = []

        def encode(image):
            seen.append(image)
            if len(seen) > 40:
                raise RuntimeError("encoder died")
            return image

        return encode

    began = time.time()
    with pytest.raises(Exception, match="encoder died"):
        sink.write_clips(frames.clips(spark, clips=2, seconds=2, size=4), str(tmp_path / "v"), encoder=broken)
    assert listing(tmp_path / "v") == [] and time.time() - began < 60


def test_recordings_stay_below_the_folder(spark, tmp_path):
    bad = spark.createDataFrame([("../out", 0, b"x")], "video_id string, frame_number int, image binary")
    with pytest.raises(Exception, match="leaves the store"):
        sink.write_clips(bad, str(tmp_path / "v"))
