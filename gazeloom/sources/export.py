"""Dataset exports: long joints, episode tables with statistics, bundles and cards."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.config import Thresholds
from gazeloom.operators.body import EDGES, JOINTS
from gazeloom.operators.folds import by_recording
from gazeloom.operators.rollups import vector_stats
from gazeloom.operators.sequence import running_index
from gazeloom.sources.sink import ClipCopySink, EpisodeSink


def long_joints(body: DataFrame, key: str) -> DataFrame:
    """One row a frame and joint, in joint order."""
    rows = body.withColumn("frame_idx", F.col("frame_number").cast("int")).select(key, "frame_idx", "timestamp_ms", "root_quaternion", "root_tracked", "joints", F.posexplode(F.array(*[F.lit(j) for j in JOINTS])).alias("joint_id", "joint_name"))
    j = F.col("joints")[F.col("joint_name")]
    return rows.select(
        key, "frame_idx", "timestamp_ms", F.col("joint_id").cast("smallint").alias("joint_id"), "joint_name", *[j["pos"][k].cast("float").alias(c) for k, c in enumerate("xyz")], j["confidence"].cast("float").alias("confidence"), j["source"].alias("provenance"),
        *[F.col("root_quaternion")[k].cast("float").alias(f"root_q{c}") for k, c in enumerate("wxyz")], "root_tracked",
    )


def skeleton_document() -> str:
    return json.dumps({"joints": list(JOINTS), "edges": [list(e) for e in EDGES], "units": "meters"})


def episode_numbers(body: DataFrame, key: str) -> DataFrame:
    """key, episode_index: recordings that have frames, numbered without gaps in key order. One row a recording."""
    shown = body.where(F.size("joints") > 0).select(key).distinct()
    return shown.select(key, (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("episode_index"))


def episodes(body: DataFrame, key: str) -> DataFrame:
    """Frames of training episodes: state, confidence and wrist action vectors, numbered without gaps. Recordings without frames take no number."""
    j = F.col("joints")
    state = F.flatten(F.transform(F.array(*[F.lit(n) for n in JOINTS]), lambda n: j[n]["pos"]))
    confidence = F.transform(F.array(*[F.lit(n) for n in JOINTS]), lambda n: j[n]["confidence"])
    action = F.flatten(F.transform(F.array(F.lit("l_wrist"), F.lit("r_wrist")), lambda n: j[n]["pos"]))
    rows = running_index(body.where(F.size("joints") > 0), key, ["timestamp_ms"])
    vector = "array<float>"
    return rows.join(episode_numbers(body, key), key).select(key, state.cast(vector).alias("observation.state"), confidence.cast(vector).alias("observation.confidence"), action.cast(vector).alias("action"), (F.col("timestamp_ms") / 1000).cast("float").alias("timestamp"), "frame_index", "episode_index", F.col("index").cast("long").alias("index"), F.lit(0).cast("long").alias("task_index"))


#: The layout of an episode dataset.
DATA_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
VIDEO_PATH = "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"
VIDEO_KEY = "observation.images.ego"
VECTORS = ("observation.state", "observation.confidence", "action")
REQUIRED = (*VECTORS, "timestamp", "frame_index", "episode_index", "index", "task_index")
META = ("meta/info.json", "meta/episodes.jsonl", "meta/tasks.jsonl", "meta/stats.json")


def _features(fps: float, height: int, width: int) -> dict:
    axes = lambda joints: [f"{j}.{a}" for j in joints for a in "xyz"]
    names = {"observation.state": axes(JOINTS), "observation.confidence": list(JOINTS), "action": axes(("l_wrist", "r_wrist"))}
    vectors = {c: {"dtype": "float32", "shape": [len(n)], "names": n} for c, n in names.items()}
    video = {"dtype": "video", "shape": [height, width, 3], "names": ["height", "width", "channel"], "info": {"video.fps": fps, "video.codec": "h264", "video.is_depth_map": False}}
    scalars = {c: {"dtype": "float32" if c == "timestamp" else "int64", "shape": [1], "names": None} for c in REQUIRED if c not in VECTORS}
    return vectors | {VIDEO_KEY: video} | scalars


def _put(store, place: str, text: Iterable[str]) -> None:
    store.create_dir(place.rsplit("/", 1)[0])
    with store.open_output_stream(place) as f:
        for part in text:
            f.write(part.encode())


def copy_clips(numbered: DataFrame, path: str, clip: str, chunk: int = 1000) -> DataFrame:
    """Copies each recording's clip (a column with its URI) to its episode's place, in steps; numbered: episode_index and clip. Gives episode_index and bytes; a null clip gives no row.

    All clips become visible at once, or none if a copy fails; clips that were there go.
    """
    spark = numbered.sparkSession
    spark.dataSource.register(ClipCopySink)
    rows = numbered.where(F.col(clip).isNotNull()).select("episode_index", F.col(clip).alias("clip"))
    rows.write.format("clip_copies").mode("overwrite").options(place=VIDEO_PATH.replace("{video_key}", VIDEO_KEY), chunk=chunk).save(path)
    return spark.read.schema("episode_index long, bytes long").json(f"{path}/meta/videos.jsonl")


def write_episodes(frames: DataFrame, path: str, task: str, fps: float | None = None, height: int = 1920, width: int = 1080, chunk: int = 1000) -> dict:
    """An episode dataset under path (a URI or an absolute path): a Parquet file an episode in folders of `chunk`, and meta files of features, lengths, tasks and statistics.

    fps, where not given, is that of the first episode with a span of time, or 10. Gives the description with its statistics. Data and meta files that were there go, once all episodes are written.
    """
    spark = frames.sparkSession
    store, root = fs.FileSystem.from_uri(path)
    spark.dataSource.register(EpisodeSink)
    rows = frames.select(*(F.col(f"`{c}`").alias(c.replace(".", "_")) for c in REQUIRED))  # Arrow functions take no names with dots
    dealt = rows.repartition("episode_index").sortWithinPartitions("episode_index", "frame_index")
    dealt.write.format("episodes").mode("overwrite").options(place=DATA_PATH, chunk=chunk, task=task, names=json.dumps(REQUIRED)).save(path)
    lengths = spark.read.schema("episode_index long, length long").json(f"{path}/meta/episodes.jsonl")
    totals = lengths.agg(F.count("*").alias("episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("frames")).first()
    if fps is None:
        spans = frames.groupBy("episode_index").agg((F.max("timestamp") - F.min("timestamp")).cast("double").alias("span"), F.count("*").alias("n")).where("span > 0")
        rate = spans.agg(F.min_by(F.round((F.col("n") - 1) / F.col("span"), 3), "episode_index").alias("fps")).first().fps
        fps = rate or 10.0

    # all vectors as one, so that one pass over the frames gives every statistic
    wide = (*VECTORS, "timestamp", "frame_index")
    features = _features(fps, height, width)
    one = F.concat(*(F.col(f"`{c}`").cast("array<double>") if c in VECTORS else F.array(F.col(c).cast("double")) for c in wide))
    rows, stats, at = vector_stats(frames.select(one.alias("v")), "v").orderBy("component").collect(), {}, 0  # as many as components
    for c in wide:
        n = features[c]["shape"][0]
        own, at = rows[at : at + n], at + n
        stats[c] = {name: [r[k] for r in own] for name, k in (("mean", "mean"), ("std", "std"), ("min", "least"), ("max", "most"))} | {"count": [totals.frames]}

    info = {
        "codebase_version": "v2.0", "robot_type": "human_egocentric_chest_cam", "total_episodes": totals.episodes, "total_frames": totals.frames, "total_tasks": 1, "total_videos": totals.episodes,
        "total_chunks": -(-totals.episodes // chunk), "chunks_size": chunk, "fps": fps, "splits": {"train": f"0:{totals.episodes}"}, "data_path": DATA_PATH, "video_path": VIDEO_PATH, "features": features,
    }
    _put(store, f"{root}/meta/tasks.jsonl", [json.dumps({"task_index": 0, "task": task}) + "\n"])
    _put(store, f"{root}/meta/stats.json", [json.dumps(stats, indent=2)])
    _put(store, f"{root}/meta/info.json", [json.dumps(info, indent=2)])
    return info | {"stats": stats}


def validate_episodes(spark: SparkSession, path: str, info: dict | None = None) -> list[str]:
    """What is wrong with a written dataset: meta files, columns, and every episode's length and place. info: the description, if not that in the dataset."""
    store, root = fs.FileSystem.from_uri(path)
    there = lambda p: store.get_file_info(f"{root}/{p}").type != fs.FileType.NotFound
    if info is None:
        if not there(META[0]):
            return [f"missing {META[0]}"]
        with store.open_input_stream(f"{root}/{META[0]}") as f:
            info = json.loads(f.read())
    problems = [f"missing {m}" for m in META if not there(m)]
    if not info["total_episodes"]:
        return problems
    if not there("data"):
        return [*problems, "missing data"]
    frames = spark.read.parquet(f"{path}/data/*/*.parquet")
    absent = [c for c, f in info["features"].items() if f["dtype"] != "video" and c not in frames.columns]
    problems += [f"missing column {c}" for c in absent]
    if absent:
        return problems
    n = frames.agg(F.count("*").alias("n"), F.count_distinct("episode_index").alias("e"), F.min("index").alias("a"), F.max("index").alias("b"), F.count_distinct("index").alias("d")).first()
    if n.n != info["total_frames"]:
        problems.append(f"{n.n} frames, {info['total_frames']} described")
    if n.e != info["total_episodes"]:
        problems.append(f"{n.e} episodes, {info['total_episodes']} described")
    if n.n and (n.a != 0 or n.b != n.n - 1 or n.d != n.n):
        problems.append("index isn't 0..frames-1")
    place = F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(F.col("episode_index") / info["chunks_size"]), "episode_index")
    strays = frames.where(~F.col("_metadata.file_path").endswith(place)).select("episode_index").distinct().count()
    if strays:
        problems.append(f"{strays} episodes have frames in another episode's file")
    if "missing meta/episodes.jsonl" not in problems:
        told = spark.read.schema("episode_index long, length long").json(f"{path}/meta/episodes.jsonl")
        held = frames.groupBy("episode_index").agg(F.count("*").alias("n"))
        off = told.join(held, "episode_index", "full").where(~F.col("n").eqNullSafe(F.col("length"))).count()
        if off:
            problems.append(f"{off} episodes differ from their described length")
    return problems


#: The joint index of each of our joints in the parametric body model, and its parameters' shapes.
BODY_MODEL_INDEX = {
    "pelvis": 0, "l_hip": 1, "r_hip": 2, "spine": 3, "l_knee": 4, "r_knee": 5, "l_ankle": 7, "r_ankle": 8, "chest": 9, "neck": 12, "head": 15,
    "l_shoulder": 16, "r_shoulder": 17, "l_elbow": 18, "r_elbow": 19, "l_wrist": 20, "r_wrist": 21,
}
BODY_MODEL_SHAPES = {"transl": 3, "global_orient": 3, "body_pose": 63, "left_hand_pose": 45, "right_hand_pose": 45, "betas": 10, "expression": 10}


def body_model_document() -> dict:
    return {"format": "SMPL-X parameters (.npz)", "status": "mapping only: the model's weights are licensed and not included", "param_spec": {k: [n] for k, n in BODY_MODEL_SHAPES.items()}, "joint_mapping": BODY_MODEL_INDEX, "provenance": "head and legs are inferred; weigh joints by their confidence"}


def body_model_targets(body: DataFrame, key: str) -> DataFrame:
    """What a body model is fitted to: key, timestamp_ms, and by model joint the target points and their weights."""
    order = sorted(JOINTS, key=BODY_MODEL_INDEX.get)
    j = F.col("joints")
    return body.where(F.size("joints") > 0).select(key, "timestamp_ms", F.array(*(F.lit(BODY_MODEL_INDEX[n]) for n in order)).alias("model_joints"), F.array(*(j[n]["pos"] for n in order)).alias("targets"), F.array(*(j[n]["confidence"] for n in order)).alias("weights"))


def fit_body_model(targets: DataFrame, key: str, make: Callable[[], Callable[[pd.DataFrame], list[list[float]]]]) -> DataFrame:
    """key, timestamp_ms, params by a provided fit of a recording's targets. `make` builds the fit in the task, where the licensed model loads."""
    kind = targets.schema[key].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("timestamp_ms", kind="stable")
        return pd.DataFrame({key: rows[key], "timestamp_ms": rows["timestamp_ms"], "params": make()(rows)})

    return by_recording(targets, key, fold, f"{key} {kind}, timestamp_ms double, params array<double>")


#: Members of a recording's bundle in the manifest's order: name, type, what must be there.
MEMBERS = (
    ("anonymized.mp4", "video/mp4", None, "clip with faces blurred and without sound"),
    ("pose_joints.parquet", "application/vnd.apache.parquet", "body", "joints by frame in meters, with confidence and provenance"),
    ("skeleton.json", "application/json", "body", "joint order, bones and units"),
    ("smplx_README.json", "application/json", "body", "joint mapping of the parametric body model"),
    ("hand_pose.parquet", "application/vnd.apache.parquet", "hands", "21 points a hand by frame, relative to the image"),
    ("segments.json", "application/json", "segments", "labelled spans of the recording"),
    ("events.json", "application/json", None, "events and the recording's summary"),
    ("manifest.json", "application/json", None, "this list"),
)


def bundle_contents(**there: Column) -> Column:
    """The bundle's members as an array in order; there: body, hands and segments, whether a recording has them."""
    rows = [F.struct(F.lit(path).alias("path"), F.lit(kind).alias("type"), F.lit(about).alias("description"), (F.coalesce(there[need], F.lit(False)) if need else F.lit(True)).alias("there")) for path, kind, need, about in MEMBERS]
    return F.transform(F.filter(F.array(*rows), lambda m: m["there"]), lambda m: F.struct(m["path"].alias("path"), m["type"].alias("type"), m["description"].alias("description")))


def capture_record(videos: DataFrame, t: Thresholds = Thresholds(), intrinsics: str | None = None) -> Column:
    """How a recording was taken, as a struct. Columns that videos lacks are null. intrinsics: a column of calibrated ones; where null, the assumed field of view stands."""
    known = lambda *names: F.coalesce(*(F.col(c) for c in names if c in videos.columns), F.lit(None).cast("string"))
    lens = F.col(intrinsics).isNotNull() if intrinsics else F.lit(False)
    fov = F.when(~lens, F.lit(t.camera_fov_degrees))
    mount = F.struct(F.lit(t.mount_height_fraction).alias("height_frac_of_operator"), F.lit(t.mount_forward_fraction).alias("forward_frac_of_operator"), F.lit(t.mount_pitch_degrees).alias("pitch_deg_down"))
    return F.struct(
        F.struct(F.lit("chest (shirt-clipped)").alias("mount"), mount.alias("mount_geometry_body_frame"), (F.col(intrinsics) if intrinsics else F.lit(None).cast("string")).alias("intrinsics"), fov.alias("assumed_fov_deg"), lens.alias("intrinsics_calibrated")).alias("camera"),
        F.struct(F.struct(known("width").alias("width"), known("height").alias("height")).alias("resolution"), known("fps").alias("fps"), F.lit("RGB").alias("color"), F.lit("removed (privacy)").alias("audio")).alias("recording"),
        F.struct(known("worker_id_anonymized", "operator_id").alias("anonymized_id"), known("operator_height_cm").alias("height_cm")).alias("operator"),
        F.struct(known("scene").alias("scene"), known("property_tag").alias("property_tag"), F.lit(None).cast("string").alias("indoor_outdoor"), F.lit(None).cast("string").alias("lighting")).alias("environment"),
        F.struct(F.lit(None).cast("string").alias("reference")).alias("consent"),
    )


def manifests(videos: DataFrame, summaries: DataFrame, t: Thresholds = Thresholds(), **parts: DataFrame | None) -> DataFrame:
    """id, contents, manifest (JSON) of each recording.

    summaries: rollups of events by video_id. parts: hands, body, segments, each a row a recording (video_id and what its processing is described
    by); one that is None or lacks a recording leaves its members out of the contents, and its description null.
    """
    rows = videos.withColumn("__capture", capture_record(videos, t))
    own = [c for c in ("id", "original_filename", "operator_id", "worker_id_anonymized", "property_tag", "uploaded_at", "duration_seconds", "status") if c in videos.columns]
    joined = rows.select(F.col("id").alias("video_id"), F.struct(*own).alias("video"), F.col("__capture").alias("capture"))
    named = {"events": summaries, **{k: parts.get(k) for k in ("hands", "body", "segments")}}
    for name, df in named.items():
        if df is None:
            joined = joined.withColumn(name, F.lit(None).cast("string"))
        else:
            joined = joined.join(df.select("video_id", F.struct(*[c for c in df.columns if c != "video_id"]).alias(name)), "video_id", "left")
    contents = bundle_contents(**{k: F.col(k).isNotNull() for k in ("body", "hands", "segments")})
    done = joined.withColumn("contents", contents)
    document = F.struct(F.lit("1.0").alias("export_version"), "video", F.col("capture").alias("capture_metadata"), F.struct(*named).alias("processing"), "contents")
    return done.select(F.col("video_id").alias("id"), "contents", F.to_json(document, {"ignoreNullFields": "false"}).alias("manifest"))


def parquet_bytes(df: DataFrame) -> bytes:
    """One recording's rows as a Parquet file."""
    out = io.BytesIO()
    pq.write_table(df.toArrow(), out)
    return out.getvalue()


def bundle(members: dict[str, bytes | str | dict]) -> bytes:
    """A zip of named members, in order, for one recording."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, json.dumps(body, indent=2) if isinstance(body, dict) else body)
    return out.getvalue()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and the first 16 hex digits of the SHA-256 of each file, read in steps."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = []
            for uri in b["path"]:
                store, name = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while step := f.read(1 << 20):
                        digest.update(step)
                sums.append(digest.hexdigest()[:16])
            yield pd.DataFrame({"path": b["path"], "bytes": b["length"], "sha256_16": sums})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.mapInPandas(run, "path string, bytes long, sha256_16 string")


def card(totals: dict, runs: list[dict], title: str = "Dataset") -> str:
    lines = [f"# {title}", "", f"- Episodes: {totals['episodes']}", f"- Frames: {totals['frames']}", f"- Hours: {totals['seconds'] / 3600:.1f}", "", "| dataset | n | MPJPE mm | PA-MPJPE mm |", "|-|-|-|-|"]
    return "\n".join([*lines, *(f"| {r['dataset']} | {r['n']} | {r['mpjpe_mm']} | {r['pa_mpjpe_mm']} |" for r in runs)]) + "\n"
