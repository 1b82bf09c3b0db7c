"""Reading and writing the engine's tables: Parquet with explicit schemas, JSON documents, JSON-line logs, binary media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gazeloom import schemas


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def read_hand_pose(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_schema(schemas.HAND_POSE)).parquet(path)


def write_hand_pose(df: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Parquet with its provenance as field metadata of frame_number, which survives reading."""
    cols = [F.col(c).alias(c, metadata=metadata) if c == "frame_number" else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").parquet(path)


def hand_pose_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    return dict(spark.read.parquet(path).schema["frame_number"].metadata)


def valid_hand(points: Column, joints: int = 21) -> Column:
    """Null, or `joints` points of three coordinates."""
    return points.isNull() | ((F.size(points) == joints) & F.forall(points, lambda p: F.size(p) == 3))


def segments_document(segments: DataFrame, key: str) -> DataFrame:
    """One JSON document a recording."""
    parts = F.struct(*[c for c in segments.columns if c != key])
    return segments.groupBy(key).agg(F.sort_array(F.collect_list(parts)).alias("segments")).select(key, F.to_json(F.struct(key, "segments")).alias("document"))


def read_segments(documents: DataFrame, key: str, text: str, segment: str) -> DataFrame:
    """Rows of a JSON document's segments; documents that don't parse give none."""
    doc = F.from_json(text, f"{key} string, segments array<struct<{segment}>>")
    return documents.select(doc.alias("d")).select(F.col(f"d.{key}"), F.inline("d.segments"))


def append_log(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = schemas.EVAL_RUN) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(_schema(schema)).option("mode", "DROPMALFORMED").json(path)


def _stored(path: str, start: int, n: int) -> bytes:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as f:
        return f.read_at(n, start)


def media(spark: SparkSession, path: str, most_bytes: int = 2 << 30) -> DataFrame:
    """path, modificationTime and length of uploads that are not empty, not too large, and carry the box type of an accepted container. Only the first bytes of a file are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mp4,mov,MP4,MOV}").load(path).select("path", "modificationTime", "length")

    def accepted(batches):
        for b in batches:
            yield b[[_stored(p, 4, 4) == b"ftyp" for p in b["path"]]]

    return files.where(F.col("length").between(8, most_bytes)).mapInPandas(accepted, files.schema)


def media_range(files: DataFrame, start: int, end: int) -> DataFrame:
    """Bytes start..end (inclusive) of media, as many as there are; null and status 416 where the range isn't there. Only the range is read."""
    def cut(batches):
        for b in batches:
            ok = [start < n and start <= end for n in b["length"]]
            yield b[["path"]].assign(body=[_stored(p, start, min(end, n - 1) - start + 1) if good else None for p, n, good in zip(b["path"], b["length"], ok)], status=[206 if good else 416 for good in ok])

    return files.select("path", "length").mapInPandas(cut, "path string, body binary, status int")


def pose_document(frames: DataFrame, key: str, **fields: object) -> DataFrame:
    """One JSON document a recording: the given fields, frame_count and its frames in time order."""
    parts = F.struct("timestamp_ms", *[c for c in frames.columns if c not in (key, "timestamp_ms")])
    docs = frames.groupBy(key).agg(F.sort_array(F.collect_list(parts)).alias("frames"))
    return docs.select(key, F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in fields.items()), key, F.size("frames").alias("frame_count"), "frames"), {"ignoreNullFields": "false"}).alias("document"))


def read_poses(documents: DataFrame, key: str, text: str, frame: str) -> DataFrame:
    """Frames of pose documents; frame: their schema. Documents that don't parse give none."""
    doc = F.from_json(text, f"{key} string, frames array<struct<{frame}>>")
    return documents.select(doc.alias("d")).select(F.col(f"d.{key}"), F.inline("d.frames"))


def storage_path(root: str, key: str) -> str:
    """root/key for keys that stay below the root."""
    parts = [p for p in key.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or key.startswith("/"):
        raise ValueError(f"key leaves the store: {key!r}")
    return f"{root.rstrip('/')}/{'/'.join(parts)}"


#: The profile that leaves frames as they are.
IDENTITY_PROFILE = {"camera_model": "default", "lens_model": "standard", "image_size": [1920, 1080], "intrinsic_matrix": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], "distortion_coefficients": [0.0, 0.0, 0.0, 0.0, 0.0], "reprojection_error_pixels": 0.0}


def profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_schema(schemas.PROFILE)).option("mode", "DROPMALFORMED").option("multiLine", True).json(path).where("camera_model is not null")


def with_profile(recordings: DataFrame, known: DataFrame, model: str = "camera_model") -> DataFrame:
    """Each recording with its camera's profile as `profile`, or the identity."""
    spark = recordings.sparkSession
    default = spark.createDataFrame([tuple(IDENTITY_PROFILE[f.name] for f in _schema(schemas.PROFILE))], schemas.PROFILE).select(F.struct("*").alias("__default"))
    p = known.select(F.col("camera_model").alias("__model"), F.struct("*").alias("__profile"))
    out = recordings.join(p, F.col(model) == F.col("__model"), "left").crossJoin(default)  # one row
    return out.withColumn("profile", F.coalesce("__profile", "__default")).drop("__model", "__profile", "__default")


def is_identity(distortion: Column) -> Column:
    return F.forall(distortion, lambda c: c == 0)
