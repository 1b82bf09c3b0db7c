"""One object over a store of tables, with the operations a service would offer; all return DataFrames or plain values."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.config import Thresholds
from gazeloom.functions import text
from gazeloom.operators import body, folds, metrics, rollups, sequence, tables
from gazeloom.sources import bundles, export
from gazeloom.sources.probe import probe
from gazeloom.sources.tables import media, media_range, profiles, storage_path


class Engine:
    """Tables under a root: videos, segments, events, hand_pose, head_pose, body_pose, each keyed by video_id."""

    def __init__(self, spark: SparkSession, root: str, thresholds: Thresholds = Thresholds()):
        self.spark, self.root, self.thresholds = spark, root, thresholds

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(storage_path(self.root, name))

    def _one(self, name: str, video_id: str | None) -> DataFrame:
        df = self._read(name)
        return df if video_id is None else df.where(F.col("video_id") == video_id)

    def videos(self) -> DataFrame:
        return self._read("videos").orderBy(F.desc("uploaded_at"))

    def video(self, video_id: str) -> DataFrame:
        return self._read("videos").where(F.col("id") == video_id)

    def delete(self, video_id: str, *dependents: str) -> list[DataFrame]:
        """The tables without a video and what belongs to it, for the caller to write."""
        gone = self.spark.createDataFrame([(video_id,)], "id string")
        return tables.without(self._read("videos"), gone, *((self._read(d), "video_id") for d in dependents or ("events", "segments")))

    def hand_pose(self, video_id: str | None = None) -> DataFrame:
        return self._one("hand_pose", video_id)

    def head_pose(self, video_id: str | None = None) -> DataFrame:
        return self._one("head_pose", video_id)

    def body_pose(self, video_id: str | None = None) -> DataFrame:
        return self._one("body_pose", video_id)

    def camera_profiles(self) -> DataFrame:
        return profiles(self.spark, storage_path(self.root, "profiles")).orderBy("camera_model")

    def ingest(self, path: str, **tags: str) -> DataFrame:
        """Rows of `videos` for the accepted uploads under a folder; the id is of place, size and time, so the same upload has the same id again."""
        files = media(self.spark, path)
        number = F.substring(F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256), 1, 32)
        return files.select(number.alias("id"), F.element_at(F.split("path", "/"), -1).alias("original_filename"), F.col("modificationTime").alias("uploaded_at"), F.col("path").alias("raw_key"), F.col("length").alias("bytes"), F.lit("uploaded").alias("status"), *(F.lit(v).alias(k) for k, v in tags.items()))

    def media_range(self, video_id: str, start: int, end: int) -> DataFrame:
        """Bytes of a video's anonymized clip, or none where it has no clip."""
        return media_range(media(self.spark, storage_path(self.root, "anonymized")).where(F.col("path").endswith(f"/{video_id}.mp4")), start, end)

    def segments(self, video_id: str | None = None) -> DataFrame:
        return self._one("segments", video_id)

    def events(self, video_id: str | None = None) -> DataFrame:
        return self._one("events", video_id).orderBy("start_time")

    def run_segments(self, labels: DataFrame, closed: bool = True) -> DataFrame:
        """labels: video_id, ts, task, confidence, description. Islands of equal tasks, or of alike descriptions that aren't blank; short ones merged.

        The last segment ends by the recording's duration, where `videos` or a column duration_seconds of labels has one that is over 0.
        """
        interval, whole = 1 / self.thresholds.segment_fps, "duration_seconds"
        if whole not in labels.columns:
            videos = self._table("videos")
            known = None if videos is None or whole not in videos.columns else videos.select(F.col("id").alias("video_id"), F.col(whole).cast("double").alias(whole))
            labels = labels.withColumn(whole, F.lit(None).cast("double")) if known is None else labels.join(known, "video_id", "left")
        labels = labels.withColumn(whole, F.when(F.col(whole) > 0, F.col(whole)))
        if closed:
            rows = sequence.islands(labels, "video_id", "ts", "task", interval=interval, confidence="confidence", description="description", duration=F.col(whole))
            rows = rows.select("video_id", "start", "end", F.col("task").alias("label"), "confidence", "description")
        else:
            rows = folds.open_segments(labels.where(F.col("description").rlike(r"\S")), "video_id", "ts", "task", "confidence", "description", interval, whole)
        return folds.merge_short(rows, "video_id", self.thresholds.min_segment_seconds)

    def run_events(self, segments: DataFrame) -> DataFrame:
        """Typed events of segments, with the property of their video."""
        seconds = F.round(F.col("end") - F.col("start"), 3)
        v = self._read("videos").select(F.col("id").alias("video_id"), "property_tag")
        rows = segments.select("video_id", text.event_type(F.col("label"), seconds, self.thresholds.idle_downtime_seconds).alias("type"), "label", F.col("start").alias("start_time"), F.col("end").alias("end_time"), seconds.alias("duration_seconds"), "description")
        return rows.join(v, "video_id", "left")

    def run_hand_pose(self, hands: DataFrame) -> DataFrame:
        """Bounded gap fill, then smoothing, of both hands; filled frames get a low confidence where they have none."""
        for side in ("left", "right"):
            hands = sequence.gap_fill(hands, "video_id", "timestamp_ms", f"{side}_hand_landmarks", max_gap=self.thresholds.max_fill_gap_seconds, scale=0.001)
            c = f"{side}_confidence"
            hands = hands.withColumn(c, F.when(F.col("is_filled") & F.col(c).isNull(), F.lit(self.thresholds.filled_confidence).cast("float")).otherwise(F.col(c))).withColumnRenamed("is_filled", f"{side}_filled")
            hands = folds.smooth(hands, "video_id", "timestamp_ms", f"{side}_hand_landmarks")
        return hands

    def run_head_pose(self, motions: DataFrame) -> DataFrame:
        """motions: video_id, timestamp_ms, rotation (nine numbers) and translation between sampled frames, null where tracking failed."""
        return folds.accumulate_pose(motions, "video_id", "timestamp_ms", "rotation", "translation")

    def run_body_pose(self, hands: DataFrame, heads: DataFrame, **size) -> DataFrame:
        return body.fuse(hands, heads, "video_id", self.thresholds, **size)

    def video_summary(self, video_id: str | None = None) -> DataFrame:
        return rollups.recording_summary(self._one("events", video_id), "video_id", "type", "duration_seconds")

    def overview(self, operator_id: str | None = None) -> DataFrame:
        return rollups.operator_overview(self._read("videos"), self._read("events"), operator_id)

    def per_property(self) -> DataFrame:
        v = self._read("videos").select(rollups.site(F.col("property_tag")).alias("site"), F.col("id").alias("video_id"))
        e = rollups.recording_summary(self._read("events"), "video_id", "type", "duration_seconds")
        return v.join(e, "video_id", "left").groupBy("site").agg(F.count("*").alias("videos"), F.sum("service_event_count").alias("service_events"), F.sum("downtime_seconds").alias("downtime_seconds"))

    def build_context(self, video_id: str | None = None) -> DataFrame:
        """video_id, context: header, metrics and timeline of each video that has segments."""
        segments, videos, events, hands = self.segments(video_id), self._table("videos"), self._table("events"), self._table("hand_pose")
        ids = segments.select("video_id").distinct()
        if videos is None:
            videos = ids.select(F.col("video_id").alias("id"))
        for name, kind in (("original_filename", "string"), ("property_tag", "string"), ("duration_seconds", "double")):
            if name not in videos.columns:
                videos = videos.withColumn(name, F.lit(None).cast(kind))
        summaries = ids
        if events is not None:
            summaries = summaries.join(rollups.recording_summary(events, "video_id", "type", "duration_seconds"), "video_id", "left")
        sides = [c for c in ("left_hand_landmarks", "right_hand_landmarks") if hands is not None and c in hands.columns]
        if sides:
            active = rollups.active_seconds(hands, "video_id", "timestamp_ms", sides).select("video_id", F.round("active_seconds", 2).alias("active_hand_seconds"))
            summaries = summaries.join(active, "video_id", "left")
        for name in ("active_hand_seconds", "service_event_count", "downtime_seconds", "contamination_event_count"):
            if name not in summaries.columns:
                summaries = summaries.withColumn(name, F.lit(None).cast("double"))
        return rollups.video_contexts(videos, summaries, segments, self.thresholds.chat_max_segments).withColumnRenamed("id", "video_id")

    def answer(self, question: str, ask: Callable[[str, str], str], video_id: str | None = None, most: int = 50) -> dict:
        """Asks a provided model about the timelines of one video or of all, `most` at a time (a prompt's bound); several answers are the context of a last one.

        Timelines come to the driver a partition at a time and go to the model by blocks; of the answers of a level at most `most` wait.
        """
        levels: list[list[str]] = []
        step, asked = max(2, most), 0

        def add(said: str, level: int) -> None:
            if level == len(levels):
                levels.append([])
            levels[level].append(said)
            if len(levels[level]) > (step if level else most):
                block, levels[level] = levels[level][:-1], levels[level][-1:]
                add(ask("\n\n".join(block), question), level + 1)

        for r in self.build_context(video_id).orderBy("video_id").toLocalIterator():
            add(r.context, 0)
            asked += 1
        if not asked:
            add("(no processed footage with commentary yet)", 0)
        level = 0
        while True:
            said = ask("\n\n".join(levels[level]), question)
            if level == len(levels) - 1:
                return {"answer": said, "videos": asked}
            level += 1
            levels[level].append(said)
            if len(levels[level]) > step:  # an answer came on top of a full level
                block, levels[level] = levels[level][:step], levels[level][step:]
                add(ask("\n\n".join(block), question), level + 1)

    def _table(self, name: str) -> DataFrame | None:
        """A table, or None where there is none."""
        try:
            return self._read(name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def probe(self) -> DataFrame:
        """Facts of the uploads of `videos` (raw_key), by id."""
        return probe(self._read("videos").select("id", F.col("raw_key").alias("path")).where("path is not null"))

    def backfilled(self) -> DataFrame:
        """`videos` with durations from the containers where they have none, for the caller to write."""
        return tables.backfill_duration(self._read("videos"), self.probe())

    def retire_uploads(self, retain: bool = False) -> DataFrame:
        """Deletes the uploads of videos that are through: id, raw_key, outcome, error. A file that is gone already is `gone`; one that can't be deleted is `kept`. retain: deletes nothing."""
        found = metrics.raw_to_delete(self._read("videos"))
        return tables.delete_files(found.where(F.lit(not retain)), "raw_key")

    def card(self, runs: DataFrame | None = None, title: str = "Dataset") -> str:
        """The dataset's card: totals of the recordings with frames, and of each dataset's evaluations the latest, self-tests left out."""
        videos, frames = self._read("videos"), self._table("hand_pose")
        counted = videos.where("false").select(F.col("id").alias("video_id"), F.lit(0).alias("frame_count")) if frames is None else frames.groupBy("video_id").agg(F.count("*").alias("frame_count"))
        totals = metrics.corpus_totals(videos.withColumnRenamed("id", "video_id"), counted, "video_id", "duration_seconds").first()
        rows = []
        if runs is not None:
            last = sequence.latest(metrics.without_self_tests(runs, "dataset"), "dataset", [F.desc("ts")]).orderBy("dataset")
            rows = [r.asDict() for r in last.select("dataset", F.coalesce("n", "n_samples").alias("n"), "mpjpe_mm", "pa_mpjpe_mm").collect()]  # one a dataset
        return export.card({"episodes": totals.episodes, "frames": totals.frames, "seconds": totals.hours * 3600}, rows, title)

    def export_bundles(self, path: str, only: DataFrame | None = None) -> DataFrame:
        """A zip under path/bundles for each video (of `only`, a column video_id, if given): as export_bundle, but made in tasks. Gives video_id and members."""
        ids = self._read("videos").select(F.col("id").cast("string").alias("video_id"))
        ids = ids if only is None else ids.join(only.select(F.col("video_id").cast("string")).distinct(), "video_id", "left_semi")
        own = {n: t if t is None else t.join(ids, "video_id", "left_semi") for n, t in ((n, self._table(n)) for n in ("hand_pose", "body_pose", "segments", "events"))}
        hands, bodies, segments, events = own.values()
        count = lambda df, name: None if df is None else df.groupBy("video_id").agg(F.count("*").alias(name))
        summaries = ids.withColumn("event_count", F.lit(0).cast("long")) if events is None else ids.join(rollups.recording_summary(events, "video_id", "type", "duration_seconds"), "video_id", "left").na.fill(0)
        videos = self._read("videos").join(ids.select(F.col("video_id").alias("id")), "id", "left_semi")
        made = export.manifests(videos, summaries, self.thresholds, hands=count(hands, "frames"), body=count(bodies, "frame_count"), segments=count(segments, "count"))
        members = bundles.fixed_members(ids, "events.json", "[]")
        if events is not None:
            told = bundles.json_members(events, "events.json", "start_time")
            members = members.join(told.select("video_id"), "video_id", "left_anti").unionByName(told)
        members = members.unionByName(made.select(F.col("id").cast("string").alias("video_id"), F.lit(bundles.PLACE["manifest.json"]).alias("place"), F.lit("manifest.json").alias("name"), F.col("manifest").cast("binary").alias("body"), F.lit(None).cast("string").alias("source")))
        if hands is not None:
            members = members.unionByName(bundles.parquet_members(hands, "hand_pose.parquet", ["timestamp_ms"]))
        if segments is not None:
            members = members.unionByName(bundles.json_members(segments, "segments.json", "start_time"))
        if bodies is not None:
            frames = bodies if "frame_number" in bodies.columns else bodies.withColumn("frame_number", F.row_number().over(Window.partitionBy("video_id").orderBy("timestamp_ms")) - 1)
            members = members.unionByName(bundles.parquet_members(export.long_joints(frames, "video_id"), "pose_joints.parquet", ["frame_idx", "joint_id"])).unionByName(bundles.documents_of_bodies(bodies.select("video_id").distinct()))
        folder = storage_path(self.root, "anonymized")
        store, place = fs.FileSystem.from_uri(folder)
        if store.get_file_info(place).type == fs.FileType.Directory:
            clips = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(folder).select("path", F.regexp_extract("path", r"([^/]+)\.mp4$", 1).alias("video_id"))
            members = members.unionByName(bundles.clip_members(clips.join(ids, "video_id", "left_semi")))
        return bundles.write_bundles(members, path)

    def _stored(self, name: str, video_id: str) -> DataFrame | None:
        """A video's rows of a table, or None where there is no such table or row."""
        try:
            rows = self._one(name, video_id)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return None if rows.isEmpty() else rows

    def export_bundle(self, video_id: str) -> bytes:
        """A zip of one video: its clip, hands, joints, segments, events and manifest, as far as it has them. Holds one recording in memory."""
        tables_of = {name: self._stored(name, video_id) for name in ("hand_pose", "body_pose", "segments", "events")}
        hands, bodies, segments, events = tables_of.values()
        as_json = lambda df: "[" + ",\n".join(df.toJSON().collect()) + "]" if df is not None else "[]"  # noqa: E731 - one video's rows
        one = self.spark.range(1).select(F.lit(video_id).alias("video_id"))
        summary = one.withColumn("event_count", F.lit(0)) if events is None else self.video_summary(video_id)
        counted = {
            "hands": hands and hands.groupBy("video_id").agg(F.count("*").alias("frames")),
            "body": bodies and bodies.groupBy("video_id").agg(F.count("*").alias("frame_count")),
            "segments": segments and segments.groupBy("video_id").agg(F.count("*").alias("count")),
        }
        made = export.manifests(self.video(video_id), summary, self.thresholds, **counted).first()
        if made is None:
            raise KeyError(f"no video {video_id!r}")
        store, place = fs.FileSystem.from_uri(storage_path(self.root, f"anonymized/{video_id}.mp4"))
        members: dict[str, bytes | str | dict] = {}
        if store.get_file_info(place).type == fs.FileType.File:
            with store.open_input_stream(place) as f:
                members["anonymized.mp4"] = f.read()
        if hands is not None:
            members["hand_pose.parquet"] = export.parquet_bytes(hands.orderBy("timestamp_ms"))
        if bodies is not None:
            frames = bodies if "frame_number" in bodies.columns else bodies.withColumn("frame_number", F.row_number().over(Window.partitionBy("video_id").orderBy("timestamp_ms")) - 1)
            members["pose_joints.parquet"] = export.parquet_bytes(export.long_joints(frames, "video_id").orderBy("frame_idx", "joint_id"))
            members |= {"skeleton.json": export.skeleton_document(), "smplx_README.json": export.body_model_document()}
        if segments is not None:
            members["segments.json"] = as_json(segments.orderBy("start_time"))
        members["events.json"] = as_json(events and events.orderBy("start_time"))
        return export.bundle(members | {"manifest.json": made.manifest})
