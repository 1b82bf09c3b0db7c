"""Bundles of recordings, made in tasks: each member of each recording is a row, and a zip takes its rows in order.

A recording's tables meet in one task each, as its Parquet members are files of one recording; its clip is
copied from storage in steps. Zips become visible all at once.
"""

from __future__ import annotations

import io
import json
import shutil
import uuid
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from gazeloom.sources.export import MEMBERS, body_model_document, skeleton_document
from gazeloom.sources.sink import File, StagedWriter
from gazeloom.sources.tables import storage_path

PLACE = {name: k for k, (name, *_) in enumerate(MEMBERS)}
ROW = "video_id string, place int, name string, body binary, source string"


def parquet_members(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """A Parquet member of each recording (video_id), its rows in order."""
    def member(rows: pa.Table) -> pa.Table:
        out = io.BytesIO()
        pq.write_table(rows.sort_by([(c, "ascending") for c in order]), out)
        return pa.table({"video_id": rows.column("video_id")[:1].cast(pa.string()), "body": pa.array([out.getvalue()], pa.binary())})

    return _row(df.groupBy("video_id").applyInArrow(member, "video_id string, body binary"), name)


def json_members(df: DataFrame, name: str, order: str) -> DataFrame:
    """A JSON member of each recording: its rows in order, a line each; nulls are left out."""
    rows = df.select("video_id", F.struct(F.col(order), F.to_json(F.struct(*df.columns)).alias("json")).alias("r"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["json"]), ",\n")
    return _row(rows.groupBy("video_id").agg(F.concat(F.lit("["), lines, F.lit("]")).alias("body")), name)


def _row(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("video_id").cast("string"), F.lit(PLACE[name]).alias("place"), F.lit(name).alias("name"), F.col("body").cast("binary"), F.lit(None).cast("string").alias("source"))


def fixed_members(ids: DataFrame, name: str, text: str) -> DataFrame:
    """A member that is the same for every recording of ids (video_id)."""
    return _row(ids.select("video_id", F.lit(text).alias("body")), name)


def clip_members(clips: DataFrame) -> DataFrame:
    """clips: video_id, path (a URI)."""
    name = MEMBERS[0][0]
    return clips.select(F.col("video_id").cast("string"), F.lit(PLACE[name]).alias("place"), F.lit(name).alias("name"), F.lit(None).cast("binary").alias("body"), F.col("path").alias("source"))


def documents_of_bodies(ids: DataFrame) -> DataFrame:
    """What describes the joints, for recordings that have some."""
    return fixed_members(ids, "skeleton.json", skeleton_document()).unionByName(fixed_members(ids, "smplx_README.json", json.dumps(body_model_document(), indent=2)))


class BundleWriter(StagedWriter):
    """A zip for each recording; rows come by video_id, then place."""

    owned = ("bundles",)

    def files(self, batches, store, top):
        name, members, staged, out, z = None, 0, "", None, None

        def closed() -> File:
            z.close()
            out.close()
            return File(storage_path("bundles", f"{name}.zip"), staged, name, members)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("video_id", "name", "body", "source"))
            for video, member, body, source in zip(*columns):
                if video != name or z is None:
                    if z:
                        yield closed()
                    name, members, staged = video, 0, f"{top}/{uuid.uuid4().hex}"
                    out = store.open_output_stream(staged, compression=None)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if source is None:
                    z.writestr(member, body)
                else:
                    there, place = fs.FileSystem.from_uri(source)
                    with there.open_input_stream(place, compression=None) as a, z.open(member, "w", force_zip64=True) as b:
                        shutil.copyfileobj(a, b, 1 << 20)
                members += 1
        if z:
            yield closed()

    def described(self, files):
        return {"bundles/bundles.jsonl": (json.dumps({"video_id": f.number, "members": f.size}) for f in sorted(files, key=lambda f: str(f.number)))}


class BundleSink(DataSource):
    """format("bundles"): rows of members."""

    @classmethod
    def name(cls):
        return "bundles"

    def writer(self, schema, overwrite):
        return BundleWriter(dict(self.options), overwrite)


def write_bundles(members: DataFrame, path: str, overwrite: bool = True) -> DataFrame:
    """bundles/<video_id>.zip of members' rows; gives video_id and the number of members of each."""
    spark = members.sparkSession
    spark.dataSource.register(BundleSink)
    dealt = members.select("video_id", "place", "name", "body", "source").repartition("video_id").sortWithinPartitions("video_id", "place")
    dealt.write.format("bundles").mode("overwrite" if overwrite else "append").save(path)
    return spark.read.schema("video_id string, members int").json(f"{path}/bundles/bundles.jsonl")
