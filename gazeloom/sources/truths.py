"""External truths: archives of predicted and true points, and hand annotations with their validity.

An archive is a zip of arrays. Its directory is read from the file's end, and of a stored array only the
rows of a partition, by their byte range; a compressed array is read whole, by its own range. Annotations
are JSON documents, whose maps by sequence and frame become rows.
"""

from __future__ import annotations

import ast
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gazeloom.sources.probe import Ranges

#: Signatures of a zip's parts.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
STORED, DEFLATED = 0, 8
#: Rows of a partition, and of an Arrow batch.
ROWS, BATCH = 100_000, 1024


@dataclass
class Member:
    method: int
    packed: int
    size: int
    header: int  # where its local header is

    def start(self, r: Ranges) -> int:
        head = r.at(self.header, 30)
        if head[:4] != LOCAL:
            raise ValueError("a member has no local header")
        name, extra = struct.unpack_from("<HH", head, 26)
        return self.header + 30 + name + extra


def members(r: Ranges) -> dict[str, Member]:
    """The archive's directory, from its end; large archives too."""
    tail = min(r.length, 22 + 65_535)
    data = r.at(r.length - tail, tail)
    at = data.rfind(END)
    if at < 0:
        raise ValueError("not an archive")
    count, size, offset = struct.unpack_from("<HII", data, at + 10)
    if at >= 20 and data[at - 20 : at - 16] == LOCATOR64:
        (where,) = struct.unpack_from("<Q", data, at - 12)
        head = r.at(where, 56)
        if head[:4] != END64:
            raise ValueError("a large archive without its end record")
        count, size, offset = struct.unpack_from("<QQQ", head, 32)
    directory, at, found = r.at(offset, size), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("the directory ends early")
        method, packed, full = (struct.unpack_from("<H", directory, at + 10)[0], *struct.unpack_from("<II", directory, at + 20))
        name, extra, comment = struct.unpack_from("<HHH", directory, at + 28)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        more = directory[at + 46 + name : at + 46 + name + extra]
        while len(more) >= 4:
            kind, n = struct.unpack_from("<HH", more)
            if kind == 1:  # the wide fields, in order, of those that don't fit
                wide = iter(struct.unpack_from(f"<{n // 8}Q", more, 4))
                full, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (full, packed, header))
            more = more[4 + n :]
        found[directory[at + 46 : at + 46 + name].decode()] = Member(method, packed, full, header)
        at += 46 + name + extra + comment
    return found


@dataclass
class Array:
    """An array in an archive: its type and shape, and where its numbers begin."""

    dtype: np.dtype
    shape: tuple[int, ...]
    member: Member
    start: int
    offset: int  # of the numbers in the member
    body: bytes | None = None  # of a compressed member

    def rows(self, r: Ranges, first: int, last: int) -> np.ndarray:
        each = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))
        a, b = self.offset + first * each, self.offset + last * each
        if self.member.method == STORED:
            data = r.at(self.start + a, b - a)
        else:
            if self.body is None:
                self.body = zlib.decompress(r.at(self.start, self.member.packed), -15)
            data = self.body[a:b]
        return np.frombuffer(data, self.dtype).reshape(last - first, *self.shape[1:])


def array(r: Ranges, directory: dict[str, Member], name: str) -> Array | None:
    """The array of a name, of which only the header is read if it is stored; None where there is none."""
    m = directory.get(f"{name}.npy")
    if m is None:
        return None
    if m.method not in (STORED, DEFLATED):
        raise ValueError(f"{name}: an unknown compression")
    start, body = m.start(r), None
    if m.method == DEFLATED:
        body = zlib.decompress(r.at(start, m.packed), -15)
    head = body[:12] if body is not None else r.at(start, min(12, m.size))
    if head[:6] != b"\x93NUMPY":
        raise ValueError(f"{name}: not an array")
    wide = head[6] > 1
    (n,) = struct.unpack_from("<I" if wide else "<H", head, 8)
    offset = 12 if wide else 10
    spec = ast.literal_eval((body[offset : offset + n] if body is not None else r.at(start + offset, n)).decode("latin-1"))
    dtype = np.dtype(spec["descr"])
    if dtype.hasobject:
        raise ValueError(f"{name}: arrays of objects are not read")
    if spec["fortran_order"] and len(spec["shape"]) > 1:
        raise ValueError(f"{name}: numbers are not in the order of rows")
    return Array(dtype, tuple(spec["shape"]), m, start, offset + n, body)


class _Slice(InputPartition):
    def __init__(self, uri: str, dataset: str, first: int, last: int):
        self.uri, self.dataset, self.first, self.last = uri, dataset, first, last


_PAIRS = pa.schema([("dataset", pa.string()), ("sample", pa.int64()), ("predicted", pa.list_(pa.list_(pa.float64()))), ("truth", pa.list_(pa.list_(pa.float64()))), ("joint_names", pa.list_(pa.string())), ("provenance", pa.list_(pa.string()))])


def _nested(x: np.ndarray) -> pa.Array:
    n, joints, width = x.shape
    inner = pa.ListArray.from_arrays(np.arange(0, n * joints * width + 1, width, dtype=np.int32), pa.array(x.astype(np.float64).ravel()))
    return pa.ListArray.from_arrays(np.arange(0, n * joints + 1, joints, dtype=np.int32), inner)


class _PairReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.names = tuple(options.get(k, k) for k in ("pred", "gt", "joint_names", "provenance"))

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [f for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".npz")] if info.type == fs.FileType.Directory else [info]
        prefix, out = self.path[: -len(root)] if self.path.endswith(root) else "", []
        for f in sorted(found, key=lambda f: f.path):
            uri = f"{prefix}{f.path}"
            r = Ranges(uri)
            directory = members(r)
            p, g = (array(r, directory, k) for k in self.names[:2])
            r.close()
            if p is None or g is None or p.shape != g.shape or len(p.shape) != 3 or p.shape[2] != 3:
                raise ValueError(f"{uri}: {self.names[0]} and {self.names[1]} must be there, of one shape (samples, joints, 3)")
            name = f.base_name.rsplit(".", 1)[0]
            out += [_Slice(uri, name, k, min(k + self.rows, p.shape[0])) for k in range(0, p.shape[0], self.rows)]
        return out

    def read(self, partition):
        if partition is None:
            return
        r = Ranges(partition.uri)
        directory = members(r)
        p, g, names, provenance = (array(r, directory, k) for k in self.names)
        joints = [str(x) for x in names.rows(r, 0, names.shape[0]).tolist()] if names else [f"j{k}" for k in range(p.shape[1])]
        per_sample = provenance is not None and len(provenance.shape) == 2
        shared = [str(x) for x in provenance.rows(r, 0, provenance.shape[0]).tolist()] if provenance is not None and not per_sample else None
        for a in range(partition.first, partition.last, BATCH):
            b = min(a + BATCH, partition.last)
            own = [[str(x) for x in row] for row in provenance.rows(r, a, b).tolist()] if per_sample else [shared] * (b - a)
            columns = [pa.array([partition.dataset] * (b - a)), pa.array(range(a, b), pa.int64()), _nested(p.rows(r, a, b)), _nested(g.rows(r, a, b)), pa.array([joints] * (b - a), pa.list_(pa.string())), pa.array(own, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, schema=_PAIRS)
        r.close()


class PairArchives(DataSource):
    """format("pair_archives"): options path (an archive or a folder of them), rows (of a partition), and names of arrays if not pred, gt, joint_names, provenance."""

    @classmethod
    def name(cls):
        return "pair_archives"

    def schema(self):
        return "dataset string, sample long, predicted array<array<double>>, truth array<array<double>>, joint_names array<string>, provenance array<string>"

    def reader(self, schema):
        return _PairReader(self.options)


def pairs(spark: SparkSession, path: str, **options) -> DataFrame:
    """Samples of archives of predicted and true points. Without names of joints they are j0, j1, ...; provenance (of joints, shared or by sample) is null where it isn't there."""
    spark.dataSource.register(PairArchives)
    return spark.read.format("pair_archives").options(path=path, **{k: str(v) for k, v in options.items()}).load()


#: Places of a right hand's joints, wrist first and then each finger from its base, in the annotations' order; the left hand's follow.
RIGHT_HAND = (20, 3, 2, 1, 0, 7, 6, 5, 4, 11, 10, 9, 8, 15, 14, 13, 12, 19, 18, 17, 16)
JOINTS = 21
#: Coordinates beyond this are millimetres, others metres.
METRES = 10


def _flag(x: Column) -> Column:
    """Whether a scalar, read as text, says yes."""
    return F.coalesce(F.lower(F.trim(x)).isin("true", "1", "1.0"), F.lit(False))


def hand_annotations(spark: SparkSession, path: str) -> DataFrame:
    """sequence, frame, truth_id (R or L), points (21, in millimetres), joint_valid, valid: of documents {annotations: {sequence: {frame: {world_coord, joint_valid}}}}.

    valid: all 21 joints are, and have three coordinates. A document is in millimetres if any coordinate goes beyond ten. Records that lack a hand's joints give an invalid hand without points.
    """
    schema = "annotations map<string, map<string, struct<world_coord: array<array<double>>, joint_valid: array<string>>>>"
    documents = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "annotations")
    sequences = documents.select("file", F.explode("annotations").alias("sequence", "frames"))
    records = sequences.select("file", "sequence", F.explode("frames").alias("frame", "r")).select("file", "sequence", F.col("frame").cast("int").alias("frame"), "r.*")
    most = F.aggregate(F.flatten("world_coord"), F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    unit = records.groupBy("file").agg(F.when(F.max(most) > METRES, 1.0).otherwise(1000.0).alias("unit"))  # a row a document
    hands = []
    for side, first in (("R", 0), ("L", JOINTS)):
        order = F.array(*(F.lit(k + first) for k in RIGHT_HAND))
        points = F.transform(order, lambda k: F.get("world_coord", k))
        flags = F.transform(order, lambda k: _flag(F.get("joint_valid", k)))
        whole = F.forall(points, lambda p: p.isNotNull() & (F.size(p) == 3) & F.forall(p, lambda x: x.isNotNull()))
        hands.append(F.struct(F.lit(side).alias("truth_id"), F.when(F.coalesce(whole, F.lit(False)), points).alias("points"), flags.alias("joint_valid")))
    rows = records.join(unit, "file").select("sequence", "frame", "unit", F.inline(F.array(*hands)))
    scaled = F.transform("points", lambda p: F.transform(p, lambda x: x * F.col("unit")))
    return rows.select("sequence", "frame", "truth_id", scaled.alias("points"), "joint_valid", (F.forall("joint_valid", lambda v: v) & F.col("points").isNotNull()).alias("valid"))


def annotated_images(spark: SparkSession, path: str) -> DataFrame:
    """sequence, frame, file_name of documents {images: {id: {seq_name, frame_idx, file_name}}}, or with a list of images."""
    image = "struct<seq_name: string, frame_idx: int, file_name: string>"
    text = spark.read.option("wholetext", True).text(path)
    by_id = F.from_json("value", f"images map<string, {image}>")
    listed = F.from_json("value", f"images array<{image}>")
    is_list = F.get_json_object("value", "$.images").startswith("[")
    images = F.when(is_list, listed["images"]).otherwise(F.map_values(by_id["images"]))
    return text.select(F.inline(images)).select(F.col("seq_name").alias("sequence"), F.col("frame_idx").alias("frame"), "file_name")


def hand_truths(spark: SparkSession, annotations: str, images: str | None = None, there: DataFrame | None = None) -> DataFrame:
    """Valid hands by image: image, truth_id, points, and file_name where images are given. there: a column file_name of images at hand; others are left out."""
    hands = hand_annotations(spark, annotations).where("valid")
    image = F.concat_ws("/", "sequence", F.format_string("%06d", "frame")).alias("image")
    if images is None:
        return hands.select(image, "truth_id", "points")
    known = annotated_images(spark, images)
    if there is not None:
        known = known.join(there.select("file_name").distinct(), "file_name", "left_semi")
    return hands.join(known, ["sequence", "frame"]).select(image, "file_name", "truth_id", "points")


def evaluation(matches: DataFrame, names: Sequence[str]) -> DataFrame:
    """joint (null: all), mean error after alignment and after shifting roots, and samples, of best_aligned_match's rows."""
    each = matches.select(F.posexplode(F.arrays_zip("pa_errors", "root_errors")).alias("k", "e")).select(F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("joint"), "e.*")
    return each.rollup("joint").agg(F.avg("pa_errors").alias("pa_mpjpe"), F.avg("root_errors").alias("mpjpe"), F.count("*").alias("n"))
