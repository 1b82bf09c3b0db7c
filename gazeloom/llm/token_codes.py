"""Token ids in directly addressable codes.

An id is split into chunks of CHUNK bits, lowest first. Level k holds the k-th chunks of all ids
that have one, a bitmap of which of them go on to level k + 1, and a rank directory (set bits before
every BLOCK-bit block), so the i-th id is read by following one position a level: no block is decoded.

A file holds up to `per_file` ids of documents in ascending doc_id order (a document that would not
fit opens the next file; a longer one has a file of its own), with a directory of its documents:

    magic "DAC1", uint32 levels, uint64 ids, uint64 documents
    int64 doc_id and uint8 null flag of each, uint64 first id of each and the end
    for each level: uint64 chunks, chunks (uint8), bitmap (bytes of 8, low bit first), uint32 directory

Files are written under a temporary name in the shared folder and renamed, so a task that is run
again leaves whole files only; the manifest, written by Spark, lists those that count.

Nulls: a null text has the end id alone; null doc_ids come first and are kept. Repeated doc_ids
are kept, in the order of a hash of their texts, and may go to several files. An empty table gives no files and an empty result.
A text of any length is encoded whole. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.llm.shared import Scratch, ship, small_batches
from gazeloom.llm.tokens import encoder, vocabulary_path

CHUNK, BLOCK = 8, 512
MAGIC = b"DAC1"
PER_FILE = 4_000_000


class Level:
    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position: the directory, whole bytes of its block, then bits of a byte."""
        byte = at >> 3
        out = self.ranks[at // BLOCK].astype(np.int64)
        first = at // BLOCK * (BLOCK // 8)
        for k in range(BLOCK // 8):
            inside = first + k < byte
            if not inside.any():
                break
            out[inside] += np.bitwise_count(self.bitmap[(first + k)[inside]])
        return out + np.bitwise_count(self.bitmap[byte] & ((1 << (at & 7)) - 1).astype(np.uint8))


def encode(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> np.uint64(CHUNK) > 0
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(bitmap)] = bitmap
        sums = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        levels.append(Level((rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8), padded, np.concatenate([[0], np.cumsum(sums)])[:-1].astype(np.uint32)))
        rest = rest[more] >> np.uint64(CHUNK)
        if not len(rest):
            return levels


def access(levels: list[Level], at: np.ndarray) -> np.ndarray:
    """The ids at positions `at`, each found by itself."""
    out, at, alive = np.zeros(len(at), np.uint64), np.asarray(at, np.int64), np.arange(len(at))
    for k, level in enumerate(levels):
        out[alive] |= level.chunks[at].astype(np.uint64) << np.uint64(CHUNK * k)
        on = level.goes_on(at)
        alive, at = alive[on], level.rank(at[on]) if on.any() else at[:0]
        if not len(alive):
            break
    return out.astype(np.uint32)


def decode(levels: list[Level]) -> np.ndarray:
    """All ids in order: access to every position, where ranks are running counts."""
    out = np.zeros(len(levels[-1].chunks), np.uint64)
    for k in range(len(levels) - 1, -1, -1):
        level, n = levels[k], len(levels[k].chunks)
        here = level.chunks.astype(np.uint64)
        if k < len(levels) - 1:
            more = np.unpackbits(level.bitmap, count=n, bitorder="little").astype(bool)
            here[more] |= out << np.uint64(CHUNK)
        out = here
    return out.astype(np.uint32)


def dump(doc_ids: list[int | None], bounds: np.ndarray, ids: np.ndarray) -> bytes:
    levels = encode(ids)
    out = [MAGIC, struct.pack("<IQQ", len(levels), len(ids), len(doc_ids)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), bounds.astype("<u8").tobytes()]
    for x in levels:
        out += [struct.pack("<Q", len(x.chunks)), x.chunks.tobytes(), x.bitmap.tobytes(), x.ranks.astype("<u4").tobytes()]
    return b"".join(out)


class Reader:
    """A file's documents and, by position, its ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels, self.n_ids, n_docs = struct.unpack_from("<IQQ", data, 4)
        at = 4 + struct.calcsize("<IQQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        ids, nulls = take("<i8", n_docs), None
        nulls = take("u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls)]
        self.bounds = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append(Level(take("u1", n), take("u1", blocks * BLOCK // 8), take("<u4", blocks)))

    def __getitem__(self, at) -> np.ndarray:
        return access(self.levels, np.atleast_1d(at))

    def ids(self) -> np.ndarray:
        return decode(self.levels)


class File:
    """Random access to a file in storage: of a level, an id takes a byte, a block of the bitmap and an entry of the directory."""

    def __init__(self, path: str):
        store, place = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(place)
        head = self._at(0, 24)
        if head[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels, self.n_ids, n_docs = struct.unpack_from("<IQQ", head, 4)
        at, self.levels = 24 + 9 * n_docs + 8 * (n_docs + 1), []
        for _ in range(n_levels):
            n = struct.unpack("<Q", self._at(at, 8))[0]
            blocks = -(-n // BLOCK)
            # where the chunks, the bitmap and the directory begin
            self.levels.append((at + 8, at + 8 + n, at + 8 + n + blocks * BLOCK // 8))
            at = self.levels[-1][2] + 4 * blocks

    def _at(self, start: int, n: int) -> bytes:
        return self.file.read_at(n, start)

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        out = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            out |= self._at(chunks + at, 1)[0] << CHUNK * k
            block, inside = divmod(at, BLOCK)
            bits = int.from_bytes(self._at(bitmap + block * BLOCK // 8, inside // 8 + 1), "little")
            if not bits >> inside & 1:
                break
            at = struct.unpack("<I", self._at(ranks + 4 * block, 4))[0] + (bits & (1 << inside) - 1).bit_count()
        return out

    def close(self) -> None:
        self.file.close()


def put(path: str, data: bytes) -> None:
    """Write whole or not at all: a name of its own, then a rename."""
    import uuid

    store, place = fs.FileSystem.from_uri(path)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    store.move(part, place)


def get(path: str) -> bytes:
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(place, compression=None) as f:
        return f.read()


def folder(path: str) -> str:
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place, recursive=True)
    return path


def write(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end: int = 1, per_file: int = PER_FILE, scratch: Scratch | None = None) -> DataFrame:
    """Writes the files; returns their manifest: partition, number, path, n_ids, n_docs."""
    ship(spark)
    small_batches(spark)
    scratch = scratch or Scratch(spark, "codes")
    vocabulary, top = vocabulary or vocabulary_path(), scratch.path("files")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, number, e = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        bounds: list[int] = [0]

        def close() -> pa.RecordBatch:
            nonlocal number
            # the attempt is part of the name: attempts of one task never meet
            path = f"{folder(f'{top}/{part:06d}')}/{number:06d}-{uuid.uuid4().hex[:8]}.dac"
            put(path, dump(doc_ids, np.array(bounds), np.concatenate(parts)))
            row = pa.RecordBatch.from_pydict({"partition": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "path": [path], "n_ids": pa.array([bounds[-1]], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64())})
            number += 1
            doc_ids.clear(), parts.clear(), bounds.clear()
            bounds.append(0)
            return row

        for batch in batches:
            ids, cut = e.encode(batch.column("text").cast(pa.binary()).to_pylist(), end)
            lengths = np.diff(cut)
            at, names = 0, batch.column("doc_id").to_pylist()
            while at < len(names):
                # as many documents as fit the open file, one at least if it is empty
                fit = int(np.searchsorted(np.cumsum(lengths[at:]), per_file - bounds[-1], side="right"))
                if not fit and doc_ids:
                    yield close()
                    continue
                fit = max(fit, 1)
                parts.append(ids[cut[at] : cut[at + fit]])
                doc_ids.extend(names[at : at + fit])
                bounds.extend((bounds[-1] + cut[at + 1 : at + fit + 1] - cut[at]).tolist())
                at += fit
        if doc_ids:
            yield close()

    # rows of one doc_id (or of null) are parted by a hash of the text; ranges are sampled from these two numbers
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")
    return scratch.save(ordered.mapInArrow(files, "partition int, number int, path string, n_ids long, n_docs long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; start counts all ids before it."""
    ship(spark)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("partition").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before.orderBy("partition")), F.lit(0)))
    placed = manifest.join(parts.select("partition", "base"), "partition").withColumn("first", F.col("base") + F.coalesce(F.sum("n_ids").over(before.partitionBy("partition").orderBy("number")), F.lit(0)))
    n_files = manifest.count()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                r = Reader(get(path))
                raw = memoryview(r.ids().astype("<u4").tobytes())
                b = r.bounds.tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(r.doc_ids, pa.int64()), "start": pa.array(r.bounds[:-1] + first, pa.int64()),
                    "n_tokens": pa.array(np.diff(r.bounds), pa.int64()), "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(b, b[1:])], pa.int64()),
                })

    return placed.select("path", "first").repartition(max(1, min(n_files, 20_000))).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
