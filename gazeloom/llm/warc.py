"""WARC archives with a shared Zstandard dictionary.

An archive begins with a skippable frame that holds a dictionary trained on records of that
archive; every record after it is a Zstandard frame of its own, compressed with the dictionary, so
a record can be read from its offset with the archive's first frame at hand. Of equal payloads of
`least` bytes or more, the one with the largest page_id is a response record, the others are
revisit records that name it and hold no payload.

Equal payloads are found by SHA-256 and the largest page_id of each is a partial maximum, so a
group of any size is a row. Shorter payloads pass by the join that tells copies, and the rows of a
large group are dealt to several tasks. Record ids are UUIDs: of a response that others name, from
its page_id and payload; of all other records, also from their place in the archives. The dictionary is trained on the archive's first records, up to
`sample` bytes: a bound on memory that decides only how small records get.

Nulls: a null html is an empty payload, a null url an empty target; null page_ids are archived,
lose to any other page_id, and if a group has no other, its records are all responses. Rows equal in
page_id and payload: one is the response, the others revisit it. Empty tables give no archive.
A payload of any length is a record of its own and is held by one task. Columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.llm.shared import Scratch, heavy_join, ship, small_batches
from gazeloom.llm.token_codes import folder, get, put

#: The skippable frame that opens an archive with its dictionary.
DICTIONARY_FRAME = 0x184D2A5D
LEAST = 1000
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:pages")


def record_id(page_id: int | None, digest: bytes, place: str = "") -> str:
    """<urn:uuid:...> of a record; place tells apart records of equal pages."""
    return f"<{uuid.uuid5(_NAMES, f'{page_id} {digest.hex()} {place}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, kind: str, refers_to: int | None, date: str, place: str = "") -> bytes:
    """A WARC/1.1 record: header lines, an empty line, the block, two empty lines. The page's number is in a field of its own."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, place)}", f"WARC-Date: {date}", f"WARC-Target-URI: {(url or '').translate({10: ' ', 13: ' '})}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"X-Page-ID: {'null' if page_id is None else page_id}",
    ]
    block = payload
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        block = b""
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary, or plain content where there is too little to train on."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


class Archive:
    """Bytes of an archive that grows by records."""

    def __init__(self, samples: list[bytes], level: int = 3):
        data = train(samples)
        self.coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data))
        self.parts, self.size, self.records = [struct.pack("<II", DICTIONARY_FRAME, len(data)), data], 8 + len(data), 0

    def add(self, data: bytes) -> int:
        """Compresses a record; returns its offset."""
        at, frame = self.size, self.coder.compress(data)
        self.parts.append(frame)
        self.size += len(frame)
        self.records += 1
        return at


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of an archive, frame by frame."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        d, parts = coder.decompressobj(), []
        while not d.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            # in steps, as what lies behind a frame is copied
            parts.append(d.decompress(view[at : at + (64 << 10)]))
            at += min(64 << 10, len(data) - at)
        at -= len(d.unused_data)
        yield parse(b"".join(parts))


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """For each payload that comes twice or more: its SHA-256 (same), the page_id of its response (response_id) and how many have it (copies)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    small = pages.select("page_id", F.sha2(body, 256).alias("same"), F.octet_length(body).alias("n")).where(F.col("n") >= least)
    groups = small.groupBy("same").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).where("copies > 1")
    return groups


def write(spark: SparkSession, pages: DataFrame, least: int = LEAST, per_file: int = 32 << 20, sample: int = 4 << 20, scratch: Scratch | None = None, date: str | None = None) -> DataFrame:
    """Writes archives into the shared folder; returns their manifest: path, records, bytes. date: of all records, by default now."""
    ship(spark)
    small_batches(spark, 256)
    scratch = scratch or Scratch(spark, "warc")
    top = scratch.path("archives")
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"))
    long = F.octet_length("payload") >= least
    groups = scratch.save(decide(pages, least), "groups")
    known = heavy_join(rows.where(long).withColumn("same", F.sha2("payload", 256)), groups, "same", "copies", ["page_id"], "left")
    # rows equal in page_id and payload share a salt: the first of them is the response
    turn = F.row_number().over(Window.partitionBy("same", "__salt", "page_id").orderBy("url"))
    known = known.withColumn("turn", F.when(F.col("page_id") == F.col("response_id"), turn).otherwise(1))
    copy = F.col("response_id").isNotNull() & ((~F.col("page_id").eqNullSafe(F.col("response_id"))) | (F.col("turn") > 1))
    known = known.select("page_id", "url", "payload", F.when(copy, "revisit").otherwise("response").alias("kind"), F.when(copy, F.col("response_id")).alias("refers_to"), (F.col("response_id").isNotNull() & ~copy).alias("named"))
    none = F.lit(None).cast(pages.schema["page_id"].dataType)
    known = known.unionByName(rows.where(~long).select("page_id", "url", "payload", F.lit("response").alias("kind"), none.alias("refers_to"), F.lit(False).alias("named")))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, waiting, weight, archive, k = TaskContext.get().partitionId(), 0, [], 0, None, 0

        def close() -> pa.RecordBatch:
            nonlocal archive, number
            path = f"{folder(top)}/{part:06d}-{number:04d}-{uuid.uuid4().hex[:8]}.warc.zst"
            put(path, b"".join(archive.parts))
            row = pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([archive.records], pa.int64()), "bytes": pa.array([archive.size], pa.int64())})
            archive, number = None, number + 1
            return row

        def begin() -> None:
            nonlocal archive, weight
            archive = Archive(waiting)
            for x in waiting:
                archive.add(x)
            waiting.clear()
            weight = 0

        for batch in batches:
            for page_id, url, payload, kind, refers_to, named in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "kind", "refers_to", "named"))):
                k += 1
                x = record(page_id, url, payload, hashlib.sha1(payload).digest(), kind, refers_to, date, "" if named else f"{part} {k}")
                if archive is None:
                    waiting.append(x)
                    weight += len(x)
                    if weight >= sample:
                        begin()
                else:
                    archive.add(x)
                    if archive.size >= per_file:
                        yield close()
        if waiting:
            begin()
        if archive is not None:
            yield close()

    return scratch.save(known.mapInArrow(archives, "path string, records long, bytes long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the archives; payloads of responses are hashed again."""
    ship(spark)
    n_files = manifest.count()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x == "null" else int(x)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out: list[tuple] = []
                for fields, block in records(get(path)):
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    n, refers_to = int(fields["WARC-Payload-Length"]), None
                    if fields["WARC-Type"] == "revisit":
                        refers_to = number(fields["X-Refers-To-Page-ID"])
                    else:
                        n, found = len(block), hashlib.sha1(block).hexdigest()
                        if found != digest:
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                    out.append((number(fields["X-Page-ID"]), n, digest, fields["WARC-Type"], refers_to))
                a, b, c, d, e = zip(*out)
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(a, pa.int64()), "payload_bytes": pa.array(b, pa.int64()), "payload_digest": pa.array(c, pa.string()), "record_type": pa.array(d, pa.string()), "refers_to": pa.array(e, pa.int64())})

    return manifest.select("path").repartition(max(1, min(n_files, 20_000))).mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def ratio(manifest: DataFrame) -> float:
    r = manifest.agg(F.sum("bytes"), F.sum("records")).first()
    return float(r[0] or 0) / max(1, r[1] or 0)
