"""Sinks for files that have a layout of their own: episode datasets, copied clips, clips made of frames.

Each is a Python data source whose tasks write to a staging folder of their job under names of their own
and send back what they wrote. The driver then moves the files that count into a ready tree, adds the
lists that describe them, and shows all of it by renaming folders. A failed job removes its staging
folder, so nothing of it is ever visible; files of attempts that lost stay in the staging folder and go
with it. What travels to the driver is a line for each file.
"""

from __future__ import annotations

import json
import shutil
import struct
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING = "_staging"
#: Moves that the driver has under way at once.
MOVES = 16


@dataclass(frozen=True)
class File:
    place: str  # under the dataset
    staged: str
    number: int | str  # the episode or recording
    size: int  # frames, or bytes


@dataclass
class Written(WriterCommitMessage):
    files: list[File] = field(default_factory=list)


def gone(store: fs.FileSystem, place: str) -> bool:
    return store.get_file_info(place).type == fs.FileType.NotFound


def remove_tree(store: fs.FileSystem, place: str) -> None:
    if not gone(store, place):
        store.delete_dir(place)


class StagedWriter(DataSourceArrowWriter):
    """Two phases: `write` stages a task's files, `commit` shows all of them, `abort` leaves none.

    owned: the top folders that overwriting replaces; in append mode their files are added, and a file that is there is an error.
    """

    owned: tuple[str, ...] = ()

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def _roots(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root, f"{root}/{STAGING}/{self.job}"

    def files(self, batches: Iterator[pa.RecordBatch], store: fs.FileSystem, top: str) -> Iterator[File]:
        """Writes a task's files under `top`; each is given once it is closed."""
        raise NotImplementedError

    def described(self, files: list[File]) -> dict[str, Iterator[str]]:
        """Lists that go with the files: place and lines."""
        return {}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, staging = self._roots()
        top = f"{staging}/{uuid.uuid4().hex}"
        store.create_dir(top)
        return Written(list(self.files(iterator, store, top)))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root, staging = self._roots()
        files = [f for m in messages if isinstance(m, Written) for f in m.files]
        twice = [p for p, n in Counter(f.place for f in files).items() if n > 1]
        if twice:
            raise ValueError(f"several tasks wrote {twice[0]}: deal rows by file before they are written")
        if not self.overwrite and (there := [f.place for f in files if not gone(store, f"{root}/{f.place}")]):
            raise FileExistsError(f"{there[0]} is there already")
        ready = f"{staging}/ready"
        for folder in {f.place.rpartition("/")[0] for f in files}:
            store.create_dir(f"{ready}/{folder}")
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: store.move(f.staged, f"{ready}/{f.place}"), files))
        lists = self.described(files)
        for place, lines in lists.items():
            store.create_dir(f"{ready}/{place.rpartition('/')[0]}")
            with store.open_output_stream(f"{ready}/{place}") as out:
                if not self.overwrite and not gone(store, f"{root}/{place}"):
                    with store.open_input_stream(f"{root}/{place}") as old:
                        shutil.copyfileobj(old, out, 1 << 20)
                for line in lines:
                    out.write(f"{line}\n".encode())
        if self.overwrite:
            for top in self.owned:
                remove_tree(store, f"{root}/{top}")
        self._show(store, ready, root, [*(f.place for f in files), *lists])
        remove_tree(store, staging)
        self._tidy(store, root)

    def _show(self, store: fs.FileSystem, ready: str, root: str, places: list[str]) -> None:
        """A top folder that isn't there yet takes one rename; into one that is, files are moved."""
        for top in sorted({p.split("/", 1)[0] for p in places}):
            if gone(store, f"{root}/{top}"):
                store.move(f"{ready}/{top}", f"{root}/{top}")
            else:
                own = [p for p in places if p.split("/", 1)[0] == top]
                for folder in {p.rpartition("/")[0] for p in own}:
                    store.create_dir(f"{root}/{folder}")
                with ThreadPoolExecutor(MOVES) as pool:
                    list(pool.map(lambda p: store.move(f"{ready}/{p}", f"{root}/{p}"), own))

    def _tidy(self, store: fs.FileSystem, root: str) -> None:
        """The staging folder goes with the last job that uses it."""
        if not gone(store, f"{root}/{STAGING}") and not store.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            store.delete_dir(f"{root}/{STAGING}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root, staging = self._roots()
        remove_tree(store, staging)
        self._tidy(store, root)


class EpisodeWriter(StagedWriter):
    """A Parquet file an episode; rows come by episode_index, then frame_index. `meta/episodes.jsonl` lists episodes and lengths."""

    owned = ("data", "meta")

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.place, self.chunk, self.task = options["place"], int(options.get("chunk", 1000)), options.get("task", "")
        self.names = json.loads(options["names"]) if "names" in options else None

    def files(self, batches, store, top):
        writer, number, length = None, None, 0

        def closed() -> File:
            writer.close()
            return File(self.place.format(episode_chunk=number // self.chunk, episode_index=number), f"{top}/{number}", number, length)

        for batch in batches:
            if self.names:
                batch = batch.rename_columns(self.names)
            e = batch.column("episode_index").to_numpy()
            cuts = [0, *(np.flatnonzero(e[1:] != e[:-1]) + 1).tolist(), len(e)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if number != e[a]:
                    if writer:
                        yield closed()
                    number, length = int(e[a]), 0
                    writer = pq.ParquetWriter(f"{top}/{number}", batch.schema, filesystem=store)
                writer.write_batch(batch.slice(a, b - a))
                length += b - a
        if writer:
            yield closed()

    def described(self, files):
        # a generator: the list is written line by line
        return {"meta/episodes.jsonl": (json.dumps({"episode_index": f.number, "tasks": [self.task], "length": f.size}) for f in sorted(files, key=lambda f: f.number))}


class EpisodeSink(DataSource):
    """format("episodes"): options place (a pattern of episode_chunk and episode_index), chunk, task, names (JSON list of the columns' names)."""

    @classmethod
    def name(cls):
        return "episodes"

    def writer(self, schema, overwrite):
        return EpisodeWriter(dict(self.options), overwrite)


class ClipCopyWriter(StagedWriter):
    """Copies clips (episode_index, clip: a URI) in steps. `meta/videos.jsonl` lists episodes and bytes."""

    owned = ("videos",)

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.place, self.chunk = options["place"], int(options.get("chunk", 1000))

    def files(self, batches, store, top):
        for batch in batches:
            for number, uri in zip(batch.column("episode_index").to_pylist(), batch.column("clip").to_pylist()):
                source, name = fs.FileSystem.from_uri(uri)
                with source.open_input_stream(name) as a, store.open_output_stream(f"{top}/{number}") as b:
                    shutil.copyfileobj(a, b, 1 << 20)
                yield File(self.place.format(episode_chunk=number // self.chunk, episode_index=number), f"{top}/{number}", number, store.get_file_info(f"{top}/{number}").size)

    def described(self, files):
        return {"meta/videos.jsonl": (json.dumps({"episode_index": f.number, "bytes": f.size}) for f in sorted(files, key=lambda f: f.number))}


class ClipCopySink(DataSource):
    """format("clip_copies"): options place, chunk."""

    @classmethod
    def name(cls):
        return "clip_copies"

    def writer(self, schema, overwrite):
        return ClipCopyWriter(dict(self.options), overwrite)


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def full_box(kind: bytes, flags: int, *body: bytes) -> bytes:
    return box(kind, flags.to_bytes(4), *body)


#: A picture's place is unchanged; ticks of a second.
UNIT_MATRIX = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
TICKS = 90_000
#: Frames and bytes of a fragment.
FRAGMENT, FRAGMENT_BYTES = 64, 4 << 20


class ClipFile:
    """A clip of one picture track, written forward only: a movie box, then fragments of frames and their bytes."""

    def __init__(self, out, fps: float, width: int, height: int, codec: bytes = b"jpeg"):
        self.out, self.duration, self.count = out, round(TICKS / fps), 0
        self.held: list[bytes] = []
        entry = box(codec, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", width, height, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
        tables = [full_box(k, 0, bytes(n)) for k, n in ((b"stts", 4), (b"stsc", 4), (b"stsz", 8), (b"stco", 4))]
        data = box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1)))
        media = box(b"minf", full_box(b"vmhd", 1, bytes(8)), data, box(b"stbl", full_box(b"stsd", 0, struct.pack(">I", 1), entry), *tables))
        mdia = box(b"mdia", full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TICKS, 0, 0x55C4, 0)), full_box(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"\0"), media)
        tkhd = full_box(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, 0), bytes(16), UNIT_MATRIX, struct.pack(">II", width << 16, height << 16))
        mvhd = full_box(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, TICKS, 0, 1 << 16, 1 << 8), bytes(10), UNIT_MATRIX, bytes(24), struct.pack(">I", 2))
        mvex = box(b"mvex", full_box(b"trex", 0, struct.pack(">IIIII", 1, 1, self.duration, 0, 0)))
        out.write(box(b"ftyp", b"isom", bytes(4), b"isomiso5") + box(b"moov", mvhd, box(b"trak", tkhd, mdia), mvex))
        self.fragments = 0

    def add(self, frame: bytes) -> None:
        self.held.append(frame)
        self.count += 1
        if len(self.held) == FRAGMENT or sum(map(len, self.held)) >= FRAGMENT_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        self.fragments += 1
        sizes = struct.pack(f">{len(self.held)}I", *map(len, self.held))
        base = full_box(b"tfdt", 0, struct.pack(">I", (self.count - len(self.held)) * self.duration % (1 << 32)))

        def moof(offset: int) -> bytes:
            run = full_box(b"trun", 0x201, struct.pack(">Ii", len(self.held), offset), sizes)
            return box(b"moof", full_box(b"mfhd", 0, struct.pack(">I", self.fragments)), box(b"traf", full_box(b"tfhd", 0x20000, struct.pack(">I", 1)), base, run))

        head = moof(0)
        self.out.write(moof(len(head) + 8))
        self.out.write(struct.pack(">I4s", sum(map(len, self.held)) + 8, b"mdat"))
        for frame in self.held:
            self.out.write(frame)
        self.held = []

    def close(self) -> None:
        self._flush()


Encoder = Callable[[], Callable[[bytes], bytes]]


class FrameWriter(StagedWriter):
    """A clip for each recording; rows come by video_id, then frame_number. Frames that are null are left out."""

    owned = ("clips",)

    def __init__(self, options: dict, overwrite: bool, encoder: Encoder | None):
        super().__init__(options, overwrite)
        self.fps, self.width, self.height = float(options.get("fps", 30)), int(options.get("width", 0)), int(options.get("height", 0))
        self.codec, self.encoder = options.get("codec", "jpeg").encode(), encoder

    def files(self, batches, store, top):
        from gazeloom.sources.tables import storage_path

        encode, name, clip, out = self.encoder() if self.encoder else bytes, None, None, None
        staged = ""

        def closed() -> File:
            clip.close()
            out.close()
            return File(storage_path("clips", f"{name}.mp4"), staged, name, clip.count)

        for batch in batches:
            for video, image in zip(batch.column("video_id").to_pylist(), batch.column("image").to_pylist()):
                if video is None:
                    raise ValueError("a frame has no video_id")
                if video != name:
                    if clip:
                        yield closed()
                    name, staged = video, f"{top}/{uuid.uuid4().hex}"
                    out = store.open_output_stream(staged, compression=None)
                    clip = ClipFile(out, self.fps, self.width, self.height, self.codec)
                if image is not None:
                    clip.add(encode(image))
        if clip:
            yield closed()

    def described(self, files):
        return {"clips/clips.jsonl": (json.dumps({"video_id": f.number, "frames": f.size}) for f in sorted(files, key=lambda f: str(f.number)))}


_encoders: dict[str, Encoder] = {}


class FrameSink(DataSource):
    """format("frames"): options fps, width, height, codec (of the encoded frames)."""

    encoder: Encoder | None = None

    @classmethod
    def name(cls):
        return "frames"

    def writer(self, schema, overwrite):
        return FrameWriter(dict(self.options), overwrite, type(self).encoder)


def write_clips(frames: DataFrame, path: str, fps: float = 30.0, width: int = 0, height: int = 0, codec: str = "jpeg", encoder: Encoder | None = None, overwrite: bool = True) -> DataFrame:
    """Clips `clips/<video_id>.mp4` of frames (video_id, frame_number, image), one exchange by recording; gives video_id and frames.

    encoder: builds, once a task, what turns an image into a frame of the codec; without it images are frames already. A recording's
    frames go through a task in order, a fragment at a time, so a clip's length is not held.
    """
    spark = frames.sparkSession
    sink = type("FrameSink", (FrameSink,), {"encoder": staticmethod(encoder) if encoder else None})
    spark.dataSource.register(sink)
    rows = frames.select("video_id", "frame_number", "image").repartition("video_id").sortWithinPartitions("video_id", "frame_number")
    rows.write.format("frames").mode("overwrite" if overwrite else "append").options(fps=fps, width=width, height=height, codec=codec).save(path)
    return spark.read.schema("video_id string, frames long").json(f"{path}/clips/clips.jsonl")
