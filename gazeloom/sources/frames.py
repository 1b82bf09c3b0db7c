"""Frame streams: a data source of synthetic clips, and detectors as functions over batches of frames."""

from __future__ import annotations

import contextlib
import hashlib
import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not

from gazeloom.config import Thresholds
from gazeloom.operators.folds import suppressed, text_boxes
from gazeloom.operators.sequence import carry


class FrameFilters:
    """What filters on a frame scan leave to be made: recordings, a range of frame numbers, and every n-th frame.

    Filters that are taken here are exact, so Spark needn't look at them again; others are given back.
    """

    def __init__(self, every: int = 1):
        self.every, self.sampled, self.videos = max(1, every), None, None
        self.first, self.last = 0, None

    def push(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        if isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.attribute == ("sampled",) and isinstance(f.child.value, bool):
            f = EqualTo(("sampled",), not f.child.value)
        column, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if column == ("video_id",) and isinstance(f, (EqualTo, In)):
            these = {value} if isinstance(f, EqualTo) else set(f.value)
            self.videos = these if self.videos is None else self.videos & these
        elif column == ("sampled",) and isinstance(f, EqualTo) and isinstance(value, bool):
            if self.sampled is not None and self.sampled != value:
                self.last = -1  # nothing is both
            self.sampled = value
        elif column == ("frame_number",) and isinstance(value, int):
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self._until(value - isinstance(f, LessThan))
            elif isinstance(f, EqualTo):
                self.first = max(self.first, value)
                self._until(value)
            else:
                return False
        elif isinstance(f, IsNotNull) and column in (("video_id",), ("sampled",), ("frame_number",)):
            pass  # they never are
        else:
            return False
        return True

    def _until(self, last: int) -> None:
        self.last = last if self.last is None else min(self.last, last)

    def has(self, video: str) -> bool:
        return self.videos is None or video in self.videos

    def frames(self, n: int, stride: int = 1) -> Iterator[int]:
        """Numbers below n to make, of those that the stride shows."""
        end = n if self.last is None else min(n, self.last + 1)
        step = math.lcm(stride, self.every) if self.sampled else stride
        for k in range(-(-self.first // step) * step, end, step):
            if self.sampled is not False or k % self.every:
                yield k


class _Clip(InputPartition):
    def __init__(self, number: int):
        self.number = number


def told(folder: str | None, clip: str, frames: int, read: int = 0) -> None:
    """Leaves a line of what a scan made, for those who ask (option tally: a folder)."""
    if folder:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{uuid.uuid4().hex}") as f:
            f.write(json.dumps({"video_id": clip, "frames": frames, "bytes": read}).encode())


SCHEMA = "video_id string, frame_number int, timestamp_ms double, sampled boolean, image binary"


class _ClipReader(DataSourceReader):
    def __init__(self, options):
        self.clips, self.fps = int(options.get("clips", 1)), float(options.get("fps", 30))
        self.seconds, self.stride = float(options.get("seconds", 2)), max(1, int(options.get("stride", 1)))
        self.size, self.tally = int(options.get("size", 16)), options.get("tally")
        self.wanted = FrameFilters(int(options.get("every", 1)))

    def pushFilters(self, filters):
        return self.wanted.push(filters)

    def partitions(self):
        return [_Clip(k) for k in range(self.clips) if self.wanted.has(f"clip{k}")]

    def read(self, partition):
        if partition is None:  # no clip is wanted
            return
        # frames that no one asks for are never made, as a decoder would skip them
        name, made = f"clip{partition.number}", 0
        for n in self.wanted.frames(int(self.fps * self.seconds), self.stride):
            image = hashlib.shake_128(f"{partition.number}:{n}".encode()).digest(self.size * self.size)
            made += 1
            yield (name, n, round(n / self.fps * 1000, 2), n % self.wanted.every == 0, image)
        told(self.tally, name, made)


class ClipSource(DataSource):
    """format("clips"): options clips, fps, seconds, stride, every, size. One partition a clip. `sampled` holds for each `every`-th frame."""

    @classmethod
    def name(cls):
        return "clips"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _ClipReader(self.options)


def clips(spark: SparkSession, **options) -> DataFrame:
    """Synthetic clips; filters on video_id, sampled and frame_number reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClipSource)
    return spark.read.format("clips").options(**{k: str(v) for k, v in options.items()}).load()


class _Stored(InputPartition):
    def __init__(self, video: str, uri: str):
        self.video, self.uri = video, uri


class _StoredReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tally = options["path"], options.get("tally")
        self.wanted = FrameFilters(int(options.get("every", 1)))

    def pushFilters(self, filters):
        return self.wanted.push(filters)

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        prefix = self.path[: -len(root)] if self.path.endswith(root) else ""
        named = [(f.base_name.rsplit(".", 1)[0], f"{prefix}{f.path}") for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith((".mp4", ".mov"))]
        return [_Stored(v, u) for v, u in sorted(named) if self.wanted.has(v)]

    def read(self, partition):
        from gazeloom.sources.probe import Ranges
        from gazeloom.sources.samples import index

        if partition is None:  # no clip is wanted
            return
        r = Ranges(partition.uri)
        found, made = index(r), 0
        for n in self.wanted.frames(len(found.sizes)):
            made += 1
            yield (partition.video, n, found.milliseconds(n), n % self.wanted.every == 0, r.at(int(found.offsets[n]), int(found.sizes[n])))
        told(self.tally, partition.video, made, r.read)
        r.close()


class StoredClips(DataSource):
    """format("clip_frames"): options path (a clip, or a folder of clips), every. One partition a clip; the images are the container's samples, as encoded.

    A sample is read by its byte range, so frames that no one asks for are never read.
    """

    @classmethod
    def name(cls):
        return "clip_frames"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _StoredReader(self.options)


def stored_frames(spark: SparkSession, path: str, every: int = 1, **options) -> DataFrame:
    """Frames of stored clips, by the clip's name; filters on video_id, sampled and frame_number reach the source. Codecs that need other frames need all of them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredClips)
    return spark.read.format("clip_frames").options(path=path, every=str(every), **{k: str(v) for k, v in options.items()}).load()


DETECTIONS = "array<struct<x0:double,y0:double,x1:double,y1:double,score:double,source:string,strong:boolean>>"


def detect(frames: DataFrame, make: Callable[[], Callable[[bytes], list[tuple]]], column: str = "detections") -> DataFrame:
    """Adds what a detector finds in each frame. `make` builds it once a partition (models load there)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema)
    names = ("x0", "y0", "x1", "y1", "score", "source", "strong")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make()
        for b in batches:
            b[column] = [[dict(zip(names, d)) for d in detector(image)] for image in b["image"]]
            yield b

    return frames.mapInPandas(run, f"{fields}, {column} {DETECTIONS}")


def detect_decimated(scan: Callable[[], DataFrame], make: Callable[[], Callable[[bytes], list[tuple]]], column: str = "detections", carried: bool = True) -> DataFrame:
    """Every frame of a scan (without its image), with what a detector finds in the `sampled` ones.

    scan: gives the frames; it is asked twice, once for the sampled frames with their images, once for the numbers of the others, so only the sampled
    ones are looked at. carried: the others have the detections of the last sampled frame, or null before the first; otherwise null.
    """
    keys = ["video_id", "frame_number", "timestamp_ms", "sampled"]
    seen = detect(scan().where("sampled"), make, column).select(*keys, column)
    rest = scan().where("not sampled").select(*keys, F.lit(None).cast(DETECTIONS).alias(column))
    frames = seen.unionByName(rest)
    return carry(frames, "video_id", ["frame_number"], column) if carried else frames


def label(frames: DataFrame, make: Callable[[], Callable[[bytes], tuple[str, float, str]]]) -> DataFrame:
    """Adds a labeller's task, confidence and description of each frame."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = make()
        for b in batches:
            b[["task", "confidence", "description"]] = [labeller(image) for image in b["image"]]
            yield b

    return frames.mapInPandas(run, f"{fields}, task string, confidence double, description string")


@contextlib.contextmanager
def opened(made: object) -> Iterator[object]:
    """A provider, entered and left if it is a context manager."""
    if hasattr(made, "__enter__"):
        with made as inside:
            yield inside
    else:
        yield made


HANDS = "left_hand_landmarks array<array<double>>, right_hand_landmarks array<array<double>>, left_confidence double, right_confidence double"


def find_hands(frames: DataFrame, make: Callable[[], object], swap: bool = False) -> DataFrame:
    """Adds both hands' points and confidences of each frame (null for a hand that isn't seen).

    make builds a provider once a partition: a context manager or not, whose detect(image) gives rows (side, confidence, points), where a side is
    "Left" or "Right" in any case. Of several hands on a side the last counts. swap: sides are of a mirrored image. A null image has no hands.
    """
    names = [f.split()[0] for f in HANDS.split(", ")]
    own = [c for c in frames.columns if c.lower() not in names]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(make()) as provider:
            for b in batches:
                rows = []
                for image in b["image"]:
                    seen: dict[str, tuple] = {}
                    for side, confidence, points in provider.detect(image) if image is not None else ():
                        left = (side.lower() == "left") != swap
                        seen["left" if left else "right"] = ([list(map(float, p)) for p in points], float(confidence))
                    (lp, lc), (rp, rc) = (seen.get(s, (None, None)) for s in ("left", "right"))
                    rows.append((lp, rp, lc, rc))
                found = pd.DataFrame(rows, columns=names).astype({"left_confidence": "float64", "right_confidence": "float64"})
                yield pd.concat([b.reset_index(drop=True), found], axis=1)

    return frames.select(*own).mapInPandas(run, f"{fields}, {HANDS}")


TEXT = "array<struct<x0:double,y0:double,x1:double,y1:double,score:double>>"


def find_text(frames: DataFrame, make: Callable[[], object], least: float = 0.5, column: str = "text_boxes", thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Adds the boxes of text in each frame, best first: a provider's grids decoded, boxes suppressed that overlap a better one, and kept by size.

    make builds a provider once a partition: grids(image) gives scores [rows, columns], geometry [5, rows, columns], and the frame's width and height.
    Boxes are clipped to the frame; their longer side lies between the thresholds' shares of the shorter side of the frame. A null image has none.
    """
    own = [c for c in frames.columns if c.lower() != column.lower()]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in own)
    t = thresholds

    def boxes_of(provider: object, image: bytes) -> list[dict]:
        scores, geometry, width, height = provider.grids(image)
        boxes, sure = text_boxes(np.asarray(scores, float), np.asarray(geometry, float), least)
        order = np.argsort(-sure, kind="stable")
        kept = order[suppressed(boxes[order].tolist(), t.text_nms)]
        out = []
        for k in kept.tolist():
            x0, y0, x1, y1 = np.clip(boxes[k], 0, [width, height, width, height]).tolist()
            w, h, side = x1 - x0, y1 - y0, min(width, height)
            if side * t.text_min_fraction <= max(w, h) <= side * t.text_max_fraction and w > 1 and h > 1:
                out.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "score": float(sure[k])})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(make()) as provider:
            for b in batches:
                yield b.assign(**{column: [boxes_of(provider, x) if x is not None else [] for x in b["image"]]})

    return frames.select(*own).mapInPandas(run, f"{fields}, {column} {TEXT}")


def union_of(*makers: Callable) -> Callable:
    """A detector that returns what all of several find."""
    def make():
        parts = [m() for m in makers]
        return lambda image: [d for p in parts for d in p(image)]

    return make


def fake_faces(confirm: float = 0.74) -> Callable:
    """Deterministic boxes from an image's bytes, for tests and dry runs."""
    def make():
        def run(image: bytes) -> list[tuple]:
            score = image[0] / 255
            return [(float(image[1]), float(image[2]), image[1] + 40.0, image[2] + 40.0, score, "fake", score >= confirm)] if score >= 0.5 else []

        return run

    return make


PROVIDERS: dict[str, Callable] = {"fake": fake_faces}


def provider(name: str) -> Callable:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name!r}")
    return PROVIDERS[name]()
