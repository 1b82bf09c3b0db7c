"""What a clip's container says of itself: size, rotation, frames, rate and duration, without a video library.

A container of this family is a tree of boxes, each a length, a type and a body. The walk reads headers
of boxes and the small bodies it needs, by byte ranges from storage; media data are skipped over, so a
clip of many gigabytes costs a few reads. Clips in fragments are counted by the runs of their fragments.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rate of a clip that tells none, and boxes that hold boxes.
DEFAULT_FPS = 30.0
FOLDERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf", b"edts"))
#: Bytes that are fetched at once, so that neighbouring headers cost one read.
WINDOW = 4096

PROBE = "width int, height int, fps double, frame_count long, duration_seconds double, rotation int, codec string, bytes_read long, error string"


class Ranges:
    """Byte ranges of a file in storage, with the last window kept and all bytes that were read counted."""

    def __init__(self, uri: str, length: int | None = None):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(place)
        self.length = self.file.size() if length is None else length
        self.start, self.window, self.read = 0, b"", 0

    def at(self, start: int, n: int) -> bytes:
        """n bytes; fewer are an error."""
        if not self.start <= start <= start + n <= self.start + len(self.window):
            want = min(max(n, WINDOW), max(0, self.length - start))
            self.start, self.window = start, self.file.read_at(want, start) if want else b""
            self.read += len(self.window)
        found = self.window[start - self.start : start - self.start + n]
        if len(found) < n:
            raise ValueError(f"the file ends in a box at byte {start}")
        return found

    def numbers(self, kind: str, start: int) -> tuple:
        return struct.unpack(f">{kind}", self.at(start, struct.calcsize(f">{kind}")))

    def close(self) -> None:
        self.file.close()


def boxes(r: Ranges, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, where the body starts, where it ends) of the boxes in a range."""
    while start + 8 <= end:
        size, kind = r.numbers("I4s", start)
        body = start + 8
        if size == 1:
            size, body = r.numbers("Q", body)[0], body + 8
        elif size == 0:  # up to the end
            size = end - start
        if size < body - start:
            raise ValueError(f"a box at byte {start} is shorter than its header")
        yield kind, body, min(start + size, end)
        start += size


def _header(r: Ranges, at: int) -> tuple[int, int]:
    """(time scale, duration) of a movie's or a medium's header; an unknown duration is 0."""
    version = r.at(at, 1)[0]
    scale, duration = r.numbers("IQ", at + 20) if version == 1 else r.numbers("II", at + 12)
    return scale, 0 if duration == (1 << (64 if version == 1 else 32)) - 1 else duration


def _track_header(r: Ranges, at: int) -> tuple[int, int, float, float]:
    """(number, rotation, width, height): the matrix turns the picture clockwise to be upright."""
    long = r.at(at, 1)[0] == 1
    (number,) = r.numbers("I", at + (20 if long else 12))
    a, b = r.numbers("ii", at + (52 if long else 40))
    width, height = r.numbers("II", at + (88 if long else 76))
    turned = round(math.degrees(math.atan2(b, a))) if a or b else 0
    return number, turned % 360, width / 65536, height / 65536


class _Track:
    def __init__(self):
        self.number = self.rotation = self.scale = self.duration = self.frames = self.ticks = 0
        self.shown = (0.0, 0.0)
        self.size: tuple[int, int] | None = None
        self.handler = self.codec = b""


def _entries(r: Ranges, at: int, end: int, track: _Track) -> None:
    """The first sample entry: its format and, for pictures, the coded size."""
    for kind, body, _ in boxes(r, at + 8, end):
        track.codec = kind
        if track.handler in (b"vide", b"") and end - body >= 28:
            track.size = r.numbers("HH", body + 24)
        return


def _time_to_sample(r: Ranges, at: int) -> tuple[int, int]:
    """(samples, ticks) of the runs of equal durations, which are read in steps."""
    (n,) = r.numbers("I", at + 4)
    samples = ticks = 0
    for k in range(0, n, WINDOW // 8):
        some = min(WINDOW // 8, n - k)
        pairs = r.numbers(f"{2 * some}I", at + 8 + 8 * k)
        samples += sum(pairs[::2])
        ticks += sum(x * y for x, y in zip(pairs[::2], pairs[1::2]))
    return samples, ticks


def _run(r: Ranges, at: int, default: int) -> tuple[int, int]:
    """(samples, ticks) of a run in a fragment."""
    flags = int.from_bytes(r.at(at + 1, 3))
    (n,) = r.numbers("I", at + 4)
    if not flags & 0x100:  # no durations of its own
        return n, n * default
    at += 8 + 4 * bool(flags & 0x1) + 4 * bool(flags & 0x4)
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    width, ticks = len(fields), 0
    for k in range(0, n, WINDOW // (4 * width)):
        some = min(WINDOW // (4 * width), n - k)
        ticks += sum(r.numbers(f"{width * some}I", at + 4 * width * k)[::width])
    return n, ticks


def container(r: Ranges) -> dict:
    """Facts of a clip; a file without a movie box or a picture track is an error."""
    tracks: list[_Track] = []
    defaults: dict[int, int] = {}
    fragments: dict[int, list[int]] = {}
    movie = (0, 0)
    extended, open_track = 0, (0, 0)

    def walk(start: int, end: int) -> None:
        nonlocal movie, extended, open_track
        for kind, body, stop in boxes(r, start, end):
            track = tracks[-1] if tracks else _Track()
            if kind == b"trak":
                tracks.append(_Track())
            if kind in FOLDERS:
                walk(body, stop)
            elif kind == b"mvhd":
                movie = _header(r, body)
            elif kind == b"tkhd":
                track.number, track.rotation, *track.shown = _track_header(r, body)
            elif kind == b"mdhd":
                track.scale, track.duration = _header(r, body)
            elif kind == b"hdlr" and not track.handler:
                track.handler = r.at(body + 8, 4)
            elif kind == b"stsd":
                _entries(r, body, stop, track)
            elif kind == b"stts":
                track.frames, track.ticks = _time_to_sample(r, body)
            elif kind in (b"stsz", b"stz2") and not track.frames:
                (track.frames,) = r.numbers("I", body + 8)
            elif kind == b"mehd":
                (extended,) = r.numbers("Q" if r.at(body, 1)[0] == 1 else "I", body + 4)
            elif kind == b"trex":
                number, _, duration = r.numbers("III", body + 4)
                defaults[number] = duration
            elif kind == b"tfhd":
                flags = int.from_bytes(r.at(body + 1, 3))
                (number,) = r.numbers("I", body + 4)
                at = body + 8 + 8 * bool(flags & 0x1) + 4 * bool(flags & 0x2)
                open_track = number, r.numbers("I", at)[0] if flags & 0x8 else defaults.get(number, 0)
            elif kind == b"trun":
                n, ticks = _run(r, body, open_track[1])
                sums = fragments.setdefault(open_track[0], [0, 0])
                sums[0] += n
                sums[1] += ticks

    walk(0, r.length)
    pictures = [t for t in tracks if t.handler == b"vide"]
    if not pictures:
        raise ValueError("no picture track")
    t = pictures[0]
    more = fragments.get(t.number, (0, 0))
    frames, ticks = t.frames + more[0], t.ticks + more[1]
    fps = frames * t.scale / ticks if ticks > 0 else frames * t.scale / t.duration if t.duration else 0.0
    fps = fps if fps > 0 else DEFAULT_FPS
    known = max(movie[1], extended)
    if known and movie[0]:
        duration = known / movie[0]
    elif ticks and t.scale:
        duration = ticks / t.scale
    else:
        duration = frames / fps
    if not frames:
        frames = round(duration * fps)
    width, height = t.size if t.size and all(t.size) else map(int, t.shown)
    if t.rotation in (90, 270):
        width, height = height, width
    return {"width": width, "height": height, "fps": float(fps), "frame_count": frames, "duration_seconds": round(duration, 3), "rotation": t.rotation, "codec": t.codec.decode("latin-1")}


def probe(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Adds the facts of each clip to files (its URI, and its length where that column is there); display size, so sides are swapped for clips turned by a quarter.

    Clips that can't be read have nulls and an error; a null path has the error "no path". Columns that have the names of facts give way.
    """
    facts = [x.split()[0] for x in PROBE.split(", ")]
    names = [c for c in files.columns if c.lower() not in facts]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for uri, n in zip(b[path], b[length] if length in b else [None] * len(b)):
                row, r = dict.fromkeys(facts), None
                try:
                    if uri is None:
                        raise ValueError("no path")
                    r = Ranges(uri, None if n is None or n != n else int(n))
                    row |= container(r)
                except (OSError, ValueError) as e:
                    row["error"] = str(e)
                if r is not None:
                    row["bytes_read"] = r.read
                    r.close()
                rows.append(row)
            kinds = {"width": "Int32", "height": "Int32", "frame_count": "Int64", "rotation": "Int32", "bytes_read": "Int64", "fps": "float64", "duration_seconds": "float64"}
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=facts).astype(kinds)], axis=1)

    return files.select(*(F.col(f"`{c}`") for c in names)).mapInPandas(run, f"{fields}, {PROBE}")


def probed_media(spark: SparkSession, path: str) -> DataFrame:
    """Accepted uploads under a path with their facts."""
    from gazeloom.sources.tables import media

    return probe(media(spark, path))
