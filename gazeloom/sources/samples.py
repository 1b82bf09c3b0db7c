"""Where a clip's frames lie in its file: sizes, offsets and times of the picture track's samples, from the container's tables or its fragments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gazeloom.sources.probe import FOLDERS, Ranges, _header, _track_header, boxes

#: Entries of a table that are read at once.
STEP = 1 << 16


@dataclass
class Samples:
    offsets: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray  # ticks
    scale: int

    def milliseconds(self, k: int) -> float:
        return round(float(self.starts[k]) / self.scale * 1000, 2) if self.scale else 0.0


def table(r: Ranges, at: int, n: int, kind: str = ">u4", width: int = 1) -> np.ndarray:
    """n rows of `width` numbers."""
    size = np.dtype(kind).itemsize * width
    parts = [np.frombuffer(r.at(at + size * k, size * min(STEP, n - k)), kind) for k in range(0, n, STEP)]
    return np.concatenate(parts).astype(np.int64).reshape(n, width) if parts else np.zeros((0, width), np.int64)


class _Tables:
    """Of one track, the raw tables."""

    def __init__(self):
        self.number = self.scale = self.fixed = 0
        self.handler = b""
        empty = np.zeros((0, 1), np.int64)
        self.times, self.sizes, self.chunks, self.places = np.zeros((0, 2), np.int64), empty, np.zeros((0, 3), np.int64), empty

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, sizes, durations)"""
        sizes = self.sizes.ravel()
        n, durations = len(sizes), np.repeat(self.times[:, 1], self.times[:, 0])
        durations = np.pad(durations, (0, max(0, n - len(durations))), "edge" if len(durations) else "constant")[:n]
        if not n or not len(self.places):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # runs of chunks with equally many samples, to samples of each chunk
        first = self.chunks[:, 0] - 1
        each = np.repeat(self.chunks[:, 1], np.diff(np.append(first, len(self.places))))
        chunk = np.repeat(np.arange(len(each)), each)[:n]
        before = np.cumsum(sizes) - sizes
        opens = np.searchsorted(chunk, np.arange(len(each)))
        base = before[np.minimum(opens, n - 1)]
        return self.places.ravel()[chunk] + before[: len(chunk)] - base[chunk], sizes[: len(chunk)], durations[: len(chunk)]


def index(r: Ranges) -> Samples:
    """Samples of the first picture track; a file without one is an error."""
    tracks: list[_Tables] = []
    defaults: dict[int, tuple[int, int]] = {}
    parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    now = {"moof": 0, "number": 0, "base": 0, "duration": 0, "size": 0, "next": None}

    def fragment(at: int) -> None:
        flags, n = int.from_bytes(r.at(at + 1, 3)), int(r.numbers("I", at + 4)[0])
        at += 8
        start = now["next"] if now["next"] is not None else now["base"]
        if flags & 0x1:
            start = now["base"] + r.numbers("i", at)[0]
            at += 4
        at += 4 * bool(flags & 0x4)
        fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
        rows = table(r, at, n, width=len(fields)) if fields else np.zeros((n, 0), np.int64)
        own = lambda f, other: rows[:, fields.index(f)] if f in fields else np.full(n, other, np.int64)
        durations, sizes = own(0x100, now["duration"]), own(0x200, now["size"])
        parts.append((now["number"], start + np.cumsum(sizes) - sizes, sizes, durations))
        now["next"] = start + int(sizes.sum())

    def walk(start: int, end: int) -> None:
        for kind, body, stop in boxes(r, start, end):
            t = tracks[-1] if tracks else _Tables()
            if kind == b"trak":
                tracks.append(_Tables())
            if kind == b"moof":
                now["moof"] = body - 8
            if kind in FOLDERS:
                walk(body, stop)
            elif kind == b"tkhd":
                t.number = _track_header(r, body)[0]
            elif kind == b"mdhd":
                t.scale = _header(r, body)[0]
            elif kind == b"hdlr" and not t.handler:
                t.handler = r.at(body + 8, 4)
            elif kind == b"stts":
                t.times = table(r, body + 8, r.numbers("I", body + 4)[0], width=2)
            elif kind == b"stsz":
                fixed, n = r.numbers("II", body + 4)
                t.sizes = np.full((n, 1), fixed, np.int64) if fixed else table(r, body + 12, n)
            elif kind == b"stsc":
                t.chunks = table(r, body + 8, r.numbers("I", body + 4)[0], width=3)
            elif kind in (b"stco", b"co64"):
                t.places = table(r, body + 8, r.numbers("I", body + 4)[0], ">u4" if kind == b"stco" else ">u8")
            elif kind == b"trex":
                number, _, duration, size = r.numbers("IIII", body + 4)
                defaults[number] = duration, size
            elif kind == b"tfhd":
                flags, (number,) = int.from_bytes(r.at(body + 1, 3)), r.numbers("I", body + 4)
                at, (duration, size) = body + 8, defaults.get(number, (0, 0))
                base = now["moof"]
                if flags & 0x1:
                    base, at = r.numbers("Q", at)[0], at + 8
                at += 4 * bool(flags & 0x2)
                if flags & 0x8:
                    duration, at = r.numbers("I", at)[0], at + 4
                if flags & 0x10:
                    size = r.numbers("I", at)[0]
                now.update(number=number, base=base, duration=duration, size=size, next=None)
            elif kind == b"trun":
                fragment(body)

    walk(0, r.length)
    pictures = [t for t in tracks if t.handler == b"vide"]
    if not pictures:
        raise ValueError("no picture track")
    t = pictures[0]
    all_parts = [t.samples(), *(p[1:] for p in parts if p[0] == t.number)]
    offsets, sizes, durations = (np.concatenate(x) for x in zip(*all_parts))
    return Samples(offsets, sizes, np.cumsum(durations) - durations, t.scale)
