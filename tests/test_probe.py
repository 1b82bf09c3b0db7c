"""Containers that are made by hand: sizes, turns, rates, fragments, broken files, and what is read of them."""

import struct

import pytest

from gazeloom.operators.tables import backfill_duration
from gazeloom.sources.probe import container, probe, probed_media, Ranges


def box(kind, *body, large=False):
    data = b"".join(body)
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data if large else struct.pack(">I4s", len(data) + 8, kind) + data


def full(kind, version, flags, *body):
    return box(kind, bytes([version]) + flags.to_bytes(3), *body)


#: a and b of a matrix that turns clockwise by so many degrees.
TURNS = {0: (1, 0), 90: (0, 1), 180: (-1, 0), 270: (0, -1)}


def clip(width=1920, height=1080, turn=0, scale=30000, runs=((300, 1001),), movie=(600, 6006), long=False, handler=b"vide", stts=True, stsz=None, before=(), extra=b"", mdat=1000, large=False, number=1):
    a, b = TURNS[turn]
    matrix = struct.pack(">9i", a << 16, b << 16, 0, -b << 16, a << 16, 0, 0, 0, 1 << 30)
    shown = struct.pack(">II", width << 16, height << 16)
    tkhd = full(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, number, 0, 0), bytes(16), matrix, shown) if long else full(b"tkhd", 0, 7, struct.pack(">IIIII", 0, 0, number, 0, 0), bytes(16), matrix, shown)
    total = sum(n * d for n, d in runs)
    head = lambda s, d: struct.pack(">QQIQ", 0, 0, s, d) if long else struct.pack(">IIII", 0, 0, s, d)
    entry = box(b"avc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", width, height), bytes(50))
    table = full(b"stts", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">II", n, d) for n, d in runs)) if stts else b""
    sizes = full(b"stsz", 0, 0, struct.pack(">II", 0, stsz), bytes(4 * stsz)) if stsz else b""
    stbl = box(b"stbl", full(b"stsd", 0, 0, struct.pack(">I", 1), entry), table, sizes)
    mdia = box(b"mdia", full(b"mdhd", long, 0, head(scale, total), bytes(4)), full(b"hdlr", 0, 0, bytes(4), handler, bytes(12), b"x\0"), box(b"minf", stbl))
    moov = box(b"moov", full(b"mvhd", long, 0, head(*movie), bytes(76)), *before, box(b"trak", tkhd, mdia), extra)
    return box(b"ftyp", b"isom", bytes(4)) + box(b"mdat", b"\xff" * mdat, large=large) + moov


@pytest.fixture
def stored(tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data)
        return f"file://{tmp_path}/{name}"

    return put


def facts(uri):
    r = Ranges(uri)
    return container(r) | {"read": r.read}


@pytest.mark.parametrize("long", [False, True])
@pytest.mark.parametrize(("turn", "size"), [(0, (1920, 1080)), (90, (1080, 1920)), (180, (1920, 1080)), (270, (1080, 1920))])
def test_quarter_turns_swap_sides(stored, turn, size, long):
    f = facts(stored("a.mp4", clip(turn=turn, long=long)))
    assert (f["width"], f["height"]) == size and f["rotation"] == turn and f["codec"] == "avc1"
    assert f["frame_count"] == 300 and f["fps"] == pytest.approx(30000 / 1001) and f["duration_seconds"] == 10.01


def test_rates_of_uneven_runs(stored):
    f = facts(stored("a.mp4", clip(scale=1000, runs=((10, 40), (20, 20), (1, 200)), movie=(1000, 0))))
    assert f["frame_count"] == 31 and f["fps"] == pytest.approx(31) and f["duration_seconds"] == 1.0


def test_many_runs_are_read_in_steps(stored):
    f = facts(stored("a.mp4", clip(scale=1000, runs=tuple((1, 30 + k % 3) for k in range(3000)), movie=(1000, 93_000))))
    assert f["frame_count"] == 3000 and f["fps"] == pytest.approx(3000 / 93)


def test_a_clip_without_times_takes_the_usual_rate(stored):
    f = facts(stored("a.mp4", clip(runs=(), stts=False, stsz=90, movie=(0, 0))))
    assert f["fps"] == 30 and f["frame_count"] == 90 and f["duration_seconds"] == 3.0
    f = facts(stored("b.mp4", clip(runs=(), stts=False, movie=(1000, 2500))))
    assert f["fps"] == 30 and f["frame_count"] == 75 and f["duration_seconds"] == 2.5


def test_pictures_are_found_after_sound(stored):
    sound = box(b"trak", full(b"tkhd", 0, 7, struct.pack(">IIIII", 0, 0, 9, 0, 0), bytes(16), struct.pack(">9i", *[0] * 9), bytes(8)), box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 48000, 480_000), bytes(4)), full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12)), box(b"minf", box(b"stbl", full(b"stts", 0, 0, struct.pack(">III", 1, 470, 1024))))))
    f = facts(stored("a.mp4", clip(before=(sound,))))
    assert f["frame_count"] == 300 and f["width"] == 1920


def test_fragments_are_counted(stored):
    extra = box(b"mvex", full(b"mehd", 0, 0, struct.pack(">I", 4000)), full(b"trex", 0, 0, struct.pack(">IIIII", 1, 1, 100, 0, 0)))
    head = clip(scale=1000, runs=(), movie=(1000, 0), extra=extra, mdat=0)
    own = full(b"trun", 0, 0x301, struct.pack(">Ii", 3, 0), *(struct.pack(">II", d, 9) for d in (100, 150, 250)))
    parts = [box(b"moof", full(b"mfhd", 0, 0, bytes(4)), box(b"traf", full(b"tfhd", 0, flags, struct.pack(">I", 1), *given), run)) + box(b"mdat", bytes(5000)) for flags, given, run in ((0, (), full(b"trun", 0, 0, struct.pack(">I", 20))), (0x8, (struct.pack(">I", 50),), full(b"trun", 0, 0, struct.pack(">I", 30))), (0, (), own))]
    f = facts(stored("a.mp4", head + b"".join(parts)))
    assert f["frame_count"] == 53 and f["fps"] == pytest.approx(53 / 4) and f["duration_seconds"] == 4.0


def test_media_data_are_not_read(stored):
    f = facts(stored("a.mp4", clip(mdat=50_000_000, large=True)))
    assert f["read"] < 20_000 and f["frame_count"] == 300


def test_probe_of_uploads(spark, stored, tmp_path):
    stored("good.mp4", clip(turn=90, mdat=3_000_000))
    stored("cut.mp4", clip()[:-200])
    stored("sound.mov", clip(handler=b"soun"))
    stored("short.mp4", box(b"ftyp", b"isom", bytes(4)))
    stored("other.mp4", b"RIFF" + bytes(100))
    got = {r.path.rsplit("/", 1)[1]: r for r in probed_media(spark, str(tmp_path)).collect()}
    assert set(got) == {"good.mp4", "cut.mp4", "sound.mov", "short.mp4"}  # others are no uploads
    good = got["good.mp4"]
    assert (good.width, good.height, good.rotation, good.frame_count, good.error) == (1080, 1920, 90, 300, None) and good.bytes_read < 20_000 < good.length
    assert all(got[k].error and got[k].width is None and got[k].fps is None for k in ("cut.mp4", "sound.mov", "short.mp4"))


def test_probe_without_lengths_fills_durations(spark, stored):
    files = spark.createDataFrame([("a", stored("a.mp4", clip())), ("b", "file:///nowhere/x.mp4"), ("c", None)], "id string, path string")
    found = probe(files)
    recordings = spark.createDataFrame([("a", 0.0), ("b", None), ("c", 7.0)], "id string, duration_seconds double")
    assert {r.id: r.duration_seconds for r in backfill_duration(recordings, found).collect()} == {"a": 10.01, "b": None, "c": 7.0}
    assert {r.id: r.error for r in found.where("error is not null").collect()}["c"] == "no path"
