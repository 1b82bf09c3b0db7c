"""Frame scans with pushed filters: only the frames that are asked for are made or read; detections are carried between them."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from gazeloom.sources import frames, sink
from gazeloom.sources.probe import Ranges
from gazeloom.sources.samples import index
from test_probe import box, full


def tally(folder):
    lines = [json.loads(p.read_text()) for p in folder.glob("*") if not p.name.startswith(".")] if folder.exists() else []
    return sum(x["frames"] for x in lines), sum(x["bytes"] for x in lines), {x["video_id"] for x in lines}


FILTERS = [
    ("sampled", 3 * 12, 3),
    ("not sampled", 3 * 48, 3),
    ("video_id = 'clip1'", 60, 1),
    ("video_id in ('clip0', 'clip2', 'none') and sampled", 24, 2),
    ("frame_number >= 10 and frame_number < 20", 30, 3),
    ("frame_number > 10 and frame_number <= 20 and sampled", 6, 3),
    ("frame_number = 7", 3, 3),
    ("video_id = 'clip1' and video_id = 'clip2'", 0, 0),
    ("sampled and not sampled", 0, 3),
    ("frame_number between 3 and 50 and timestamp_ms < 500", 3 * 48, 3),  # times are left to Spark
    ("frame_number % 5 = 0", 180, 3),
]


@pytest.mark.parametrize(("condition", "made", "scanned"), FILTERS)
def test_frames_that_no_one_asks_for_are_not_made(spark, tmp_path, condition, made, scanned):
    df = frames.clips(spark, clips=3, fps=30, seconds=2, every=5, size=2, tally=tmp_path / "t")
    got = df.where(condition).select("video_id", "frame_number").collect()
    n, _, videos = tally(tmp_path / "t")
    assert n <= made and len(videos) <= scanned
    assert n == made or not got
    want = frames.clips(spark, clips=3, fps=30, seconds=2, every=5, size=2).cache()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.where(condition).select("video_id", "frame_number").collect()))
    want.unpersist()


def test_stride_and_samples_go_together(spark, tmp_path):
    df = frames.clips(spark, clips=1, fps=30, seconds=2, stride=4, every=6, size=2, tally=tmp_path / "t").where("sampled")
    assert sorted(r.frame_number for r in df.collect()) == [0, 12, 24, 36, 48] and tally(tmp_path / "t")[0] == 5


def test_detections_are_carried_between(spark, tmp_path):
    scan = lambda: frames.clips(spark, clips=2, fps=30, seconds=1, every=4, size=4, tally=tmp_path / "t")
    out = frames.detect_decimated(scan, frames.fake_faces()).collect()
    assert len(out) == 60 and tally(tmp_path / "t")[0] == 60
    whole = {(r.video_id, r.frame_number): r.detections for r in frames.detect(scan(), frames.fake_faces()).collect()}
    for r in out:
        assert r.sampled == (r.frame_number % 4 == 0)
        assert r.detections == whole[r.video_id, r.frame_number // 4 * 4]
    bare = frames.detect_decimated(scan, frames.fake_faces(), carried=False)
    assert bare.where("detections is not null").count() == 16


def test_stored_frames_are_read_by_ranges(spark, tmp_path):
    made = frames.clips(spark, clips=3, fps=25, seconds=4, size=100)
    sink.write_clips(made, str(tmp_path / "v"), fps=25)
    folder = f"file://{tmp_path}/v/clips"
    back = frames.stored_frames(spark, folder)
    assert sorted(map(tuple, back.drop("sampled").collect())) == sorted(map(tuple, made.drop("sampled").collect()))
    few = frames.stored_frames(spark, folder, every=20, tally=tmp_path / "t").where("sampled and video_id = 'clip2'")
    assert sorted(r.frame_number for r in few.collect()) == [0, 20, 40, 60, 80]
    n, read, videos = tally(tmp_path / "t")
    # five frames of 10,000 bytes and the heads of two fragments
    assert (n, videos) == (5, {"clip2"}) and read < 120_000 < 1_000_000 < (tmp_path / "v/clips/clip2.mp4").stat().st_size
    one = frames.stored_frames(spark, f"{folder}/clip1.mp4").where("frame_number = 99").collect()
    assert len(one) == 1 and one[0].timestamp_ms == 3960.0


def chunked(sizes, per_chunk, durations, wide=False, fixed=0):
    """A clip whose frames lie in chunks with gaps, described by tables; gives its bytes and frames."""
    data, places, bodies, at = b"", [], [], 0
    head = box(b"ftyp", b"isom", bytes(4))
    start = len(head) + 8
    k = 0
    for n in per_chunk:
        data += b"\xee" * 13
        places.append(start + len(data))
        for _ in range(n):
            bodies.append(bytes([k % 250]) * sizes[k])
            data += bodies[-1]
            k += 1
    runs = [(1, d) for d in durations]
    firsts = [(c + 1, n, 1) for c, n in enumerate(per_chunk) if not c or per_chunk[c - 1] != n]
    tables = [
        full(b"stsd", 0, 0, struct.pack(">I", 1), box(b"jpeg", bytes(70))), full(b"stts", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">II", *r) for r in runs)),
        full(b"stsc", 0, 0, struct.pack(">I", len(firsts)), *(struct.pack(">III", *f) for f in firsts)),
        full(b"stsz", 0, 0, struct.pack(">II", fixed, len(sizes)), b"" if fixed else struct.pack(f">{len(sizes)}I", *sizes)),
        full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", len(places)), struct.pack(f">{len(places)}{'Q' if wide else 'I'}", *places)),
    ]
    tkhd = full(b"tkhd", 0, 7, struct.pack(">IIIII", 0, 0, 1, 0, 0), bytes(16), struct.pack(">9i", 1 << 16, *[0] * 8), bytes(8))
    mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 1000, sum(durations)), bytes(4)), full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12)), box(b"minf", box(b"stbl", *tables)))
    return head + box(b"mdat", data) + box(b"moov", full(b"mvhd", 0, 0, bytes(96)), box(b"trak", tkhd, mdia)), bodies


@pytest.mark.parametrize(("sizes", "per_chunk", "wide", "fixed"), [([5, 9, 1, 30, 7, 7, 2], (2, 2, 3), False, 0), ([4] * 9, (3, 3, 3), True, 4), ([8] * 5, (1, 2, 2), False, 8), ([3, 700, 20], (3,), True, 0)])
def test_tables_of_chunks(tmp_path, sizes, per_chunk, wide, fixed):
    durations = [40 + k for k in range(len(sizes))]
    data, bodies = chunked(sizes, per_chunk, durations, wide, fixed)
    (tmp_path / "a.mp4").write_bytes(data)
    r = Ranges(f"file://{tmp_path}/a.mp4")
    found = index(r)
    assert [r.at(int(o), int(s)) for o, s in zip(found.offsets, found.sizes)] == bodies
    assert [found.milliseconds(k) for k in range(len(sizes))] == [float(sum(durations[:k])) for k in range(len(sizes))]
