"""Providers of hands and of text: built and closed once a partition, decoded, and null-safe."""

import pytest

from gazeloom.sources import frames

SCHEMA = "video_id string, frame_number int, image binary"


def provider_of(folder):
    """A provider that leaves a file when it is entered and when it is left; hands by the image's first byte."""
    def make():
        import pathlib
        import uuid

        class Hands:
            def __enter__(self):
                (pathlib.Path(folder) / f"in-{uuid.uuid4().hex}").touch()
                return self

            def __exit__(self, *_):
                (pathlib.Path(folder) / f"out-{uuid.uuid4().hex}").touch()

            def detect(self, image):
                points = [[image[0] / 255, k / 21, 0] for k in range(21)]
                return [("Left", 0.9, points)] * (image[0] % 2) + [("RIGHT", 0.4, points), ("Right", 0.8, points)] * (image[0] > 100)

        return Hands()

    return make


@pytest.mark.parametrize("swap", [False, True])
def test_hands(spark, tmp_path, swap):
    rows = [("a", k, bytes([v])) for k, v in enumerate((1, 2, 101, 102))] + [("a", 9, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = {r.frame_number: r for r in frames.find_hands(df, provider_of(str(tmp_path)), swap).collect()}
    left, right = ("right", "left") if swap else ("left", "right")
    seen = {k: (r[f"{left}_confidence"], r[f"{right}_confidence"]) for k, r in got.items()}
    assert seen == {0: (0.9, None), 1: (None, None), 2: (0.9, 0.8), 3: (None, 0.8), 9: (None, None)}
    assert got[2][f"{left}_hand_landmarks"][3] == pytest.approx([101 / 255, 3 / 21, 0]) and got[1][f"{left}_hand_landmarks"] is None
    names = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert names.count("in") == names.count("out") >= 1


def test_text(spark):
    def make():
        """Two cells of one text, one of another, a speck and a faint one; cells are four pixels wide."""
        import numpy as np

        class Grids:
            def grids(self, image):
                scores, geometry = np.zeros((20, 30)), np.zeros((5, 20, 30))
                for y, x, s, w, h in ((5, 5, 0.9, 20, 10), (5, 6, 0.8, 20, 10), (12, 20, 0.7, 16, 8), (2, 2, 0.95, 1, 1), (8, 8, 0.3, 20, 10)):
                    scores[y, x] = s
                    geometry[:4, y, x] = h / 2, w / 2, h / 2, w / 2
                return scores, geometry, 120, 80

        return Grids()

    df = spark.createDataFrame([("a", 0, b"x"), ("a", 1, None)], SCHEMA)
    got = {r.frame_number: r.text_boxes for r in frames.find_text(df, make).collect()}
    assert got[1] == []
    assert [(b.x0, b.y0, b.x1, b.y1, b.score) for b in got[0]] == [(10.0, 15.0, 30.0, 25.0, 0.9), (72.0, 44.0, 88.0, 52.0, 0.7)]


def test_detectors_are_joined(spark):
    df = spark.createDataFrame([("a", 0, bytes([200, 10, 20, 0]))], SCHEMA)
    other = lambda: lambda image: [(1.0, 2.0, 3.0, 4.0, 0.6, "other", False)]
    [r] = frames.detect(df, frames.union_of(frames.provider("fake"), other)).collect()
    assert [d.source for d in r.detections] == ["fake", "other"] and r.detections[0].strong and not r.detections[1].strong
    with pytest.raises(ValueError):
        frames.provider("none")
