"""Lenses both ways and their frames; figures, hands at wrists and bones against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from gazeloom.functions import lens
from gazeloom.operators import display
from gazeloom.plans.vision import K, STANDARD, WIDE, numbers
from gazeloom.sources.tables import IDENTITY_PROFILE, with_profile


def grid(spark, n=15, most=0.75):
    at = [most * (2 * i / (n - 1) - 1) for i in range(n)]
    return spark.createDataFrame([(x, y) for x in at for y in at], "x double, y double")


@pytest.mark.parametrize(("kind", "c", "most"), [("standard", STANDARD, 0.55), ("standard", (0.1, -0.02), 0.7), ("fisheye", WIDE, 2.0), ("fisheye", (0.05, 0.01, 0.002, 0.0), 1.5), ("standard", (0.0,) * 5, 0.7), ("standard", (), 0.7)])
def test_lenses_are_inverted(spark, kind, c, most):
    coefficients = numbers(c) if c else F.array().cast("array<double>")
    rows = grid(spark, most=most)
    seen = rows.select("*", *(v.alias(n) for v, n in zip(lens.distort(F.col("x"), F.col("y"), coefficients, kind), ("a", "b"))))
    back = seen.select("*", *(v.alias(n) for v, n in zip(lens.undistort(F.col("a"), F.col("b"), coefficients, kind), ("p", "q"))))
    for r in back.collect():
        assert (r.p, r.q) == pytest.approx((r.x, r.y), abs=1e-7)


def test_the_lens_may_be_a_column(spark):
    df = spark.createDataFrame([(0.3, 0.2, "standard", [0.1, 0.0, 0.0, 0.0, 0.0]), (0.3, 0.2, "fisheye", [0.1, 0.0, 0.0, 0.0]), (None, 0.2, "standard", [0.1])], "x double, y double, lens string, d array<double>")
    a, b, none = df.select(*(v.alias(n) for v, n in zip(lens.distort(F.col("x"), F.col("y"), F.col("d"), F.col("lens")), "ab"))).collect()
    assert a.a == pytest.approx(0.3 * (1 + 0.1 * 0.13)) and none.a is None
    r = math.hypot(0.3, 0.2)
    t = math.atan(r)
    assert b.a == pytest.approx(0.3 * (t + 0.1 * t**3) / r)


def test_angles_beyond_the_lens_are_null(spark):
    x, y = lens.undistort(F.col("x"), F.lit(0.0), numbers((0.0, 0.0, 0.0, 0.0)), "fisheye")
    got = spark.createDataFrame([(1.0,), (3.0,)], "x double").select(x.alias("x")).collect()
    assert got[0].x == pytest.approx(math.tan(1.0)) and got[1].x is None


PROFILE = {"camera_model": "cam", "lens_model": "standard", "image_size": [1280, 720], "intrinsic_matrix": [list(r) for r in K], "distortion_coefficients": list(STANDARD), "reprojection_error_pixels": 0.4}


def recordings(spark, *profiles):
    from gazeloom import schemas

    known = spark.createDataFrame([tuple(p.values()) for p in profiles], schemas.PROFILE)
    return with_profile(spark.createDataFrame([("a", "cam", 1280, 720), ("b", "cam", 640, 360), ("c", "other", 640, 360), ("d", None, 640, 360)], "id string, camera_model string, width int, height int"), known)


@pytest.mark.parametrize(("kind", "c"), [("standard", STANDARD), ("fisheye", WIDE)])
def test_straightened_frames_have_no_empty_border(spark, kind, c):
    rows = recordings(spark, PROFILE | {"lens_model": kind, "distortion_coefficients": list(c)})
    p = F.col("profile")
    rows = rows.withColumn("k", lens.for_frame(p, F.col("width"), F.col("height"))).withColumn("new", lens.rectified_intrinsics(F.col("k"), p["distortion_coefficients"], F.col("width"), F.col("height"), p["lens_model"]))
    got = {r.id: r for r in rows.select("id", "k", "new", lens.straightening_record(p, F.col("new")).alias("record")).collect()}
    assert [x / 2 for x in got["a"].k[0]] == got["b"].k[0] and got["b"].new[0][0] == pytest.approx(got["a"].new[0][0] / 2, rel=0.01)
    assert got["a"].record.applied and got["a"].record.rectified_intrinsics.fx == got["a"].new[0][0] and got["a"].record.reprojection_error_pixels == 0.4
    assert not got["c"].record.applied and got["c"].record.lens_model is None and got["c"].record.camera_model == IDENTITY_PROFILE["camera_model"]
    # the corners and middles of the new frame lie within the old one (for the wide lens, the middles do)
    new, k = got["a"].new, got["a"].k
    places = [(u, v) for u in (0, 639.5, 1279) for v in (0, 359.5, 719) if kind == "standard" or (u == 639.5) != (v == 359.5)]
    df = spark.createDataFrame([((u - new[0][2]) / new[0][0], (v - new[1][2]) / new[1][1]) for u, v in places], "x double, y double")
    for r in df.select(*(v.alias(n) for v, n in zip(lens.pixels(*lens.distort(F.col("x"), F.col("y"), numbers(c), kind), F.array(*map(numbers, k))), "uv"))).collect():
        assert -1 <= r.u <= 1280 and -1 <= r.v <= 720


def test_plain_profiles_leave_pixels(spark):
    rows = recordings(spark, PROFILE)
    p = F.col("profile")
    rows = rows.withColumn("k", lens.for_frame(p, F.col("width"), F.col("height"))).withColumn("new", lens.rectified_intrinsics(F.col("k"), p["distortion_coefficients"], F.col("width"), F.col("height"), p["lens_model"]))
    got = {r.id: r.s for r in rows.select("id", lens.straightened(F.lit(100.0), F.lit(50.0), p, F.col("k"), F.col("new")).alias("s")).collect()}
    assert tuple(got["c"]) == tuple(got["d"]) == (100.0, 50.0) and got["a"].u != pytest.approx(100, abs=1)


def rot(p, c, yaw, pitch):
    x, y, z = (a - b for a, b in zip(p, c))
    x, z = x * math.cos(yaw) + z * math.sin(yaw), z * math.cos(yaw) - x * math.sin(yaw)
    y, z = y * math.cos(pitch) - z * math.sin(pitch), y * math.sin(pitch) + z * math.cos(pitch)
    return [c[0] + x, c[1] + y, c[2] + z]


def arm(s, t, h):
    d = [b - a for a, b in zip(s, t)]
    n = math.hypot(*d) or 1
    u = [x / n for x in d]
    a, b = 0.17 * h, 0.15 * h
    reach = max(abs(a - b) + 0.001, min(math.hypot(*d), a + b - 0.001))
    along = (a * a + reach * reach - b * b) / (2 * reach)
    side = [r - x * sum(i * j for i, j in zip((0, -1, -0.3), u)) for r, x in zip((0, -1, -0.3), u)]
    m = math.hypot(*side) or 1
    bend = math.sqrt(max(0, a * a - along * along))
    return [x + y * reach for x, y in zip(s, u)], [x + y * along + z / m * bend for x, y, z in zip(s, u, side)]


def expected(h, q, left, right):
    j = {k: [c * h for c in v] for k, v in display.STANDING.items()}
    if q:
        w, x, y, z = q
        pitch, yaw = math.asin(max(-1, min(1, 2 * (w * y - z * x)))), math.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
        for k in display.FOLLOW:
            j[k] = rot(j[k], [0, 0.55 * h, 0], 0.7 * yaw, 0.6 * pitch)
        j["head_top"] = rot(j["head_top"], j["neck"], 0.3 * yaw, 0.4 * pitch)
    for s, hand, side in (("l", left, -1), ("r", right, 1)):
        sh = j[f"{s}_shoulder"]
        t = [(hand[0][0] - 0.5) * 0.9 * h, 0.85 * h - (0.12 + hand[0][1] * 0.5) * h, (0.28 + (1 - hand[0][1]) * 0.12) * h] if hand else [sh[0] + side * 0.05, sh[1] - 0.38 * h, sh[2] + 0.12 * h]
        j[f"{s}_wrist"], j[f"{s}_elbow"] = arm(sh, t, h)
    j["head"] = [(a + b) / 2 for a, b in zip(j["neck"], j["head_top"])]
    return {k: j[k] for k in display.FIGURE}


def test_figures(spark):
    hand = [[0.3, 0.6, 0.0]] + [[0.4, 0.5, 0.1]] * 20
    rows = [(1, None, None, None, 1.7), (2, [0.9, 0.2, -0.3, 0.1], hand, None, 1.8), (3, [1.0, 0.0, 0.0, 0.0], [], hand, 1.6), (4, [0.5, 0.5, 0.5, 0.5], None, hand, 1.7)]
    df = spark.createDataFrame(rows, "id int, quaternion array<double>, left_hand_landmarks array<array<double>>, right_hand_landmarks array<array<double>>, h double")
    for r, (_, q, left, right, h) in zip(display.figure(df, F.col("h")).orderBy("id").collect(), rows):
        want = expected(h, q, left, right)
        assert set(r.figure) == set(want)
        for k in want:
            assert r.figure[k] == pytest.approx(want[k], abs=1e-9), k
        for s in "lr":
            assert math.dist(r.figure[f"{s}_shoulder"], r.figure[f"{s}_elbow"]) == pytest.approx(0.17 * h) and math.dist(r.figure[f"{s}_elbow"], r.figure[f"{s}_wrist"]) == pytest.approx(0.15 * h)


def test_hands_rest_without_points(spark):
    points = [[0.5 + k / 100, 0.5 - k / 50, k / 30] for k in range(21)]
    df = spark.createDataFrame([(1, points), (2, points[:20]), (3, None)], "id int, h array<array<double>>")
    wrist = F.array(F.lit(0.2), F.lit(1.0), F.lit(0.3))
    seen, short, none = df.select("id", display.hand_at_wrist(wrist, F.col("h")).alias("at"), display.hand_lines(wrist, F.col("h")).alias("lines")).orderBy("id").collect()
    assert seen["at"][0] == [0.2, 1.0, 0.3] and seen["at"][10] == pytest.approx([0.2 + 0.07, 1.0 + 0.14, 0.3 + 7 / 30])
    assert len(seen.lines) == 21 and seen.lines[-1].b == seen["at"][17]
    assert short["at"] is None and short.lines == none.lines and len(none.lines) == 6
    assert none.lines[0].b == pytest.approx([0.2 - 0.0495, 0.9, 0.35]) and none.lines[-1].a == [0.2, 1.0, 0.3]


def turned(q, v):
    w, x, y, z = q
    t = [2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])]
    return [v[0] + w * t[0] + y * t[2] - z * t[1], v[1] + w * t[1] + z * t[0] - x * t[2], v[2] + w * t[2] + x * t[1] - y * t[0]]


def test_bones_have_a_frame(spark):
    ends = [([0.0, 0.0, 0.0], [0.0, 2.0, 0.0]), ([1.0, 1.0, 1.0], [1.0, -3.0, 1.0]), ([0.2, 0.1, 0.0], [1.0, 0.5, -2.0]), ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])]
    for r in spark.createDataFrame(ends, "a array<double>, b array<double>").select("a", "b", display.bone_frame(F.col("a"), F.col("b")).alias("f")).collect():
        assert r.f.mid == pytest.approx([(x + y) / 2 for x, y in zip(r.a, r.b)]) and r.f.length == pytest.approx(math.dist(r.a, r.b))
        assert sum(x * x for x in r.f.turn) == pytest.approx(1)
        if r.f.length:
            assert turned(r.f.turn, [0, 1, 0]) == pytest.approx(r.f.axis, abs=1e-9)
        else:
            assert r.f.axis is None and r.f.turn == [1, 0, 0, 0]
