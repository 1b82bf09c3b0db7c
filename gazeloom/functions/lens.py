"""Lens distortion of points and its inverse, as Column expressions; profiles for a frame size and their records.

A point is in pixels; a camera matrix is an array of rows. The standard lens is radial and tangential
(k1, k2, p1, p2, k3), the wide one a polynomial of the angle (k1 to k4). The inverses are iterations of a
fixed number of steps, each a fold over a pair of numbers, so an expression doesn't grow with its steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazeloom.functions.geometry import scale_intrinsics

#: Steps of the inverses: both settle well within for lenses that are invertible over the frame.
STEPS = 30
Point = tuple[Column, Column]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is written, and computed, once."""
    return F.transform(F.array(value), f)[0]


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _coefficients(d: Column, n: int) -> list[Column]:
    """The first n; those that are missing are 0."""
    return [F.coalesce(F.get(d, k).cast("double"), F.lit(0.0)) for k in range(n)]


def normalised(u: Column, v: Column, k: Column) -> Point:
    """A pixel as a direction: x / z and y / z."""
    return (u - k[0][2]) / k[0][0], (v - k[1][2]) / k[1][1]


def pixels(x: Column, y: Column, k: Column) -> Point:
    return x * k[0][0] + k[0][2], y * k[1][1] + k[1][2]


def _standard_terms(x: Column, y: Column, d: Sequence[Column]) -> tuple[Column, Column, Column]:
    """(radial factor, tangential shift of x, of y)"""
    k1, k2, p1, p2, k3 = d
    r = x * x + y * y
    return 1 + r * (k1 + r * (k2 + r * k3)), p1 * x * y * 2 + p2 * (r + x * x * 2), p2 * x * y * 2 + p1 * (r + y * y * 2)


def distort(x: Column, y: Column, distortion: Column, lens: Column | str = "standard") -> Point:
    """Where a lens shows a direction."""
    lens = F.lit(lens) if isinstance(lens, str) else lens
    radial, dx, dy = _standard_terms(x, y, _coefficients(distortion, 5))
    r = F.sqrt(x * x + y * y)
    share = F.when(r > 1e-12, _wide(F.atan(r), _coefficients(distortion, 4)) / r).otherwise(1.0)
    wide = lens == "fisheye"
    return F.when(wide, x * share).otherwise(x * radial + dx), F.when(wide, y * share).otherwise(y * radial + dy)


def _wide(t: Column, k: Sequence[Column]) -> Column:
    s = t * t
    return t * (1 + s * (k[0] + s * (k[1] + s * (k[2] + s * k[3]))))


def _wide_slope(t: Column, k: Sequence[Column]) -> Column:
    s = t * t
    return 1 + s * (k[0] * 3 + s * (k[1] * 5 + s * (k[2] * 7 + s * k[3] * 9)))


def undistort(x: Column, y: Column, distortion: Column, lens: Column | str = "standard", steps: int = STEPS) -> Point:
    """The direction that a lens shows at (x, y): the inverse of distort. Null where a coordinate is null or the wide lens's angle reaches a right angle."""
    found = undistorted(_pair(x.cast("double"), y.cast("double")), distortion, lens, steps)
    return found["x"], found["y"]


def undistorted(point: Column, distortion: Column, lens: Column | str = "standard", steps: int = STEPS) -> Column:
    """undistort for a struct(x, y), as one."""
    lens = F.lit(lens) if isinstance(lens, str) else lens
    turns = F.array_repeat(F.lit(0), steps)
    coefficients = F.array(*_coefficients(distortion, 5))

    def standard(p: Column, c: Column) -> Column:
        def back(s: Column, _: Column) -> Column:
            # what the last guess would be shifted and scaled by, taken off the point
            radial, dx, dy = _standard_terms(s["x"], s["y"], [c[k] for k in range(5)])
            return _pair((p["x"] - dx) / radial, (p["y"] - dy) / radial)

        return F.aggregate(turns, p, back)

    def wide(p: Column, c: Column) -> Column:
        k = [c[i] for i in range(4)]
        # the angle by Newton's steps, held below a right angle on the way
        held = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.57), t))

        def turned(far: Column, angle: Column) -> Column:
            share = F.when(far > 1e-12, F.tan(angle) / far).otherwise(1.0)
            return F.when(F.abs(_wide(angle, k) - far) < 1e-6, _pair(p["x"] * share, p["y"] * share))

        def at(far: Column) -> Column:
            return let(F.aggregate(turns, held(far), lambda t, _: held(t - (_wide(t, k) - far) / _wide_slope(t, k))), lambda angle: turned(far, angle))

        return let(F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]), at)

    return let(point, lambda p: let(coefficients, lambda c: F.when(lens == "fisheye", wide(p, c)).otherwise(standard(p, c))))


def rectified_intrinsics(k: Column, distortion: Column, width: Column, height: Column, lens: Column | str = "standard") -> Column:
    """The camera matrix of the straightened frame, of the same size, that shows no place from outside of the given one.

    Standard lens: the largest upright rectangle inside of the straightened border, by nine points a side. Wide lens: the focal length
    that brings the middles of all sides out to the border or beyond, with their mean in the middle.
    """
    lens = F.lit(lens) if isinstance(lens, str) else lens
    w, h = width.cast("double"), height.cast("double")
    zero = F.lit(0.0)

    def seen(k: Column, places: Column, kind: str) -> Column:
        """Directions of places (structs u, v)."""
        return F.transform(places, lambda p: undistorted(_pair(*normalised(p["u"], p["v"], k)), distortion, kind))

    def standard(k: Column) -> Column:
        share = lambda i: i / F.lit(8.0)
        side = lambda u, v: seen(k, F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(u(i).alias("u"), v(i).alias("v"))), "standard")
        edge = lambda at: lambda i: at + zero * i
        along_x, along_y = (lambda i: (w - 1) * share(i)), (lambda i: (h - 1) * share(i))
        ends = F.struct(
            F.array_max(F.transform(side(edge(zero), along_y), lambda p: p["x"])).alias("left"), F.array_min(F.transform(side(edge(w - 1), along_y), lambda p: p["x"])).alias("right"),
            F.array_max(F.transform(side(along_x, edge(zero)), lambda p: p["y"])).alias("top"), F.array_min(F.transform(side(along_x, edge(h - 1)), lambda p: p["y"])).alias("bottom"),
        )

        def matrix(e: Column) -> Column:
            fx, fy = (w - 1) / (e["right"] - e["left"]), (h - 1) / (e["bottom"] - e["top"])
            return F.array(F.array(fx, zero, -fx * e["left"]), F.array(zero, fy, -fy * e["top"]), F.array(zero, zero, F.lit(1.0)))

        return let(ends, matrix)

    def wide(k: Column) -> Column:
        middles = F.array(*(F.struct(u.alias("u"), v.alias("v")) for u, v in ((w / 2, zero), (w, h / 2), (w / 2, h), (zero, h / 2))))
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 4

        def matrix(b: Column) -> Column:
            f = F.greatest(w * 0.5 / (b["cx"] - F.array_min(b["xs"])), w * 0.5 / (F.array_max(b["xs"]) - b["cx"]), h * 0.5 * b["aspect"] / (b["cy"] - F.array_min(b["ys"])), h * 0.5 * b["aspect"] / (F.array_max(b["ys"]) - b["cy"]))
            return let(f, lambda f: F.array(F.array(f, zero, w * 0.5 - b["cx"] * f), F.array(zero, f / b["aspect"], (h * b["aspect"] * 0.5 - b["cy"] * f) / b["aspect"]), F.array(zero, zero, F.lit(1.0))))

        def centered(s: Column) -> Column:
            return F.struct(s["xs"].alias("xs"), s["ys"].alias("ys"), s["aspect"].alias("aspect"), mean(s["xs"]).alias("cx"), mean(s["ys"]).alias("cy"))

        def sides(found: Column) -> Column:
            aspect = k[0][0] / k[1][1]
            return F.struct(F.transform(found, lambda p: p["x"]).alias("xs"), F.transform(found, lambda p: p["y"] * aspect).alias("ys"), aspect.alias("aspect"))

        return let(let(let(seen(k, middles, "fisheye"), sides), centered), matrix)

    return let(k, lambda k: F.when(lens == "fisheye", wide(k)).otherwise(standard(k)))


def is_plain(profile: Column) -> Column:
    """Whether a profile leaves frames as they are."""
    return F.forall(profile["distortion_coefficients"], lambda c: c == 0)


def for_frame(profile: Column, width: Column, height: Column) -> Column:
    """A profile's camera matrix for frames of a size."""
    return scale_intrinsics(profile["intrinsic_matrix"], profile["image_size"], width, height)


def straightened(u: Column, v: Column, profile: Column, k: Column, new_k: Column) -> Column:
    """struct(u, v): where a pixel goes in the straightened frame. k, new_k: the profile's matrix for the frame, and rectified_intrinsics of it. A plain profile leaves it."""
    here = F.struct(u.cast("double").alias("u"), v.cast("double").alias("v"))
    found = let(k, lambda k: undistorted(_pair(*normalised(here["u"], here["v"], k)), profile["distortion_coefficients"], profile["lens_model"]))

    def shown(p: Column, n: Column) -> Column:
        a, b = pixels(p["x"], p["y"], n)
        return F.struct(a.alias("u"), b.alias("v"))

    return F.when(is_plain(profile), here).otherwise(let(new_k, lambda n: let(found, lambda p: shown(p, n))))


def straightening_record(profile: Column, new_k: Column) -> Column:
    """What was done to a recording's frames, for its processing record."""
    done = ~is_plain(profile)
    kept = let(new_k, lambda n: F.struct(n[0][0].alias("fx"), n[1][1].alias("fy"), n[0][2].alias("cx"), n[1][2].alias("cy")))
    return F.struct(
        done.alias("applied"), profile["camera_model"].alias("camera_model"), F.when(done, profile["lens_model"]).alias("lens_model"), F.when(done, profile["reprojection_error_pixels"]).alias("reprojection_error_pixels"),
        F.when(done, kept).alias("rectified_intrinsics"),
    )
