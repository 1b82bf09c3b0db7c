"""Boxes, rotations, cameras and quaternions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(column: str) -> list[Column]:
    return [F.col(f"{column}.{k}") for k in ("x0", "y0", "x1", "y1")]


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where boxes don't meet or have no area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when((w * h > 0) & (union > 0), w * h / union).otherwise(0.0)


def overlaps(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def center(a: Box) -> tuple[Column, Column]:
    return (a[0] + a[2]) / 2, (a[1] + a[3]) / 2


def diagonal(a: Box) -> Column:
    return F.sqrt((a[2] - a[0]) * (a[2] - a[0]) + (a[3] - a[1]) * (a[3] - a[1]))


def dilate(a: Box, share: Column) -> list[Column]:
    w, h = a[2] - a[0], a[3] - a[1]
    return [a[0] - w * share, a[1] - h * share, a[2] + w * share, a[3] + h * share]


def lerp(a: Sequence[Column], b: Sequence[Column], t: Column) -> list[Column]:
    return [x + (y - x) * t for x, y in zip(a, b)]


def blur_kernel(a: Box, strength: float, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1, k) of the clipped box and its odd kernel of 9 or more; null where nothing is left."""
    x0, y0 = F.greatest(F.lit(0), a[0].cast("int")), F.greatest(F.lit(0), a[1].cast("int"))
    x1, y1 = F.least(width, a[2].cast("int")), F.least(height, a[3].cast("int"))
    k = (F.greatest(x1 - x0, y1 - y0) * strength).cast("int").bitwiseOR(F.lit(1))
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.greatest(F.lit(9), k).alias("k")))


def rescale(a: Box, scale: Column) -> list[Column]:
    return [x / scale for x in a]


def from_relative(a: Box, width: Column, height: Column) -> list[Column]:
    """A relative box (x, y, w, h) in pixels."""
    return [a[0] * width, a[1] * height, (a[0] + a[2]) * width, (a[1] + a[3]) * height]


def size_between(a: Box, width: Column, height: Column, least: float, most: float) -> Column:
    """The longer side between shares of the shorter image side, and both sides over a pixel."""
    w, h, side = a[2] - a[0], a[3] - a[1], F.least(width, height)
    return F.greatest(w, h).between(side * least, side * most) & (w > 1) & (h > 1)


def downscale(width: Column, height: Column, most: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))


def upright(rotation: Column, width: Column, height: Column) -> Column:
    """struct(width, height) after a rotation by quarter turns."""
    turned = rotation.isin(90, 270)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def side_data_rotation(rotation: Column) -> Column:
    return F.pmod(-rotation, F.lit(360))


def bitrate(width: Column, height: Column, fps: Column) -> Column:
    return F.greatest(F.lit(2_000_000), F.least(F.lit(12_000_000), (width * height * fps * 0.1).cast("int")))


def focal_length(width: Column, fov_degrees: Column) -> Column:
    return width * 0.5 / F.tan(F.radians(fov_degrees) / 2)


def field_of_view(width: Column, focal: Column) -> Column:
    return F.degrees(F.atan(width / (focal * 2)) * 2)


def quaternion_matrix(q: Column) -> Column:
    """Row-major rotation of (w, x, y, z), of any length; the identity for a null one."""
    w, x, y, z = (q[k] for k in range(4))
    n = w * w + x * x + y * y + z * z
    s = 2.0 / n
    rows = [1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y), s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x), s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y)]
    return F.when(n < 1e-9, F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])).otherwise(F.array(*rows))


def matrix_quaternion(m: Column) -> Column:
    """(w, x, y, z) of a row-major rotation, by its largest diagonal term."""
    r = [[m[3 * i + j] for j in range(3)] for i in range(3)]
    trace = r[0][0] + r[1][1] + r[2][2]

    def root(x: Column) -> Column:
        return F.sqrt(F.greatest(x, F.lit(0.0))) * 2

    a, b, c, d = root(trace + 1), root(1 + r[0][0] - r[1][1] - r[2][2]), root(1 + r[1][1] - r[0][0] - r[2][2]), root(1 + r[2][2] - r[0][0] - r[1][1])
    xy, xz, yz = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
    wx, wy, wz = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
    return (
        F.when(trace > 0, F.array(a / 4, wx / a, wy / a, wz / a))
        .when((r[0][0] > r[1][1]) & (r[0][0] > r[2][2]), F.array(wx / b, b / 4, xy / b, xz / b))
        .when(r[1][1] > r[2][2], F.array(wy / c, xy / c, c / 4, yz / c))
        .otherwise(F.array(wz / d, xz / d, yz / d, d / 4))
    )


def quaternion_euler(q: Column) -> Column:
    """struct(yaw, pitch, roll) in radians."""
    w, x, y, z = (q[k] for k in range(4))
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (w * x - y * z) * 2))
    return F.struct(F.atan2((w * y + x * z) * 2, 1 - (x * x + y * y) * 2).alias("yaw"), F.asin(s).alias("pitch"), F.atan2((w * z + x * y) * 2, 1 - (x * x + z * z) * 2).alias("roll"))


def ray_sphere_far(o: Sequence[Column], d: Sequence[Column], c: Sequence[Column], r: Column) -> Column:
    """Distance along a unit ray to the far side of a sphere, or null."""
    oc = [x - y for x, y in zip(o, c)]
    b = sum((x * y for x, y in zip(oc, d)), F.lit(0.0)) * 2
    disc = b * b - 4 * (sum((x * x for x in oc), F.lit(0.0)) - r * r)
    t = (F.sqrt(F.greatest(disc, F.lit(0.0))) - b) / 2
    return F.when((disc >= 0) & (t > 0), t)


def scale_intrinsics(k: Column, from_size: Column, width: Column, height: Column) -> Column:
    """A camera matrix for another frame size."""
    x, y = width / from_size[0], height / from_size[1]
    return F.array(*[F.array(*[k[i][j] * (x if i == 0 else y if i == 1 else F.lit(1.0)) for j in range(3)]) for i in range(3)])


def colmap_intrinsics(model: Column, p: Column) -> Column:
    """struct(fx, fy, cx, cy, distortion) of a reconstruction's camera parameters."""
    one = model.isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE")
    at = lambda k: F.try_element_at(p, F.lit(k))
    zero = F.lit(0.0)
    d = F.when(model.isin("SIMPLE_RADIAL", "SIMPLE_RADIAL_FISHEYE"), F.array(at(4), zero, zero, zero, zero)).when(model.isin("RADIAL", "RADIAL_FISHEYE"), F.array(at(4), at(5), zero, zero, zero)).when(model.isin("OPENCV", "OPENCV_FISHEYE"), F.array(at(5), at(6), at(7), at(8), zero)).otherwise(F.array(zero, zero, zero, zero, zero))
    return F.struct(at(1).alias("fx"), F.when(one, at(1)).otherwise(at(2)).alias("fy"), F.when(one, at(2)).otherwise(at(3)).alias("cx"), F.when(one, at(3)).otherwise(at(4)).alias("cy"), d.alias("distortion"))


def root_aligned_errors(p: Column, g: Column, root: int = 0) -> Column:
    """Distance of every joint of p and g (arrays of points) after moving both roots to the origin."""
    def of(a: Column, b: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(F.zip_with(a, p[root], lambda x, y: x - y), F.zip_with(b, g[root], lambda x, y: x - y), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    return F.zip_with(p, g, of)


def permuted(points: Column, order: Sequence[int]) -> Column:
    return F.transform(F.array(*[F.lit(k + 1) for k in order]), lambda k: F.element_at(points, k))


def timeline_share(start: Column, end: Column, duration: Column) -> Column:
    """struct(left, width) in percent of a duration of a second or more."""
    whole = F.greatest(duration, F.lit(1.0))
    return F.struct((start / whole * 100).alias("left"), ((end - start) / whole * 100).alias("width"))


def by_side(label: Column, points: Column, score: Column, swap: Column) -> Column:
    """struct(left, left_confidence, right, right_confidence) of one detected hand; mirrored views swap the sides."""
    left = (label == "Left") != swap
    return F.struct(F.when(left, points).alias("left"), F.when(left, score).alias("left_confidence"), F.when(~left, points).alias("right"), F.when(~left, score).alias("right_confidence"))


def next_multiple(n: Column, step: int = 32) -> Column:
    """A side of a detector's input: the nearest multiple, one at least."""
    return F.greatest(F.lit(step), (F.bround(n / step) * step).cast("int"))
