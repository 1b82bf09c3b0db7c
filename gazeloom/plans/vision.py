"""Queries of lenses, interface figures, aligned matches and decimated detection over the driver's tables, which stand in for recordings."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gazeloom.functions import lens
from gazeloom.operators import display, folds, metrics
from gazeloom.plans.queries import events, query
from gazeloom.sources import frames
from gazeloom.sources.tables import table

#: A lens of each kind, and a frame.
K = ((800.0, 0.0, 640.0), (0.0, 820.0, 360.0), (0.0, 0.0, 1.0))
STANDARD, WIDE = (-0.25, 0.08, 0.001, -0.0015, -0.01), (-0.02, 0.004, -0.001, 0.0002)


def numbers(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def component(k: int) -> Column:
    """A number of a row's embedding, by its place from 1."""
    return F.element_at("embedding", k).cast("double")


_R2 = "(x * x + y * y)"
_DISTORTED = f"""d as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings where embedding[1] is not null and embedding[2] is not null),
 s as (select *, 1 + {STANDARD[0]}::double * {_R2} + {STANDARD[1]}::double * {_R2} ** 2 + {STANDARD[4]}::double * {_R2} ** 3 as radial, atan(sqrt({_R2})) as t from d),
 w as (select *, t * (1 + {WIDE[0]}::double * t ** 2 + {WIDE[1]}::double * t ** 4 + {WIDE[2]}::double * t ** 6 + {WIDE[3]}::double * t ** 8) as td from s)"""


@query(f"""with {_DISTORTED} select vec_id, round(640 + 800 * (x * radial + 2 * {STANDARD[2]}::double * x * y + {STANDARD[3]}::double * ({_R2} + 2 * x * x)), 6) as u,
 round(360 + 820 * (y * radial + {STANDARD[2]}::double * ({_R2} + 2 * y * y) + 2 * {STANDARD[3]}::double * x * y), 6) as v, round(x, 6) as x, round(y, 6) as y from w""")
def lens_standard(spark, d):
    """Directions to pixels through a standard lens, and back."""
    return _through_lens(spark, d, "standard", STANDARD)


@query(f"with {_DISTORTED} select vec_id, round(640 + 800 * case when t > 1e-12 then x * td / sqrt({_R2}) else x end, 6) as u, round(360 + 820 * case when t > 1e-12 then y * td / sqrt({_R2}) else y end, 6) as v, round(x, 6) as x, round(y, 6) as y from w")
def lens_wide(spark, d):
    """Directions to pixels through a wide lens, and back."""
    return _through_lens(spark, d, "fisheye", WIDE)


def _through_lens(spark, d, kind, coefficients):
    k, c = F.array(*map(numbers, K)), numbers(coefficients)
    rows = table(spark, d, "embeddings").select("vec_id", component(1).alias("x0"), component(2).alias("y0")).where("x0 is not null and y0 is not null")
    x, y = lens.distort(F.col("x0"), F.col("y0"), c, kind)
    u, v = lens.pixels(x, y, k)
    shown = rows.select("vec_id", u.alias("u"), v.alias("v"))
    x, y = lens.undistort(*lens.normalised(F.col("u"), F.col("v"), k), c, kind)
    return shown.select("vec_id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


H = 1.7


def _swing_sql(x: str, y: str, z: str, cx: str, cy: str, cz: str, yaw: str, pitch: str) -> list[str]:
    """x, y, z turned by yaw, then leaned by pitch, about a center."""
    across, ahead = f"(({x} - {cx}) * cos({yaw}) + ({z} - {cz}) * sin({yaw}))", f"(({z} - {cz}) * cos({yaw}) - ({x} - {cx}) * sin({yaw}))"
    up = f"({y} - {cy})"
    return [f"({cx} + {across})", f"({cy} + {up} * cos({pitch}) - {ahead} * sin({pitch}))", f"({cz} + {up} * sin({pitch}) + {ahead} * cos({pitch}))"]


def _figure_sql() -> str:
    place = lambda j: [repr(c * H) for c in display.STANDING[j]]
    trunk = {j: _swing_sql(*place(j), *place("pelvis"), "turn", "lean") for j in ("neck", "head_top", "l_shoulder")}
    top = _swing_sql("tx", "ty", "tz", "nx", "ny", "nz", "look", "nod")
    upper, lower = display.UPPER_ARM * H, display.LOWER_ARM * H
    most, least = upper + lower - display.SLACK, abs(upper - lower) + display.SLACK
    return f"""with q as (select vec_id, embedding[1]::double as w, embedding[2]::double as x, embedding[3]::double as y, embedding[4]::double as z, embedding[5]::double as u, embedding[6]::double as v from embeddings where embedding is not null),
 a as (select *, case when vec_id % 7 = 0 then 0 else atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)) end as yaw, case when vec_id % 7 = 0 then 0 else asin(greatest(-1, least(1, 2 * (w * y - z * x)))) end as pitch from q),
 b as (select *, yaw * {display.TURN} as turn, pitch * {display.LEAN} as lean, yaw * {display.LOOK} as look, pitch * {display.NOD} as nod from a),
 c as (select *, {", ".join(f"{e} as {n}" for j, names in (("neck", ("nx", "ny", "nz")), ("head_top", ("tx", "ty", "tz")), ("l_shoulder", ("sx", "sy", "sz"))) for e, n in zip(trunk[j], names))} from b),
 t as (select *, case when vec_id % 5 = 0 then sx - 0.05::double else (u - 0.5) * 0.9 * {H} end - sx as dx, case when vec_id % 5 = 0 then sy - 0.38::double * {H} else 0.85::double * {H} - (0.12 + v * 0.5) * {H} end - sy as dy, case when vec_id % 5 = 0 then sz + 0.12::double * {H} else (0.28 + (1 - v) * 0.12) * {H} end - sz as dz,
  {", ".join(f"({n} + {e}) / 2 as {o}" for n, e, o in zip(("nx", "ny", "nz"), top, ("head_x", "head_y", "head_z")))} from c),
 n as (select *, sqrt(dx * dx + dy * dy + dz * dz) as len from t),
 r as (select *, dx / len as ax, dy / len as ay, dz / len as az, greatest({least!r}::double, least(len, {most!r}::double)) as reach from n),
 g as (select *, ({upper!r}::double ** 2 + reach * reach - {lower!r}::double ** 2) / (2 * reach) as along, -ay - 0.3 * az as side from r),
 p as (select *, -ax * side as px, -1 - ay * side as py, -0.3::double - az * side as pz, sqrt(greatest(0, {upper!r}::double ** 2 - along * along)) as bend from g),
 o as (select *, sqrt(px * px + py * py + pz * pz) as plen from p)
 select vec_id, round(head_x, 6) as head_x, round(head_y, 6) as head_y, round(head_z, 6) as head_z, round(sx + ax * reach, 6) as wrist_x, round(sy + ay * reach, 6) as wrist_y, round(sz + az * reach, 6) as wrist_z,
  round(sx + ax * along + px / plen * bend, 6) as elbow_x, round(sy + ay * along + py / plen * bend, 6) as elbow_y, round(sz + az * along + pz / plen * bend, 6) as elbow_z from o"""


@query(_figure_sql())
def interface_figure(spark, d):
    """The figure's head and left arm; every seventh frame has no orientation, every fifth no hand."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    rows = e.select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.array(*map(component, (1, 2, 3, 4)))).alias("quaternion"), F.when(F.col("vec_id") % 5 != 0, F.array(F.array(component(5), component(6), F.lit(0.0)))).alias("left_hand_landmarks"), F.lit(None).cast("array<array<double>>").alias("right_hand_landmarks"))
    j = F.col("figure")
    return display.figure(rows, H).select("vec_id", *(F.round(j[name][k], 6).alias(f"{out}_{c}") for name, out in (("head", "head"), ("l_wrist", "wrist"), ("l_elbow", "elbow")) for k, c in enumerate("xyz")))


_LINES = ", ".join(f"({a}, {b})" for a, b in display.HAND_BONES)


@query(f"""with p as (select vec_id, [embedding[64]::double, 1, 0.2] as w, list_transform(generate_series(1, 61, 3), lambda i: [embedding[i]::double, embedding[i + 1]::double, embedding[i + 2]::double]) as h from embeddings where embedding is not null),
 m as (select vec_id, list_transform(h, lambda x: [w[1] + (x[1] - h[1][1]) * 0.7, w[2] - (x[2] - h[1][2]) * 0.7, w[3] + (x[3] - h[1][3]) * 0.7]) as h from p), e(a, b) as (values {_LINES}),
 l as (select vec_id, h[a + 1] as s, h[b + 1] as t from m, e)
 select vec_id, count(*) as n, round(sum(sqrt((s[1] - t[1]) ** 2 + (s[2] - t[2]) ** 2 + (s[3] - t[3]) ** 2)), 6) as length, round(sum(s[1]), 6) as sx, round(sum(t[2]), 6) as ty from l group by vec_id""")
def hand_at_wrist(spark, d):
    """Lines of hands at wrists: how many, their length and sums of their ends."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    points = F.transform(F.sequence(F.lit(1), F.lit(61), F.lit(3)), lambda i: F.array(*(F.element_at("embedding", i + k).cast("double") for k in range(3))))
    rows = e.select("vec_id", F.array(component(64), F.lit(1.0), F.lit(0.2)).alias("w"), points.alias("h"))
    lines = rows.select("vec_id", F.inline(display.hand_lines(F.col("w"), F.col("h"))))
    gap = sum(((F.col("a")[k] - F.col("b")[k]) * (F.col("a")[k] - F.col("b")[k]) for k in range(3)), F.lit(0.0))
    return lines.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum(F.sqrt(gap)), 6).alias("length"), F.round(F.sum(F.col("a")[0]), 6).alias("sx"), F.round(F.sum(F.col("b")[1]), 6).alias("ty"))


def _points(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(3 * n - 2), F.lit(3)), lambda i: F.array(*(F.element_at("embedding", i + k).cast("double") for k in range(3))))


@query("""select vec_id // 4 as image, vec_id as prediction_id, min(vec_id) over (partition by vec_id // 4, embedding[1:63]) as truth_id, 0.0::double as pa_error from embeddings where embedding is not null""")
def best_aligned_match(spark, d):
    """Hands that are turned, doubled and moved find their own truth among their image's four, at no error."""
    e = table(spark, d, "embeddings").where("embedding is not null").select(F.expr("vec_id div 4").alias("image"), "vec_id", _points(21).alias("points"))
    turned = F.transform("points", lambda p: F.array((p[0] * 0.6 - p[1] * 0.8) * 2 + 5, (p[0] * 0.8 + p[1] * 0.6) * 2 - 3, p[2] * 2 + 1))
    predicted = e.select("image", F.col("vec_id").alias("prediction_id"), turned.alias("points"))
    out = metrics.best_aligned_match(predicted, e.select("image", F.col("vec_id").alias("truth_id"), "points"), "image")
    return out.select("image", "prediction_id", "truth_id", F.abs(F.round("pa_error", 6)).alias("pa_error"))


def _residual_sql() -> str:
    """Sum of squares that alignment leaves, from the singular values of the 3 x 3 product of centered points: roots of its Gram matrix's cubic."""
    mean = lambda side, c: f"list_sum(list_transform(generate_series(1, 21), lambda i: {side}[3 * i - {3 - c}])) / 21"
    cell = lambda r, c: f"list_sum(list_transform(generate_series(1, 21), lambda i: (x[3 * i - {3 - r}] - mx{r}) * (y[3 * i - {3 - c}] - my{c})))"
    square = lambda s: " + ".join(f"list_sum(list_transform(generate_series(1, 21), lambda i: ({s}[3 * i - {3 - r}] - m{s}{r}) ** 2))" for r in (1, 2, 3))
    gram = lambda a, b: " + ".join(f"h{k}{a} * h{k}{b}" for k in (1, 2, 3))
    return f"""with p as (select a.vec_id, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.embedding is not null and b.embedding is not null),
 m as (select *, {", ".join(f"{mean(s, c)} as m{s}{c}" for s in "xy" for c in (1, 2, 3))} from p),
 h as (select vec_id, {square("x")} as xx, {square("y")} as yy, {", ".join(f"{cell(r, c)} as h{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3))} from m),
 k as (select *, {", ".join(f"{gram(a, b)} as k{a}{b}" for a, b in ((1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3)))}, h11 * (h22 * h33 - h23 * h32) - h12 * (h21 * h33 - h23 * h31) + h13 * (h21 * h32 - h22 * h31) as det from h),
 q as (select *, (k11 + k22 + k33) / 3 as t from k),
 r as (select *, sqrt(((k11 - t) ** 2 + (k22 - t) ** 2 + (k33 - t) ** 2 + 2 * (k12 ** 2 + k13 ** 2 + k23 ** 2)) / 6) as s from q),
 c as (select *, acos(greatest(-1, least(1, ((k11 - t) * ((k22 - t) * (k33 - t) - k23 ** 2) - k12 * (k12 * (k33 - t) - k23 * k13) + k13 * (k12 * k23 - (k22 - t) * k13)) / (2 * s ** 3)))) / 3 as w from r),
 l as (select *, t + 2 * s * cos(w) as l1, t + 2 * s * cos(w + 2 * pi() / 3) as l3 from c),
 v as (select *, sqrt(l1) as s1, sqrt(3 * t - l1 - l3) as s2, sqrt(greatest(l3, 0)) as s3 from l)
 select vec_id, round(yy - (s1 + s2 + sign(det) * s3) ** 2 / xx, 5) as residual from v"""


@query(_residual_sql())
def aligned_residuals(spark, d):
    """What similarity alignment leaves between neighbouring hands, as a sum of squares."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", _points(21).alias("p"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    squares = F.aggregate("pa_errors", F.lit(0.0), lambda s, x: s + x * x)
    return folds.aligned_errors(pairs, "p", "q").select("vec_id", F.round(squares, 5).alias("residual"))


#: Frames between looks.
EVERY = 3


@query(f"""with f as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_number from events),
 s as (select *, frame_number % {EVERY} = 0 as sampled from f),
 c as (select user_id, frame_number, sampled, last_value(case when sampled then event_type end ignore nulls) over (partition by user_id order by frame_number rows between unbounded preceding and current row) as seen from s)
 select user_id, frame_number::int as frame_number, sampled, case when length(seen) >= 5 then 1 else 0 end as boxes, case when length(seen) >= 5 then ascii(seen)::double end as x0 from c""")
def decimated_detection(spark, d):
    """A detector looks at every third frame of a recording; the frames between carry what it saw."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = events(spark, d).select("user_id", "event_type", (F.row_number().over(order) - 1).alias("frame_number"))
    rows = numbered.select(F.col("user_id").cast("string").alias("video_id"), "frame_number", F.col("frame_number").cast("double").alias("timestamp_ms"), (F.col("frame_number") % EVERY == 0).alias("sampled"), F.encode("event_type", "utf-8").alias("image"))

    def detector():
        # a label of five letters or more is a face whose left edge is its first letter
        return lambda image: [(float(image[0]), 0.0, image[0] + 40.0, 40.0, 0.9, "label", True)] if len(image) >= 5 else []

    out = frames.detect_decimated(lambda: rows, detector)
    kind = dict(events(spark, d).dtypes)["user_id"]
    return out.select(F.col("video_id").cast(kind).alias("user_id"), "frame_number", "sampled", F.size("detections").alias("boxes"), F.try_element_at("detections", F.lit(1))["x0"].alias("x0"))
