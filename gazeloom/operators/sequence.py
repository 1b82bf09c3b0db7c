"""Ordered per-recording operators that window functions express: one exchange by the recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, HERE = Window.unboundedPreceding, Window.currentRow


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def stride(source_fps: Column, sample_fps: Column) -> Column:
    """Half-even rounding, as the sampling rate was defined with."""
    return F.greatest(F.lit(1), F.bround(source_fps / sample_fps).cast("int"))


def stride_sample(df: DataFrame, frame: str, every: Column | int) -> DataFrame:
    return df.where(F.col(frame) % every == 0)


def media_time_ms(frame: Column, fps: Column) -> Column:
    return F.round(frame / fps * 1000, 2)


def even_sample(df: DataFrame, key: str, order: str | Sequence[str], n: int, centers: bool = False) -> DataFrame:
    """n evenly spaced rows of each key: floor(i * rows / (n + 1)) for i in 1..n, or the centers of n slices."""
    w = Window.partitionBy(key)
    at = F.row_number().over(w.orderBy(*_names(order))) - 1
    rows = df.withColumn("__at", at).withColumn("__n", F.count("*").over(w))
    steps = F.sequence(F.lit(0), F.lit(n - 1)) if centers else F.sequence(F.lit(1), F.lit(n))
    pick = (lambda i: F.floor((i + 0.5) * F.col("__n") / n)) if centers else (lambda i: F.floor(i * F.col("__n") / (n + 1)))
    return rows.where(F.exists(steps, lambda i: pick(i) == F.col("__at"))).drop("__at", "__n")


def cap_rows(df: DataFrame, key: str, order: str | Sequence[str], n: int) -> DataFrame:
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(*_names(order)))).where(F.col("__at") <= n).drop("__at")


def islands(df: DataFrame, key: str, time: str, label: str, order: Sequence[str] | None = None, duration: Column | None = None, interval: float = 1.0, confidence: str | None = None, description: str | None = None) -> DataFrame:
    """Runs of equal labels: key, label, start, end, frames (and mean confidence, first non-blank description).

    A run ends where the next begins; the last after one interval, or at the recording's duration if that is sooner.
    """
    order = list(order or [time])
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.lag(label).over(w).eqNullSafe(F.col(label))) | (F.row_number().over(w) == 1)
    marked = df.withColumn("__run", F.sum(new.cast("int")).over(w.rowsBetween(FIRST, HERE)))
    aggs = [F.min(time).alias("start"), F.max(time).alias("__last"), F.count("*").alias("frames")]
    if confidence:
        aggs.append(F.round(F.avg(confidence), 3).alias("confidence"))
    if description:
        aggs.append(F.min_by(description, F.when(F.col(description).rlike(r"\S"), F.struct(*order))).alias("description"))
    if duration is not None:
        aggs.append(F.max(duration).alias("__duration"))
    runs = marked.groupBy(key, "__run", label).agg(*aggs)
    end = F.col("__last") + interval
    if duration is not None:
        end = F.when(F.coalesce(F.col("__duration"), F.lit(0)) > 0, F.least(F.col("__duration"), end)).otherwise(end)
    end = F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("__run")), end)
    return runs.withColumn("end", end).drop("__run", "__last", "__duration")


def gap_fill(df: DataFrame, key: str, time: str, value: str, order: Sequence[str] | None = None, max_gap: float = 0.3, scale: float = 1.0) -> DataFrame:
    """Linear fill between valid rows that are max_gap (in time * scale) or less apart; never before the first or after the last. Adds is_filled."""
    order = list(order or [time])
    # looking ahead is looking back in the other order: both frames grow row by row
    ahead = Window.partitionBy(key).orderBy(*map(F.desc, order)).rowsBetween(FIRST, HERE)
    back = Window.partitionBy(key).orderBy(*order).rowsBetween(FIRST, HERE)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    df = df.withColumn("__b", F.last(here, ignorenulls=True).over(ahead)).withColumn("__a", F.last(here, ignorenulls=True).over(back))
    span = F.col("__b.t") - F.col("__a.t")
    t = (F.col(time) - F.col("__a.t")) / F.when(span == 0, 1).otherwise(span)
    fits = F.col(value).isNull() & F.col("__a").isNotNull() & F.col("__b").isNotNull() & (span * scale <= max_gap)

    def blend(a: Column, b: Column) -> Column:
        return (1 - t) * a + t * b

    kind = df.schema[value].dataType.simpleString()
    if kind.startswith("array<array"):
        filled = F.zip_with("__a.v", "__b.v", lambda p, q: F.zip_with(p, q, blend))
    elif kind.startswith("array"):
        filled = F.zip_with("__a.v", "__b.v", blend)
    else:
        filled = blend(F.col("__a.v"), F.col("__b.v"))
    return df.withColumn("is_filled", F.coalesce(fits, F.lit(False))).withColumn(value, F.when(F.col("is_filled"), filled.cast(kind)).otherwise(F.col(value))).drop("__a", "__b")


def carry(df: DataFrame, key: str, order: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """The last non-null value so far; an empty array is a value, a null is none."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(FIRST, HERE)
    return df.withColumn(out or value, F.last(value, ignorenulls=True).over(w))


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, columns: Sequence[str], order: Sequence[str] = (), tie: str = "earlier", tolerance: float | None = None) -> DataFrame:
    """Each left row with the columns of the right row of its key nearest in time, as struct `nearest` with its time.

    One union and one sort by key: forward and backward non-null values, so nothing is multiplied.
    tie: which of two equally near rows counts; of right rows at one time, the first in `order`.
    """
    if order:
        first = Window.partitionBy(key, time).orderBy(*order)
        right = right.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    right = right.select(F.col(key), F.col(time), F.struct(F.col(time).alias("time"), *columns).alias("__r"))
    both = left.withColumn("__left", F.struct(*left.columns)).select(key, time, "__left", F.lit(None).cast(right.schema["__r"].dataType).alias("__r")).unionByName(right.select(key, time, F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("__left"), "__r"))
    # looking ahead is looking back in the other order: both frames grow row by row
    ahead = Window.partitionBy(key).orderBy(F.desc(time)).rangeBetween(FIRST, HERE)
    back = Window.partitionBy(key).orderBy(time).rangeBetween(FIRST, HERE)
    near = both.withColumn("__b", F.last("__r", ignorenulls=True).over(ahead)).withColumn("__a", F.last("__r", ignorenulls=True).over(back)).where("__left is not null")
    before, after = F.col(time) - F.col("__a.time"), F.col("__b.time") - F.col(time)
    closer = after < before if tie == "earlier" else after <= before
    found = F.when(F.col("__a").isNull() | closer, F.col("__b")).otherwise(F.col("__a"))
    found = F.when(F.col("__b").isNull(), F.col("__a")).otherwise(found)
    out = near.select("__left.*", found.alias("nearest"))
    if tolerance is not None:
        out = out.withColumn("nearest", F.when(F.abs(F.col("nearest.time") - F.col(time)) <= tolerance, F.col("nearest")))
    return out


def interval_join(points: DataFrame, spans: DataFrame, key: str, time: str, columns: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Each point with the first span (by start) of its key with start <= time < end, as struct `span`; null for none.

    Spans that don't overlap (islands, segments) need one pass: the last start so far is the only candidate.
    """
    spans = spans.select(F.col(key), F.col(start).alias(time), F.struct(F.col(start).alias("start"), F.col(end).alias("end"), *columns).alias("__s"))
    p = points.select(F.col(key), F.col(time), F.struct(*points.columns).alias("__p"))
    both = p.withColumn("__s", F.lit(None).cast(spans.schema["__s"].dataType)).unionByName(spans.withColumn("__p", F.lit(None).cast(p.schema["__p"].dataType)))
    w = Window.partitionBy(key).orderBy(time).rangeBetween(FIRST, HERE)
    out = both.withColumn("span", F.last("__s", ignorenulls=True).over(w)).where("__p is not null")
    return out.select("__p.*", F.when(F.col("span.end") > F.col(time), F.col("span")).alias("span"))


def overlapping_intervals(points: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, width: float) -> DataFrame:
    """All (point, span) with start <= time < end: an equi-join on bins of the width, then the bounds."""
    cell = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("__cell")
    return points.withColumn("__cell", F.floor(F.col(time) / width)).join(spans.select("*", cell), [key, "__cell"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("__cell")


def bridge_gaps(df: DataFrame, key: Sequence[str], frame: str, box: Sequence[str], max_gap: int, dilation: float, most: float = 0.5) -> DataFrame:
    """Interpolated boxes for the frames between a key's consecutive ones that are max_gap or less apart, grown most in the middle."""
    w = Window.partitionBy(*key).orderBy(frame)
    rows = df.select(*key, frame, *box, F.lead(frame).over(w).alias("__next"), *[F.lead(b).over(w).alias(f"__{b}") for b in box])
    rows = rows.where((F.col("__next") - F.col(frame) > 1) & (F.col("__next") - F.col(frame) <= max_gap))
    rows = rows.withColumn("__f", F.explode(F.sequence(F.col(frame) + 1, F.col("__next") - 1)))
    t = (F.col("__f") - F.col(frame)) / (F.col("__next") - F.col(frame))
    x0, y0, x1, y1 = (F.col(b) + (F.col(f"__{b}") - F.col(b)) * t for b in box)
    grow = F.least(F.lit(most), F.least(F.col("__f") - F.col(frame), F.col("__next") - F.col("__f")) * dilation)
    return rows.select(*key, F.col("__f").alias(frame), *[c.alias(b) for c, b in zip(grown(x0, y0, x1, y1, grow), box)])


def grown(x0: Column, y0: Column, x1: Column, y1: Column, share: Column) -> list[Column]:
    return [x0 - (x1 - x0) * share, y0 - (y1 - y0) * share, x1 + (x1 - x0) * share, y1 + (y1 - y0) * share]


def hold_ends(df: DataFrame, key: Sequence[str], frame: str, box: Sequence[str], hold: int, dilation: float, frames: int, most: float = 0.5) -> DataFrame:
    """Boxes for `hold` frames before a key's first and after its last, growing away from it, within 0..frames-1."""
    ends = df.groupBy(*key).agg(F.min_by(F.struct(frame, *box), frame).alias("a"), F.max_by(F.struct(frame, *box), frame).alias("b"))
    k = F.explode(F.sequence(F.lit(1), F.lit(hold))).alias("k")
    parts = []
    for end, sign in (("a", -1), ("b", 1)):
        side = ends.select(*key, F.col(end).alias("e"), k)
        grow = F.least(F.lit(most), F.col("k") * dilation)
        parts.append(side.select(*key, (F.col(f"e.{frame}") + F.col("k") * sign).alias(frame), *[c.alias(b) for c, b in zip(grown(*[F.col(f"e.{b}") for b in box], grow), box)]))
    return parts[0].union(parts[1]).where((F.col(frame) >= 0) & (F.col(frame) < frames))


def running_index(df: DataFrame, episode: str, order: Sequence[str]) -> DataFrame:
    """frame_index in its episode, and index over all episodes: each episode's first is a sum over episodes' lengths, not over rows."""
    inside = df.withColumn("frame_index", (F.row_number().over(Window.partitionBy(episode).orderBy(*order)) - 1).cast("long"))
    lengths = df.groupBy(episode).agg(F.count("*").alias("__n"))
    lengths = lengths.select(episode, F.coalesce(F.sum("__n").over(Window.orderBy(episode).rowsBetween(FIRST, -1)), F.lit(0)).alias("__first"))
    return inside.join(lengths, episode).withColumn("index", F.col("__first") + F.col("frame_index")).drop("__first")


def latest(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def run_delta(df: DataFrame, key: str, order: Sequence[str], value: str, threshold: float = 0.0005) -> DataFrame:
    """previous, delta and direction (up, down, flat) of a value against its key's row before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    delta = F.col(value) - before
    return df.withColumn("previous", before).withColumn("delta", delta).withColumn("direction", F.when(delta > threshold, "up").when(delta < -threshold, "down").when(delta.isNotNull(), "flat"))
