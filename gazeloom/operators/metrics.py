"""Evaluation and corpus metrics, matches of predictions with truths, and filters of logs: partial aggregates and keyed joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.functions.geometry import root_aligned_errors
from gazeloom.operators.folds import aligned_errors


def measured_fraction(frames: DataFrame, key: str, sides: Sequence[Column]) -> DataFrame:
    """Share of a recording's wrists (a flag for each side) that were measured, to three places."""
    hits = sum((F.count_if(s) for s in sides[1:]), F.count_if(sides[0]))
    return frames.groupBy(key).agg(F.count("*").alias("frame_count"), F.round(hits / (F.count("*") * len(sides)), 3).alias("wrist_measured_fraction"))


def tracked_fraction(frames: DataFrame, key: str, tracked: Column) -> DataFrame:
    return frames.groupBy(key).agg((F.count_if(tracked) / F.greatest(F.count("*"), F.lit(1))).alias("tracked_fraction"))


def provenance_counts(joints: DataFrame, key: str, provenance: str) -> DataFrame:
    return joints.groupBy(key, provenance).agg(F.count("*").alias("n"))


def labelling_cost(calls: DataFrame, key: str, per_frame: float, tokens: Column, per_token: float) -> DataFrame:
    """Dollars of a recording's labelled frames: a price a frame and one a token."""
    return calls.groupBy(key).agg(F.count("*").alias("frames"), F.sum(tokens).alias("tokens"), (F.count("*") * per_frame + F.sum(tokens) * per_token).alias("cost_usd"))


def detection_rate(attempts: DataFrame, key: str, found: Column) -> DataFrame:
    return attempts.groupBy(key).agg(F.count_if(found).alias("detected"), F.count("*").alias("attempted"), F.round(F.count_if(found) / F.greatest(F.count("*"), F.lit(1)), 3).alias("detection_rate"))


def corpus_totals(recordings: DataFrame, frames: DataFrame, key: str, seconds: str) -> DataFrame:
    """One row: episodes (recordings with frames), their frames and hours. frames: a row a recording with `frame_count`."""
    both = frames.join(recordings.select(key, seconds), key, "left")
    return both.agg(F.count("*").alias("episodes"), F.coalesce(F.sum("frame_count"), F.lit(0)).alias("frames"), (F.coalesce(F.sum(seconds), F.lit(0)).cast("double") / 3600).alias("hours"))


def sweep_best(runs: DataFrame, name: str, rate: str, error: str) -> DataFrame:
    """The configuration with the highest detection rate (to three places), the least error on ties, then the first by name."""
    return runs.orderBy(F.desc(F.round(rate, 3)), error, name).limit(1)


def joints_by_error(samples: DataFrame, errors: str, joint_names: Sequence[str]) -> DataFrame:
    """Mean error of each joint, worst first."""
    rows = samples.select(F.posexplode(errors).alias("k", "error")).groupBy("k").agg(F.avg("error").alias("mean_error"), F.count("*").alias("n"))
    return rows.select(F.element_at(F.array(*map(F.lit, joint_names)), F.col("k") + 1).alias("joint"), "mean_error", "n").orderBy(F.desc("mean_error"), "joint")


def best_match(predicted: DataFrame, truth: DataFrame, image: str, error: Callable[[str, str], Column], points: str = "points") -> DataFrame:
    """Each prediction (image, prediction_id, points) with the truth of its image (truth_id) that has the least mean error.

    An image holds a few hands; predictions of images without a truth are left out.
    """
    pairs = predicted.join(truth.withColumnRenamed(points, "__truth"), image).withColumn("error", error(points, "__truth"))
    best = F.min_by(F.struct("truth_id", "error"), F.struct("error", "truth_id"))
    return pairs.groupBy(image, "prediction_id").agg(best.alias("m")).select(image, "prediction_id", "m.truth_id", "m.error")


def best_aligned_match(predicted: DataFrame, truth: DataFrame, image: str, points: str = "points", root: int = 0) -> DataFrame:
    """Each prediction (image, prediction_id, points) with the truth of its image (truth_id) that is nearest after similarity alignment.

    Gives truth_id, pa_error and root_error (mean distances after the alignment, and after shifting joint `root` onto the other's), pa_errors and root_errors
    (by joint). An image holds a few hands; predictions of images without a truth that can be aligned are left out. Equal errors: the least truth_id.
    """
    mean = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / F.size(e)
    pairs = predicted.select(image, "prediction_id", points).join(truth.select(image, "truth_id", F.col(points).alias("__truth")), image)
    errors = aligned_errors(pairs, points, "__truth").where("pa_errors is not null")
    scored = errors.withColumn("pa_error", mean("pa_errors")).withColumn("root_errors", root_aligned_errors(F.col(points), F.col("__truth"), root))
    kept = ("truth_id", "pa_error", "pa_errors", "root_errors")
    best = scored.groupBy(image, "prediction_id").agg(F.min_by(F.struct(*kept), F.struct("pa_error", "truth_id")).alias("m")).select(image, "prediction_id", "m.*")
    return best.withColumn("root_error", mean("root_errors"))


def without_self_tests(runs: DataFrame, dataset: str, excluded: Sequence[str] = ("synthetic-selftest",)) -> DataFrame:
    """Runs on real data; a null dataset is no self-test."""
    return runs.where(F.coalesce(~F.col(dataset).isin(*excluded), F.lit(True)))


def ready(recordings: DataFrame, status: str = "status", states: Sequence[str] = ("processed",)) -> DataFrame:
    return recordings.where(F.col(status).isin(*states))


def union_of_logs(*logs: DataFrame) -> DataFrame:
    """All rows of logs whose columns differ; missing ones are null."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def union_of_boxes(frames: DataFrame, *boxes: str) -> DataFrame:
    """A frame's boxes of all kinds in one array; null arrays are empty."""
    empty = F.array().cast(frames.schema[boxes[0]].dataType)
    return frames.withColumn("boxes", F.concat(*(F.coalesce(F.col(b), empty) for b in boxes)))


def listing(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of columns, sorted."""
    return df.select(*columns).distinct().orderBy(*columns)


def raw_to_delete(recordings: DataFrame, raw: str = "raw_key", status: str = "status") -> DataFrame:
    """Uploads that retention may delete: those of recordings that are through, never of failed ones."""
    return recordings.where((F.col(status) == "processed") & F.col(raw).isNotNull()).select("id", raw)
