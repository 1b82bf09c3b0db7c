"""Rollups and quality metrics: partial aggregates by recording, operator, site or label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNTAGGED = "(untagged)"


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def seconds_by(events: DataFrame, key: str, label: str, seconds: str) -> DataFrame:
    return events.groupBy(key, label).agg(F.sum(seconds).alias("seconds"))


def seconds_map(events: DataFrame, key: str, label: str, seconds: str) -> DataFrame:
    """One row a key with a map from label to seconds."""
    per = seconds_by(events, key, label, seconds)
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "seconds")))).alias("time_per_label"))


def recording_summary(events: DataFrame, key: str, kind: str = "type", seconds: str = "seconds") -> DataFrame:
    k, s = F.col(kind), F.col(seconds)
    zero = F.lit(0).cast(events.schema[seconds].dataType)

    def total(*kinds: str) -> Column:
        return F.sum(F.when(k.isin(*kinds), s).otherwise(zero))

    return events.groupBy(key).agg(
        F.count("*").alias("event_count"), F.sum(s).alias("total_seconds"), F.count_if(k == "service").alias("service_event_count"), total("service").alias("service_seconds"),
        total("idle", "downtime").alias("idle_seconds"), total("downtime").alias("downtime_seconds"), F.count_if(k == "downtime").alias("downtime_event_count"), F.count_if(k == "contamination").alias("contamination_event_count"),
    )


def operator_overview(recordings: DataFrame, events: DataFrame, operator: str | None = None) -> DataFrame:
    """One row of totals. Recordings and events are summed apart; events of other operators don't count, even if none match."""
    if operator is not None:
        recordings = recordings.where(F.col("operator_id") == operator)
    own = events.join(recordings.select(F.col("id").alias("video_id")), "video_id", "left_semi")
    a = recordings.agg(F.count("*").alias("video_count"), F.round(F.coalesce(F.sum(F.coalesce("duration_seconds", F.lit(0))), F.lit(0)) / 3600, 3).alias("hours"))
    k = F.col("type")
    b = own.agg(
        F.count_if(k == "service").alias("service_event_count"), F.coalesce(F.sum(F.when(k == "downtime", F.col("duration_seconds"))), F.lit(0.0)).alias("downtime_seconds"), F.count_if(k == "contamination").alias("contamination_event_count"),
    )
    return a.crossJoin(b)  # one row each


def site(tag: Column) -> Column:
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit(UNTAGGED))


def active_seconds(frames: DataFrame, key: str, time_ms: str, hands: Sequence[str], default_interval: float = 0.1) -> DataFrame:
    """Frames with a hand times the mean sampling interval. An empty landmark list is no hand."""
    any_hand = F.lit(False)
    for h in hands:
        any_hand = any_hand | (F.coalesce(F.size(h), F.lit(0)) > 0)
    n = F.count(time_ms)
    interval = F.when(n < 2, F.lit(default_interval)).otherwise((F.max(time_ms) - F.min(time_ms)) / 1000.0 / F.nullif(n - 1, F.lit(0)))
    return frames.groupBy(key).agg((F.count_if(any_hand) * F.coalesce(interval, F.lit(default_interval))).alias("active_seconds"), F.count_if(any_hand).alias("frames_with_hand"), F.count("*").alias("sampled"))


def coverage(frames: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Share of a key's frames for which each flag holds; 0 for none."""
    return frames.groupBy(key).agg(F.count("*").alias("frames"), *[F.round(F.coalesce(ratio(F.count_if(c), F.count("*")), F.lit(0.0)), 4).alias(n) for n, c in flags.items()])


def track_stats(detections: DataFrame, key: str, track: str, frame: str, strong: str) -> DataFrame:
    per = detections.groupBy(key, track).agg(F.bool_or(strong).alias("confirmed"), F.count("*").alias("n"), F.collect_set(frame).alias("frames"))
    out = per.groupBy(key).agg(F.count_if("confirmed").alias("confirmed_tracks"), F.count_if(~F.col("confirmed")).alias("rejected_tracks"), F.count("*").alias("total_tracks"), F.sum(F.when(F.col("confirmed"), F.col("n")).otherwise(0)).alias("confirmed_detections"))
    frames = per.where("confirmed").select(key, F.explode("frames").alias("f")).groupBy(key).agg(F.count_distinct("f").alias("frames_with_confirmed_detection"))
    return out.join(frames, key, "left").fillna(0, ["frames_with_confirmed_detection"])


def orientation_vote(detections: DataFrame, key: str, rotation: str, score: str, strong: str, least: float = 1.0) -> DataFrame:
    """The rotation with the most strong score, the smaller on a tie; none below the threshold."""
    per = detections.where(strong).groupBy(key, rotation).agg(F.sum(score).alias("votes"))
    best = per.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), rotation))).where("__k = 1")
    return best.where(F.col("votes") >= least).drop("__k")


def effective_rotation(content: Column, metadata: Column, fallback: int = 0) -> Column:
    return F.coalesce(content, F.nullif(metadata, F.lit(0)), F.lit(fallback % 360))


def mode_first_seen(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """A key's commonest label; of equally common ones, the first seen."""
    per = df.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return per.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first_seen"))).where("__k = 1").drop("__k")


def longest_first(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.char_length(text)), order))).where("__k = 1").drop("__k")


def vector_stats(df: DataFrame, vector: str) -> DataFrame:
    """Per component: count, mean, population deviation, least, most; merged from partial sums."""
    parts = df.select(F.posexplode(vector).alias("component", "v")).withColumn("v", F.col("v").cast("double"))
    return parts.groupBy("component").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


def privacy_metrics(labels: DataFrame, key: str, face: Column, hidden: Column, hand_only: Column, leak_pii: Column, pii: Column) -> DataFrame:
    """Recall, false-blur rate and PII miss rate of each key and, in the row with a null key, over all; null where nothing is labelled."""
    return labels.rollup(key).agg(
        (1 - ratio(F.count_if(face & ~hidden), F.nullif(F.count_if(face), F.lit(0)))).alias("recall"),
        ratio(F.count_if(hand_only & hidden), F.nullif(F.count_if(hand_only), F.lit(0))).alias("false_blur_rate"),
        ratio(F.count_if(leak_pii), F.nullif(F.count_if(pii), F.lit(0))).alias("pii_miss_rate"),
        F.grouping(key).cast("int").alias("overall"),
    )


def leak_rate(labelled: DataFrame, blurred: DataFrame, key: str, frame: str) -> DataFrame:
    """Labelled frames within the clip that aren't blurred, over all labelled ones. labelled has `total` frames of the clip."""
    hit = labelled.join(blurred.select(key, frame).distinct().withColumn("__b", F.lit(True)), [key, frame], "left")
    leak = (F.col(frame) < F.col("total")) & F.col("__b").isNull()
    return hit.groupBy(key).agg(F.count_if(leak).alias("leaks"), F.count("*").alias("labelled"), ratio(F.count_if(leak), F.count("*")).alias("leak_rate"))


def caption_accuracy(items: DataFrame, category: str, score: str, reference: str) -> DataFrame:
    """Mean score and count of annotated items by category and overall (overall = 1)."""
    items = items.where(F.trim(F.coalesce(reference, F.lit(""))) != "").withColumn("category", F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("uncategorized")))
    return items.rollup("category").agg(F.avg(score).alias("accuracy"), F.count("*").alias("n"), F.grouping("category").cast("int").alias("overall"))


def throughput(stages: DataFrame, footage_seconds: float) -> DataFrame:
    """Share of the whole and multiple of real time of each stage, and which is the slowest."""
    whole = Window.partitionBy(F.lit(0))
    return stages.withColumn("share", F.col("seconds") / F.sum("seconds").over(whole)).withColumn("times_realtime", ratio(F.lit(footage_seconds), F.col("seconds"))).withColumn("bottleneck", F.col("seconds") == F.max("seconds").over(whole))


#: GPU presets in dollars an hour.
GPU_PRICES = (("4090", 0.40), ("L4", 0.80), ("A10G", 1.00), ("A100", 2.50))


def cost_projection(work: DataFrame, hours: str, times_realtime: float, budget: float, prices: Sequence[tuple[str, float]] = GPU_PRICES) -> DataFrame:
    """Each row's GPU hours, cost, machines to finish in a day, and hours the budget covers, by GPU."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("gpu"), F.lit(p).alias("rate")) for n, p in prices])).alias("g")
    out = work.select("*", pairs).select(*work.columns, "g.*").withColumn("gpu_hours", F.col(hours) / times_realtime)
    return out.withColumn("cost", F.col("gpu_hours") * F.col("rate")).withColumn("machines_for_a_day", F.ceil(F.col("gpu_hours") / 24).cast("long")).withColumn("hours_in_budget", F.lit(budget) / F.col("rate") * times_realtime).withColumn("fits", F.col("cost") <= budget)


def joint_errors(samples: DataFrame, errors: str, joint_names: Sequence[str], provenance: str) -> DataFrame:
    """Mean error overall, by joint and by provenance, over pooled joints."""
    rows = samples.select(F.posexplode(errors).alias("k", "error"), provenance)
    rows = rows.withColumn("joint", F.element_at(F.array(*[F.lit(n) for n in joint_names]), F.col("k") + 1))
    return rows.groupingSets([[], ["joint"], [provenance]], "joint", provenance).agg(F.avg("error").alias("mean_error"), F.count("*").alias("n"), F.grouping_id().alias("level"))


def context_lines(segments: DataFrame, key: str, start: str, end: str, text: str, most: int = 400) -> DataFrame:
    """A key's timeline as one text: a line for each of its first segments that has one."""
    from gazeloom.functions.text import clock

    w = Window.partitionBy(key).orderBy(start)
    lines = segments.withColumn("__k", F.row_number().over(w)).where((F.col("__k") <= most) & (F.trim(text) != ""))
    line = F.concat(F.lit("    "), clock(F.col(start)), F.lit("–"), clock(F.col(end)), F.lit(": "), F.trim(text))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__k", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def video_contexts(videos: DataFrame, summaries: DataFrame, segments: DataFrame, most: int = 400) -> DataFrame:
    """id, context: each recording's header, metrics and timeline. Recordings without segments have none.

    videos: id, original_filename, property_tag, duration_seconds. summaries: video_id, active_hand_seconds, service_event_count,
    downtime_seconds, contamination_event_count. segments: video_id, start_time, end_time, description, task_label.
    """
    said = segments.withColumn("said", F.coalesce(F.nullif("description", F.lit("")), F.col("task_label"), F.lit("")))
    lines = context_lines(said, "video_id", "start_time", "end_time", "said", most).withColumnRenamed("context", "lines")
    rows = segments.select("video_id").distinct().join(videos.withColumnRenamed("id", "video_id"), "video_id").join(summaries, "video_id", "left").join(lines, "video_id", "left")
    shown = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    head = F.concat(F.lit("VIDEO ["), F.substring("video_id", 1, 8), F.lit("] file="), shown("original_filename", ""), F.lit(", property="), F.coalesce(F.nullif("property_tag", F.lit("")), F.lit("n/a")), F.lit(", duration="), F.format_string("%.0f", F.coalesce(F.col("duration_seconds"), F.lit(0)).cast("double")), F.lit("s"))
    metrics = F.concat(F.lit("  duration_active_hands="), shown("active_hand_seconds", "None"), F.lit("s, service_events="), shown("service_event_count", "0"), F.lit(", downtime="), shown("downtime_seconds", "0"), F.lit("s, contamination="), shown("contamination_event_count", "0"))
    return rows.select(F.col("video_id").alias("id"), F.concat_ws("\n", head, metrics, F.lit("  timeline (what the worker was doing):"), "lines").alias("context"))
