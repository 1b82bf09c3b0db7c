import pytest
from pyspark.sql import functions as F

from gazeloom.operators import folds, rollups, sequence


def frames(spark, tasks, key="v"):
    return spark.createDataFrame([(key, float(i), t, 0.5 + i / 10, f"d{i}" if i != 1 else "") for i, t in enumerate(tasks)], "video string, ts double, task string, conf double, note string")


def test_islands_then_merge(spark):
    runs = sequence.islands(frames(spark, "TTTITT"), "video", "ts", "task", duration=F.lit(6.0), confidence="conf", description="note")
    got = [(r.task, r.start, r.end) for r in runs.orderBy("start").collect()]
    assert got == [("T", 0, 3), ("I", 3, 4), ("T", 4, 6)]
    merged = folds.merge_short(runs.select("video", "task", "start", "end"), "video", 1.5).orderBy("start").collect()
    assert [(r.task, r.start, r.end) for r in merged] == [("T", 0, 4), ("T", 4, 6)]


def test_gap_fill_stops_at_long_gaps_and_ends(spark):
    rows = [("v", 0.0, None), ("v", 100.0, [[1.0, 2.0]]), ("v", 200.0, None), ("v", 300.0, [[3.0, 6.0]]), ("v", 400.0, None), ("v", 900.0, [[0.0, 0.0]]), ("v", 950.0, None)]
    df = spark.createDataFrame(rows, "video string, ms double, hand array<array<float>>")
    got = {r.ms: (r.hand, r.is_filled) for r in sequence.gap_fill(df, "video", "ms", "hand", max_gap=0.3, scale=0.001).collect()}
    assert got[200.0] == ([[2.0, 4.0]], True)
    assert got[0.0][0] is None and got[400.0][0] is None and got[950.0][0] is None


@pytest.mark.parametrize(("tie", "want"), [("earlier", "a"), ("later", "b")])
def test_nearest_ties(spark, tie, want):
    left = spark.createDataFrame([("v", 10.0), ("w", 1.0)], "k string, t double")
    right = spark.createDataFrame([("v", 8.0, "a"), ("v", 12.0, "b")], "k string, t double, name string")
    got = {r.k: r.nearest for r in sequence.nearest(left, right, "k", "t", ["name"], tie=tie).collect()}
    assert got["v"]["name"] == want and got["w"] is None
    assert {r.k: r.nearest for r in sequence.nearest(left, right, "k", "t", ["name"], tie=tie, tolerance=1).collect()}["v"] is None


def test_tracks_bridge_and_reject(spark):
    rows = [("v", f, 0, 10.0, 10.0, 50.0, 50.0) for f in (0, 4)] + [("w", f, 0, 10.0, 10.0, 50.0, 50.0) for f in (0, 21)]
    df = spark.createDataFrame(rows, "video string, frame int, det int, x0 double, y0 double, x1 double, y1 double")
    t = folds.track_boxes(df, "video", "frame", "det", 8)
    assert {(r.video, r.n) for r in t.groupBy("video").agg(F.count_distinct("track").alias("n")).collect()} == {("v", 1), ("w", 2)}
    box = ["x0", "y0", "x1", "y1"]
    filled = sequence.bridge_gaps(t, ["video", "track"], "frame", box, 8, 0.06).where("video = 'v'").orderBy("frame").collect()
    assert [r.frame for r in filled] == [1, 2, 3] and filled[1].x0 == pytest.approx(10 - 40 * 0.12)
    held = sequence.hold_ends(t, ["video", "track"], "frame", box, 2, 0.06, 10).where("video = 'v'")
    assert sorted(r.frame for r in held.collect()) == [5, 6]


def test_one_euro_resets_and_follows():
    out = folds.one_euro([[[0.0, 0.0]], [[1.0, 0.0]], None, [[5.0, 5.0]]], [0, 100, 200, 300])
    assert out[0] == [[0.0, 0.0]] and 0 < out[1][0][0] < 1 and out[2] is None and out[3] == [[5.0, 5.0]]


def test_open_segments_compare_with_the_first(spark):
    df = spark.createDataFrame([("v", 0.0, "lifts a box", 1.0, "x"), ("v", 1.0, "lifts a bag", 0.5, "longer"), ("v", 2.0, "drives away now", 1.0, "z")], "video string, t double, label string, conf double, note string")
    got = folds.open_segments(df, "video", "t", "label", "conf", "note").orderBy("start").collect()
    assert [(r.start, r.end, r.label, r.confidence, r.description) for r in got] == [(0, 2, "lifts a box", 0.75, "longer"), (2, 3, "drives away now", 1.0, "z")]


def test_groups_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(20).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
        out = folds.by_recording(df, "k", lambda rows: rows.head(1).assign(n=len(rows))[["k", "n"]], "k long, n long")
        assert sorted(map(tuple, out.collect())) == [(0, 10), (1, 10)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_overview_of_an_unknown_operator_is_zero(spark):
    v = spark.createDataFrame([("a", "op", 10.0)], "id string, operator_id string, duration_seconds double")
    e = spark.createDataFrame([("a", "service", 5.0), ("a", "downtime", 40.0)], "video_id string, type string, duration_seconds double")
    r = rollups.operator_overview(v, e, "nobody").first()
    assert (r.video_count, r.service_event_count, r.downtime_seconds) == (0, 0, 0)
    assert rollups.operator_overview(v, e).first().downtime_seconds == 40


def test_summary_matches_the_worked_case(spark):
    e = spark.createDataFrame([("v", "transit", 5.0), ("v", "service", 15.0), ("v", "downtime", 40.0), ("v", "contamination", 10.0)], "video string, type string, seconds double")
    r = rollups.recording_summary(e, "video").first()
    assert (r.event_count, r.service_event_count, r.downtime_seconds, r.contamination_event_count) == (4, 1, 40, 1)
