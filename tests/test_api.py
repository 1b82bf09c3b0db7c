import io
import zipfile

from gazeloom.api import Engine


def test_from_labels_to_overview(spark, tmp_path):
    root = str(tmp_path)
    videos = [("v1", "route.mov", "op", "Maple", 70.0), ("v2", "b.mov", "op", "", 5.0)]
    spark.createDataFrame(videos, "id string, original_filename string, operator_id string, property_tag string, duration_seconds double").selectExpr("*", "timestamp'2024-01-01' as uploaded_at").write.parquet(f"{root}/videos")
    tasks = ["transit/walking"] * 5 + ["moving container"] * 15 + ["idle/waiting"] * 40 + ["handling overflow/contamination"] * 10
    labels = spark.createDataFrame([("v1", float(i), t, 0.9, f"sees {t}") for i, t in enumerate(tasks)], "video_id string, ts double, task string, confidence double, description string")
    e = Engine(spark, root)
    segments = e.run_segments(labels)
    e.run_events(segments).write.parquet(f"{root}/events")
    segments.selectExpr("video_id", "start as start_time", "end as end_time", "label as task_label", "confidence", "description").write.parquet(f"{root}/segments")
    r = e.video_summary("v1").first()
    assert (r.event_count, r.service_event_count, r.downtime_seconds, r.contamination_event_count) == (4, 1, 40, 1)
    assert {(x.site, x.videos) for x in e.per_property().collect()} == {("Maple", 1), ("(untagged)", 1)}
    assert e.overview("op").first().video_count == 2
    context = e.build_context("v1").first().context
    assert "00:05–00:20: sees moving container" in context
    assert e.answer("what?", lambda c, q: str(len(c) > 0))["answer"] == "True"
    assert "events.json" in zipfile.ZipFile(io.BytesIO(e.export_bundle("v1"))).namelist()
    assert [t.count() for t in e.delete("v1")] == [1, 0, 0]


def test_answer_reads_all_videos(spark, tmp_path):
    rows = [(f"v{k:03}", 0.0, 1.0, "idle/waiting", 0.9, f"sees thing {k:03}") for k in range(120)]
    spark.createDataFrame(rows, "video_id string, start_time double, end_time double, task_label string, confidence double, description string").write.parquet(f"{tmp_path}/segments")
    prompts = []
    e = Engine(spark, str(tmp_path))
    found = e.answer("what?", lambda c, q: prompts.append(c) or c, most=50)
    assert found["videos"] == 120 and all(f"sees thing {k:03}" in found["answer"] for k in range(120))
    assert [p.count("sees thing") for p in prompts] == [50, 50, 20, 120]
    assert e.answer("what?", lambda c, q: c, most=1)["answer"].count("sees thing") == 120
