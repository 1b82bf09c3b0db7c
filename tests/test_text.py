import pytest
from pyspark.sql import functions as F

from gazeloom.functions import text


def one(spark, column, **values):
    names = list(values)
    ddl = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(("label", "seconds", "kind"), [
    ("moving container", 5.0, "service"), ("loading/unloading", 5.0, "service"), ("handling overflow/contamination", 5.0, "contamination"), ("idle/waiting", 10.0, "idle"),
    ("idle/waiting", 45.0, "downtime"), ("idle/waiting", 30.0, "downtime"), ("transit/walking", 5.0, "transit"), ("approaching property", 5.0, "transit"), ("Understanding a map", 5.0, "idle"), ("sorting parts", 99.0, "task"),
])
def test_event_type(spark, label, seconds, kind):
    assert one(spark, text.event_type, a=label, b=seconds) == kind


@pytest.mark.parametrize(("said", "task"), [
    ("idle/waiting", "idle/waiting"), ("the worker is moving a container", "moving container"), ("opening a gate", "opening gate/enclosure"), ("manipulating a latch", "manipulating lock or latch"),
    ("walking down the street", "transit/walking"), ("peeling an orange", None), ("   ", None),
])
def test_taxonomy(spark, said, task):
    assert one(spark, text.match_taxonomy, a=said) == task


def test_parse_label(spark):
    r = one(spark, text.parse_label, a='Sure: {"task": "loading/unloading", "confidence": "0.8", "description": " lifts a box "}')
    assert (r.task, r.confidence, r.description) == ("loading/unloading", 0.8, "lifts a box")
    r = one(spark, text.parse_label, a="no idea, walking maybe")
    assert (r.task, r.confidence) == ("transit/walking", 0.3)
    r = one(spark, text.parse_label, a="{broken")
    assert (r.task, r.confidence) == ("idle/waiting", 0.3)


def test_activity_similarity_clock(spark):
    assert one(spark, text.derive_activity, a="The person is lifting a heavy box onto the truck bed") == "lifting heavy box onto"
    assert one(spark, text.derive_activity, a="it is") == "activity"
    assert one(spark, text.similar, a="lifts a box", b="lifts the box") is True
    assert one(spark, text.similar, a="", b="box") is False
    assert one(spark, text.clock, a=6119.9) == "101:59"
    assert one(spark, text.humanize_seconds, a=3725.0) == "1h 2m"
    assert one(spark, text.humanize_bytes, a=1536.0) == "1.5 KB"
    assert one(spark, text.parse_score, a='{"score": 0.7, "reason": "near"}').score == 0.5
    assert one(spark, text.parse_score, a="nothing").reason == "unparseable judge reply"
    assert one(spark, text.clean_scene, a=' "Car service." \nmore') == "Car service"
    assert one(spark, text.label_color, a="unknown") == "#64748b"


def matched(value):
    """The rules of match_taxonomy in plain Python, over the whole value."""
    v = (value or "").strip(" ").lower()
    if not v:
        return None
    exact = [t for t in text.TAXONOMY if v == t]
    loose = [t for t in text.TAXONOMY if t in v or v in t]
    words = [t for k, t in text.TAXONOMY_KEYWORDS if k in v]
    return next(iter(exact + loose + words), None)


def test_taxonomy_of_whole_texts(spark, tmp_path):
    from gazeloom.plans.queries import QUERIES

    # what decides comes after character 400, or a later label goes before an earlier keyword
    said = [None, "", "  ", "peeling an orange", "x" * 400 + " latch", "x" * 398 + "latch", "walk " + "y" * 900 + " moving container", "z" * 5000 + " Idle/Waiting", " " * 500 + "gate", "o" * 1000]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.task for r in QUERIES["taxonomy_match_whole"](spark, str(tmp_path)).collect()}
    assert found == {k: matched(v) for k, v in enumerate(said)}
    assert found[4] == found[5] == "manipulating lock or latch" and found[6] == "moving container" and found[8] == "opening gate/enclosure"


def test_money_rounds_the_binary_value(spark):
    # 1.15 and 9.995 lie below the half, 1.25 and 0.125 on it; the page's toFixed takes that up, C's printf to the even digit
    cases = [
        (1150.0, "$1.1k", "$1.1k"), (9.995, "$9.99", "$9.99"), (1250.0, "$1.3k", "$1.2k"), (1750.0, "$1.8k", "$1.8k"), (0.125, "$0.13", "$0.12"), (-0.125, "$-0.13", "$-0.12"),
        (9950.0, "$9.9k", "$9.9k"), (9999.0, "$10.0k", "$10.0k"), (10500.0, "$11k", "$11k"), (10.5, "$11", "$11"), (999.5, "$1000", "$1000"), (-20000.0, "$-20000.00", "$-20000.00"), (None, None, None),
    ]
    df = spark.createDataFrame([(x,) for x, *_ in cases], "x double").select("x", text.money(F.col("x")).alias("up"), text.money(F.col("x"), even=True).alias("even"))
    assert [tuple(r) for r in df.collect()] == cases


def test_money_format_equals_sql_at_halves(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from gazeloom.plans.queries import QUERIES, SQL

    # every price whose seventh lies at a half of the last digit shown, its neighbours, and no price
    prices = [c / 200 * 7 + d for c in range(-400, 2001) for d in (-0.01, 0, 0.01)] + [c * 50.0 * 7 + d for c in range(20, 400) for d in (-0.01, 0, 0.01)] + [None]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    found = {r.o_orderkey: r.shown for r in QUERIES["money_format"](spark, str(tmp_path)).collect()}
    assert found == dict(con.execute(SQL["money_format"]).fetchall()) and len(found) == len(prices)
