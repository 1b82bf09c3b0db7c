"""Operators over the driver's tables, as stand-ins for recordings.

events: user_id is a recording, ts its clock, event_id the order of frames, event_type a label,
value a measurement. orders and customers: recordings and operators; lineitem: segments and sites.
embeddings: landmark vectors. documents, conversations: descriptions. labels: human labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.functions import geometry as g
from gazeloom.functions import text
from gazeloom.operators import body, folds, metrics, rollups, sequence
from gazeloom.operators.body import EDGES, JOINTS
from gazeloom.sources.tables import table
from gazeloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, event_type, value, props and us: microseconds of ts."""
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


_EV = "e as (select *, epoch_us(ts) as us from events)"
#: A frame's label, by type of event.
LABELS = {"click": "moving container", "view": "transit/walking", "signup": "standing by the gate", "purchase": "handling overflow/contamination", "error": "idle/waiting"}
_LABEL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items()) + " else 'sorting parts' end"
_TYPE = f"""case when lab in ('moving container','opening gate/enclosure','manipulating lock or latch','loading/unloading') then 'service'
 when base = 'idle' and secs >= 30 then 'downtime' else base end"""
_BASE = """case lab when 'handling overflow/contamination' then 'contamination' when 'idle/waiting' then 'idle' when 'transit/walking' then 'transit' when 'approaching property' then 'transit'
 else case when regexp_matches(lower(lab), 'idle|wait|stand|still|pause') then 'idle' when regexp_matches(lower(lab), 'walk|transit|approach|moving') then 'transit' else 'task' end end"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    table_ = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])
    return events(spark, d).withColumn("lab", F.coalesce(table_[F.col("event_type")], F.lit("sorting parts")))


@query(f"with a as (select event_id, {_LABEL} as lab, value as secs from events), b as (select *, {_BASE} as base from a) select event_id, lab, {_TYPE} as type from b")
def event_typing(spark, d):
    return labelled(spark, d).select("event_id", "lab", text.event_type(F.col("lab"), F.col("value")).alias("type"))


_ISLANDS = f"""{_EV}, m as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as new from e window w as (partition by user_id order by us, event_id)),
 r as (select *, sum(new) over (partition by user_id order by us, event_id rows unbounded preceding) as run from m),
 i as (select user_id, run, event_type, min(us) as s, max(us) as last, count(*) as frames, avg(value) as confidence from r group by all),
 s as (select user_id, event_type, s as start, frames, confidence, coalesce(lead(s) over (partition by user_id order by run), last + 1000000) as "end" from i)"""


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    return sequence.islands(events(spark, d), "user_id", "us", "event_type", ["us", "event_id"], interval=1_000_000)


@query(f'with {_ISLANDS} select user_id, event_type, start::bigint as start, "end"::bigint as "end", frames from s')
def segment_islands(spark, d):
    return runs_of(spark, d).select("user_id", "event_type", "start", "end", "frames")


def _typed(spark, d):
    table_ = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])
    rows = runs_of(spark, d).withColumn("lab", table_[F.col("event_type")]).withColumn("us", F.col("end") - F.col("start"))
    # an hour of the table's clock stands for ten seconds
    return rows.withColumn("type", text.event_type(F.col("lab"), F.col("us") / 360_000_000.0))


_TYPED = f"{_ISLANDS}, a as (select *, \"end\" - start as dur, {_LABEL} as lab, (\"end\" - start) / 360000000.0 as secs from s), b as (select *, {_BASE} as base from a), t as (select *, {_TYPE} as type from b)"


@query(f"""with {_TYPED} select user_id, count(*) as event_count, sum(dur)::bigint as total_seconds, count(*) filter (type = 'service') as service_event_count,
 coalesce(sum(dur) filter (type = 'service'), 0)::bigint as service_seconds, coalesce(sum(dur) filter (type in ('idle','downtime')), 0)::bigint as idle_seconds, coalesce(sum(dur) filter (type = 'downtime'), 0)::bigint as downtime_seconds,
 count(*) filter (type = 'downtime') as downtime_event_count, count(*) filter (type = 'contamination') as contamination_event_count from t group by user_id""")
def video_summary(spark, d):
    return rollups.recording_summary(_typed(spark, d), "user_id", "type", "us")


@query(f"with {_TYPED} select user_id, lab, sum(dur)::bigint as seconds from t group by all")
def time_per_task(spark, d):
    return rollups.seconds_by(_typed(spark, d), "user_id", "lab", "us")


@query("""with v as (select o_orderkey from orders), x as (select count(*) as video_count, round(sum(o_totalprice::decimal(18,2))::double / 3600, 3) as hours from orders),
 y as (select count(*) filter (l_returnflag = 'N') as service_event_count, sum(case when l_returnflag = 'R' then l_quantity::decimal(18,2) else 0 end)::double as downtime_seconds, count(*) filter (l_returnflag = 'A') as contamination_event_count from lineitem where l_orderkey in (select o_orderkey from v))
 select * from x, y""")
def operator_overview(spark, d):
    recordings = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("operator_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("duration_seconds"))
    kinds = F.when(F.col("l_returnflag") == "N", "service").when(F.col("l_returnflag") == "R", "downtime").otherwise("contamination")
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), kinds.alias("type"), F.col("l_quantity").cast("decimal(18,2)").alias("duration_seconds"))
    out = rollups.operator_overview(recordings, own)
    return out.select("video_count", F.col("hours").cast("double").alias("hours"), "service_event_count", F.col("downtime_seconds").cast("double").alias("downtime_seconds"), "contamination_event_count")


@query("""select coalesce(nullif(case when l_shipdate is null or l_linestatus = 'F' then '' else l_returnflag end, ''), '(untagged)') as site, count(*) as segments, sum(l_quantity::decimal(18,2))::double as seconds from lineitem group by 1""")
def per_property(spark, d):
    tag = F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_returnflag"))
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").groupBy(rollups.site(tag).alias("site")).agg(F.count("*").alias("segments"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("seconds"))


@query("""select l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) as level, count(*) as segments, sum(l_quantity::decimal(18,2))::double as seconds from lineitem group by rollup(l_returnflag, l_linestatus)""")
def property_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg((F.grouping("l_returnflag").cast("bigint") + F.grouping("l_linestatus").cast("bigint")).alias("level"), F.count("*").alias("segments"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("seconds"))


def _near(spark, d, tie, tolerance=None):
    e = events(spark, d)
    left = e.where("event_type = 'click'").select("user_id", "us", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id"), "value")
    out = sequence.nearest(left, right, "user_id", "us", ["view_id", "value"], ["view_id"], tie, tolerance)
    return out.select("event_id", F.col("nearest.view_id").alias("view_id"), ((F.col("nearest.time") - F.col("us")) / 1e6).alias("off"))


def _near_sql(side: str, limit: str = "") -> str:
    return f"""with {_EV}, c as (select * from e where event_type = 'click'), v as (select * from e where event_type = 'view'),
 p as (select c.event_id, v.event_id as view_id, (v.us - c.us) / 1e6::double as off, row_number() over (partition by c.event_id order by abs(v.us - c.us), {side}, v.event_id) as k from c left join v using (user_id))
 select event_id, {f'case when abs(off) <= {limit} then view_id end' if limit else 'view_id'} as view_id, {f'case when abs(off) <= {limit} then off end' if limit else 'off'} as off from p where k = 1"""


@query(_near_sql("v.us"))
def nearest_asof(spark, d):
    return _near(spark, d, "earlier")


@query(_near_sql("v.us", "3600"))
def asof_tolerance(spark, d):
    return _near(spark, d, "earlier", 3_600_000_000)


@query(_near_sql("v.us desc"))
def asof_later(spark, d):
    return _near(spark, d, "later")


@query("""with c as (select * from events where event_type = 'click'), v as (select * from events where event_type = 'view'),
 p as (select c.event_id, v.event_id as view_id, row_number() over (partition by c.event_id order by abs(v.event_id - c.event_id), v.event_id) as k from c left join v on c.user_id = v.user_id and abs(v.event_id - c.event_id) <= 200)
 select event_id, view_id from p where k = 1""")
def asof_frame_number(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("frame"))
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("frame"))
    out = sequence.nearest(left, right, "user_id", "frame", [], tie="earlier", tolerance=200)
    return out.select(F.col("frame").alias("event_id"), F.col("nearest.time").alias("view_id"))


@query(f'with {_ISLANDS} select e.event_id, s.start::bigint as start, s.event_type as label from e left join s on e.user_id = s.user_id and e.us >= s.start and e.us < s."end"')
def interval_join(spark, d):
    out = sequence.interval_join(events(spark, d).select("user_id", "us", "event_id"), runs_of(spark, d), "user_id", "us", ["event_type"])
    return out.select("event_id", F.col("span.start").alias("start"), F.col("span.event_type").alias("label"))


@query(f'with {_ISLANDS} select e.event_id, s.start::bigint as start from e join s on e.user_id = s.user_id and e.us >= s.start - 600000000 and e.us < s.start + 600000000')
def overlapping_intervals(spark, d):
    spans = runs_of(spark, d).select("user_id", "start", (F.col("start") - 600_000_000).alias("a"), (F.col("start") + 600_000_000).alias("b"))
    return sequence.overlapping_intervals(events(spark, d).select("user_id", "us", "event_id"), spans, "user_id", "us", "a", "b", 3.6e9).select("event_id", "start")


@query("select event_id, (event_id / 30.0 * 1000)::double as ms from events where event_id % 3 = 0")
def stride_sample(spark, d):
    rows = sequence.stride_sample(events(spark, d), "event_id", sequence.stride(F.lit(30.0), F.lit(10.0)))
    return rows.select("event_id", (F.col("event_id") / F.lit(30.0) * 1000).alias("ms"))


@query(f"""with {_EV}, n as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as pos, count(*) over (partition by user_id) as n from e)
 select distinct event_id from n, (select unnest(generate_series(1, 12)) as i) where pos = (i * n) // 13""")
def even_sample(spark, d):
    return sequence.even_sample(events(spark, d), "user_id", ["us", "event_id"], 12).select("event_id")


@query(f"with {_EV} select user_id, event_id from e qualify row_number() over (partition by user_id order by us, event_id) <= 25")
def cap_rows(spark, d):
    return sequence.cap_rows(events(spark, d), "user_id", ["us", "event_id"], 25).select("user_id", "event_id")


@query(f"""with {_EV}, x as (select *, case when event_type = 'error' then null else value end as v from e),
 y as (select *, last_value(case when v is not null then us end ignore nulls) over a as ta, last_value(v ignore nulls) over a as va, first_value(case when v is not null then us end ignore nulls) over b as tb, first_value(v ignore nulls) over b as vb from x
  window a as (partition by user_id order by us, event_id rows between unbounded preceding and current row), b as (partition by user_id order by us, event_id rows between current row and unbounded following))
 select event_id, coalesce(v is null and ta is not null and tb is not null and tb - ta <= 36000000000, false) as is_filled,
  case when v is null and tb - ta <= 36000000000 then (1 - (us - ta)::double / (tb - ta)) * va + ((us - ta)::double / (tb - ta)) * vb else v end as value from y""")
def gap_fill_linear(spark, d):
    e = events(spark, d).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return sequence.gap_fill(e.select("user_id", "us", "event_id", "value"), "user_id", "us", "value", ["us", "event_id"], 36_000_000_000).select("event_id", "is_filled", "value")


@query(f"with {_EV} select event_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by us, event_id rows unbounded preceding) as carried from e")
def locf_carry(spark, d):
    e = events(spark, d).withColumn("seen", F.when(F.col("event_type") == "view", F.col("value")))
    return sequence.carry(e, "user_id", ["us", "event_id"], "seen", "carried").select("event_id", "carried")


_BOXES = "b as (select user_id as track, date_diff('day', date '2024-01-01', ts::date)::int as frame, min(value) as x0, min(value) as y0, min(value) + 40 as x1, min(value) + 60 as y1 from events group by all)"


def _boxes(spark, d):
    v = F.min("value")
    return events(spark, d).groupBy(F.col("user_id").alias("track"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("frame")).agg(v.alias("x0"), v.alias("y0"), (v + 40).alias("x1"), (v + 60).alias("y1"))


@query(f"""with {_BOXES}, n as (select *, lead(frame) over w as nf, lead(x0) over w as a, lead(y0) over w as b, lead(x1) over w as c, lead(y1) over w as dd from b window w as (partition by track order by frame)),
 f as (select *, unnest(generate_series(frame + 1, nf - 1)) as f from n where nf - frame > 1 and nf - frame <= 8),
 i as (select track, f::int as frame, (f - frame)::double / (nf - frame) as t, least(0.5::double, least(f - frame, nf - f) * 0.06::double) as gr, x0 + (a - x0) * t as p, y0 + (b - y0) * t as q, x1 + (c - x1) * t as r, y1 + (dd - y1) * t as s from f)
 select track, frame, p - (r - p) * gr as x0, q - (s - q) * gr as y0, r + (r - p) * gr as x1, s + (s - q) * gr as y1 from i""")
def gap_expand(spark, d):
    return sequence.bridge_gaps(_boxes(spark, d), ["track"], "frame", ["x0", "y0", "x1", "y1"], 8, 0.06)


@query(f"""with {_BOXES}, e as (select track, min(frame) as fa, max(frame) as fb, arg_min(x0, frame) as ax, arg_max(x0, frame) as bx from b group by track),
 h as (select track, (fa - k)::int as frame, ax as x, least(0.5::double, k * 0.06::double) as gr from e, (select unnest(generate_series(1, 4)) as k) union all select track, (fb + k)::int, bx, least(0.5::double, k * 0.06::double) from e, (select unnest(generate_series(1, 4)) as k))
 select track, frame, x - 40 * gr as x0, x - 60 * gr as y0, x + 40 + 40 * gr as x1, x + 60 + 60 * gr as y1 from h where frame >= 0 and frame < 32""")
def hold_ends(spark, d):
    return sequence.hold_ends(_boxes(spark, d), ["track"], "frame", ["x0", "y0", "x1", "y1"], 4, 0.06, 32)


@query(f"""with {_EV} select user_id, (count(*) filter (event_type = 'click'))  * (case when count(*) < 2 then 0.1::double else (max(us) - min(us)) / 1000.0::double / 1000.0::double / (count(*) - 1) end) as active_seconds,
 count(*) filter (event_type = 'click') as frames_with_hand, count(*) as sampled from e group by user_id""")
def active_seconds(spark, d):
    e = events(spark, d).withColumn("ms", F.col("us") / 1000.0).withColumn("hand", F.when(F.col("event_type") == "click", F.array("value")).otherwise(F.array().cast("array<double>")))
    return rollups.active_seconds(e, "user_id", "ms", ["hand"])


@query("select user_id, count(*) as frames, round((count(*) filter (event_type = 'click'))::double / count(*), 4) as any_hand, round((count(*) filter (value > 50))::double / count(*), 4) as confirmed from events group by user_id")
def coverage(spark, d):
    return rollups.coverage(events(spark, d), "user_id", {"any_hand": F.col("event_type") == "click", "confirmed": F.col("value") > 50})


@query("""with p as (select user_id, event_type, bool_or(value > 90) as c, count(*) as n from events group by all), f as (select user_id, count(distinct ts::date) as n from events join p using (user_id, event_type) where c group by 1)
 select user_id, count(*) filter (c) as confirmed_tracks, count(*) filter (not c) as rejected_tracks, count(*) as total_tracks, sum(case when c then p.n else 0 end)::bigint as confirmed_detections, coalesce(any_value(f.n), 0) as frames_with_confirmed_detection from p left join f using (user_id) group by user_id""")
def track_stats(spark, d):
    e = events(spark, d).select("user_id", "event_type", F.to_date("ts").alias("frame"), (F.col("value") > 90).alias("strong"))
    return rollups.track_stats(e, "user_id", "event_type", "frame", "strong")


@query("""with p as (select user_id, (event_id % 4 * 90)::bigint as rotation, sum(value::decimal(18,4))::double as votes from events where value > 40 group by all)
 select user_id, rotation, votes from p where votes >= 1 qualify row_number() over (partition by user_id order by votes desc, rotation) = 1""")
def orientation_vote(spark, d):
    e = events(spark, d).select("user_id", (F.col("event_id") % 4 * 90).alias("rotation"), F.col("value").cast("decimal(18,4)").alias("score"), (F.col("value") > 40).alias("strong"))
    return rollups.orientation_vote(e, "user_id", "rotation", "score", "strong").select("user_id", "rotation", F.col("votes").cast("double").alias("votes"))


@query("""with c as (select user_id, event_type, count(*) as n, min(event_id) as first_seen from events group by all) select user_id, event_type, n, first_seen from c qualify row_number() over (partition by user_id order by n desc, first_seen) = 1""")
def mode_first_seen(spark, d):
    return rollups.mode_first_seen(events(spark, d), "user_id", "event_type", "event_id")


@query("select conv_id, turn, text from conversations qualify row_number() over (partition by conv_id order by length(text) desc, turn) = 1")
def longest_text(spark, d):
    return rollups.longest_first(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "text", "turn")


@query("""with u as (select generate_subscripts(embedding, 1) - 1 as component, unnest(embedding)::double as v from embeddings)
 select component::int as component, count(v) as n, avg(v) as mean, stddev_pop(v) as std, min(v) as least, max(v) as most from u group by 1""")
def vector_stats(spark, d):
    return rollups.vector_stats(table(spark, d, "embeddings"), "embedding")


@query("""with p as (select a.vec_id, a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
 s as (select vec_id, list_transform(generate_series(1, 63, 3), lambda i: [x[i] - x[1], x[i+1] - x[2], x[i+2] - x[3]]) as p, list_transform(generate_series(1, 63, 3), lambda i: [y[i] - y[1], y[i+1] - y[2], y[i+2] - y[3]]) as q from p)
 select vec_id, list_sum(list_transform(generate_series(1, 21), lambda i: sqrt((p[i][1]::double - q[i][1]::double) ** 2 + (p[i][2]::double - q[i][2]::double) ** 2 + (p[i][3]::double - q[i][3]::double) ** 2))) / 21 as mpjpe from s""")
def root_align(spark, d):
    e = table(spark, d, "embeddings")
    hand = F.transform(F.sequence(F.lit(1), F.lit(61), F.lit(3)), lambda i: F.array(*[F.element_at("embedding", i.cast("int") + k) for k in range(3)]))
    h = e.select("vec_id", hand.alias("p"))
    moved = F.transform("p", lambda x: F.zip_with(x, F.col("p")[0], lambda a, b: a - b))
    h = h.select("vec_id", F.transform(moved, lambda x: F.transform(x, lambda v: v.cast("double"))).alias("p"))
    pairs = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    errors = g.root_aligned_errors(F.col("p"), F.col("q"))
    return pairs.select("vec_id", (F.aggregate(errors, F.lit(0.0), lambda s, x: s + x) / 21).alias("mpjpe"))


_LB = "b as (select l_orderkey as k, l_linenumber as n, l_quantity as x0, l_discount * 100 as y0, l_quantity + 10 as x1, l_discount * 100 + 5 as y1 from lineitem)"


def _line_boxes(spark, d):
    q, s = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), q.alias("x0"), s.alias("y0"), (q + 10).alias("x1"), (s + 5).alias("y1"))


@query(f"""with {_LB}, p as (select a.k, a.n, b.n as m, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) as w, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as h from b a join b on a.k = b.k and a.n < b.n)
 select k, n, m, case when w * h > 0 then w * h / (100 - w * h) else 0 end as iou from p""")
def box_iou(spark, d):
    b = _line_boxes(spark, d)
    a, o = b.alias("a"), b.alias("b")
    pairs = a.join(o, (F.col("a.k") == F.col("b.k")) & (F.col("a.n") < F.col("b.n")))
    return pairs.select(F.col("a.k").alias("k"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), g.iou(g.box("a"), g.box("b")).alias("iou"))


@query(f"with {_LB} select a.k, a.n from b a where not exists (select 1 from b where b.k = a.k and b.n <> a.n and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1)")
def overlap_antijoin(spark, d):
    b = _line_boxes(spark, d)
    hit = (F.col("a.k") == F.col("b.k")) & (F.col("a.n") != F.col("b.n")) & g.overlaps(g.box("a"), g.box("b"))
    return b.alias("a").join(b.alias("b"), hit, "left_anti").select("k", "n")


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"select doc_id, coalesce(nullif(array_to_string(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: not list_contains([{_STOP}], w) and length(w) > 2), 1, 4), ' '), ''), 'activity') as activity from documents")
def text_activity(spark, d):
    return table(spark, d, "documents").select("doc_id", text.derive_activity(F.col("text")).alias("activity"))


@query(r"""with t as (select conv_id, turn, text, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as w from conversations),
 p as (select a.conv_id, a.turn, a.text as x, b.text as y, a.w as v, b.w as u, len(list_intersect(a.w, b.w)) as i from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
 select conv_id, turn, case when len(v) = 0 or len(u) = 0 then x = y else i / (len(v) + len(u) - i) >= 0.34::double or i >= 2 end as alike from p""")
def similar_neighbours(spark, d):
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", text.similar(F.col("text"), F.col("after")).alias("alike"))


_TAX = ", ".join(f"case when v = '{t}' then '{t}' end" for t in text.TAXONOMY) + ", " + ", ".join(f"case when contains(v, '{t}') or contains('{t}', v) then '{t}' end" for t in text.TAXONOMY) + ", " + ", ".join(f"case when contains(v, '{k}') then '{t}' end" for k, t in text.TAXONOMY_KEYWORDS)


_MATCHED = f"with x as (select doc_id, lower(trim(text)) as v from documents) select doc_id, case when v <> '' then coalesce({_TAX}) end as task from x"


@query(_MATCHED)
def taxonomy_match(spark, d):
    return table(spark, d, "documents").select("doc_id", text.match_taxonomy(F.col("text")).alias("task"))


@query(_MATCHED)
def taxonomy_match_whole(spark, d):
    """The same under its earlier name."""
    return taxonomy_match(spark, d)


@query("with x as (select event_id, floor(value * 97)::int as s from events) select event_id, printf('%02d:%02d', s // 60, s % 60) as clock from x")
def clock_format(spark, d):
    return events(spark, d).select("event_id", text.clock(F.col("value") * 97).alias("clock"))


@query("""with x as (select conv_id, turn, text from conversations where trim(text) <> '' and turn < 400)
 select conv_id, string_agg(printf('    %02d:%02d–%02d:%02d: %s', turn * 7 // 60, turn * 7 % 60, (turn * 7 + 7) // 60, (turn * 7 + 7) % 60, trim(text)), chr(10) order by turn) as context from x group by 1""")
def chat_context(spark, d):
    c = table(spark, d, "conversations").withColumn("s", F.col("turn") * 7).withColumn("e", F.col("turn") * 7 + 7)
    return rollups.context_lines(c, "conv_id", "s", "e", "text")


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.5::double) as k from events")
def json_parse(spark, d):
    e = events(spark, d)
    return e.select("event_id", F.coalesce(F.from_json("props", "k string")["k"].try_cast("double"), F.lit(0.5)).alias("k"))


@query("""select d.source, grouping(d.source)::int as overall, 1 - (count(*) filter (l.toxic = 1 and d.n_chars < 900))::double / nullif(count(*) filter (l.toxic = 1), 0) as recall,
 (count(*) filter (l.toxic = 0 and l.quality = 0 and d.n_chars >= 900))::double / nullif(count(*) filter (l.toxic = 0 and l.quality = 0), 0) as false_blur_rate,
 (count(*) filter (l.quality = 0 and d.n_chars < 2000))::double / nullif(count(*) filter (l.quality = 0), 0) as pii_miss_rate from labels l join documents d using (doc_id) group by rollup(d.source)""")
def privacy_recall(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "source", "n_chars"), "doc_id")
    toxic, poor, n = F.col("toxic") == 1, F.col("quality") == 0, F.col("n_chars")
    return rollups.privacy_metrics(rows, "source", toxic, n >= 900, ~toxic & poor, poor & (n < 2000), poor).withColumn("false_blur_rate", F.col("false_blur_rate"))


@query("""with l as (select user_id, event_id % 97 as frame, 90 as total from events where event_type = 'error'), b as (select distinct user_id, event_id % 97 as frame from events where event_type = 'view')
 select user_id, count(*) filter (l.frame < total and b.frame is null) as leaks, count(*) as labelled, (count(*) filter (l.frame < total and b.frame is null))::double / count(*) as leak_rate from l left join b using (user_id, frame) group by 1""")
def leak_rate(spark, d):
    e = events(spark, d).withColumn("frame", F.col("event_id") % 97)
    return rollups.leak_rate(e.where("event_type = 'error'").withColumn("total", F.lit(90)), e.where("event_type = 'view'"), "user_id", "frame")


@query("""select case when lang = 'es' then 'uncategorized' else lang end as category, grouping(case when lang = 'es' then 'uncategorized' else lang end)::int as overall, avg(quality) as accuracy, count(*) as n
 from labels join documents using (doc_id) where trim(text) <> '' group by rollup(case when lang = 'es' then 'uncategorized' else lang end)""")
def caption_accuracy(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "lang", "text"), "doc_id").withColumn("cat", F.when(F.col("lang") != "es", F.col("lang")))
    return rollups.caption_accuracy(rows, "cat", "quality", "text")


@query(f"with {_EV} select user_id, event_id, value from e qualify row_number() over (partition by user_id order by us desc, event_id desc) = 1")
def latest_per_key(spark, d):
    return sequence.latest(events(spark, d), "user_id", [F.desc("us"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query(f"""with {_EV}, x as (select event_id, value, lag(value) over (partition by user_id order by us, event_id) as previous from e)
 select event_id, value - previous as delta, case when value - previous > 0.0005 then 'up' when value - previous < -0.0005 then 'down' when previous is not null then 'flat' end as direction from x""")
def run_delta(spark, d):
    return sequence.run_delta(events(spark, d), "user_id", ["us", "event_id"], "value").select("event_id", "delta", "direction")


@query("""select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as frame_index, row_number() over (order by conv_id, turn) - 1 as index from conversations""")
def running_index(spark, d):
    return sequence.running_index(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", ["turn"])


@query("""select conv_id, count(*) as n, round((count(*) - 1)::double / nullif(max(turn) - min(turn), 0), 3) as fps from conversations group by 1""")
def fps_estimate(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.round(rollups.ratio((F.count("*") - 1).cast("double"), F.nullif(F.max("turn") - F.min("turn"), F.lit(0))), 3).alias("fps"))


@query("select o_orderkey, o_totalprice from orders order by o_orderdate desc, o_orderkey desc limit 6")
def recent_n(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(6).select("o_orderkey", "o_totalprice")


@query("""with t as (select o_orderpriority as task, sum(o_totalprice::decimal(18,2))::double as seconds from orders group by 1) select task, seconds, seconds / greatest(1, max(seconds) over ()) as width from t""")
def top_tasks(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("seconds"))
    return t.withColumn("width", F.col("seconds") / F.greatest(F.lit(1.0), F.max("seconds").over(Window.partitionBy(F.lit(0))))).orderBy(F.desc("seconds"))


@query("select event_id, 'clicks' as detector from events where event_type = 'click' union all select event_id, 'strong' from events where value > 50")
def union_detectors(spark, d):
    e = events(spark, d)
    return e.where("event_type = 'click'").select("event_id", F.lit("clicks").alias("detector")).unionByName(e.where("value > 50").select("event_id", F.lit("strong").alias("detector")))


@query("select distinct user_id, event_type from events where value > 10 except select user_id, event_type from events where value > 95")
def except_required(spark, d):
    e = events(spark, d)
    return e.where("value > 10").select("user_id", "event_type").subtract(e.where("value > 95").select("user_id", "event_type"))


@query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45) and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def semi_anti(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_returnflag")
    o = table(spark, d, "orders", "o_orderkey")
    return o.join(lines.where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(lines.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("""with w as (select l_returnflag as flag, sum(l_quantity::decimal(18,2))::double / 10 as hours from lineitem group by 1), p(gpu, rate) as (values ('4090', 0.40::double), ('L4', 0.80), ('A10G', 1.00), ('A100', 2.50))
 select flag, gpu, rate, hours, hours / 2.0 as gpu_hours, hours / 2.0 * rate as cost, ceil(hours / 2.0 / 24)::bigint as machines_for_a_day, 500.0 / rate * 2.0 as hours_in_budget, hours / 2.0 * rate <= 500 as fits from w, p""")
def cost_projection(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / 10).alias("hours"))
    return rollups.cost_projection(w, "hours", 2.0, 500.0)


@query("""with s as (select event_type as stage, sum(value::decimal(18,4))::double as seconds from events group by 1) select stage, seconds, seconds / sum(seconds) over () as share, 3600.0 / seconds as times_realtime, seconds = max(seconds) over () as bottleneck from s""")
def throughput_report(spark, d):
    return rollups.throughput(events(spark, d).groupBy(F.col("event_type").alias("stage")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("seconds")), 3600.0)


_Q = "q as (select vec_id, embedding[1]::double as w, embedding[2]::double as x, embedding[3]::double as y, embedding[4]::double as z from embeddings)"


def _quaternions(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("q"))


@query(f"with {_Q} select vec_id, atan2(2 * (w * y + x * z), 1 - 2 * (x * x + y * y)) as yaw, asin(greatest(-1, least(1, 2 * (w * x - y * z)))) as pitch, atan2(2 * (w * z + x * y), 1 - 2 * (x * x + z * z)) as roll from q")
def quat_euler(spark, d):
    return _quaternions(spark, d).select("vec_id", g.quaternion_euler(F.col("q")).alias("e")).select("vec_id", "e.*")


@query(f"""with {_Q}, n as (select *, 2.0 / (w * w + x * x + y * y + z * z) as s from q)
 select vec_id, 1 - s * (y * y + z * z) as r00, s * (x * y - w * z) as r01, s * (x * z + w * y) as r02, 1 - s * (x * x + y * y) as r22, abs(w) * sqrt(s / 2) as w from n""")
def quat_matrix(spark, d):
    m = _quaternions(spark, d).withColumn("m", g.quaternion_matrix(F.col("q"))).withColumn("back", g.matrix_quaternion(F.col("m")))
    return m.select("vec_id", *[F.col("m")[k].alias(n) for k, n in ((0, "r00"), (1, "r01"), (2, "r02"), (8, "r22"))], F.abs(F.col("back")[0]).alias("w"))


@query("select p_partkey, p_size * 40 * 0.5 / tan(radians(60 + p_size) / 2) as focal, 60 + p_size::double as fov from part")
def pinhole(spark, d):
    p = table(spark, d, "part").withColumn("f", g.focal_length(F.col("p_size") * 40, F.col("p_size") + 60))
    return p.select("p_partkey", F.col("f").alias("focal"), g.field_of_view(F.col("p_size") * 40, F.col("f")).alias("fov"))


_BONES = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)


_NAMED = ", ".join(f"'{j}'" for j in JOINTS)


@query(f"""with recursive e(parent, child) as (values {_BONES}), j as (select vec_id, [{_NAMED}][i] as joint, embedding[3 * i - 2]::double as x, embedding[3 * i - 1]::double as y, embedding[3 * i]::double as z from embeddings, (select unnest(generate_series(1, 17)) as i) where embedding is not null),
 t as (select vec_id, joint, 0 as depth, 0::double as length, x, y, z from j where joint = 'pelvis'
  union all select j.vec_id, j.joint, t.depth + 1, t.length + sqrt((j.x - t.x) ** 2 + (j.y - t.y) ** 2 + (j.z - t.z) ** 2), j.x, j.y, j.z from t join e on e.parent = t.joint join j on j.joint = e.child and j.vec_id = t.vec_id)
 select vec_id, joint, depth, round(length, 6) as length from t""")
def tree_depth(spark, d):
    """Each joint's steps from the pelvis and the length of its bones up to there."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    at = {j: F.array(*(F.element_at("embedding", 3 * k + c).cast("double") for c in (1, 2, 3))) for k, j in enumerate(JOINTS)}
    gap = lambda a, b: F.sqrt(sum(((at[a][k] - at[b][k]) * (at[a][k] - at[b][k]) for k in range(3)), F.lit(0.0)))
    paths: dict[str, list[tuple[str, str]]] = {"pelvis": []}
    for parent, child in EDGES:  # parents come first
        paths[child] = [*paths[parent], (parent, child)]
    bones = e.select("vec_id", *(gap(p, c).alias(c) for p, c in EDGES))
    rows = F.array(*(F.struct(F.lit(j).alias("joint"), F.lit(len(path)).alias("depth"), F.round(sum((F.col(c) for _, c in path), F.lit(0.0)), 6).alias("length")) for j, path in paths.items()))
    return bones.select("vec_id", F.inline(rows))


_NAMES = ", ".join(f"'{j}'" for j in JOINTS)


@query(f"""with e(parent, child) as (values {_BONES}), j as (select vec_id, [{_NAMES}][i] as joint, embedding[3 * i - 2]::double as x, embedding[3 * i - 1]::double as y, embedding[3 * i]::double as z from embeddings, (select unnest(generate_series(1, 17)) as i))
 select a.vec_id, e.parent, e.child, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as length, (a.x + b.x) / 2 as mid_x from e join j a on a.joint = e.parent join j b on b.joint = e.child and a.vec_id = b.vec_id""")
def bones_join(spark, d):
    names = F.array(*[F.lit(n) for n in JOINTS])
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(17))).alias("i"), "embedding")
    j = rows.select("vec_id", F.element_at(names, F.col("i")).alias("joint"), *[F.element_at("embedding", F.col("i") * 3 - k).cast("double").alias(c) for c, k in (("x", 2), ("y", 1), ("z", 0))])
    e = body.edges(spark)
    a = j.select("vec_id", F.col("joint").alias("parent"), F.struct("x", "y", "z").alias("a"))
    b = j.select("vec_id", F.col("joint").alias("child"), F.struct("x", "y", "z").alias("b"))
    pairs = a.join(e, "parent").join(b, ["vec_id", "child"])
    gap = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"), F.lit(0.0))
    return pairs.select("vec_id", "parent", "child", F.sqrt(gap).alias("length"), ((F.col("a.x") + F.col("b.x")) / 2).alias("mid_x"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by all")
def stream_tumbling(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type").select("start", "event_type", "n")


@query("""with s as (select time_bucket(interval '30 minutes', ts) as b, event_type from events), w as (select b as start, event_type from s union all select b - interval '30 minutes', event_type from s) select start, event_type, count(*) as n from w group by all""")
def stream_sliding(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type", slide="30 minutes").select("start", "event_type", "n")


@query("""with m as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), r as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as run from m)
 select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) as n from r group by user_id, run""")
def stream_session(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")


_X, _Y = "string_split(x.label, ' ')", "string_split(y.label, ' ')"
_ALIKE = f"len(list_intersect({_X}, {_Y}))::double / len(list_distinct({_X} || {_Y})) >= 0.34 or len(list_intersect({_X}, {_Y})) >= 2"
#: Open segments up to their sums; a sum is compensated, in the frames' order.
_SUM = """list_reduce(list({'s': value, 'c': 0::double} order by k), lambda a, b: {'s': a.s + b.s, 'c': a.c + case when abs(a.s) >= abs(b.s) then a.s - (a.s + b.s) + b.s else b.s - (a.s + b.s) + a.s end})"""


@query(f"""with recursive {_EV}, f as (select user_id, us / 1e6::double as t, {_LABEL} as label, value, event_type, row_number() over (partition by user_id order by us, event_id) as k from e),
 l as (select distinct label from f), y as (select x.label as a, y.label as b from l x, l y where {_ALIKE}),
 w as (select user_id, k, label as anchor, 1 as seg from f where k = 1 union all select f.user_id, f.k, case when y.a is null then f.label else w.anchor end, w.seg + case when y.a is null then 1 else 0 end from w join f on f.user_id = w.user_id and f.k = w.k + 1 left join y on y.a = w.anchor and y.b = f.label),
 m as (select * from w join f using (user_id, k)), n as (select user_id, seg, label, count(*) as c, min(k) as first from m group by all), q as (select user_id, seg, label from n qualify row_number() over (partition by user_id, seg order by c desc, first) = 1),
 g as (select user_id, seg, min(t) as start, max(t) as last, {_SUM} as total, count(*) as frames, arg_min(event_type, k) filter (length(event_type) = longest) as description from (select *, max(length(event_type)) over (partition by user_id, seg) as longest from m) group by all)
 select user_id, start, coalesce(lead(start) over (partition by user_id order by seg), last + 1) as "end", label, printf('%.3f', (total.s + total.c) / frames)::double as confidence, description from g join q using (user_id, seg)""")
def open_segments(spark, d):
    rows = labelled(spark, d).select("user_id", (F.col("us") / 1e6).alias("t"), F.col("lab").alias("label"), F.col("value").alias("confidence"), F.col("event_type").alias("description"))
    return folds.open_segments(rows, "user_id", "t", "label", "confidence", "description")


@query(f"""with recursive {_ISLANDS}, f as (select user_id, event_type, start / 1e6::double as a, "end" / 1e6::double as b, row_number() over (partition by user_id order by start) as k from s),
 n as (select *, lead(b - a) over (partition by user_id order by k) as after from f),
 w as (select user_id, 0::bigint as k, 0 as seg, null::double as a, null::double as b, null::varchar as event_type, null::double as taken from f group by user_id
  union all select user_id, k, case way when 'new' then seg + 1 else seg end, case way when 'new' then start else a end, case way when 'after' then b else stop end, case way when 'new' then own else event_type end, case way when 'after' then start end
  from (select *, case when round(stop - start, 3) >= 3600 or (seg = 0 and after is null) then 'new' when after is null or (seg > 0 and round(b - a, 3) >= round(after, 3)) then 'before' else 'after' end as way
   from (select w.user_id, n.k, w.seg, w.a, w.b, w.event_type, n.event_type as own, coalesce(w.taken, n.a) as start, n.b as stop, n.after from w join n on n.user_id = w.user_id and n.k = w.k + 1)))
 select user_id, arg_max(event_type, k) as event_type, max(a) as start, max(b) as "end" from w where seg > 0 group by user_id, seg""")
def merge_short(spark, d):
    return folds.merge_short(runs_of(spark, d).select("user_id", "event_type", (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end")), "user_id", 3600.0)


@query(f"""with recursive {_EV}, n as (select user_id, us / 1000.0::double as ms, case when event_type <> 'error' then value::float end as x, case when event_type <> 'error' then (value / 2)::float end as y, row_number() over (partition by user_id order by us, event_id) as k from e),
 w as (select user_id, 0::bigint as k, null::double as ms, null::float as x, null::float as y, 0::float as u, 0::float as v from n group by user_id
  union all select user_id, k, ms, case when u2 is null then px else (a2::float * px + (1 - a2)::float * x)::float end, case when u2 is null then py else (a2::float * py + (1 - a2)::float * y)::float end, coalesce(u2, 0::float), coalesce(v2, 0::float)
  from (select *, 1 / (1 + 1.0::double / (2 * pi() * ({folds.T.min_cutoff}::double + {folds.T.beta}::double * sqrt((u2 * u2 + v2 * v2)::double)::float::double)) / dt) as a2
   from (select *, (a1::float * ((px - x) / dt::float) + (1 - a1)::float * u)::float as u2, (a1::float * ((py - y) / dt::float) + (1 - a1)::float * v)::float as v2
    from (select *, 1 / (1 + 1.0::double / (2 * pi() * {folds.T.derivative_cutoff}::double) / dt) as a1
     from (select w.user_id, n.k, n.ms, n.x as px, n.y as py, w.x, w.y, w.u, w.v, greatest(0.001::double, n.ms / 1000 - w.ms / 1000) as dt from w join n on n.user_id = w.user_id and n.k = w.k + 1)))))
 select user_id, ms, x::double as hand_x, y::double as hand_y from w where k > 0""")
def one_euro(spark, d):
    rows = events(spark, d).select("user_id", (F.col("us") / 1000.0).alias("ms"), F.when(F.col("event_type") != "error", F.array(F.array(F.col("value").cast("float"), (F.col("value") / 2).cast("float")))).alias("hand"))
    hand = F.col("hand")[0]
    return folds.smooth(rows, "user_id", "ms", "hand").select("user_id", "ms", *[hand[k].cast("double").alias(f"hand_{c}") for k, c in enumerate("xy")])


@query()
def tracker(spark, d):
    rows = events(spark, d).select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("frame"), "event_id", F.col("value").alias("x0"), F.col("value").alias("y0"), (F.col("value") + 40).alias("x1"), (F.col("value") + 60).alias("y1"))
    return folds.track_boxes(rows, "user_id", "frame", "event_id", 5)


_OVERLAP = "greatest(0, least(c.x1, r.x1) - greatest(c.x0, r.x0)) * greatest(0, least(c.y1, r.y1) - greatest(c.y0, r.y0))"


@query(f"""with recursive {_LB}, r as (select *, x0 * 0.7 + n as score, row_number() over (partition by k order by x0 * 0.7 + n desc, n, x0, y0) as place from b),
 w as (select k, 0::bigint as place, []::struct(n integer, x0 double, y0 double, x1 double, y1 double)[] as kept from b group by k
  union all select r.k, r.place, case when len(list_filter(w.kept, lambda c: {_OVERLAP} / ((r.x1 - r.x0) * (r.y1 - r.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - {_OVERLAP}) > {folds.T.text_nms})) > 0
   then w.kept else list_append(w.kept, {{'n': r.n, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) end from w join r on r.k = w.k and r.place = w.place + 1),
 z as (select k, arg_max(kept, place) as kept from w group by k), u as (select k, unnest(kept) as c from z)
 select k, c.n as n, c.x0 as x0, c.y0 as y0, c.x1 as x1, c.y1 as y1, c.x0 * 0.7 + c.n as score from u""")
def nms(spark, d):
    return folds.non_max(_line_boxes(spark, d).withColumn("score", F.col("x0") * 0.7 + F.col("n")), ["k"], "score", order=["n", "x0", "y0"])


_TURN = ", ".join(f"n.r[{i + 1}] * w.m[{j}] + n.r[{i + 2}] * w.m[{j + 3}] + n.r[{i + 3}] * w.m[{j + 6}]" for i in (0, 3, 6) for j in (1, 2, 3))
_MOVE = ", ".join(f"w.p[{i}] + (w.m[{3 * i - 2}] * n.x + w.m[{3 * i - 1}] * n.y + w.m[{3 * i}] * n.z)" for i in (1, 2, 3))


@query(f"""with recursive {_Q}, s as (select *, 2.0::double / (w * w + x * x + y * y + z * z) as s from q),
 n as (select label, vec_id, x, y, z, case when vec_id % 7 <> 0 then [1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y), s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x), s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y)] end as r,
  row_number() over (partition by label order by vec_id) as k from s join embeddings using (vec_id)),
 w as (select label, null::bigint as vec_id, 0::bigint as k, [0, 0, 0]::double[] as p, [1, 0, 0, 0, 1, 0, 0, 0, 1]::double[] as m, false as tracked from embeddings group by label
  union all select n.label, n.vec_id, n.k, case when n.r is null then w.p else [{_MOVE}] end, case when n.r is null then w.m else [{_TURN}] end, n.r is not null from w join n on n.label is not distinct from w.label and n.k = w.k + 1)
 select label, vec_id::double as timestamp_ms, {", ".join(f"p[{i + 1}] as p{i}" for i in range(3))}, {", ".join(f"m[{i + 1}] as r{i}" for i in range(9))}, tracked from w where k > 0""")
def pose_accumulation(spark, d):
    q = _quaternions(spark, d).join(table(spark, d, "embeddings", "vec_id", "label"), "vec_id")
    steps = q.select("label", F.col("vec_id").alias("t"), F.when(F.col("vec_id") % 7 != 0, g.quaternion_matrix(F.col("q"))).alias("r"), F.slice("q", 2, 3).alias("d"))
    poses = folds.accumulate_pose(steps, "label", "t", "r", "d")
    return poses.select("label", "timestamp_ms", *[F.col("position")[k].alias(f"p{k}") for k in range(3)], *[F.col("rotation")[k].alias(f"r{k}") for k in range(9)], "tracked")


@query()
def procrustes(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(1), F.lit(61), F.lit(3)), lambda i: F.array(*[F.element_at("embedding", i.cast("int") + k).cast("double") for k in range(3)])).alias("p"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    return folds.aligned_errors(pairs, "p", "q").select("vec_id", "pa_errors")


_HEADS = f"""with {_EV}, c as (select user_id, us / 1000.0::double as timestamp_ms, event_type from e where event_type in ('click', 'purchase')), h as (select user_id, us / 1000.0::double as ms, min(value) as v from e where event_type = 'view' group by all),
 p as (select c.*, v, row_number() over (partition by c.user_id, c.timestamp_ms, c.event_type order by abs(ms - timestamp_ms), ms) as k from c left join h using (user_id)),
 r as (select user_id, timestamp_ms, coalesce(v > 10, false) as root_tracked, case when event_type = 'click' then 0.9::double else 0.225::double end as l_wrist_confidence, coalesce(v, 0) / 500 as x, 2 / (1 + (coalesce(v, 0) / 500) ** 2) as s from p where k = 1)
 select user_id, timestamp_ms, root_tracked, l_wrist_confidence, 0::double as head_x, round((1 - s * x * x) * 0.68 - s * x * 0.034, 4) as head_y, round(s * x * 0.68 + (1 - s * x * x) * 0.034, 4) as head_z from r"""


@query(_HEADS)
def body_pose(spark, d):
    e = events(spark, d).withColumn("ms", F.col("us") / 1000.0)
    hand = F.array(F.array(F.col("value") / 100, F.lit(0.6), F.lit(0.0)))
    hands = e.where("event_type in ('click', 'purchase')").select("user_id", F.col("ms").alias("timestamp_ms"), F.when(F.col("event_type") == "click", hand).alias("left_hand_landmarks"), hand.alias("right_hand_landmarks"))
    heads = e.where("event_type = 'view'").groupBy("user_id", F.col("ms").alias("timestamp_ms")).agg(F.min("value").alias("v"))
    heads = heads.select("user_id", "timestamp_ms", F.array(F.lit(1.0), F.col("v") / 500, F.lit(0.0), F.lit(0.0)).alias("quaternion"), (F.col("v") > 10).alias("tracked"))
    return body.fuse(hands, heads, "user_id").select("user_id", "timestamp_ms", "root_tracked", F.col("joints")["l_wrist"]["confidence"].alias("l_wrist_confidence"), *[F.col("joints")["head"]["pos"][k].alias(f"head_{c}") for k, c in enumerate("xyz")])

def _samples(spark, d):
    errors = F.transform(F.slice("embedding", 1, 17), lambda x: F.abs(x).cast("double"))
    return table(spark, d, "embeddings").select(errors.alias("errors"), F.concat(F.lit("p"), F.col("label") % 3).alias("provenance"))


_ERR = f"s as (select 'p' || (label % 3) as provenance, [{_NAMES}][i] as joint, abs(embedding[i])::double as error from embeddings, (select unnest(generate_series(1, 17)) as i))"


@query(f"with {_ERR} select joint, provenance, avg(error) as mean_error, count(*) as n, grouping_id(joint, provenance)::bigint as level from s group by grouping sets ((), (joint), (provenance))")
def joint_errors(spark, d):
    return rollups.joint_errors(_samples(spark, d), "errors", JOINTS, "provenance")


@query(f"with {_ERR} select joint, avg(error) as mean_error, count(*) as n from s group by joint order by mean_error desc, joint")
def joints_by_error(spark, d):
    return metrics.joints_by_error(_samples(spark, d), "errors", JOINTS)


@query("select l_orderkey, count(*) as frame_count, round(((count(*) filter (l_returnflag = 'R')) + (count(*) filter (l_linestatus = 'F')))::double / (2 * count(*)), 3) as wrist_measured_fraction from lineitem group by 1")
def measured_wrist_fraction(spark, d):
    return metrics.measured_fraction(table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus"), "l_orderkey", [F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"])


@query("select user_id, (count(*) filter (event_type = 'view'))::double / greatest(count(*), 1) as tracked_fraction from events group by 1")
def tracked_fraction(spark, d):
    return metrics.tracked_fraction(events(spark, d), "user_id", F.col("event_type") == "view")


@query("select user_id, event_type, count(*) as n from events group by all")
def provenance_counts(spark, d):
    return metrics.provenance_counts(events(spark, d), "user_id", "event_type")


@query("select conv_id, count(*) as frames, sum(length(text))::bigint as tokens, count(*) * 0.002::double + sum(length(text))::bigint * 0.00001::double as cost_usd from conversations group by 1")
def labelling_cost(spark, d):
    return metrics.labelling_cost(table(spark, d, "conversations"), "conv_id", 0.002, F.char_length("text"), 0.00001)


@query("select user_id, count(*) filter (value > 40) as detected, count(*) as attempted, round((count(*) filter (value > 40))::double / greatest(count(*), 1), 3) as detection_rate from events group by 1")
def detection_rate(spark, d):
    return metrics.detection_rate(events(spark, d), "user_id", F.col("value") > 40)


@query("""with f as (select l_orderkey as k, count(*) as n from lineitem group by 1)
 select count(*) as episodes, sum(n)::bigint as frames, sum(o_totalprice::decimal(18,2))::double / 3600 as hours from f left join orders on k = o_orderkey""")
def corpus_totals(spark, d):
    frames = table(spark, d, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("frame_count"))
    out = metrics.corpus_totals(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("s")), frames, "k", "s")
    return out


@query("""with r as (select l_suppkey as config, (count(*) filter (l_returnflag = 'R'))::double / count(*) as rate, sum((l_discount * 100)::bigint)::double / count(*) as error from lineitem group by 1)
 select config, rate, error from r order by round(rate, 3) desc, error, config limit 1""")
def sweep_best(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("config")).agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("rate"), (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*")).alias("error"))
    return metrics.sweep_best(r, "config", "rate", "error")


@query("""with h as (select vec_id // 4 as image, vec_id % 4 as k, vec_id, list_transform(generate_series(1, 13, 3), lambda i: [embedding[i]::double - embedding[1]::double, embedding[i + 1]::double - embedding[2]::double, embedding[i + 2]::double - embedding[3]::double]) as p from embeddings),
 e as (select a.image, a.vec_id as prediction_id, b.vec_id as truth_id, list_sum(list_transform(generate_series(1, 5), lambda i: sqrt((a.p[i][1] - b.p[i][1]) ** 2 + (a.p[i][2] - b.p[i][2]) ** 2 + (a.p[i][3] - b.p[i][3]) ** 2))) / 5 as error from h a join h b on a.image = b.image and a.k < 2 and b.k >= 2)
 select image, prediction_id, truth_id, error from e qualify row_number() over (partition by image, prediction_id order by error, truth_id) = 1""")
def best_match(spark, d):
    points = F.transform(F.sequence(F.lit(1), F.lit(13), F.lit(3)), lambda i: F.array(*[F.element_at("embedding", i.cast("int") + k).cast("double") for k in range(3)]))
    h = table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("image"), "vec_id", points.alias("points"))
    mean = lambda p, q: F.aggregate(g.root_aligned_errors(F.col(p), F.col(q)), F.lit(0.0), lambda s, x: s + x) / 5
    return metrics.best_match(h.where("vec_id % 4 < 2").withColumnRenamed("vec_id", "prediction_id"), h.where("vec_id % 4 >= 2").withColumnRenamed("vec_id", "truth_id"), "image", mean)


@query("select event_id, event_type from events where event_type <> 'error'")
def without_self_tests(spark, d):
    return metrics.without_self_tests(events(spark, d), "event_type", ("error",)).select("event_id", "event_type")


@query("select o_orderkey from orders where o_orderstatus in ('F', 'O')")
def ready_recordings(spark, d):
    return metrics.ready(table(spark, d, "orders"), "o_orderstatus", ("F", "O")).select("o_orderkey")


@query("select event_id, user_id, null::bigint as turn from events union all select null, conv_id, turn from conversations")
def union_of_logs(spark, d):
    return metrics.union_of_logs(events(spark, d).select("event_id", "user_id"), table(spark, d, "conversations").select(F.col("conv_id").alias("user_id"), "turn"))


@query("select event_id, 0 as kind, value as x0 from events where event_type = 'click' union all select event_id, 1, value * 2 from events where value > 50")
def union_of_boxes(spark, d):
    one = lambda kind, x: F.array(F.struct(F.lit(kind).alias("kind"), x.alias("x0")))
    e = events(spark, d).select("event_id", F.when(F.col("event_type") == "click", one(0, F.col("value"))).alias("faces"), F.when(F.col("value") > 50, one(1, F.col("value") * 2)).alias("texts"))
    return metrics.union_of_boxes(e, "faces", "texts").select("event_id", F.inline("boxes"))


@query("select distinct lang, source from documents order by lang, source")
def sorted_listing(spark, d):
    return metrics.listing(table(spark, d, "documents"), "lang", "source")


@query("""select event_id, case when (event_id % 2 = 0) <> (event_type = 'click') then value end as left_confidence, case when (event_id % 2 = 0) <> (event_type = 'click') then null else value end as right_confidence from events""")
def handedness_swap(spark, d):
    e = events(spark, d).withColumn("h", g.by_side(F.when(F.col("event_id") % 2 == 0, "Left").otherwise("Right"), F.array("value"), F.col("value"), F.col("event_type") == "click"))
    return e.select("event_id", "h.left_confidence", "h.right_confidence")


@query("""select o_orderkey, case when o_totalprice / 7 >= 10000 then printf('$%dk', floor(o_totalprice / 7 / 1000 + 0.5)::bigint) when o_totalprice / 7 >= 1000 then printf('$%.1fk', o_totalprice / 7 / 1000) when o_totalprice / 7 < 10 then printf('$%.2f', o_totalprice / 7) else printf('$%d', floor(o_totalprice / 7 + 0.5)::bigint) end as shown from orders""")
def money_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.money(F.col("o_totalprice") / 7, even=True).alias("shown"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as uploaded_at from orders")
def row_records(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("uploaded_at"))


@query(_HEADS)
def body_pose_heads(spark, d):
    """The same under its earlier name."""
    return body_pose(spark, d)


@query(f"""with recursive {_EV}, f as (select user_id, us / 1e6::double as t, {_LABEL} as label, value, event_type, row_number() over (partition by user_id order by us, event_id) as k from e),
 z as (select user_id, max(t) - 0.25::double as whole from f group by 1), l as (select distinct label from f), y as (select x.label as a, y.label as b from l x, l y where {_ALIKE}),
 w as (select user_id, k, label as anchor, 1 as seg from f where k = 1 union all select f.user_id, f.k, case when y.a is null then f.label else w.anchor end, w.seg + case when y.a is null then 1 else 0 end from w join f on f.user_id = w.user_id and f.k = w.k + 1 left join y on y.a = w.anchor and y.b = f.label),
 m as (select * from w join f using (user_id, k)), n as (select user_id, seg, label, count(*) as c, min(k) as first from m group by all), q as (select user_id, seg, label from n qualify row_number() over (partition by user_id, seg order by c desc, first) = 1),
 g as (select user_id, seg, min(t) as start, max(t) as last, count(*) as frames, arg_min(event_type, k) filter (length(event_type) = longest) as description from (select *, max(length(event_type)) over (partition by user_id, seg) as longest from m) group by all)
 select user_id, start, coalesce(lead(start) over (partition by user_id order by seg), least(whole, last + 1)) as "end", label, description from g join q using (user_id, seg) join z using (user_id)""")
def open_segments_clamped(spark, d):
    """Open segments whose recording ends before its last sample and interval."""
    rows = labelled(spark, d).withColumn("t", F.col("us") / 1e6)
    rows = rows.withColumn("whole", F.max("t").over(Window.partitionBy("user_id")) - 0.25).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    rows = rows.select("user_id", "t", F.col("lab").alias("label"), F.col("value").alias("confidence"), F.col("event_type").alias("description"), "whole")
    return folds.open_segments(rows, "user_id", "t", "label", "confidence", "description", duration="whole").select("user_id", "start", "end", "label", "description")


@query(f"""with {_ISLANDS}, z as (select user_id, max(us) + 400000 as whole from e group by 1), i2 as (select user_id, run, min(us) as s, max(us) as last, event_type from r group by all)
 select user_id, event_type, s::bigint as start, coalesce(lead(s) over (partition by user_id order by run), least(whole, last + 1000000))::bigint as "end" from i2 join z using (user_id)""")
def segment_islands_clamped(spark, d):
    rows = events(spark, d).withColumn("whole", F.max("us").over(Window.partitionBy("user_id")) + 400_000)
    return sequence.islands(rows, "user_id", "us", "event_type", ["us", "event_id"], duration=F.col("whole"), interval=1_000_000).select("user_id", "event_type", "start", "end")


@query("""with s as (select conv_id, turn, turn * 7 as a, turn * 7 + 7 as b, trim(text) as said from conversations), c as (select conv_id, count(*) as n from conversations group by 1),
 l as (select conv_id, string_agg(printf('    %02d:%02d–%02d:%02d: %s', a // 60, a % 60, b // 60, b % 60, said), chr(10) order by turn) as lines from s where said <> '' and turn < 400 group by 1)
 select conv_id::varchar as id, concat_ws(chr(10), printf('VIDEO [%s] file=f%d, property=n/a, duration=%.0fs', substr(conv_id::varchar, 1, 8), conv_id, (n * 7)::double), printf('  duration_active_hands=None' || 's, service_events=%d, downtime=%ds, contamination=0', n, n * 2), '  timeline (what the worker was doing):', lines) as context from c left join l using (conv_id)""")
def chat_context_full(spark, d):
    c = table(spark, d, "conversations").withColumn("video_id", F.col("conv_id").cast("string"))
    n = c.groupBy("video_id").agg(F.count("*").alias("n"))
    videos = n.select(F.col("video_id").alias("id"), F.concat(F.lit("f"), "video_id").alias("original_filename"), F.lit("").alias("property_tag"), (F.col("n") * 7).alias("duration_seconds"))
    summaries = n.select("video_id", F.lit(None).cast("double").alias("active_hand_seconds"), F.col("n").alias("service_event_count"), (F.col("n") * 2).alias("downtime_seconds"), F.lit(0).alias("contamination_event_count"))
    segments = c.select("video_id", (F.col("turn") * 7).alias("start_time"), (F.col("turn") * 7 + 7).alias("end_time"), F.col("text").alias("description"), F.lit("").alias("task_label"))
    return rollups.video_contexts(videos, summaries, segments)
