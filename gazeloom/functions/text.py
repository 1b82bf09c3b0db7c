"""Label, reply and display functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazeloom.config import Thresholds

T = Thresholds()

#: Labels, types and keywords.
SERVICE_LABELS = ("moving container", "opening gate/enclosure", "manipulating lock or latch", "loading/unloading")
TYPE_OF_LABEL = {"handling overflow/contamination": "contamination", "idle/waiting": "idle", "transit/walking": "transit", "approaching property": "transit"}
IDLE_WORDS = ("idle", "wait", "stand", "still", "pause")
TRANSIT_WORDS = ("walk", "transit", "approach", "moving")
TAXONOMY = (
    "approaching property", "moving container", "opening gate/enclosure", "manipulating lock or latch",
    "handling overflow/contamination", "loading/unloading", "transit/walking", "idle/waiting",
)
TAXONOMY_KEYWORDS = (
    ("approach", "approaching property"), ("container", "moving container"), ("bin", "moving container"), ("gate", "opening gate/enclosure"),
    ("enclosure", "opening gate/enclosure"), ("lock", "manipulating lock or latch"), ("latch", "manipulating lock or latch"),
    ("overflow", "handling overflow/contamination"), ("contamin", "handling overflow/contamination"), ("load", "loading/unloading"),
    ("unload", "loading/unloading"), ("walk", "transit/walking"), ("transit", "transit/walking"), ("idle", "idle/waiting"), ("wait", "idle/waiting"),
)
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "of", "to", "in", "on", "at", "with", "and", "or", "their", "his", "her", "they", "person", "image",
    "shows", "appears", "seems", "frame", "camera", "this", "that", "it", "be", "being", "doing", "while", "as", "from", "into", "near", "by", "for",
)
COLORS = {
    "service": "#22c55e", "moving container": "#22c55e", "loading/unloading": "#16a34a", "opening gate/enclosure": "#10b981", "manipulating lock or latch": "#14b8a6",
    "contamination": "#ef4444", "handling overflow/contamination": "#ef4444", "downtime": "#f59e0b", "idle": "#a16207", "idle/waiting": "#a16207",
    "transit": "#3b82f6", "transit/walking": "#3b82f6", "approaching property": "#6366f1", "task": "#8b5cf6",
}
OTHER_COLOR = "#64748b"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def event_type(label: Column, seconds: Column, downtime: float = T.idle_downtime_seconds) -> Column:
    """Known labels by exact match, others by keywords in lower case; long idleness is downtime."""
    low = F.lower(label)
    base = F.when(label.isin(*SERVICE_LABELS), "service")
    for known, kind in TYPE_OF_LABEL.items():
        base = base.when(label == known, kind)
    base = base.when(_any(low, IDLE_WORDS), "idle").when(_any(low, TRANSIT_WORDS), "transit").otherwise("task")
    return F.when((base == "idle") & (seconds >= downtime), "downtime").otherwise(base)


def match_taxonomy(value: Column) -> Column:
    """Free text to a canonical label: exact, then containment either way in order, then keywords; blank is null."""
    def match(v: Column) -> Column:
        exact = [F.when(v == t, t) for t in TAXONOMY]
        loose = [F.when(F.contains(v, F.lit(t)) | F.contains(F.lit(t), v), t) for t in TAXONOMY]
        words = [F.when(F.contains(v, F.lit(k)), t) for k, t in TAXONOMY_KEYWORDS]
        return F.when(v != "", F.coalesce(*exact, *loose, *words))

    # the text in lower case is made once, not for each of the comparisons
    return F.transform(F.array(F.lower(F.trim(value))), match)[0]


def parse_label(reply: Column) -> Column:
    """A model's reply to struct(task, confidence, description, raw): JSON between the outer braces, else a guess of little confidence."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    obj = F.from_json(body, "task string, confidence string, description string")
    task = match_taxonomy(obj["task"])
    given = F.when(F.trim(obj["confidence"]) == obj["confidence"], obj["confidence"]).otherwise(F.trim(obj["confidence"])).try_cast("double")
    sure = F.coalesce(given, F.lit(0.5))
    confidence = F.when(task.isNull(), F.least(sure, F.lit(0.3))).otherwise(sure)
    return F.struct(
        F.coalesce(task, match_taxonomy(reply), F.lit("idle/waiting")).alias("task"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 3).alias("confidence"),
        F.coalesce(F.trim(obj["description"]), F.lit("")).alias("description"),
        F.substring(reply, 1, 500).alias("raw"),
    )


def derive_activity(text: Column, n: int = 4) -> Column:
    """The first words of substance, as a label."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS) & (F.char_length(w) > 2))
    label = F.array_join(F.slice(words, 1, n), " ")
    return F.when(label == "", "activity").otherwise(label)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def similar(a: Column, b: Column, jaccard: float = T.similar_jaccard, shared: int = T.similar_shared) -> Column:
    """Token sets alike by Jaccard or by shared tokens; texts without tokens only if equal."""
    x, y = _tokens(a), _tokens(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), a == b).otherwise((both / F.greatest(either, F.lit(1)) >= jaccard) | (both >= shared))


def clock(seconds: Column) -> Column:
    """mm:ss, truncated; minutes go on past 99."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), s % 60)


def clock_ms(seconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    ms = F.floor(F.greatest(seconds, F.lit(0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("0L") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def humanize_seconds(seconds: Column) -> Column:
    s = F.floor(seconds + 0.5).cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    minutes = F.when(s % 60 != 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%dm", m))
    return F.when(seconds.isNull(), "—").when(s < 60, F.format_string("%ds", s)).when(m < 60, minutes).otherwise(F.format_string("%dh %dm", h, m % 60))


def humanize_share(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.format_string("%d%%", F.floor(x * 100 + 0.5).cast("long")))


def humanize_bytes(n: Column) -> Column:
    """B to GB by 1024; one decimal below ten units."""
    n = n.cast("double")
    out = F.when(n.isNull() | (n == 0), "—").when(n < 1024, F.format_string("%.0f B", n))
    for k, unit in enumerate(("KB", "MB"), 1):
        v = n / 1024**k
        out = out.when(v < 1024, F.when(v < 10, F.format_string(f"%.1f {unit}", v)).otherwise(F.format_string(f"%.0f {unit}", v)))
    v = n / 1024**3
    return out.otherwise(F.when(v < 10, F.format_string("%.1f GB", v)).otherwise(F.format_string("%.0f GB", v)))


def _fixed(x: Column, digits: int, even: bool) -> Column:
    """x with decimals, rounded by its binary value, where format_string rounds the shortest decimal; exact ties away from zero, or to the even digit."""
    if not even:
        x = F.when(F.abs(x * 2 ** (digits + 1)) % 2 == 1, x + F.signum(x) / 10 ** (digits + 1)).otherwise(x)
    # beyond 2^53 no fraction is left
    exact = F.call_function("format_number", x, F.lit("0." + "0" * digits))
    return F.when(F.abs(x) < 2.0**53, exact).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def _whole(x: Column) -> Column:
    """x of at least one as a whole number, ties up."""
    return F.when(x < 2.0**63, F.format_string("%d", F.floor(x + 0.5))).when(x.isNotNull(), F.format_string("%.0f", x))


def money(x: Column, even: bool = False) -> Column:
    """Dollars: cents below ten, whole ones below a thousand, then thousands, with a decimal below ten thousand; null is null.

    Decimals are rounded by the binary value, exact ties away from zero as the page's toFixed does or, if `even`, to the even digit as C's printf does.
    """
    x = x.cast("double")
    k = x / 1000
    thousands = F.concat(F.when(x >= 10000, _whole(k)).otherwise(_fixed(k, 1, even)), F.lit("k"))
    return F.concat(F.lit("$"), F.when(x >= 1000, thousands).when(x < 10, _fixed(x, 2, even)).otherwise(_whole(x)))


def clean_scene(answer: Column) -> Column:
    """The first line without blanks, quotes and stops around it, sixty characters at most."""
    return F.substring(F.trim(F.btrim(F.element_at(F.split(F.trim(answer), "\n"), 1), F.lit(' ".'))), 1, 60)


def parse_score(reply: Column) -> Column:
    """struct(score, reason): the score of a judge's JSON reply, snapped half-even to 0, 0.5 or 1."""
    obj = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "score string, reason string")
    score = F.coalesce(obj["score"], F.lit("0")).try_cast("double")
    ok = obj.isNotNull() & (F.regexp_extract(reply, r"(?s)\{.*\}", 0) != "") & score.isNotNull()
    snapped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.bround(score * 2) / 2))
    return F.struct(F.when(ok, snapped).otherwise(0.0).alias("score"), F.when(ok, F.substring(F.coalesce(obj["reason"], F.lit("")), 1, 80)).otherwise("unparseable judge reply").alias("reason"))


def label_color(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair])
    return F.coalesce(table[label], F.lit(OTHER_COLOR))


def accuracy_verdict(mm: Column) -> Column:
    return F.when(mm < 15, "STRONG").when(mm < 25, "COMPETITIVE").otherwise("NEEDS WORK")


def bone_name(name: Column) -> Column:
    """Rig prefixes and punctuation off, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^.*[:|]", ""), "[^A-Za-z0-9]", ""))


def content_checksum(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


#: Keys under which services put what is looked for, in order.
HAND_KEYS = ("hands", "predictions", "detections", "results")
POINT_KEYS = ("keypoints_2d", "joints_2d", "keypoints", "landmarks_2d", "keypoints2d", "pred_keypoints_2d")
SIDE_KEYS = ("hand_side", "handedness", "side")


def _within(v: Column, keys: tuple[str, ...], kind: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, F.lit(f"$.{k}"), kind) for k in keys))


def hands_of(reply: Column) -> Column:
    """array<variant>: the hands of a service's JSON reply, which is a list, an object with a list, or one hand; text that is no JSON gives none."""
    v = F.try_parse_json(reply)
    kind = F.schema_of_variant(v)
    alone = F.when(kind.startswith("OBJECT"), F.array(v))
    none = F.array().cast("array<variant>")
    return F.coalesce(F.when(kind.startswith("ARRAY"), F.try_variant_get(v, F.lit("$"), "array<variant>")), _within(v, HAND_KEYS, "array<variant>"), alone, none)


def hand_points(hand: Column) -> Column:
    """array<array<double>>: at least 21 image points of a hand (a variant), given as pairs or as objects with x and y; else null."""
    kind = F.schema_of_variant(hand)
    found = F.coalesce(F.when(kind.startswith("ARRAY"), F.try_variant_get(hand, F.lit("$"), "array<variant>")), _within(hand, POINT_KEYS, "array<variant>"))

    def point(p: Column) -> Column:
        pair = F.try_variant_get(p, F.lit("$"), "array<double>")
        x, y = (F.try_variant_get(p, F.lit(f"$.{c}"), "double") for c in "xy")
        return F.when(F.size(pair) >= 2, F.slice(pair, 1, 2)).when(F.schema_of_variant(p).startswith("OBJECT"), F.array(x, y))

    points = F.filter(F.transform(found, point), lambda p: p.isNotNull())
    return F.when(F.size(points) >= 21, points)


def is_right_hand(hand: Column) -> Column:
    """A flag if there is one, else the name of the side; right if nothing tells."""
    flag = _within(hand, ("is_right", "right"), "boolean")
    side = F.lower(F.coalesce(_within(hand, SIDE_KEYS, "string"), F.lit("right")))
    return F.coalesce(flag, F.contains(side, F.lit("right")) | side.isin("r", "1"))
