"""Quality by weak supervision: rules vote or abstain, EM weighs them. DataFrame and SQL functions only.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) on a document. Documents that the base rules (too
few words, too many repeated ones) pass are counted by their pattern of votes, of which there are at
most 3**len(RULES) = 6561; expectation-maximisation estimates how accurate each rule is in either
direction (how much oftener good documents get its good vote than bad ones, and bad ones its bad vote)
over those counts, inside one expression. A vote for a class never counts against it. A document is kept
if the base rules pass it and its pattern's posterior of good quality is one half or more.

Nulls: a null text has no words, fails the base rules and isn't kept. Null doc_ids and repeated
rows are judged like others; empty tables give empty results; extra columns are left out. All
counts are over whole texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.shared import WORD, Scratch

SYMBOLS = "[#*$%&|<>]"
MARKS = r"[!-@\[-`{-~]"
WINDOW = 8
#: name -> (bad if, good if), over the columns of `features`; neither: the rule abstains.
RULES = {
    "symbols": ("100 * n_symbols > 5 * word_chars", "100 * n_symbols <= 2 * word_chars"),
    "lines": ("100 * n_dup_lines > 40 * n_lines", "false"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "false"),
    "stutter": ("100 * n_stutter > 20 * n_words", "100 * n_stutter <= 4 * n_words"),
    "variety": ("n_distinct * n_distinct < 3 * n_words", "false"),
    "capitals": ("100 * n_capitals > 40 * word_chars", "false"),
    "marks": ("100 * n_marks > 16 * word_chars", "100 * n_marks <= 8 * word_chars"),
    "sentences": ("100 * n_stops < 2 * n_words", "100 * n_stops >= 6 * n_words"),
}
#: The class balance is given, not learned: a learned one keeps bad documents where there are few to learn from.
GOOD_SHARE = 0.5
#: Documents of each class that every vote is taken to have beforehand.
PSEUDO = 4
MOST_PATTERNS = 3 ** len(RULES)


def _count(text: str, pattern: str) -> str:
    """SQL for how many characters of a text are in a class; only the matches cost."""
    return f"char_length({text}) - char_length(regexp_replace({text}, r'{pattern}', ''))"


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that base rules and votes use, a row for each row of docs."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("w", F.expr(f"regexp_extract_all(t, r'{WORD}', 0)"))
    t = t.withColumn("line", F.expr(f"filter(split(t, '\\n'), x -> x rlike r'{WORD}')"))
    t = t.select(
        "doc_id", F.array_join("w", "").alias("c"), F.expr("size(filter(w, (x, i) -> x = get(w, i - 1)))").cast("long").alias("n_stutter"), F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.expr(rf"regexp_count(t, r'[^!-@\[-`{{-~\t-\r ][.,](?=[\t-\r ]|\z)')").cast("long").alias("n_stops"),
        F.expr(f"if(size(w) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))))").alias("h"),
        F.size("line").cast("long").alias("n_lines"), (F.size("line") - F.size(F.array_distinct("line"))).cast("long").alias("n_dup_lines"),
    )
    counts = {"word_chars": "char_length(c)", "n_symbols": _count("c", SYMBOLS), "n_capitals": _count("c", "[A-Z]"), "n_marks": _count("c", MARKS)}
    t = t.select(
        "doc_id", "n_words", "n_distinct", "n_stutter", "n_stops", "n_lines", "n_dup_lines", *(F.expr(x).cast("long").alias(k) for k, x in counts.items()),
        # windows in the order of their hashes, only where one comes twice
        F.expr("if(size(array_distinct(h)) = size(h), null, sort_array(transform(h, (x, i) -> struct(x as h, i as i))))").alias("s"),
    )
    t = t.withColumn("p", F.expr("if(s is null, null, sort_array(filter(transform(s, (x, k) -> if(get(s, k - 1).h = x.h or get(s, k + 1).h = x.h, x.i, null)), y -> y is not null)))"))
    t = t.withColumn("n_repeat_words", F.expr(f"if(p is null, 0L, cast(aggregate(transform(p, (y, k) -> least({WINDOW}, coalesce(get(p, k + 1) - y, {WINDOW}))), 0, (a, y) -> a + y) as bigint))"))
    return t.drop("s", "p")


def _em(rounds: int) -> str:
    """SQL for the posterior of each pattern: over `v`, an array of (votes array<int>, n double)."""
    rules = f"sequence(0, {len(RULES) - 1})"
    start = "transform(v, x -> struct(x.votes as votes, x.n as n, 1D / (1D + exp(-aggregate(x.votes, 0D, (s, y) -> s + y))) as q))"
    totals = "struct(aggregate(w, 0D, (s, x) -> s + x.n * x.q) as good, aggregate(w, 0D, (s, x) -> s + x.n * (1D - x.q)) as bad)"

    def ratio(vote: int) -> str:
        """Log of how much oftener good documents get the vote of rule j than bad ones."""
        good, bad = (f"ln((aggregate(w, 0D, (s, x) -> s + if(x.votes[j] = {vote}, x.n * {q}, 0D)) + {PSEUDO}D) / (t.{c} + {2 * PSEUDO}D))" for q, c in (("x.q", "good"), ("(1D - x.q)", "bad")))
        return f"{good} - {bad}"

    model = f"struct(transform({rules}, j -> greatest(0D, {ratio(1)})) as up, transform({rules}, j -> least(0D, {ratio(-1)})) as down)"
    prior = math.log(GOOD_SHARE) - math.log(1 - GOOD_SHARE)
    logit = f"aggregate({rules}, {prior!r}D, (s, j) -> s + case x.votes[j] when 1 then z.up[j] when -1 then z.down[j] else 0D end)"
    step = f"transform(array({totals}), t -> transform(array({model}), z -> transform(w, x -> struct(x.votes as votes, x.n as n, 1D / (1D + exp(-{logit})) as q)))[0])[0]"
    return f"aggregate(sequence(1, {rounds}), {start}, (w, k) -> {step})"


def posteriors(patterns: DataFrame, rounds: int = 30) -> DataFrame:
    """patterns: votes array<int>, n. Returns votes, posterior of the good class; at most MOST_PATTERNS rows meet in one."""
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("v"))
    return one.select(F.explode(F.expr(_em(rounds))).alias("x")).select("x.votes", F.col("x.q").alias("posterior"))


def judge(spark: SparkSession, docs: DataFrame, rounds: int = 30) -> DataFrame:
    """features with base_failed, votes, posterior (null for a pattern that only failed documents have) and kept for each row of docs."""
    scratch = Scratch(spark, "quality")
    f = features(docs)
    f = f.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    f = f.withColumn("votes", F.expr("array(" + ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end" for bad, good in RULES.values()) + ")"))
    f = scratch.save(f, "features")
    by_pattern = scratch.save(posteriors(f.where("not base_failed").groupBy("votes").agg(F.count("*").alias("n")), rounds), "posteriors")
    # bounded by MOST_PATTERNS rows
    return f.join(F.broadcast(by_pattern), "votes", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("posterior") >= 0.5, F.lit(False)))
