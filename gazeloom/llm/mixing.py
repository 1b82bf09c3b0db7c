"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Targets: sources in code-point order (null last) get the weights in turn; shares of `epochs`
times all words are capped at `repeats` times a source's words and the excess is reshared by
weight. A schedule of golden-ratio points, mapped through the cumulative targets, names the
source of every slot; the slots of a source are ranked, and the r-th takes the source's r-th
block of `block` words. Blocks cut the source's documents laid end to end in the order of
md5(doc_id:seed); when all are taken, the next pass begins. A slot that would pass the target
is cut there; sources that the schedule leaves short get the missing slots at its end.

Nulls: a null text has no words; null sources are one source; null doc_ids are shuffled by
the hash of an empty id. Documents without words are returned with taken 0. Repeated rows are
told apart by a row number, so each takes its own share. Empty tables give empty results.
A text of any length is counted whole, and lies in as many blocks as it has words for. Extra
columns come along if they are named in `keep`, whatever they are called; those that have a name
of the result give way. The windows over sources hold a row for each source on one task: for
some millions of sources (domains, say) that is a few hundred megabytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.llm.shared import Scratch, n_words

#: 2**32 divided by the golden ratio.
GOLDEN = 2654435769
POINTS = 1 << 32


def targets(sizes: DataFrame, weights=(5, 2, 1), epochs: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row a source: sid, source, source_size, weight, target. sizes: source, size. One row for each source is what the windows hold."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * repeats).withColumn("fill", F.col("cap") / F.col("weight"))
    up = Window.orderBy("fill", "sid")
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(epochs)) - F.col("capped")) / F.col("open"))
    # sources in order of cap by weight: the first whose cap holds its share ends the capped ones
    per = per.withColumn("final", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "sid", "level"))).over(whole))
    under = (F.col("fill") < F.col("final.fill")) | ((F.col("fill") == F.col("final.fill")) & (F.col("sid") < F.col("final.sid"))) | F.col("final").isNull()
    return per.select("sid", "source", "source_size", "weight", F.when(under, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final.level")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights=(5, 2, 1), epochs: float = 1.5, repeats: int = 2, seed: str = "mix", block: int | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, size, source_size, target, taken and `keep`; the schedule: slot, sid, block, words).

    block: words of a block; by default a two-millionth of all words, between 64 and 8192.
    """
    scratch = Scratch(spark, "mix")
    # under neutral names inside, so that none is taken for a column of a step
    named_as = {f"__keep{k}": c for k, c in enumerate(c for c in keep if c.lower() not in ("doc_id", "size", "source_size", "target", "taken"))}
    keep = tuple(named_as)
    sized = docs.select("doc_id", "source", *(F.col(f"`{c}`").alias(k) for k, c in named_as.items()), n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("__row"))
    sized = scratch.save(sized, "sized")
    per = targets(sized, weights, epochs, repeats)
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    block = block or min(8192, max(64, total // 2_000_000))
    whole = Window.partitionBy(F.lit(0)).orderBy("sid")
    run = F.coalesce(F.sum("target").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    every = F.sum("target").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("quota", F.floor("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    per = per.withColumn("lo", F.floor(F.when(every > 0, run / every * POINTS)).cast("long")).withColumn("hi", F.floor(F.when(every > 0, (run + F.col("target")) / every * POINTS)).cast("long"))
    per = per.withColumn("needed", F.when(F.col("source_size") > 0, F.expr("quota div source_size") * F.col("blocks") + F.ceil((F.col("quota") % F.col("source_size")) / block)).otherwise(0).cast("long"))
    per = scratch.save(per, "sources")
    slots = per.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0]

    # point -> source: an equi-join on cells of the unit interval, each source listed in the cells it meets
    bits = 22
    cells = per.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright(F.col("hi") - 1, bits))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % POINTS) * GOLDEN % POINTS).alias("point")).withColumn("cell", F.shiftright("point", bits))
    drawn = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "sid", F.expr("slot div 65536").alias("chunk"))
    drawn = scratch.save(drawn, "drawn")
    # rank of a slot in its source: ranks in chunks of the schedule, after the counts of earlier chunks
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n")).select("sid", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    turn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(starts, ["sid", "chunk"]).select("slot", "sid", (F.col("r") + F.col("first")).alias("turn"))
    short = per.join(drawn.groupBy("sid").agg(F.count("*").alias("n")), "sid", "left").select("sid", "needed", F.coalesce("n", F.lit(0)).alias("n")).where("needed > n")
    tail = short.select("sid", F.explode(F.sequence(F.col("n"), F.col("needed") - 1)).alias("turn")).select((F.lit(slots) + F.col("turn")).alias("slot"), "sid", "turn")
    turns = turn.union(tail).join(per.select("sid", "needed", "blocks", "source_size", "quota"), "sid").where("turn < needed")
    turns = turns.withColumn("block", F.col("turn") % F.col("blocks")).withColumn("at", F.expr("turn div blocks") * F.col("source_size") + F.col("block") * block)
    turns = turns.select("slot", "sid", "block", F.least(F.least(F.lit(block), F.col("source_size") - F.col("block") * block), F.col("quota") - F.col("at")).alias("words"))

    # documents end to end in hash order: sums in 4096 hash buckets, after the sums of earlier buckets
    named = sized.drop(*keep).join(per.select("sid", "source", "source_size", "target"), sized["source"].eqNullSafe(per["source"])).drop(per["source"])
    named = named.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))).withColumn("bucket", F.substring("key", 1, 3))
    sums = named.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size", "__row").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("first"))
    cut = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))))
    cut = cut.withColumn("from", F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).withColumn("to", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    taken = cut.join(turns, ["sid", "block"], "left").withColumn("n", F.greatest(F.least(F.col("to"), F.coalesce("words", F.lit(0))) - F.col("from"), F.lit(0)))
    own = ["doc_id", "size", "source_size", "target"]
    result = taken.groupBy("__row", *own).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("taken"))
    if keep:  # wide columns join at the end and are never exploded
        result = result.join(sized.select("__row", *keep), "__row")
    return result.select(*own, *(F.col(k).alias(c) for k, c in named_as.items()), "taken"), turns
