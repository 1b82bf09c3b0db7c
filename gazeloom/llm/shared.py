"""What the corpus operators share: scratch tables, shipping, ranks, connected components."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r "


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one only in local mode where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='gazeloom-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.dir = spark, f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark delete the shuffle files of jobs that are done; it does so when the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        remove(self.spark, self.path(name))

    def close(self) -> None:
        try:
            remove(self.spark, self.dir)
        except Exception:  # noqa: BLE001 - the JVM may be gone when the interpreter ends
            pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, for those that have no copy on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


#: What a worker keeps for its next tasks, by operator.
_kept: dict[str, dict] = {}


def kept(operator: str, cache: dict) -> dict:
    """Names an operator's cache, so that the worker can let go of it."""
    _kept[operator] = cache
    return cache


def alone(operator: str) -> None:
    """At a task's start: a worker that comes from another operator's tasks drops what that one kept, so caches of several never add up."""
    for name, cache in _kept.items():
        if name != operator:
            cache.clear()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the bytes of an Arrow batch, and its rows to `rows` or what the session has less, so that a batch of long texts fits a Python worker.

    The query runs after this call, so the session keeps the bounds.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int = 4096) -> DataFrame:
    """Adds the 0-based rank of each row in its group, without a window over a whole group.

    Rows are ranked inside hash buckets of the order columns; the buckets' counts give each
    bucket's first rank. A group with a third of all rows is spread over `buckets` windows.
    df is read twice, so pass a written table.
    """
    b = "__bucket"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*group, b).agg(F.count("*").alias("__n")).select(*group, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)) - 1)
    return inside.join(starts, [*group, b]).withColumn(out, F.col("__rank") + F.col("__start")).drop(b, "__rank", "__start")


#: A key with more than one in HEAVY of all rows is dealt to several tasks; at most HEAVY keys are heavy.
HEAVY = 1000


def heavy_join(left: DataFrame, counts: DataFrame, key: str, n: str, spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with counts (a row a key; n: how many rows of left have it), and a column __salt.

    Rows of a heavy key are dealt by the hash of `spread`, and its row of counts is repeated for each share. The list
    of heavy keys is broadcast: HEAVY rows at most. counts is read several times, so pass a written table.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    heavy = F.broadcast(counts.where(F.col(n) * HEAVY > total).select(key, F.ceil(F.col(n) * HEAVY / F.lit(max(1, total))).cast("int").alias("__salts")))
    salt = F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.col("__salts"))).cast("int")
    left = left.join(heavy, key, "left").withColumn("__salt", salt).drop("__salts")
    counts = counts.join(heavy, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(counts, [key, "__salt"], how)


def internal(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before those that a table's columns have (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) of the nodes of `edges` (long columns): root is the least node that is reachable.

    Alternating large-star and small-star rounds until the edges are stars; every round is written to the scratch folder.
    Minima are partially aggregated, and joins are on the node with rows that AQE can split.
    Nodes that have no edge to another node are not listed.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = scratch.save(e, "star0")
    for k in range(1, most + 1):
        # done when edges are stars: a node has one edge upwards, or is a root
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or up = 1 and down = 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"large{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.save(small, f"star{k}")
        scratch.drop(f"large{k}")
        scratch.drop(f"star{k - 1}")
    raise RuntimeError(f"components did not settle in {most} rounds")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def hadoop_listing(spark: SparkSession, path: str) -> Iterable[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    for x in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target):
        yield x.getPath().toString()
