"""Sharding by a Feistel permutation of global row numbers.

Rows get numbers 0..n-1 in the order of (doc_id, size, crc); an unbalanced Feistel network over
a*b >= n, a and b near the root of n, permutes them, walking a cycle on while the image is n or
more. The image modulo the shards is the shard, the quotient the slot: shard counts differ by
one at most, slots are gapless, and a row's place can be computed from its number alone.

Nulls: a null text has no bytes and crc 0; null doc_ids are numbered first. Rows that are equal
in all three columns are interchangeable. An empty table gives an empty result.
A text of any length counts by its bytes. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.shared import Scratch, ship

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser keyed by round and seed."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(seed: int) -> list[int]:
    return [int(_mixed(np.array([seed * 1_000_003 + k], dtype=np.uint64), 0x9E3779B97F4A7C15)[0]) for k in range(ROUNDS)]


def permuted(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The images of row numbers below n under the seed's permutation of 0..n-1."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    keys = round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // np.uint64(b), x % np.uint64(b)
        for k, key in enumerate(keys):
            if k % 2:
                right = (right + _mixed(left, key)  % np.uint64(b)) % np.uint64(b)
            else:
                left = (left + _mixed(right, key) % np.uint64(a)) % np.uint64(a)
        return left * np.uint64(b) + right

    with np.errstate(over="ignore"):
        out = once(rows.astype(np.uint64))
        while len(away := np.flatnonzero(out >= np.uint64(n))):
            out[away] = once(out[away])
    return out.astype(np.int64)


def numbered(spark: SparkSession, df: DataFrame, order: list[str], scratch: Scratch, out: str = "row_number") -> tuple[DataFrame, int]:
    """df with its rows' numbers in `order`, and their count: a range partitioning is written once; partition counts (a row each) give the offsets."""
    low = 33  # monotonically_increasing_id keeps the partition above these bits
    cut = scratch.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    counts = cut.groupBy(F.shiftright("__id", low).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, total = {}, 0
    for r in counts:
        starts[r.p], total = total, total + r.n
    firsts = spark.createDataFrame(sorted(starts.items()) or [(0, 0)], "p long, first long")
    return cut.withColumn("p", F.shiftright("__id", low)).join(firsts, "p").withColumn(out, F.col("first") + F.col("__id").bitwiseAND((1 << low) - 1)).drop("p", "first", "__id"), total


def shard(spark: SparkSession, docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for each row of docs."""
    ship(spark)
    scratch = Scratch(spark, "shard")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    rows, n = numbered(spark, rows, ["doc_id", "size", "text_crc32"], scratch)

    @F.pandas_udf("long")
    def place(x):
        import pandas as pd

        return pd.Series(permuted(x.to_numpy(), n, seed))

    return rows.withColumn("place", place("row_number")).select("doc_id", "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))
