"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors of a label are one node with a count. A node's signs against random hyperplanes are
its sketch; `bits` of them are its bucket in a table, and there are enough tables that a pair at the
threshold shares a bucket with probability `recall` (closer pairs with more). What is dealt by bucket
is the node's number and sketch, never its vector. Buckets larger than BLOCK are split into blocks, and
every pair of blocks is a unit of its own, so a bucket of any size is compared whole.

In a unit, nodes whose sketches differ in no more signs than a pair at the threshold does, by six
standard deviations, are candidates, each pair in the first table that joins it. Vectors join the
groups that candidates form, where all cosines are computed in double precision; a node's links are
summed there, and only a spanning star of linked nodes leaves a group, never the pairs. So vectors
travel only for nodes with a likely partner, once for each table in which they meet a new one.

Nulls: vectors that are null, zero, or hold null or non-finite components, and those without a label,
link with nothing and are components of their own, as are null vec_ids. Vectors of other lengths
don't link. Repeated rows count as other vectors. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.jaccard_trie import runs
from gazeloom.llm.shared import Scratch, components, heavy_join, ship, small_batches

BLOCK = 2048
#: A list of so many large buckets is broadcast.
LISTED = 100_000


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables): buckets of about 256 of n spread vectors, and enough tables for the recall at the threshold."""
    p = 1 - math.acos(threshold) / math.pi
    bits = min(24, max(4, round(math.log2(max(n, 1) / 256))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p**bits))


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least one reachable over the edges a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def codes_of(sketches: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """[node, table]: the buckets in sketches of packed signs."""
    signs = np.unpackbits(sketches.view(np.uint8), axis=1, count=bits * tables, bitorder="little").reshape(len(sketches), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int32))).sum(axis=2, dtype=np.int32)


def candidates(sketches: np.ndarray, codes: np.ndarray, table: int, sides: np.ndarray | None, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the nodes whose sketches differ in `most` signs or fewer and that no earlier table joins; not all such pairs."""
    n, found = len(sketches), []
    for i in range(0, n - 1, 128):
        rows = sketches[i : i + 128]
        a, b = np.nonzero(np.bitwise_count(rows[:, None, :] ^ sketches[None, i:, :]).sum(axis=2, dtype=np.int32) <= most)
        keep = a < b
        a, b = a[keep] + i, b[keep] + i
        if sides is not None:
            keep = sides[a] != sides[b]
            a, b = a[keep], b[keep]
        for j in range(0, len(a), 200_000):
            x, y = a[j : j + 200_000], b[j : j + 200_000]
            fresh = ~(codes[x, :table] == codes[y, :table]).any(axis=1)
            x, y = x[fresh], y[fresh]
            if len(x):
                # a spanning star of the edges is as good as all of them
                root = rooted(n, x, y)
                away = np.flatnonzero(root != np.arange(n))
                found.append((away, root[away]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found))


def group_links(vectors: np.ndarray, codes: np.ndarray, counts: np.ndarray, table: int, sides: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector, least linked index of each) within a group; sides: where only pairs across count. A pair that an earlier table joins counts there."""
    n = len(vectors)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for i in range(0, n, 256):
        a, b = np.nonzero(vectors[i : i + 256] @ vectors.T >= threshold)
        a += i
        keep = a < b
        if sides is not None:
            keep &= sides[a] != sides[b]
        a, b = a[keep], b[keep]
        for j in range(0, len(a), 200_000):
            x, y = a[j : j + 200_000], b[j : j + 200_000]
            fresh = ~(codes[x, :table] == codes[y, :table]).any(axis=1)
            x, y = x[fresh], y[fresh]
            links += np.bincount(x, counts[y], n).astype(np.int64) + np.bincount(y, counts[x], n).astype(np.int64)
            root = rooted(n, np.concatenate([x, np.arange(n)]), np.concatenate([y, root]))
    return links, root


def unit_vectors(lists: list, size: int) -> np.ndarray:
    v = np.array(lists, np.float64).reshape(len(lists), size)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, recall: float = 0.9995, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    ship(spark)
    small_batches(spark, 4096)
    scratch = Scratch(spark, "vectors")
    e = F.col("embedding")
    usable = F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(seed), F.size("embedding"), "embedding"))
    group = ["label", "h1", "h2"]
    nodes = rows.where("usable").groupBy(*group).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    per_label = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    bits, tables = tables_for(per_label, threshold, recall)

    width = -(-max(256, bits * tables) // 64) * 64
    p = math.acos(threshold) / math.pi
    most = width * p + 6 * math.sqrt(width * p * (1 - p))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for first in range(0, len(whole), step := max(1, 1_000_000 // width)):
                batch = whole.slice(first, step)
                lists = batch.column("embedding").to_pylist()
                sizes = np.array(list(map(len, lists)))
                for d in np.unique(sizes).tolist():
                    mine = np.flatnonzero(sizes == d)
                    if d not in planes:
                        planes[d] = np.random.default_rng([seed, d]).standard_normal((d, width))
                    signs = np.packbits(unit_vectors([lists[k] for k in mine], d) @ planes[d] > 0, axis=1, bitorder="little")
                    codes, raw = codes_of(signs, bits, tables), pa.array([x.tobytes() for x in signs], pa.binary())
                    part = [batch.column(c).take(pa.array(mine)) for c in ("node", "label")]
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([*part, pa.array(np.full(len(mine), d, np.int32)), pa.array(np.full(len(mine), t, np.int32)), pa.array(codes[:, t]), raw], names=["node", "label", "size", "table", "bucket", "sketch"])

    label = vectors.schema["label"].dataType.simpleString()
    dealt = nodes.select("node", "label", "embedding").mapInArrow(hashed, f"node long, label {label}, size int, table int, bucket int, sketch binary")
    bucket = ["label", "size", "table", "bucket"]
    dealt = scratch.save(dealt.withColumn("b", F.xxhash64(*bucket)), "dealt")
    # buckets that share a hash are split alike, and told apart where nodes are compared
    large = dealt.groupBy("b").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
    large = scratch.save(large.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "large")
    if large.count() <= LISTED:
        placed = dealt.join(F.broadcast(large.drop("members")), "b", "left")
    else:
        placed = heavy_join(dealt, large, "b", "members", ["node"], "left").drop("members", "__salt")
    # the units of a large bucket: pairs (x, y) of blocks; a node goes to the units that have its block
    block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    placed = placed.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    unit = [*bucket, "x", "y"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() << 40
        for part in runs(batches, unit):
            if len(part) < 2:
                continue
            sketch = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint64).reshape(len(part), -1)
            x, y, table = (part[c][0].as_py() for c in ("x", "y", "table"))
            sides = part["block"].to_numpy() if x != y else None
            a, b = candidates(sketch, codes_of(sketch, bits, tables), table, sides, most)
            some = np.unique(np.concatenate([a, b]))
            if not len(some):
                continue
            _, which = np.unique(rooted(len(part), a, b)[some], return_inverse=True)
            take = pa.array(some)
            yield pa.RecordBatch.from_pydict({"group": group + which, "table": np.full(len(some), table, np.int32), "side": (np.zeros(len(some), np.int32) if sides is None else 1 + (sides[some] == y).astype(np.int32)), "node": part["node"].to_numpy()[some], "sketch": part["sketch"].combine_chunks().take(take)})
            group += int(which.max()) + 1

    units = placed.select("node", "sketch", "block", *unit).repartition(*unit).sortWithinPartitions(*unit)
    pairs = scratch.save(units.mapInArrow(met, "group long, table int, side int, node long, sketch binary"), "candidates")
    scratch.drop("dealt")
    scratch.release()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["group"]):
            lists = part["embedding"].to_pylist()
            sketch = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint64).reshape(len(part), -1)
            side = part["side"].to_numpy()
            links, root = group_links(unit_vectors(lists, len(lists[0])), codes_of(sketch, bits, tables), part["n"].to_numpy(), part["table"][0].as_py(), side if side[0] else None, threshold)
            node, hit = part["node"].to_numpy(), np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_pydict({"node": node[hit], "links": links[hit], "root": node[root[hit]]})

    grouped = pairs.join(nodes.select("node", "n", "embedding"), "node").repartition("group").sortWithinPartitions("group")
    links = scratch.save(grouped.mapInArrow(linked, "node long, links long, root long"), "links")
    scratch.release()
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(scratch, links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.drop("embedding").join(sums, "node", "left").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = scratch.save(known, "known")
    first = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(first, "root").select(*group, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    keys = [rows[c].eqNullSafe(known[c]) if c == "label" else rows[c] == known[c] for c in group]
    out = rows.join(known, [*keys][0] & keys[1] & keys[2] & rows["usable"], "left")
    out = out.select(rows["vec_id"], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", rows["vec_id"]).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
