"""Packing by column generation for the cutting-stock problem.

Every document's ids (with the end id) are cut into full sequences of `length` and a remainder.
Remainders, rounded up to GRAIN, form a histogram of at most length / GRAIN item types. A linear
program chooses how often to use each pattern (a multiset of types that fits a sequence); its dual
prices go to a knapsack dynamic program that finds the best new pattern, until none pays. Pattern
counts are rounded down and the few items left are packed first-fit decreasing. Documents' remainders
are ranked within their type, and a rank computes its sequence and its place there. A second plan gives
remainders of at most FINE sequences of their own, by exact lengths; the one with fewer sequences is taken.

The plan has at most FINE + length / GRAIN types and the driver sees only the histogram, so it does not
grow with the corpus; ranks are found in hash buckets, so no type meets in one task.

Nulls: a null text is the end id alone; null doc_ids and repeated rows are packed like any other.
An empty table gives an empty result. A text of any length is encoded whole and cut into as many
sequences as it fills. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.llm.shared import Scratch, ranked, ship, small_batches
from gazeloom.llm.tokens import encoder, vocabulary_path

#: Lengths of a plan are rounded up to GRAIN; in the second plan those up to FINE are exact.
GRAIN, FINE = 8, 64


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and counts of items of sizes 1..len(prices), any number of each, within the capacity."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    sizes = np.flatnonzero(prices > 0) + 1
    worth = prices[sizes - 1]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            values = best[c - sizes[:k]] + worth[:k]
            i = int(values.argmax())
            if values[i] > best[c - 1] + 1e-12:
                best[c], last[c] = values[i], sizes[i]
    counts, c = np.zeros(len(prices), np.int64), capacity
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def inverse_of(a: np.ndarray) -> np.ndarray:
    """Inverse of a small matrix by elimination with row pivots; no BLAS, whose threads may stall beside the driver's JVM."""
    n = len(a)
    work = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.abs(work[k:, k]).argmax())
        if p != k:
            work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        rows = np.flatnonzero(work[:, k])
        rows = rows[rows != k]
        work[rows] -= work[rows, k, None] * work[k]
    return work[:, n:]


def solve(demand: np.ndarray, rounds: int = 2000, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each, counts of sizes 1..n; a sequence holds n) and how often each is used in the relaxed optimum.

    Revised simplex: the basis begins with one pattern a type, filled with it; a priced column enters, the least ratio leaves.
    """
    n = len(demand)
    types = np.flatnonzero(demand)
    if not len(types):
        return np.zeros((0, n), np.int64), np.zeros(0)
    patterns = np.zeros((len(types), n), np.int64)
    patterns[np.arange(len(types)), types] = n // (types + 1)
    need = demand[types].astype(float)
    basis = patterns[:, types].T.astype(float)
    inverse = np.diag(1 / basis.diagonal())
    for k in range(rounds):
        prices = np.zeros(n)
        prices[types] = np.maximum(inverse.sum(axis=0), 0)
        value, column = knapsack(prices, n)
        if value <= 1 + gap:  # the dual bound: within this share of the optimum
            break
        column[np.setdiff1d(np.arange(n), types)] = 0
        use, step = (inverse * need).sum(axis=1), (inverse * column[types]).sum(axis=1)  # small: threads of a BLAS cost more than they save
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        patterns[out], basis[:, out] = column, column[types]
        if k % 50 == 49:
            inverse = inverse_of(basis)
        else:  # the entering column takes the leaving one's row
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
    return patterns, np.maximum((inverse_of(basis) * need).sum(axis=1), 0)


def plan(demand: np.ndarray) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each size: [(first rank, items a sequence, first sequence)], and the number of sequences. demand: counts of sizes 1..n."""
    n = len(demand)
    patterns, use = solve(demand)
    left = demand.astype(np.int64).copy()
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks, sequence = np.zeros(n, np.int64), 0

    def place(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        for t in np.flatnonzero(pattern):
            slots.setdefault(int(t) + 1, []).append((int(ranks[t]), int(pattern[t]), sequence))
            ranks[t] += pattern[t] * times
        left[:] -= pattern * times
        sequence += times

    for pattern, times in zip(patterns, np.floor(use + 1e-9).astype(np.int64)):
        # degenerate columns may cover more than there is
        has = pattern > 0
        times = min(int(times), int((left[has] // pattern[has]).min())) if has.any() else 0
        if times > 0:
            place(pattern, times)
    # the rest, largest first; each run of equal sequences is placed at once
    while left.any():
        pattern, room = np.zeros(n, np.int64), n
        for t in np.flatnonzero(left)[::-1]:
            pattern[t] = min(left[t], room // (t + 1))
            room -= pattern[t] * (t + 1)
        has = pattern > 0
        place(pattern, int((left[has] // pattern[has]).min()))
    return slots, sequence


def best_plan(demand: np.ndarray) -> tuple[dict[int, list[tuple[int, int, int]]], int, bool]:
    """(slots by size, number of sequences, whether sizes up to FINE are exact). demand: counts of sizes 1..n, above FINE only multiples of GRAIN and n."""
    n = len(demand)
    sizes = np.arange(1, n + 1)

    def coarse(counts: np.ndarray) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
        units = np.bincount(-(-sizes // GRAIN) - 1, weights=counts).astype(np.int64)
        if n % GRAIN:
            # what is rounded up past a sequence's end is alone in it
            over, units = int(units[-1]), units[:-1]
        slots, used = plan(units) if len(units) else ({}, 0)
        slots = {k * GRAIN: v for k, v in slots.items()}
        if n % GRAIN and over:
            slots[n], used = [(0, 1, used)], used + over
        return slots, used

    slots, used = coarse(demand)
    short = np.where(sizes <= FINE, demand, 0)
    if short.any():
        exact, first = plan(short)
        rest, more = coarse(demand - short)
        if first + more < used:
            exact |= {k: [(a, b, c + first) for a, b, c in v] for k, v in rest.items()}
            return exact, first + more, True
    return slots, used, False


def pieces(spark: SparkSession, docs: DataFrame, vocabulary: str | None, end: int, length: int, emit_ids: bool) -> DataFrame:
    """doc_id, row, start, length, ids_crc32, doc_tokens (and ids) of each piece."""
    vocabulary = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            ids, bounds = e.encode(batch.column("text").cast(pa.binary()).to_pylist(), end)
            raw, sizes = memoryview(ids.astype("<u4").tobytes()), np.diff(bounds)
            n = -(-sizes // length)
            which = np.repeat(np.arange(len(sizes)), n)
            start = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * length
            size = np.minimum(sizes[which] - start, length)
            first = bounds[which] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), size.tolist())]
            out = {"doc_id": batch.column("doc_id").take(pa.array(which)), "row": batch.column("row").take(pa.array(which)), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(sizes[which], pa.int64())}
            if emit_ids:
                out["ids"] = pa.array([ids[a : a + b].astype(np.int32) for a, b in zip(first.tolist(), size.tolist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * emit_ids
    return docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, schema)


def pack(spark: SparkSession, docs: DataFrame, length: int = 2048, vocabulary: str | None = None, end: int = 1, emit_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    ship(spark)
    small_batches(spark)
    scratch = Scratch(spark, "pack")
    all_pieces = scratch.save(pieces(spark, docs, vocabulary, end, length, emit_ids), "pieces")
    size = F.col("length")
    rounded = F.least(F.ceil(size / GRAIN) * GRAIN, F.lit(length)).cast("int")
    kind = F.when(size <= FINE, size.cast("int")).otherwise(rounded)
    rest = all_pieces.where(size < length)
    whole = all_pieces.where(F.col("length") == length)
    demand = np.zeros(length, np.int64)
    for r in rest.groupBy(kind.alias("kind")).count().collect():  # at most FINE + length / GRAIN rows
        demand[r["kind"] - 1] = r["count"]
    slots, n_sequences, fine = best_plan(demand)
    rest = rest.withColumn("kind", kind if fine else rounded)
    firsts = {k: np.array([x[0] for x in v]) for k, v in slots.items()}

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch.column("kind").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(kinds), np.int64)
            for k in np.unique(kinds):
                mine = np.flatnonzero(kinds == k)
                found = np.searchsorted(firsts[int(k)], ranks[mine], side="right") - 1
                table = np.array(slots[int(k)])[found]
                sequence[mine] = table[:, 2] + (ranks[mine] - table[:, 0]) // table[:, 1]
            keep = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence)], names=[*names, "sequence_id"])

    names = [c for c in all_pieces.columns]
    numbered = ranked(rest, ["kind"], ["row", "start"], "rank")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in all_pieces.schema)
    seated = numbered.mapInArrow(seat, f"{fields}, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy("row", "start")
    seated = seated.withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # full pieces are sequences of their own; their numbers follow, by document and start
    base = ranked_alone(whole, n_sequences)
    return seated.unionByName(base).drop("row")


def ranked_alone(whole: DataFrame, first: int) -> DataFrame:
    """Numbers from `first` for full pieces, without one task for all: ranks in hash buckets."""
    return ranked(whole.withColumn("all", F.lit(0)), ["all"], ["row", "start"], "rank").withColumn("sequence_id", F.col("rank") + first).withColumn("offset", F.lit(0).cast("long")).drop("all", "rank")
