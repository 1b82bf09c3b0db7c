"""Ranked lexical search by sort-based accumulation.

Each document's occurrences of query terms are postings, written once. In a task, the impact of every
posting is repeated for the items that ask for its term and packed with a key of item and document;
runs of keys are radix-sorted by two stable passes over 16-bit digits, and the sums of equal keys are
whole scores, as a document's postings lie in one row. Each item keeps a heap of its best `k` documents
in every task. These lists are dealt by ranges of item and document hash, reduced by heaps, dealt by
ranges of items, and reduced again, so that no task holds more than `k` documents an item at a time.

Items are asked in blocks of about PAIRS pairs of item and term (an item is not divided, so a block may
be as large as one item), and what the tasks get of a block is bounded by that: terms, their weights and
the items that ask for them.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z alone in lower
case. With N documents that hold a term, L terms of theirs with repeats, n those of one document, df
documents with a term and tf its occurrences: w = floor(1000 ln((2N + 2) / (2 df + 1))),
m = 10 + (90 n N) div L, and the score is the sum of w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms.

Nulls, empty texts and texts without a term match nothing, and an item without terms has no rows. Rows
with one item_id, or with a null one, are one item that has the terms of all. Equal scores are ranked by
doc_id, null ones last; repeated documents are ranked each. Texts of any length are read whole. Empty
tables give empty results. Other columns of both tables are not used.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.shared import Scratch, ship, small_batches

#: A term, for Spark's and DuckDB's regular expressions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs of item and term, and items, that a block holds on average.
PAIRS, ITEMS = 1_000_000, 40_000
#: Keys that are sorted at once, and the documents whose numbers fit 16 bits.
ENTRIES, DIGIT = 1 << 21, 1 << 16
#: Bytes outside of terms become blanks.
_BLANKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text; bytes beyond ASCII belong to characters that are all within terms."""
    return text.translate(_BLANKS).split()


class Questions:
    """A block of items: the number of each term, and the items of each term in one array."""

    def __init__(self, pairs: list[tuple[object, bytes]]):
        self.items = list(dict.fromkeys(i for i, _ in pairs))
        if len(self.items) > DIGIT:
            raise ValueError("a block holds at most 65,536 items")
        number = {x: k for k, x in enumerate(self.items)}
        self.terms: dict[bytes, int] = {}
        term = np.array([self.terms.setdefault(t, len(self.terms)) for _, t in pairs], np.int64)
        order = np.argsort(term, kind="stable")
        self.asks = np.array([number[i] for i, _ in pairs], np.uint16)[order]
        self.counts = np.bincount(term, minlength=len(self.terms))
        self.starts = np.cumsum(self.counts) - self.counts
        self.weights = np.zeros(len(self.terms), np.int64)


def radix_order(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order of packed keys, least digit first; both are 16-bit, for which the stable sort is a radix sort."""
    low = np.argsort(doc, kind="stable")
    return low[np.argsort(item[low], kind="stable")]


class Best:
    """The best k documents of each item: heaps whose first entry is the worst."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def add(self, item: int, score: int, doc: int | None) -> None:
        entry = (score, doc is not None, -(doc or 0))
        heap = self.heaps.setdefault(item, [])
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def floor(self, item: int) -> int:
        heap = self.heaps.get(item, ())
        return heap[0][0] if len(heap) == self.k else 1

    def rows(self) -> Iterator[tuple[int, int, int | None, int]]:
        """(item, rank, doc, score)"""
        for item in sorted(self.heaps):
            for rank, (score, real, doc) in enumerate(sorted(self.heaps[item], reverse=True), 1):
                yield item, rank, -doc if real else None, score


def accumulate(q: Questions, best: Best, docs: list[int | None], doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
    """Adds the scores of up to DIGIT documents. doc: their numbers, of each posting."""
    times = q.counts[term]
    after = np.cumsum(times)
    item = q.asks[np.repeat(q.starts[term] - after + times, times) + np.arange(after[-1] if len(after) else 0)]
    key, value = np.repeat(doc.astype(np.uint16), times), np.repeat(impact, times)
    order = radix_order(item, key)
    item, key, value = item[order], key[order], value[order]
    starts = np.flatnonzero((np.diff(item, prepend=item[:1] ^ 1) != 0) | (np.diff(key, prepend=key[:1]) != 0))
    if not len(starts):
        return
    score, item, key = np.add.reduceat(value, starts), item[starts], key[starts]
    bounds = np.flatnonzero(np.diff(item.astype(np.int64), prepend=-1))
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(item)]):
        own, one = score[a:b], int(item[a])
        least = best.floor(one)
        if b - a > best.k:
            least = max(least, int(np.partition(own, b - a - best.k)[b - a - best.k]))
        for k in np.flatnonzero(own >= least).tolist():
            best.add(one, int(own[k]), docs[int(key[a + k])])


def _rows(best: Best) -> Iterator[pa.RecordBatch]:
    rows = list(best.rows())
    for k in range(0, len(rows), 10_000):
        item, rank, doc, score = zip(*rows[k : k + 10_000])
        yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "rank": pa.array(rank, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})


RESULT = "item int, rank int, doc_id long, score long"


def postings(docs: DataFrame, q, most: int = DIGIT) -> DataFrame:
    """Of each document with a term: doc_id, n (all its terms), and the numbers and occurrences of query terms. q: a broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = q.value.terms.get
        for batch in batches:
            split = [terms_of(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n = np.fromiter(map(len, split), np.int64, len(split))
            number = np.fromiter((k for words in split for k in map(find, words, repeat(-1))), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(split)), n)[number >= 0]
            keys, tf = np.unique((doc << 32) | number[number >= 0], return_counts=True)
            bounds = pa.array(np.searchsorted(keys >> 32, np.arange(len(split) + 1)), pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(bounds, pa.array((keys & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def scores(found: DataFrame, q, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's best k documents of each item. found: postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = q.value, Best(k)
        docs: list[int | None] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        entries = 0

        def flush() -> None:
            nonlocal entries
            if held:
                accumulate(block, best, docs, *(np.concatenate(x) for x in zip(*held)))
            docs.clear(), held.clear()
            entries = 0

        for batch in batches:
            terms, tf = batch.column("terms"), batch.column("tf").flatten().to_numpy().astype(np.int64)
            number, sizes = terms.flatten().to_numpy(), terms.value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(batch)), sizes)
            m = 100 - 90 + (90 * batch.column("n").to_numpy() * n_docs) // n_terms
            impact = block.weights[number] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            asked = np.add.reduceat(np.append(block.counts[number], 0), np.append(0, np.cumsum(sizes))[:-1]) * (sizes > 0)
            ids, bounds, at = batch.column("doc_id").to_pylist(), np.append(0, np.cumsum(sizes)), 0
            total = np.cumsum(asked)
            while at < len(ids):
                # as many documents as fit, one at least where nothing is held
                fit = int(np.searchsorted(total, ENTRIES - entries + (total[at - 1] if at else 0), side="right")) - at
                fit = min(fit, DIGIT - len(docs), len(ids) - at)
                if fit <= 0 and docs:
                    flush()
                    continue
                fit = max(fit, 1)
                a, b = bounds[at], bounds[at + fit]
                held.append((doc[a:b] - at + len(docs), number[a:b], impact[a:b]))
                docs.extend(ids[at : at + fit])
                entries += int(asked[at : at + fit].sum())
                at += fit
        flush()
        yield from _rows(best)

    return found.mapInArrow(run, RESULT)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The best k of each item among the rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for item, doc, score in zip(*(batch.column(c).to_pylist() for c in ("item", "doc_id", "score"))):
                best.add(item, score, doc)
        yield from _rows(best)

    return lists.mapInArrow(run, RESULT)


def asked(items: DataFrame) -> DataFrame:
    """Distinct pairs of item_id and term."""
    return items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def search(spark: SparkSession, items: DataFrame, docs: DataFrame, k: int = 10, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item. items: item_id, text; docs: doc_id, text."""
    ship(spark)
    small_batches(spark)
    scratch = Scratch(spark, "search")
    wanted = scratch.save(asked(items), "asked")
    sizes = wanted.agg(F.count("*").alias("pairs"), F.count_distinct(F.struct("item_id")).alias("items")).first()
    blocks = max(1, math.ceil(sizes.pairs / pairs), math.ceil(sizes.items / ITEMS))
    results = [_block(spark, scratch, wanted, docs, k, b, blocks) for b in range(blocks)]
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out


def _block(spark: SparkSession, scratch: Scratch, wanted: DataFrame, docs: DataFrame, k: int, b: int, blocks: int) -> DataFrame:
    own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", F.lit("block")), F.lit(blocks)) == b)
    q = Questions([(r.item_id, r.term.encode()) for r in own.collect()])
    found = scratch.save(postings(docs, spark.sparkContext.broadcast(q)), f"postings{b}")
    whole = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # the block's terms at most
        q.weights[r.term] = math.floor(1000 * math.log((2 * whole.n + 2) / (2 * r.df + 1)))
    ready = spark.sparkContext.broadcast(q)
    # lists are written, as dealing by ranges reads its input twice
    lists = scratch.save(scores(found, ready, whole.n, max(1, whole.l), k), f"lists{b}")
    parted = lists.withColumn("hash", F.xxhash64("doc_id")).repartitionByRange("item", "hash")
    fewer = scratch.save(merged(parted, k), f"fewer{b}")
    final = merged(fewer.repartitionByRange("item"), k)
    names = spark.createDataFrame([(n, x) for n, x in enumerate(q.items)], f"item int, item_id {dict(wanted.dtypes)['item_id']}")
    return final.join(names, "item").select("item_id", "rank", "doc_id", "score")
