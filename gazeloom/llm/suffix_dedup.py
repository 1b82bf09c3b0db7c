"""Suffix-array deduplication: bytes of strings of `length` bytes that also start elsewhere are removed.

Anchors. In each run of length - GRAM + 1 GRAM-grams of a text, the one with the least hash is an
anchor, so equal strings of `length` bytes hold an anchor at the same place. An anchor's context is
what a string holding it can reach; an anchor that comes once has no equal string around it.

Columns. Contexts of repeated anchors are the collection; equal ones (by a 64-bit hash) are one entry
with a weight, and as its copies share all of it, it is covered whole; it goes through the rounds only
where different contexts share a half with it.
Its suffixes are ordered column by column, from the last: each round inserts one symbol of every
context before its suffix, sorts by that symbol and the order so far (the step of a multi-document
Burrows-Wheeler construction), and updates the common prefixes of neighbours. A round reads its
column from a sequential file in the shared folder and appends its part of the transform (the
symbols before the suffixes) and of the common prefixes to others. A second pass reads these: of
suffixes that share length - 1 bytes, those with the same symbol in the transform are the ends of
strings of `length` bytes that come again, one byte further left. As contexts are aligned at their
anchors, equal strings meet in one round, so each round's part is kept by itself rather than merged
with those of shorter suffixes.

Contexts are dealt by the longer half of what their strings must share (the anchor and the bytes
left or right of it), and batched, so a task holds a bounded collection. A group of more than MOST
contexts, which a frequent passage with ever different surroundings makes, is divided: strings that
start in the first or the second half of the group's range of places share more bytes, and are dealt
by these; and so on, until what they share is the whole string.

Nulls: a null text is empty. Null doc_ids are told apart by their texts. Repeated rows are texts
that repeat. Texts shorter than `length` keep all. Empty tables give empty results. Extra columns are
kept; one named n_removed gives way to the result's.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.jaccard_trie import mixed, runs
from gazeloom.llm.shared import Scratch, alone, heavy_join, internal, ship, small_batches
from gazeloom.llm.token_codes import folder

GRAM, SLICE = 32, 1 << 18
MOST, BATCH = 50_000, 8_000
ABSENT = 256
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    """base**0..base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_UP = _powers(_P, SLICE + 2048)
_DOWN = _powers(pow(_P, -1, 1 << 64), SLICE + 2048)


class Hashes:
    """Hashes of any window of up to SLICE + 2047 bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _UP[: len(data)])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def _lowest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: position, hash, keys of its left and right halves (0 where the text is too short), and hash of its context."""
    n, reach, half = len(text), length - GRAM, (length - GRAM) // 2
    data, out = np.frombuffer(text, np.uint8), []
    for first in range(0, n - length + 1, SLICE):
        # string starts first..last; their contexts need `reach` bytes before and `length` after
        last = min(first + SLICE, n - length + 1) - 1
        base, stop = max(0, first - reach), min(n, last + reach + length + reach)
        part = data[base:stop]
        h = Hashes(part)
        at = np.arange(first - base, last - base + reach + 1)
        grams = h(at, at + GRAM)
        order = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(at), dtype=np.uint64)
        low = _lowest(order, reach + 1)
        at = at[np.unique(low & np.uint64(0xFFFFF)).astype(np.int64)]
        lo, hi = np.maximum(at + base - reach, 0) - base, np.minimum(at + base + length, n) - base
        left = np.where(at - half >= lo, h(np.maximum(at - half, 0), at + GRAM), 0)
        right = np.where(at + GRAM + half <= hi, mixed(h(at, np.minimum(at + GRAM + half, len(part))) + np.uint64(1)), 0)
        context = mixed(h(lo, hi) + mixed((at - lo).astype(np.uint64)))
        out.append((at + base, h(at, at + GRAM), left, right, context))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at, *rest = (np.concatenate(x) for x in zip(*out))
    at, keep = np.unique(at, return_index=True)  # slices meet
    return at, *(x[keep].view(np.int64) for x in rest)


def collection_spans(contexts: list[bytes], lefts: np.ndarray, weights: np.ndarray, length: int, place: str) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) bytes left of its anchor at which a string of each context starts that comes again; -1 for none.

    Column-wise construction over all contexts, each there `weights` times; see the module's text. place: a folder for its files.
    """
    m, reach = len(contexts), length - GRAM
    width = reach + length
    sizes = np.array([len(c) for c in contexts])
    columns = np.full((m, width), ABSENT, np.uint16)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns[np.repeat(np.arange(m), sizes), np.repeat(reach - lefts, sizes) + inside] = flat
    least, most = np.full(m, -1), np.full(m, -1)
    store, root = fs.FileSystem.from_uri(folder(place))
    names = [f"{root}/{uuid.uuid4().hex}.{k}" for k in ("symbols", "transform", "prefixes", "order")]
    with store.open_output_stream(names[0], compression=None) as f:
        f.write(np.ascontiguousarray(columns[:, ::-1].T))
    del columns
    symbols = store.open_input_stream(names[0], compression=None)
    column = lambda: np.frombuffer(symbols.read(2 * m), np.uint16)
    transform, prefixes, orders = (store.open_output_stream(x, compression=None) for x in names[1:])
    order, common, now = np.arange(m), np.zeros(m + 1, np.int16), column()
    for k in range(width - 1):  # the transform names the last column's symbols
        then = column()
        symbol = now[order]
        to = np.argsort(symbol, kind="stable")
        symbol = symbol[to]
        same = (symbol[1:] == symbol[:-1]) & (symbol[1:] != ABSENT)
        # least common prefix between former places; mostly neighbours
        a, b = to[:-1], to[1:]
        low = common[b]
        far = np.flatnonzero(same & (b != a + 1))
        if len(far):
            low = low.copy()
            low[far] = np.minimum.reduceat(common, np.stack([a[far] + 1, b[far] + 1], axis=1).ravel())[::2]
        order = order[to]
        common = np.zeros(m + 1, np.int16)
        common[1:m] = np.where(same, np.minimum(low + 1, length), 0)
        if k >= length - 2:
            transform.write(then[order]), prefixes.write(common), orders.write(order.astype(np.int32))
        now = then
    for f in (symbols, transform, prefixes, orders):
        f.close()
    after = sizes - lefts
    transform, prefixes, orders = (store.open_input_stream(x, compression=None) for x in names[1:])
    for s in range(-1, reach):
        # suffixes that start s bytes left of the anchor, and the symbols before them
        before, common, order = np.frombuffer(transform.read(2 * m), np.uint16), np.frombuffer(prefixes.read(2 * (m + 1)), np.int16), np.frombuffer(orders.read(4 * m), np.int32)
        near = common[1:m] >= length - 1
        group, weight = np.concatenate([[0], np.cumsum(~near)]), weights[order]
        several = (weight > 1) & (after[order] + s >= length - 1)
        several[1:] |= near
        several[:-1] |= near
        some = np.flatnonzero(several & (before != ABSENT))
        if len(some):
            _, which = np.unique(group[some] * ABSENT + before[some], return_inverse=True)
            again = order[some[np.bincount(which, weight[some])[which] > 1]]
            most[again] = s + 1
            fresh = again[least[again] < 0]
            least[fresh] = s + 1
    for f, x in zip((None, transform, prefixes, orders), names):
        if f:
            f.close()
        store.delete_file(x)
    return least, most


def _occurrences(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("suffixes")
        for batch in batches:
            out, counts = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                out.append(anchors(text or b"", length))
                counts.append(len(out[-1][0]))
            which = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [np.concatenate(x) for x in zip(*out)] if out else []
            if len(which):
                yield pa.RecordBatch.from_arrays([batch.column("key").take(which), batch.column("th").take(which), *(pa.array(c.astype(np.int64)) for c in columns)], names=["key", "th", "at", "anchor", "left", "right", "context"])

    return run


def divided(length: int):
    """For rows of (context, n, lead, body, a, b): the two halves of the places a..b at which strings may start, with a hash of what all those strings share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for context, n, lead, body, a, b in zip(*(batch.column(c).to_pylist() for c in ("context", "n", "lead", "body", "a", "b"))):
                middle = (a + b) // 2
                for x, y in ((a, middle), (middle + 1, b)):
                    if x <= lead and length - y <= len(body) - lead:
                        out.append((context, n, xxhash.xxh64_intdigest(body[lead - x : lead + length - y], x << 32 | y), x, y))
            if out:
                context, n, key, a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(context, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["context", "n", "half", "a", "b"])

    return run


def grouped(entries: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Entries (context, n, half, a, b) whose half several contexts share, with their number (members)."""
    sizes = entries.groupBy("half").agg(F.count("*").alias("members")).where("members > 1")
    return scratch.save(heavy_join(entries, scratch.save(sizes, f"{name}-sizes"), "half", "members", ["context"]).drop("__salt"), name)


def repeats(spark: SparkSession, docs: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, list[str], DataFrame]:
    """(docs with two columns that name a row's text, their names; key, th, spans: array of (start, end) to remove, which may overlap and pass the end)."""
    ship(spark)
    small_batches(spark, 512)
    reach = length - GRAM
    half = reach // 2
    own = internal(docs.columns, "key", "th")
    keyed = docs.withColumn(own[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(own[1], F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = keyed.select(F.col(own[0]).alias("key"), F.col(own[1]).alias("th"), "text")
    schema = "key long, th long, at long, anchor long, left long, right long, context long"
    every = scratch.save(texts.mapInArrow(_occurrences(length), schema), "anchors")
    again = scratch.save(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "again")
    found = scratch.save(heavy_join(every, again, "anchor", "n", ["key", "th", "at"]).drop("anchor", "n", "__salt"), "repeated")
    scratch.drop("anchors"), scratch.drop("again")
    scratch.release()
    place = F.struct("key", "th", "at")
    distinct = found.groupBy("context", "left", "right").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    distinct = scratch.save(distinct.select("context", "n", "place.*", "left", "right"), "contexts")

    # the copies of a context share all of it; rounds are for halves that different contexts share
    whole = distinct.where("n > 1").select("context", "n", F.lit(-reach).cast("long").alias("lo"), F.lit(length).cast("long").alias("hi"))
    ways = F.array(F.struct(F.col("left").alias("half"), F.lit(half).alias("a"), F.lit(reach).alias("b")), F.struct(F.col("right").alias("half"), F.lit(0).alias("a"), F.lit(half).alias("b")))
    entries = distinct.select("context", "n", F.explode(ways).alias("w")).select("context", "n", "w.*").where("half != 0")
    shared = grouped(entries, scratch, "halves")
    places = distinct.join(shared.select("context").distinct(), "context")
    wanted = places.groupBy("key", "th").agg(F.collect_list(F.struct("at", "context", "n")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a task cuts equal rows (doc_id and text) once
        for batch in batches:
            context, n, left, body = [], [], [], []
            for key, th, text, wants in zip(*(batch.column(c).to_pylist() for c in ("key", "th")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist()):
                if (key, th) in seen:
                    continue
                seen.add((key, th))
                for p in wants:
                    lo = max(0, p["at"] - reach)
                    context.append(p["context"]), n.append(p["n"]), left.append(p["at"] - lo), body.append(text[lo : p["at"] + length])
            if context:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (context, n, left)), pa.array(body, pa.binary())], names=["context", "n", "lead", "body"])

    # equal rows (doc_id and text) have equal contexts: one of them is enough
    bodies = texts.join(wanted, ["key", "th"]).mapInArrow(cut, "context long, n long, lead long, body binary").dropDuplicates(["context"])
    bodies = scratch.save(bodies, "bodies")
    scratch.release()
    small, level = shared.where(F.col("members") <= MOST), 0
    large = shared.where(F.col("members") > MOST)
    while not large.isEmpty():  # once for each halving of the places, log2(reach) times at most
        level += 1
        parts = bodies.join(large.select("context", "a", "b"), "context").mapInArrow(divided(length), "context long, n long, half long, a int, b int")
        parts = grouped(scratch.save(parts, f"parts{level}"), scratch, f"divided{level}")
        whole = whole.union(parts.where("a = b").select("context", "n", (-F.col("a")).cast("long").alias("lo"), (length - F.col("b")).cast("long").alias("hi")))
        small = small.unionByName(parts.where((F.col("members") <= MOST) & (F.col("a") < F.col("b"))))
        large = parts.where((F.col("members") > MOST) & (F.col("a") < F.col("b")))
    dealt = bodies.join(small.select("context", "half"), "context")
    rounds = scratch.path("rounds")

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[bytes, int, int]] = {}

        def spans() -> pa.RecordBatch:
            names, n = np.array(list(waiting), np.int64), np.array([x[2] for x in waiting.values()], np.int64)
            least, most = collection_spans([x[0] for x in waiting.values()], np.array([x[1] for x in waiting.values()]), n, length, rounds)
            hit = np.flatnonzero(least >= 0)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (names[hit], n[hit], -most[hit], length - least[hit])], names=["context", "n", "lo", "hi"])

        for part in runs(batches, ["half"]):
            for context, n, lead, body in zip(*(part[c].to_pylist() for c in ("context", "n", "lead", "body"))):
                waiting[context] = (body, lead, n)  # a context that comes by both halves is inserted once
            if len(waiting) >= BATCH:
                yield spans()
                waiting.clear()
        if waiting:
            yield spans()

    by_columns = dealt.repartition("half").sortWithinPartitions("half").mapInArrow(columns, "context long, n long, lo long, hi long")
    by_context = by_columns.union(whole).groupBy("context").agg(F.max("n").alias("n"), F.collect_set(F.struct("lo", "hi")).alias("parts"))
    by_context = scratch.save(by_context, "spans-of-contexts")
    for name in ("contexts", "halves", "halves-sizes", "bodies"):
        scratch.drop(name)
    scratch.release()
    hits = heavy_join(found.select("context", "key", "th", "at"), by_context, "context", "n", ["key", "th", "at"])
    hits = hits.select("key", "th", F.transform("parts", lambda p: F.struct(F.greatest(F.col("at") + p["lo"], F.lit(0)).alias("start"), (F.col("at") + p["hi"]).alias("end"))).alias("parts"))
    # a set, as rows equal in doc_id and text have the same spans at the same places
    spans = hits.groupBy("key", "th").agg(F.sort_array(F.flatten(F.collect_set("parts"))).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.drop("repeated"), scratch.drop("spans-of-contexts")
    scratch.release()
    return keyed, own, spans


def _merged(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or []:
        a, b = s["start"], min(s["end"], n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def deduplicated(spark: SparkSession, docs: DataFrame, length: int = 200, digest: bool = False) -> DataFrame:
    """Rows of docs with their text cut: the digest (doc_id, n_bytes, n_removed, n_spans, kept_sha256), or docs with the bytes that are left as text (bytes that no longer form a character go) and n_removed."""
    scratch = Scratch(spark, "suffixes")
    docs = docs.drop("n_removed")
    keyed, own, spans = repeats(spark, docs, length, scratch)
    names = docs.columns
    (out,) = internal(names, "spans")
    spans = spans.select(*(F.col(a).alias(b) for a, b in zip(("key", "th"), own)), F.col("spans").alias(out))
    joined = keyed.join(spans, own, "left").select(*names, out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, n_spans, sums, kept = [], [], [], [], []
            for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column(out).to_pylist()):
                body = text or b""
                gone = _merged(found, len(body))
                edges = [0, *(x for s in gone for x in s), len(body)]
                left = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                n_bytes.append(len(body)), removed.append(len(body) - len(left)), n_spans.append(len(gone))
                if digest:
                    sums.append(hashlib.sha256(left).hexdigest())
                else:
                    kept.append(None if text is None else left.decode(errors="ignore") if gone else body.decode())
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)), pa.array(sums, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*(pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names), pa.array(removed, pa.int64())], names=[*names, "n_removed"])

    if digest:
        return joined.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(cut, f"{fields}, n_removed long")
