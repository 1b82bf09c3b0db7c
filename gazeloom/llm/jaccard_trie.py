"""N-gram Jaccard join by prefix trees.

A document's set holds the hashes of its distinct word n-grams. Equal sets are one node. Two sets
with similarity t or more differ in few elements, so if hashes are dealt to one segment more than
that difference can touch, the two agree on whole segments. Segments are chosen so that links share
some more than one; each set leaves out as many of its most shared ones (a passage in many texts),
and the rest join it to the least set that has them: components of these joins are families that
no link leaves. In a family the sets are
ordered by one global order (descending frequency, then hash) and stored in a trie with compressed
edges: a set walks down it with its partial overlap, shared by all sets below an edge, and leaves a
subtree when the elements missed so far, of either side, exceed what the largest set below allows.

Where only components are asked for, a subtree whose sets are all in the walker's component is
passed by; a family of near copies costs about a path for each copy. A family of more than BLOCK sets
or ELEMENTS elements is then joined block by block, with some of its sets (pivots) in every block; that
makes one component of what the pivots reach. Only sets outside of the family's largest component are
joined with all blocks afterwards, so a set of that component is sent twice and not once a block.
With links=True every end is verified and each document has the number of rows it is linked to, of
equal sets or others; that costs a visit for each linked pair of sets, and all pairs of blocks. No pairs are listed.

Words are runs of anything but ASCII white space, with A-Z in lower case. Texts with fewer words
than n are one n-gram. Nulls and texts without words have an empty set and are components of their
own; null doc_ids take part by their text, and their component is the least non-null doc_id, if
any. Repeated rows are equal sets. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.llm.shared import Scratch, alone, components, kept, ship, small_batches

#: A family is one block up to so many sets and elements.
BLOCK, ELEMENTS = 4000, 4_000_000
#: Counts of sets that share a segment go no further.
CROWD = 1 << 16
CLASSES = 128
#: The least sets of so many of a large family's blocks are its pivots.
PIVOTS = 64
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = kept("jaccard", _Hashes())


def grams(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = (text or b"").lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * _M3 + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(tokens: np.ndarray) -> int:
    """A hash of the whole set."""
    total = mixed(tokens).sum(dtype=np.uint64, keepdims=True) if len(tokens) else np.zeros(1, np.uint64)
    return int(mixed(total + np.uint64(len(tokens))).view(np.int64)[0])


def classes(size: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(class, segments, most that a link differs in) where a set of this size looks for partners: its own class, and the one below if a smaller partner may be there."""
    low, k = 1, 0
    before = 0
    while True:
        high = max(low + 1, -(-3 * low // 2))
        if size < high:
            break
        before, low, k = low, high, k + 1

    def of(k: int, high: int) -> tuple[int, int, int]:
        differ = (high - 1) * (den - num) // num
        # so many that the occupied ones exceed what may differ by a fifth, for random sets of the smallest size in the class
        least, want, m = max(1, 2 * high // 3), 1.2 * differ + 1, differ + 1
        while m < 4 * (differ + 1) and m * (1 - (1 - 1 / m) ** least) < want:
            m += max(1, m // 50)
        return k, m, differ

    own = [of(k, high)]
    if before and size * num <= (low - 1) * den:
        own.append(of(k - 1, low))
    return own


_classes: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}


def segment_keys(tokens: np.ndarray, sums: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, spare): a key for each occupied segment of the set, equal for two sets that agree on it, and how many of a class's keys any link shares beyond one, times CLASSES, plus the class.

    A set with too few occupied segments for a link to share one has keys for its empty ones too: two such
    sets share one of those. sums: running sums of mixed tokens, from 0.
    """
    size = len(tokens)
    if (found := _classes.get((size, num, den))) is None:
        found = _classes[size, num, den] = classes(size, num, den)
    keys, spare = [], []
    for k, m, differ in found:
        segment = (tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        bounds = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
        out = mixed((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mixed(np.arange(m, dtype=np.uint64) + np.uint64(k << 40) + _M3))
        full = bounds[1:] > bounds[:-1]
        beyond = int(full.sum()) - differ - 1
        if beyond >= 0:
            out = out[full]
        keys.append(out)
        spare.append(np.full(len(out), max(0, beyond) * CLASSES + k, np.int32))
    return np.concatenate(keys), np.concatenate(spare)


class _Node:
    __slots__ = ("edge", "below", "ends", "largest", "alone", "one", "many")

    def __init__(self, edge: np.ndarray, largest: int, alone: int, one: int):
        self.edge, self.below, self.ends = edge, {}, []
        # of the sets below: the largest size, the fewest elements that no other set has, one set, and whether they may be of several components
        self.largest, self.alone, self.one, self.many = largest, alone, one, False


def join(sets: list[np.ndarray], num: int, den: int, links: np.ndarray | None = None, weights: np.ndarray | None = None, sides: np.ndarray | None = None, inner: tuple[int, ...] = ()) -> np.ndarray:
    """For each set, the least index linked to it, over any number of links.

    If links is given, all pairs are verified, and each adds the other set's weight to links; where sides are
    given, only pairs of different sides add, and those within the sides of inner.
    """
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def unite(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)

    sizes = [len(s) for s in sets]
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(counts), np.int64)
    order[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    # an element that one set alone has matches nothing: it only counts as missed, and paths stay shared
    ranks = np.split(np.where(counts > 1, order, -1)[inverse], np.cumsum(sizes)[:-1])
    root = _Node(np.zeros(0, np.int32), 0, 0, -1)
    own = np.zeros(len(counts), bool)  # the walker's elements
    for x in sorted(range(len(sets)), key=lambda k: sizes[k]):
        tokens = np.sort(ranks[x][ranks[x] >= 0]).astype(np.int32)
        size = sizes[x]
        alone = size - len(tokens)
        if not len(tokens):
            continue
        own[tokens] = True
        # (node, elements on the path to it, of those in x); the likeliest way, where x goes on, comes first
        stack = _ways(root, tokens, 0, 0, 0)
        while stack:
            node, depth, overlap = stack.pop()
            if links is None and not node.many and find(node.one) == find(x):
                continue
            depth += len(node.edge)
            overlap += int(np.count_nonzero(own[node.edge]))
            # elements of either set that the other lacks so far, against the most that the largest set below allows
            at = int(tokens.searchsorted(node.edge[-1], "right"))
            missed = alone + node.alone + depth - overlap + at - overlap
            if missed * (num + den) > (size + node.largest) * (den - num):
                continue
            for y in node.ends:
                if overlap * (num + den) >= num * (size + sizes[y]):
                    unite(x, y)
                    if links is not None and (sides is None or sides[x] != sides[y] or sides[x] in inner):
                        links[x] += weights[y]
                        links[y] += weights[x]
            if node.below:
                stack += _ways(node, tokens, at, depth, overlap)
        own[tokens] = False
        _insert(root, tokens, x, size, alone, find)
    return np.array([find(x) for x in range(len(sets))])


def _ways(node: _Node, tokens: np.ndarray, at: int, depth: int, overlap: int) -> list[tuple[_Node, int, int]]:
    """The children of a node, last the one that begins with the walker's next element."""
    own = node.below.get(int(tokens[at])) if at < len(tokens) else None
    ways = [(child, depth, overlap) for child in node.below.values() if child is not own]
    return ways if own is None else [*ways, (own, depth, overlap)]


def _insert(root: _Node, tokens: np.ndarray, x: int, size: int, alone: int, find) -> None:
    node, at, component = root, 0, find(x)
    while True:
        nxt = node.below.get(int(tokens[at]))
        if nxt is None:
            leaf = node.below[int(tokens[at])] = _Node(tokens[at:], size, alone, x)
            leaf.ends.append(x)
            return
        n = min(len(nxt.edge), len(tokens) - at)
        parts = np.flatnonzero(nxt.edge[:n] != tokens[at : at + n])
        n = int(parts[0]) if len(parts) else n
        if n < len(nxt.edge):
            # split the edge where the two part
            top = _Node(nxt.edge[:n], nxt.largest, nxt.alone, nxt.one)
            top.many = nxt.many
            top.below[int(nxt.edge[n])] = nxt
            nxt.edge = nxt.edge[n:]
            node.below[int(tokens[at])] = top
            nxt = top
        nxt.largest, nxt.alone = max(nxt.largest, size), min(nxt.alone, alone)
        if not nxt.many and find(nxt.one) != component:
            nxt.many = True
        at += n
        if at == len(tokens):
            nxt.ends.append(x)
            return
        node = nxt


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a sorted partition, one at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        columns = [rest[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield rest.slice(a, b - a)
        rest = rest.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest


def similar(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64 of the text) for each row of docs (doc_id, text), and n_links if asked for. Links: den * intersection >= num * union."""
    if 3 * num < 2 * den:
        raise ValueError("size classes hold for similarities of two thirds or more")
    ship(spark)
    small_batches(spark, 1024)
    scratch = Scratch(spark, "jaccard")
    # the key finds the document's text again: its id, or for a null id a hash of the text
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.col("text_hash")))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("jaccard")
        for batch in batches:
            sizes, sigs = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                tokens = grams(text, n)
                sizes.append(len(tokens))
                sigs.append(signature(tokens))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64())], names=["doc_id", "text_hash", "key", "n", "sig"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("jaccard")
        seen: set[int] = set()  # a task sends equal sets once
        for batch in batches:
            keys, sigs, spares = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                tokens = grams(text, n)
                sig = signature(tokens)
                if not len(tokens) or sig in seen:
                    continue
                seen.add(sig)
                key, spare = segment_keys(tokens, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens))]), num, den)
                keys.append(key.view(np.int64)), spares.append(spare), sigs.append(np.full(len(key), sig))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, sigs, spares)], names=["segment", "sig", "spare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = scratch.save(keyed.mapInArrow(described, f"doc_id {kind}, text_hash long, key long, n long, sig long"), "sets")
    full = sets.where("n > 0")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of segments that several sets have, with how many, up to CROWD; a run is held only so far."""
        last, held, size = None, [], 0

        def out(parts: list[tuple], count: int) -> pa.RecordBatch:
            segment, sig, spare = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array(segment), pa.array(sig), pa.array(spare), pa.array(np.full(len(sig), count, np.int32))], names=["segment", "sig", "spare", "sharing"])

        for batch in batches:
            segment, sig, spare = (batch.column(c).to_numpy() for c in ("segment", "sig", "spare"))
            if not len(segment):
                continue
            new = np.concatenate([[True], (segment[1:] != segment[:-1]) | (sig[1:] != sig[:-1])])  # several tasks may have sent a set
            segment, sig, spare = segment[new], sig[new], spare[new]
            cuts = np.concatenate([[0], np.flatnonzero(segment[1:] != segment[:-1]) + 1, [len(segment)]])
            lengths = np.diff(cuts)
            # the first run may go on from the last batch, and the last may go on in the next
            first = segment[0] == last
            if held and not first:
                if size > 1:
                    yield out(held, min(size, CROWD))
                held, size = [], 0
            a = 0
            if first:
                a = int(cuts[1])
                skip = int(held[-1][1][-1] == sig[0]) if held else 0
                if a > skip:
                    held, size = [*held, (segment[skip:a], sig[skip:a], spare[skip:a])], size + a - skip
                if size >= CROWD:
                    yield out(held, CROWD)
                    held = [tuple(x[-1:] for x in held[-1])]
                if len(lengths) == 1:
                    continue
                if size > 1 and size < CROWD:
                    yield out(held, size)
                held, size = [], 0
                middle = slice(1, len(lengths) - 1)
            else:
                middle = slice(0, len(lengths) - 1)
            if len(inner := lengths[middle]) and (inner > 1).any():
                z = int(cuts[len(lengths) - 1])
                counts = np.repeat(inner, inner)
                keep = counts > 1
                yield pa.RecordBatch.from_arrays([*(pa.array(x[a:z][keep]) for x in (segment, sig, spare)), pa.array(np.minimum(counts[keep], CROWD).astype(np.int32))], names=["segment", "sig", "spare", "sharing"])
            z = int(cuts[-2])
            held, size, last = [(segment[z:], sig[z:], spare[z:])], len(segment) - z, segment[-1]
        if held and 1 < size < CROWD:
            yield out(held, size)

    dealt = keyed.select("text").mapInArrow(segments, "segment long, sig long, spare int").repartition("segment").sortWithinPartitions("segment", "sig")
    found = scratch.save(dealt.mapInArrow(shared, "segment long, sig long, spare int, sharing int").distinct(), "shared")
    scratch.release()
    # a link shares more than `spare` of a class's segments, so each set may drop as many of its most shared
    # ones: of the segments that two linked sets share, the least shared is then left to both
    rank = F.row_number().over(Window.partitionBy("sig", "spare").orderBy(F.desc("sharing"), "segment"))
    found = found.withColumn("rank", rank).where(F.col("rank") > F.expr(f"spare div {CLASSES}")).select("segment", "sig")
    least = found.groupBy("segment").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low < high").select("segment", "low")
    stars = found.join(least, "segment").where("sig != low").select(F.col("sig").alias("a"), F.col("low").alias("b"))
    families = scratch.save(components(scratch, stars), "families")
    weight = ["weight"] if links else []  # the rows of a set
    first_of = full.groupBy("sig").agg(F.min("key").alias("key"), F.min("n").alias("n"), *(F.count("*").alias(c) for c in weight))
    wanted = scratch.save(families.join(first_of, F.col("node") == F.col("sig")).select("key", "sig", "root", "n", *weight), "wanted")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / ELEMENTS)).cast("int")
    sized = wanted.join(wanted.groupBy("root").agg(parts.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("jaccard")
        seen: set[int] = set()  # of rows that share a key and a text, a task sends one
        for batch in batches:
            raw, keep = [], []
            for k, (text, sig) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("sig").to_pylist())):
                if sig in seen:
                    continue
                tokens = grams(text, n)
                # of rows that share a doc_id, those with another text don't count
                if signature(tokens) == sig:
                    seen.add(sig)
                    raw.append(tokens.tobytes())
                    keep.append(k)
            take = pa.array(keep, pa.int64())
            names = ["sig", "root", "block", "units", *weight]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), pa.array(raw, pa.binary())], names=[*names, "tokens"])

    unit = ["root", "x", "y"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, unit):
            sigs = part["sig"].to_numpy()
            sigs, first = np.unique(sigs, return_index=True)
            if len(sigs) < 2:
                continue
            tokens = part["tokens"].take(pa.array(first)).to_pylist()
            sets = [np.frombuffer(t, np.uint64) for t in tokens]
            if not links:
                low = join(sets, num, den)
                other = low != np.arange(len(low))
                yield pa.RecordBatch.from_arrays([pa.array(sigs[other]), pa.array(sigs[low[other]])], names=["a", "b"])
                continue
            x, y = part["x"][0].as_py(), part["y"][0].as_py()
            # a block is in several units: the pairs within it count in its unit with block 0, those of block 0 in the one with block 1
            sides = part["block"].to_numpy()[first] if x != y else None
            count = np.zeros(len(sets), np.int64)
            low = join(sets, num, den, count, part["weight"].to_numpy()[first], sides, (0, 1) if y == 1 else (y,) if x == 0 else ())
            some = (count > 0) | (low != np.arange(len(low)))
            yield pa.RecordBatch.from_arrays([pa.array(z[some]) for z in (sigs, sigs[low], count)], names=["a", "b", "n"])

    def joined(members: DataFrame, name: str) -> DataFrame:
        """Links within each unit (x, y) of a family; members: key, sig, root, block and the units it is in."""
        # the same plan at every size: a broadcast that small inputs allow says nothing about large ones
        texts = keyed.select("key", "text").join(members.hint("merge"), "key").select("text", "sig", "root", "block", "units", *weight)
        placed = texts.mapInArrow(collected, f"sig long, root long, block int, units array<struct<x:int,y:int>>, {'weight long, ' * links}tokens binary")
        placed = placed.select("sig", "root", "block", "tokens", *weight, F.inline("units"))
        grouped = placed.select(*unit, "sig", "tokens", *(["block", "weight"] if links else [])).repartition(*unit).sortWithinPartitions(*unit)
        return scratch.save(grouped.mapInArrow(linked, "a long, b long" + ", n long" * links), name)

    def of(x: Column, y: Column) -> Column:
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    zero, block, every = F.lit(0), F.col("block"), F.sequence(F.lit(0), F.col("blocks") - 1)
    if links:
        # a family of one block is one unit; otherwise the pairs of different blocks, each of which joins within both
        pairs = F.transform(F.filter(every, lambda o: o != block), lambda o: of(F.least(block, o), F.greatest(block, o)))
        edges = joined(sized.withColumn("units", F.when(F.col("blocks") == 1, F.array(of(zero, zero))).otherwise(pairs)), "links")
    else:
        pivots = sized.where(f"blocks > 1 and block < {PIVOTS}").groupBy("root", "block").agg(F.min("sig").alias("sig")).select("sig", F.lit(True).alias("pivot"))
        own = F.transform(F.when(F.col("pivot"), every).otherwise(F.array("block")), lambda o: of(o, o))
        edges = joined(sized.join(pivots, "sig", "left").withColumn("units", own), "links")
        large = sized.where("blocks > 1")
        if not large.isEmpty():
            reached = components(scratch, edges).select(F.col("node").alias("sig"), F.col("root").alias("part"))
            reached = scratch.save(large.join(reached, "sig", "left").withColumn("part", F.coalesce("part", "sig")), "reached")
            each = reached.groupBy("root", "part").agg(F.count("*").alias("members"))
            most = each.groupBy("root").agg(F.max_by("part", F.struct("members", "part")).alias("most"))
            rest = reached.join(most, "root").withColumn("out", F.col("part") != F.col("most"))
            rest_of = rest.where("out").groupBy("root").agg(parts.alias("rests"))  # a family of one component is done
            p, q = F.pmod(F.xxhash64("sig", F.lit(1)), F.col("rests")), F.sequence(F.lit(0), F.col("rests") - 1)
            with_all = F.transform(q, lambda o: of(o, block))
            units = F.when(F.col("out"), F.array_distinct(F.concat(with_all, F.transform(every, lambda o: of(p, o))))).otherwise(with_all)
            edges = edges.unionByName(joined(rest.join(rest_of, "root").withColumn("units", units), "rest_links"))
    scratch.release()
    linked_to = components(scratch, edges.where("a != b").select("a", "b") if links else edges)
    each = full.groupBy("sig").agg(F.min("doc_id").alias("least"), *(F.count("*").alias(c) for c in weight))
    each = scratch.save(each.join(linked_to, each["sig"] == linked_to["node"], "left").select("sig", "least", F.coalesce("root", "sig").alias("root"), *weight), "each")
    first = each.groupBy("root").agg(F.min("least").alias("component_id"))
    named = each.join(first, "root").select("sig", "component_id", *weight)
    if links:
        sums = edges.groupBy(F.col("a").alias("sig")).agg(F.sum("n").alias("n_links"))
        named = named.join(sums, "sig", "left").select("sig", "component_id", (F.col("weight") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    rows = sets.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    counted = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    return rows.join(named, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", *counted)
