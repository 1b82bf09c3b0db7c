"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked id pairs.

A byte-level tokenizer (A) reads a space and the text, and a piece tokenizer (B), which adds that space
itself, reads the text. Both always end a token before a blank, tab or line break that follows a
character which is no white space. Texts are cut there, and the distinct segments of a partition's texts
become two interval tables of tokens (number, id, first and last byte) in DuckDB. As-of joins find
whether a token ends where one of the other side does, window sums of those ends number the groups, and
a range join lists the overlapping pairs, of which those that end together are links. A worker keeps
what it has aligned, so a segment that comes again is looked up.

Blocks of about BLOCK bytes of documents list their distinct pairs with partial counts. Spark sums these
over all blocks, finds each B id's highest count, and joins the totals back to the blocks that have a
pair; each block's documents then meet their block's pairs, which are as few as its tokens.

Texts that are null, empty, or whose joined bytes of A or B are not a space and the text (a literal
U+2581, which B takes for a blank) have no tokens: zeros, and an empty string. Null and repeated
doc_ids are kept, and each row counts. Texts of any length are read whole; a run without white space is
aligned at once. Ties of a B id's highest count are all best. Empty tables give empty results. Columns
of docs other than doc_id and text are not used.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.shared import Scratch, alone, kept, ship, small_batches
from gazeloom.llm.tokens import byte_alphabet, vocabulary_path

#: Bytes of text in a block, and of segments that are aligned at once.
BLOCK, AT_ONCE = 8 << 20, 1 << 20
#: Segments that a worker keeps between blocks (the half that came most often, once there are more), and the characters of the longest of them.
SEGMENTS, LONG = 400_000, 64
#: Pairs in a row of a block's list.
LISTED = 20_000
SPACE = "▁"
#: White space and what follows it, on to the next blank, tab or line break after a character that is no white space.
SEGMENT = re.compile(r"\s*\S+(?:[^\S \t\n]\s*\S+)*(?:[^\S \t\n]\s*)?|\s+")

#: Whether a token ends where one of the other side does, and the number of its group, in the order of groups with A first.
GROUPS = """
with ends as (
  select 0 as side, a.seg, a.k, a.id, coalesce(a.e = b.e, false)::int as closes from a asof left join b on a.e >= b.e
  union all
  select 1, b.seg, b.k, b.id, coalesce(b.e = a.e, false)::int from b asof left join a on b.e >= a.e)
select side, seg, id, (sum(closes) over (partition by side order by k) - closes)::bigint as g from ends order by g, side, k
"""
#: All overlapping pairs, and whether they end together.
OVERLAPS = "select a.seg, a.id as a, b.id as b, a.e = b.e as together from a join b on a.s < b.e and b.s < a.e order by a.k, b.k"


class Sides:
    """Ids of segments by both tokenizers, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        spec = json.load(open(a_path, encoding="utf-8"))
        split = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("a byte-level tokenizer without normalizer is needed")
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.a_widths, self.b_widths = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids as text, first in a segment, in a group, of B in a group, and others
        self.top = max(len(self.a_bytes), len(self.b_bytes))
        self.spelled = [f"{lead}{k}" for lead in ("", ";", "|", ",") for k in range(self.top)]
        self.blank = self.b.piece_to_id(SPACE)
        # else B may join what is parted here
        if any(re.search(rf"[ \t\n]|[^{SPACE}]{SPACE}", p) for k, p in enumerate(pieces) if len(p) > 1 and not self.b.is_byte(k)):
            raise ValueError("a piece model whose pieces have blanks at their start only, and no tab or line break, is needed")

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch(segments, add_special_tokens=False)]
        # B adds a blank: it stands for the segment's own, or is cut off with a line break that joins nothing
        own = [s[0] == " " for s in segments]
        b = self.b.encode([s[1:] if o else f"\n{s}" for s, o in zip(segments, own)], num_threads=1)
        lead = len(self.b.encode("\n"))
        return a, [(ids if len(s) > 1 else [self.blank]) if o else ids[lead:] for s, ids, o in zip(segments, b, own)]


class Aligner:
    """What a worker knows of segments: token and group counts, groups as text, and the numbers of their linked pairs."""

    def __init__(self, a_path: str, b_path: str):
        import duckdb

        self.sides = Sides(a_path, b_path)
        self.db = duckdb.connect(":memory:", config={"threads": 1})
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.pairs: dict[int, int] = {}
        # of a segment: whether bytes are equal, tokens of A and of B, groups, overlaps, links, and where they begin
        self.facts = [array("q") for _ in range(7)]
        self.texts: list[str] = []
        self.links = array("I")
        self.used = np.zeros(0, np.int64)

    def thin(self) -> None:
        """Keep the half of the segments that came most often of late, and of the pairs all."""
        facts = [np.frombuffer(x, np.int64) for x in self.facts]
        kept = np.argsort(-self.used, kind="stable")[: SEGMENTS // 2]
        kept = np.sort(kept[self.used[kept] > 0])
        new = np.full(len(self.texts), -1)
        new[kept] = np.arange(len(kept))
        lengths, first = facts[5][kept], facts[6][kept]
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        links = np.frombuffer(self.links, np.uint32)[np.repeat(first - after + lengths, lengths) + np.arange(total)] if total else np.zeros(0, np.uint32)
        self.facts = [array("q", x.tobytes()) for x in (*(f[kept] for f in facts[:6]), after - lengths)]
        self.links = array("I", links.tobytes())
        self.texts = [self.texts[k] for k in kept.tolist()]
        self.numbers = {s: k for s, k in zip(self.numbers, new[np.fromiter(self.numbers.values(), np.int64, len(self.numbers))].tolist()) if k >= 0}
        self.used = self.used[kept] // 2

    def add(self, segments: list[str]) -> None:
        """Align new segments, AT_ONCE bytes at a time."""
        at = 0
        while at < len(segments):
            n, end = 0, at
            while end < len(segments) and (end == at or n + 4 * len(segments[end]) <= AT_ONCE):
                n += 4 * len(segments[end])
                end += 1
            self._add(segments[at:end])
            at = end

    def _add(self, segments: list[str]) -> None:
        a, b = self.sides.encode(segments)
        a_bytes, b_bytes = self.sides.a_bytes.__getitem__, self.sides.b_bytes.__getitem__
        raw = [s.encode() for s in segments]
        same = [b"".join(map(a_bytes, x)) == r == b"".join(map(b_bytes, y)) for r, x, y in zip(raw, a, b)]
        starts = np.cumsum([0, *map(len, raw)])
        for name, ids, widths in (("a", a, self.sides.a_widths), ("b", b, self.sides.b_widths)):
            # global byte offsets, so tokens of different segments never meet
            seg = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) if s else 0 for x, s in zip(ids, same)])
            flat = np.fromiter(chain.from_iterable(compress(ids, same)), np.int32, len(seg))
            after = np.cumsum(widths[flat])
            before = np.append(0, after)[np.searchsorted(seg, np.arange(len(ids)))]
            ends = after - before[seg] + starts[seg]
            self.db.register(name, pa.table({"seg": seg, "k": np.arange(len(flat), dtype=np.int32), "id": flat, "s": ends - widths[flat], "e": ends}))
        groups = self.db.sql(GROUPS).to_arrow_table()
        overlaps = self.db.sql(OVERLAPS).to_arrow_table()
        text, n = self._spelled(*(groups.column(c).to_numpy() for c in ("side", "seg", "id", "g")), len(segments))
        seg, together = overlaps.column("seg").to_numpy(), overlaps.column("together").to_numpy()
        packed = (overlaps.column("a").to_numpy()[together].astype(np.int64) << 32) | overlaps.column("b").to_numpy()[together]
        distinct, which = np.unique(packed, return_inverse=True)
        number = np.fromiter((self.pairs.setdefault(p, len(self.pairs)) for p in distinct.tolist()), np.uint32, len(distinct))
        n_links = np.bincount(seg[together], minlength=len(segments))
        first = len(self.links) + np.cumsum(n_links) - n_links
        self.links.frombytes(number[which].astype(np.uint32).tobytes())
        facts = (same, map(len, a), map(len, b), n.tolist(), np.bincount(seg, minlength=len(segments)).tolist(), n_links.tolist(), first.tolist())
        for held, new in zip(self.facts, facts):
            held.extend(new)
        self.numbers.update(zip(segments, range(len(self.texts), len(self.texts) + len(segments))))
        self.texts += text

    def _spelled(self, side: np.ndarray, seg: np.ndarray, ids: np.ndarray, g: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
        """Each segment's groups as text, and their number."""
        if not len(ids):
            return [""] * n, np.zeros(n, np.int64)
        fresh = np.diff(g, prepend=-1) != 0
        lead = np.where(fresh, np.where(np.diff(seg, prepend=-1) != 0, 0, 1), np.where(np.diff(side, prepend=0) != 0, 2, 3))
        words = list(map(self.sides.spelled.__getitem__, (lead * self.sides.top + ids).tolist()))
        bounds = np.searchsorted(seg, np.arange(n + 1)).tolist()
        return ["".join(words[a:b]) for a, b in zip(bounds, bounds[1:])], np.bincount(seg[fresh], minlength=n)

    def block(self, texts: list[bytes | None], keep_groups: bool) -> tuple[dict[str, list], list[bytes], np.ndarray, np.ndarray]:
        """Of each text its counts and digest, and its links as numbers of the block's pairs; the block's pairs (packed) and their counts."""
        if len(self.texts) > SEGMENTS or len(self.links) > 16 * SEGMENTS:
            self.thin()
        split = [SEGMENT.findall(f" {t.decode()}") if t else [] for t in texts]
        self.add(list({s for x in split for s in x}.difference(self.numbers)))
        find = self.numbers.__getitem__
        counts = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter((k for x in split for k in map(find, x)), np.int64, int(counts.sum()))
        bounds = np.append(0, np.cumsum(counts))
        used = np.bincount(which, minlength=len(self.texts))
        used[: len(self.used)] += self.used
        self.used = used
        facts = [np.frombuffer(x, np.int64)[which] if len(x) else which for x in self.facts]

        def sums(x: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(x))[bounds])

        some = (counts > 0) & (sums(facts[0]) == counts)
        n_a, n_b, n_groups, n_overlaps, n_links = (np.where(some, sums(x), 0) for x in facts[1:6])
        text, digests, groups = self.texts.__getitem__, [], []
        for k, (a, b, has) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), some.tolist())):
            whole = ";".join(map(text, which[a:b].tolist())) if has else ""
            digests.append(hashlib.sha256(whole.encode()).hexdigest() if has else "")
            groups.append(whole if keep_groups else None)
        lengths = np.where(np.repeat(some, counts), facts[5], 0)
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        taken = np.frombuffer(self.links, np.uint32)[np.repeat(facts[6] - after + lengths, lengths) + np.arange(total)] if total else np.zeros(0, np.uint32)
        times = np.bincount(taken, minlength=len(self.pairs))
        present = np.flatnonzero(times)
        # frequent pairs first, so that most numbers are small
        present = present[np.argsort(-times[present], kind="stable")]
        local = np.zeros(len(times), np.uint32)
        local[present] = np.arange(len(present))
        taken, cut = local[taken], np.append(0, np.cumsum(n_links)).tolist()
        kind = np.uint16 if len(present) <= 1 << 16 else np.uint32
        links = [taken[a:b].astype(kind).tobytes() for a, b in zip(cut, cut[1:])]
        packed = np.fromiter(self.pairs, np.int64, len(self.pairs))[present]
        for s in [s for s in self.numbers if len(s) > LONG]:
            k = self.numbers.pop(s)
            self.texts[k], self.used[k] = "", 0
        result = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_overlaps": n_overlaps, "n_links": n_links, "groups_sha256": digests, "groups": groups}
        return result, links, packed, times[present]


_ready: dict[tuple[str, str], Aligner] = kept("alignment", {})


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner; it lives as long as the worker."""
    alone("alignment")
    if (a_path, b_path) not in _ready:
        _ready[a_path, b_path] = Aligner(a_path, b_path)
    return _ready[a_path, b_path]


COUNTS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")
_ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("groups", pa.string()), ("links", pa.binary()), ("wide", pa.bool_()), ("first", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
_DDL = f"block long, doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, groups string, links binary, wide boolean, first int, a array<int>, b array<int>, n array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """Rows of documents with their links, and rows of pairs (where `a` is not null), of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, x = TaskContext.get().partitionId(), 0, aligner(a_path, b_path)
        ids: list[int | None] = []
        texts: list[bytes | None] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            block = part << 32 | number
            number += 1
            result, links, packed, times = x.block(texts, keep_groups)
            columns = {"block": [block] * len(ids), "doc_id": ids, **result, "links": links, "wide": [len(packed) > 1 << 16] * len(ids)}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(ids), f.type) for f in _ROWS], schema=_ROWS)
            for k in range(0, len(packed), LISTED):
                some, n = packed[k : k + LISTED], times[k : k + LISTED]
                columns = {"block": [block], "first": [k], "a": [(some >> 32).tolist()], "b": [(some & 0xFFFFFFFF).tolist()], "n": [n.tolist()]}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(1, f.type) for f in _ROWS], schema=_ROWS)
            ids.clear(), texts.clear()

        size = 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if ids and size + len(t or b"") > BLOCK:
                    yield from flush()
                    size = 0
                ids.append(i), texts.append(t)
                size += len(t or b"") + 64
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, _DDL)


def _weighed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the totals of their links' pairs."""
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = pairs.column("at").to_numpy()
    count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for links, wide in zip(docs.column("links").to_pylist(), docs.column("wide").to_pylist()):
        own = np.frombuffer(links, np.uint32 if wide else np.uint16)
        n_best.append(int(best[own].sum()))
        count_sum.append(int(count[own].sum()))
    names = ["doc_id", *COUNTS, "groups_sha256", "groups"]
    return pa.table({**{c: docs.column(c) for c in names}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})


def align(spark: SparkSession, docs: DataFrame, a_path: str | None = None, b_path: str | None = None, keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of each document its counts, its groups' digest and on request the groups themselves; and the pairs (a, b, count, best)."""
    ship(spark)
    small_batches(spark)
    scratch = Scratch(spark, "alignment")
    rows = scratch.save(aligned(docs, a_path or vocabulary_path("byte_bpe_50k.json"), b_path or vocabulary_path("piece_bpe_32k.model"), keep_groups), "rows")
    listed = rows.where("a is not null").select("block", "first", F.posexplode(F.arrays_zip("a", "b", "n")).alias("k", "x")).select("block", (F.col("first") + F.col("k")).alias("at"), "x.a", "x.b", "x.n")
    counts = scratch.save(listed.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    pairs = scratch.save(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    answers = listed.select("block", "at", "a", "b").join(pairs, ["a", "b"]).select(F.col("block").alias("of_block"), "at", "count", "best")
    own = rows.where("a is null").select("block", "doc_id", *COUNTS, "groups_sha256", "groups", "links", "wide")
    out = own.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_weighed, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, groups string, n_best long, count_sum long")
    return out, pairs
