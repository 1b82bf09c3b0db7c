"""Token counts by a finite-state transducer that is compiled from a piece vocabulary.

A byte-pair model tokenizes a text so that every prefix of the tokens is the tokenization of its own
string. What is still open after some characters is therefore a suffix of what was read: the part
after the last boundary that all possible continuations share. These suffixes are the states. Reading
a character closes some tokens at the front, and how many is the output of the transition; no token
ids are made. States and transitions are compiled when a text first needs them, and kept by the worker
in a hash table of arrays.

A batch of texts is one stream of symbols: each text has the leading space that the model gives it and
an end symbol. It is cut into chunks of WIDTH symbols, which all go through the transducer in lock step.
Where two neighbours occur in no piece, the state after them is known whatever came before, so a chunk
with such a place has a constant map from there on. A chunk without one is run for each suffix that may
be open at its start, which gives a table from the pending length before to the pending length and the
count after it; tables of neighbouring chunks are composed by a prefix scan of doubling steps. Then the
symbols before each chunk's first known place are run from the states that the scan found.

The stream is handled in blocks of BLOCK symbols with the state carried over, so a text of any length
takes bounded memory beside its own characters.

Nulls and empty texts have no bytes and no tokens; null doc_ids are kept. Equal rows get equal answers,
and there are no ties. Empty tables give empty results. Columns of docs named n_bytes, n_tokens or
over_limit give way to those of the result, the text is left out, and others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.shared import alone, kept, ship, small_batches
from gazeloom.llm.tokens import vocabulary_path

WIDTH = 256
BLOCK = 1 << 21
#: Pending suffixes of up to so many characters are lanes of a chunk's table; texts that have longer ones are read symbol by symbol.
LANES = 48
#: Transitions in a worker's table before it is compiled anew.
MOST = 3_000_000
SPACE = "▁"


class Vocabulary:
    """Normal pieces with their ranks, and the number of tokens of a character that stands alone."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or train.model_type != train.BPE or not train.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("a byte-pair model with byte fallback, a leading space and no normalisation or user-defined pieces is needed")
        self.rank = {p.piece: -p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.open = {p[:k] for p in self.rank for k in range(1, len(p))}
        self.symbols = sorted({c for p in self.rank if len(p) > 1 for c in p} | {SPACE})
        self._split: dict[str, tuple[int, int]] = {"": (0, 0)}

    def alone(self, character: str) -> int:
        return 1 if character in self.rank else len(character.encode())

    def split(self, text: str) -> tuple[int, int]:
        """How many tokens the text has, and the last one's length: the best-ranked neighbours are merged until none are left, the first of equals first."""
        known = self._split.get(text)
        if known is None:
            parts = list(text)
            while True:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    r = self.rank.get(parts[k] + parts[k + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self._split[text] = (sum(1 if len(p) > 1 else self.alone(p) for p in parts), len(parts[-1]))
        return known

    def settle(self, text: str) -> tuple[str, int]:
        """The part after the last boundary that stays whatever follows, and the number of tokens before it."""
        n = len(text)
        # a token that is still open begins at one of these; before it, the text is tokenized by itself
        begins = {k for k in range(n) if text[k:] in self.open} | {n}
        while len(begins) > 1:
            last = max(begins)
            begins.remove(last)
            begins.add(last - self.split(text[:last])[1])
        at = begins.pop()
        return text[at:], self.split(text[:at])[0]


class Transducer:
    """Symbols are the characters that occur in longer pieces, then characters of 1 to 4 tokens that stand alone, then the end."""

    def __init__(self, path: str, most: int = MOST):
        self.v, self.most = Vocabulary(path), most
        n = len(self.v.symbols)
        self.of = np.zeros(0x110000, np.uint16)
        for k, first in enumerate((0, 0x80, 0x800, 0x10000)):
            self.of[first:] = n + k
        for piece in self.v.rank:
            if len(piece) == 1:
                self.of[ord(piece)] = n
        for k, c in enumerate(self.v.symbols):
            self.of[ord(c)] = k
        self.of[0x20] = self.space = self.v.symbols.index(SPACE)
        self.n, self.end, self.size = n, n + 4, n + 5
        # whether some piece has a symbol right after another
        self.joined = np.zeros((self.size, self.size), bool)
        number = {c: k for k, c in enumerate(self.v.symbols)}
        for piece in self.v.rank:
            for a, b in zip(piece, piece[1:]):
                self.joined[number[a], number[b]] = True
        self.clear()

    def clear(self) -> None:
        self.v._split = {"": (0, 0)}
        self.texts: list[str] = []
        self.ids: dict[str, int] = {}
        self.lengths, self.finals = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int32)
        self._table(1 << 16)
        self.state("")
        # the state and output of each symbol from the start
        each = [self.move(0, s) for s in range(self.size)]
        self.fresh, self.fresh_out = (np.array(x, np.int32) for x in zip(*each))

    def _table(self, slots: int) -> None:
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.keys, self.next, self.out, self.used = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int32), 0

    def state(self, text: str) -> int:
        k = self.ids.get(text)
        if k is None:
            k = self.ids[text] = len(self.texts)
            self.texts.append(text)
            if k == len(self.lengths):
                self.lengths, self.finals = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.finals))
            self.lengths[k], self.finals[k] = len(text), self.v.split(text)[0]
        return k

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """Compile one transition: the next state and the tokens that it closes."""
        if symbol >= self.n:
            return 0, int(self.finals[state]) + (symbol - self.n + 1 if symbol < self.end else 0)
        text, closed = self.v.settle(self.texts[state] + self.v.symbols[symbol])
        return self.state(text), closed

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _insert(self, keys: np.ndarray, nexts: np.ndarray, outs: np.ndarray) -> None:
        slots, mask = self._slots(keys), len(self.keys) - 1
        left = np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]  # of several that want one place, the last to be written has it
            self.next[at[won]], self.out[at[won]] = nexts[left[won]], outs[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & mask
        self.used += len(keys)

    def _compile(self, keys: np.ndarray) -> None:
        moves = [self.move(*divmod(k, self.size)) for k in keys.tolist()]
        nexts, outs = (np.array(x, np.int32) for x in zip(*moves))
        if (self.used + len(keys)) * 5 > len(self.keys) * 2:
            full = self.keys >= 0
            old = self.keys[full], self.next[full], self.out[full]
            self._table(max(len(self.keys) * 2, 1 << (3 * (self.used + len(keys))).bit_length()))
            self._insert(*old)
        self._insert(keys, nexts, outs)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the tokens that are closed, of many states with a symbol each."""
        keys = states.astype(np.int64) * self.size + symbols
        while True:
            slots = self._slots(keys)
            left = np.flatnonzero(self.keys[slots] != keys)
            missing: list[np.ndarray] = []
            while len(left):
                at = self.keys[slots[left]]
                missing.append(keys[left[at == -1]])
                left = left[(at != -1) & (at != keys[left])]
                slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            lacking = np.unique(np.concatenate(missing)) if missing else ()
            if not len(lacking):
                return self.next[slots], self.out[slots]
            self._compile(lacking)

    def tables(self, symbols: np.ndarray, chunks: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks without a known place, by pending length: the state before, the state after, and the tokens closed.

        before: the symbols ahead of the block, whose last ones a chunk at its start may have pending.
        """
        stream, ahead = np.concatenate([before, symbols]), len(before)
        start = np.zeros((len(chunks), LANES + 1), np.int32)
        for row, c in enumerate(chunks.tolist()):
            at = c * WIDTH + ahead
            text = ""
            for lane, s in enumerate(stream[max(0, at - LANES) : at][::-1].tolist(), 1):
                if s >= self.n:
                    break
                text = self.v.symbols[s] + text
                start[row, lane] = self.state(text)
        states, counts = start.ravel(), np.zeros(start.size, np.int64)
        for t in range(WIDTH):
            states, out = self.step(states, np.repeat(symbols[chunks * WIDTH + t], LANES + 1))
            counts += out
        return start, states.reshape(start.shape), counts.reshape(start.shape)

    def block(self, symbols: np.ndarray, state: int, before: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """Tokens closed at each symbol (those of a chunk without a known place at its first), the state after, and the chunks that need single steps."""
        n = -(-len(symbols) // WIDTH)
        grid = np.full(n * WIDTH, self.end, np.uint16)
        grid[: len(symbols)] = symbols
        flat = grid
        known = ~self.joined[np.concatenate([before[-1:] if len(before) else grid[:1] * 0 + self.end, grid[:-1]]), grid]
        grid, known = grid.reshape(n, WIDTH), known.reshape(n, WIDTH)
        has = known.any(axis=1)
        first = np.where(has, known.argmax(axis=1), WIDTH)
        # chunks in order of their first known place, so those that run at a step are the first ones
        order = np.argsort(first, kind="stable")
        at, columns = first[order], np.ascontiguousarray(grid[order].T)
        closed = np.zeros((WIDTH, n), np.int32)
        states = np.zeros(n, np.int32)
        for t in range(WIDTH):
            a, b = np.searchsorted(at, [t, t + 1])
            if a:
                states[:a], closed[t, :a] = self.step(states[:a], columns[t, :a])
            states[a:b] = self.fresh[columns[t, a:b]]
        after = np.zeros(n, np.int32)
        after[order] = states

        # states before each chunk: constant after a chunk with a known place, by the scan after the others
        ahead = np.concatenate([[state], after[:-1]]).astype(np.int32)
        single = np.zeros(0, np.int64)
        rows = np.flatnonzero(~has)
        per_chunk = np.zeros(n, np.int64)
        if len(rows):
            start, end, counts = self.tables(flat, rows, before)
            run = np.cumsum(np.diff(rows, prepend=-2) != 1)  # neighbouring chunks share a run
            opens = np.flatnonzero(np.diff(run, prepend=0))
            maps = np.minimum(self.lengths[end], LANES + 1).astype(np.int64)
            maps = np.concatenate([maps, np.full((len(rows), 1), LANES + 1)], axis=1)  # longer ones stay longer
            far, longest = 1, int(np.bincount(run).max())
            while far < longest:
                same = np.flatnonzero(run[far:] == run[:-far]) + far
                maps[same] = np.take_along_axis(maps[same], maps[same - far], axis=1)
                far *= 2
            enters = self.lengths[ahead[rows[opens]]][run - 1].astype(np.int64)
            enters = np.minimum(enters, LANES + 1)
            lane = np.where(np.isin(np.arange(len(rows)), opens), enters, maps[np.arange(len(rows)) - 1, enters])
            over = lane > LANES
            lane = np.minimum(lane, LANES)
            ahead[rows] = start[np.arange(len(rows)), lane]
            per_chunk[rows] = counts[np.arange(len(rows)), lane]
            after[rows] = end[np.arange(len(rows)), lane]
            following = rows[rows < n - 1] + 1
            ahead[following] = np.where(has[following], after[following - 1], ahead[following])
            single = rows[over]

        # the symbols before each chunk's first known place, from the states that are known now
        states, last = ahead[order], int(at[at < WIDTH].max(initial=-1))
        some = int(np.searchsorted(at, WIDTH))
        for t in range(last + 1):
            a, b = np.searchsorted(at[:some], [t, t + 1])
            closed[t, a:b] = self.finals[states[a:b]] + self.fresh_out[columns[t, a:b]]
            if b < some:
                states[b:some], closed[t, b:some] = self.step(states[b:some], columns[t, b:some])
        out = np.zeros((n, WIDTH), np.int64)
        out[order] = closed.T
        out[rows, 0] = per_chunk[rows]
        return out.ravel()[: len(symbols)], int(after[-1]), single

    def one(self, text: str) -> int:
        """Tokens of one text, symbol by symbol."""
        state, total = 0, 0
        for s in [self.space, *self.of[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tolist(), self.end]:
            state, closed = self.move(state, s)
            total += closed
        return total

    def symbols(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The symbols of each text that has any, in parts of at most BLOCK characters."""
        for text in texts:
            if text:
                yield np.array([self.space], np.uint16)
                whole = text.decode()
                for k in range(0, len(whole), BLOCK):
                    yield self.of[np.frombuffer(whole[k : k + BLOCK].encode("utf-32-le"), np.uint32)]
                yield np.array([self.end], np.uint16)

    def blocks(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for part in self.symbols(texts):
            held.append(part)
            n += len(part)
            if n >= BLOCK:
                whole = np.concatenate(held)
                for k in range(0, n - BLOCK + 1, BLOCK):
                    yield whole[k : k + BLOCK]
                n %= BLOCK
                held = [whole[len(whole) - n :]]
        if n:
            yield np.concatenate(held)

    def counts(self, texts: list[bytes | None]) -> np.ndarray:
        """Tokens of each text."""
        out, some = np.zeros(len(texts), np.int64), np.array([k for k, t in enumerate(texts) if t], np.int64)
        state, before, text = 0, np.zeros(0, np.uint16), 0
        again: set[int] = set()
        for symbols in self.blocks(texts):
            if self.used > self.most:
                pending = self.texts[state]
                self.clear()
                state = self.state(pending)
            closed, state, single = self.block(symbols, state, before)
            ends = np.flatnonzero(symbols == self.end)
            firsts = np.concatenate([[0], ends + 1])
            firsts = firsts[firsts < len(symbols)]
            out[some[text : text + len(firsts)]] += np.add.reduceat(closed, firsts)
            # what follows in such a text is counted from a wrong state, but its end symbol leads back to the start
            again.update(some[text + np.searchsorted(ends, single * WIDTH)].tolist())
            text += len(ends)
            before = symbols[-LANES:]
        for k in again:
            out[k] = self.one(texts[k].decode())
        return out


_ready: dict[str, Transducer] = kept("token counts", {})


def transducer(path: str) -> Transducer:
    """The worker's transducer of a model; it lives as long as the worker."""
    alone("token counts")
    if path not in _ready:
        _ready[path] = Transducer(path)
    return _ready[path]


def count(spark: SparkSession, docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """docs without their text, with n_bytes, n_tokens and over_limit: whether there are more than `limit` tokens."""
    ship(spark)
    small_batches(spark)
    model = model or vocabulary_path("piece_bpe_32k.model")
    kept = [f for f in docs.schema if f.name.lower() not in ("text", "n_bytes", "n_tokens", "over_limit")]
    # under plain names inside, as a name may hold any character
    names = [f"kept_{k}" for k in range(len(kept))]
    plain = [F.col(f"`{f.name.replace('`', '``')}`").alias(n) for f, n in zip(kept, names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            counts = t.counts(texts)
            sizes = np.fromiter((len(x or b"") for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=[*names, "n_bytes", "n_tokens", "over_limit"])

    fields = "".join(f"{n} {f.dataType.simpleString()}, " for f, n in zip(kept, names))
    out = docs.select(*plain, "text").mapInArrow(run, f"{fields}n_bytes long, n_tokens long, over_limit boolean")
    return out.select(*(F.col(n).alias(f.name) for f, n in zip(kept, names)), "n_bytes", "n_tokens", "over_limit")
