"""Whole texts to token ids, with the tokenizers library behind a cache of words.

The tokenizer splits at white space before anything else that looks past a character, so a text's
ids are those of its white-space-separated chunks. Chunks, and the pre-tokens of those whose
characters normalise one by one, are encoded once in a worker and then looked up.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

from gazeloom.llm.shared import alone, kept

#: Below U+0300 every character is its own NFC form.
FIRST_COMBINING = "̀"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class _Words(dict):
    """bytes of a chunk -> number of its entry; missing ones are encoded."""

    def __init__(self, encoder: "Encoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: bytes) -> int:
        return self.encoder._add(chunk)


class Encoder:
    """Ids of texts as the tokenizer file gives them, without special tokens of its own."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        steps = spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"]
        # the shape for which chunks and pre-tokens can be encoded alone; other files take the library's whole path
        self.by_word = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["invert"] and not split[1]["add_prefix_space"]
        self.pattern = regex.compile(split[0]["pattern"]["Regex"]) if self.by_word else None
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.bytes = byte_alphabet()
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.words = _Words(self)
        self.starts, self.lengths, self.flat = array("q"), array("i"), array("I")
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """A pre-token's ids as packed unsigned integers."""
        ids = self.parts.get(part)
        if ids is None:
            # every byte goes through the alphabet: control characters don't stand for themselves
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize("".join([self.bytes[b] for b in part.encode()]))]).tobytes()
            self.parts[part] = ids
        return ids

    def _add(self, chunk: bytes) -> int:
        text = chunk.decode()
        if max(text) < FIRST_COMBINING and not any(a in text for a in self.added):
            ids = b"".join(map(self._part, self.pattern.findall(text.lower())))
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        k = self.words[chunk] = len(self.starts)
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids) // self.flat.itemsize)
        self.flat.frombytes(ids)
        return k

    def encode(self, texts: list[bytes | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, uint32; where each text's ids begin, and their end). end: an id after each text."""
        if not self.by_word:
            each = [self.tokenizer.encode((t or b"").decode(), add_special_tokens=False).ids + ([end] if end is not None else []) for t in texts]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            return np.fromiter((i for x in each for i in x), np.uint32, bounds[-1]), bounds
        if len(self.words) > self.most:
            self._clear()
        split = [(t or b"").split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        find = self.words.__getitem__
        which = np.fromiter((k for words in split for k in map(find, words)), np.int64, int(counts.sum()))
        # views, not copies: they are gone before the next word is added
        starts, lengths = np.frombuffer(self.starts, np.int64)[which], np.frombuffer(self.lengths, np.int32)[which]
        after = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        take = np.repeat(starts - after[:-1], lengths) + np.arange(after[-1])
        ids = np.frombuffer(self.flat, np.uint32)[take]
        bounds = after[np.concatenate([[0], np.cumsum(counts)])]
        if end is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


_encoders: dict[str, Encoder] = kept("tokens", {})


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it lives as long as the worker."""
    alone("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
