"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability in
a language is the sum, over all its segmentations into pieces, of the product of their
probabilities: a forward algorithm over the word's lattice. A text's is the product over its words,
times the language's prior. Piece probabilities are learned by expectation-maximisation with
forward-backward counts on words of labelled texts.

Fitting uses, per language, documents whose hash of doc_id is below a bound that makes about
`per_language` of them, and all words of their whole texts, however rare or long. Words are counted and
grouped by Spark; in each round tasks sum the expected uses of pieces over their words, and the driver
holds the sums: pieces by languages. Prediction reads every whole text and sums over all segmentations
of every whole run of letters, in lower case, however long it is: the sums of the last positions are all
that the next one needs, and they are rescaled before they vanish.

Nulls: a null text, or one without a letter, is `und` with score 0; null langs are not learned from;
null doc_ids are hashed as nothing and are neither learned from nor held out. With no labelled text
everything is `und`. Of languages that are equally probable the first by name is given. Repeated rows get equal answers; empty tables give empty results. Columns of
docs named held_out, lang_pred or score give way to those of the result; others are kept.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.shared import Scratch, alone, kept, ship, small_batches

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Longer words are scored anew each time, so a worker's cache holds short strings.
CACHED = 64
#: Positions whose edges are listed at once, and the letters of a block of words.
POSITIONS, LETTERS_AT_ONCE = 4096, 200_000
#: Words of more letters are fitted one by one, in logarithms.
LONG = 64
FAINT, FAINTER = 1e-120, 1e120
UNKNOWN = "und"


def pieces(path: str) -> list[str]:
    """The distinct lower-case letter strings among a sentence-piece vocabulary's pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k).replace("▁", "").lower() for k in range(model.get_piece_size())}
    return sorted(p for p in found if p and LETTERS.fullmatch(p))


class Lattices:
    """All edges (start, end, piece) of a list of words, ready for vectorised passes.

    Piece 0 is any single character that is no piece itself.
    """

    def __init__(self, words: list[str], index: dict[str, int], longest: int):
        word, start, end, piece = [], [], [], []
        for w, text in enumerate(words):
            n = len(text)
            for i in range(n):
                one = index.get(text[i], 0)
                word.append(w), start.append(i), end.append(i + 1), piece.append(one)
                for j in range(i + 2, min(n, i + longest) + 1):
                    k = index.get(text[i:j])
                    if k is not None:
                        word.append(w), start.append(i), end.append(j), piece.append(k)
        self.n, self.lengths = len(words), np.array([len(w) for w in words], np.int64)
        self.letters = np.ones(len(index) + 1)
        self.letters[list(index.values())] = list(map(len, index))
        self.word, self.start, self.end, self.piece = (np.array(x, np.int64) for x in (word, start, end, piece))
        self.depth = int(self.lengths.max()) if len(words) else 0

    def _passes(self, key: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(key, kind="stable")
        bounds = np.searchsorted(key[order], np.arange(self.depth + 2))
        return [order[a:b] for a, b in zip(bounds, bounds[1:])]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: probability of all segmentations up to a position. p: [piece, language]."""
        alpha = np.zeros((self.n, self.depth + 1, p.shape[1]))
        alpha[:, 0] = 1
        for t, edges in enumerate(self._passes(self.end)):
            if t and len(edges):
                gain = alpha[self.word[edges], self.start[edges]] * p[self.piece[edges]]
                cut = np.flatnonzero(np.diff(self.word[edges], prepend=-1))  # edges keep the words' order
                alpha[self.word[edges][cut], t] = np.add.reduceat(gain, cut, axis=0)
        return alpha

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses [piece, language] of each piece, words weighted by [word, language].

        Every piece is multiplied by a constant for each of its letters, which all segmentations of a word share, so that sums stay near one.
        """
        rate = -(p * np.log(p)).sum(axis=0) / (p * self.letters[:, None]).sum(axis=0)
        p = p * np.exp(self.letters[:, None] * rate)
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.lengths] = 1
        passes = self._passes(self.start)
        for t in range(self.depth - 1, -1, -1):
            edges = passes[t]
            if len(edges):
                gain = beta[self.word[edges], self.end[edges]] * p[self.piece[edges]]
                cut = np.flatnonzero(np.diff(self.word[edges], prepend=-1))
                beta[self.word[edges][cut], t] += np.add.reduceat(gain, cut, axis=0)
        scale = weight / np.maximum(alpha[np.arange(self.n), self.lengths], 1e-300)
        use = np.nan_to_num(alpha[self.word, self.start] * p[self.piece] * beta[self.word, self.end] * scale[self.word])
        return np.stack([np.bincount(self.piece, use[:, k], len(p)) for k in range(p.shape[1])], axis=1)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def log_totals(words: list[str], index: dict[str, int], longest: int, p: np.ndarray) -> np.ndarray:
    """[word, language]: log of the sum over all segmentations of each word, of any length.

    Only the sums of the last `longest` positions are held. Where they get faint they are multiplied by a constant, which is counted.
    """
    n, ring = len(words), longest + 1
    lengths = np.array([len(w) for w in words], np.int64)
    last = np.zeros((n, ring, p.shape[1]))
    last[:, 0] = 1
    faded, out = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
    alive, first = range(n), 0
    while len(alive):
        word, start, end, piece = (array("q") for _ in range(4))
        stop = first + POSITIONS
        for w in alive:
            text, m = words[w], len(words[w])
            for i in range(max(0, first - longest + 1), min(m, stop)):
                if i >= first:
                    word.append(w), start.append(i), end.append(i + 1), piece.append(index.get(text[i], 0))
                for j in range(max(i + 2, first + 1), min(m, i + longest, stop) + 1):
                    k = index.get(text[i:j])
                    if k is not None:
                        word.append(w), start.append(i), end.append(j), piece.append(k)
        word, start, end, piece = (np.frombuffer(x, np.int64) for x in (word, start, end, piece))
        order = np.argsort(end, kind="stable")  # the words' order stays within a position
        bounds = np.searchsorted(end[order], np.arange(first + 1, min(stop, int(lengths.max())) + 2))
        for t, (a, b) in enumerate(zip(bounds, bounds[1:]), first + 1):
            edges = order[a:b]
            own = word[edges]
            gain = last[own, start[edges] % ring] * p[piece[edges]]
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            own, now = own[cut], np.add.reduceat(gain, cut, axis=0)
            last[own, t % ring] = now
            if (now < FAINT).any():
                x, y = np.nonzero(now < FAINT)
                last[own[x], :, y] *= FAINTER
                faded[own[x], y] += 1
            done = own[lengths[own] == t]
            out[done] = np.log(last[done, t % ring]) - faded[done] * np.log(FAINTER)
        first, alive = stop, [w for w in alive if len(words[w]) > stop]
    return out


def blocks_of(words: list[str]) -> Iterator[list[str]]:
    """Words in blocks of a bounded number of letters; one that is longer is alone."""
    block, letters = [], 0
    for w in words:
        if block and letters + len(w) > LETTERS_AT_ONCE:
            yield block
            block, letters = [], 0
        block.append(w)
        letters += len(w)
    if block:
        yield block


class Model:
    def __init__(self, path: str, languages: list[str], p: np.ndarray, prior: np.ndarray):
        self.path, self.languages, self.p, self.prior = path, languages, p, prior


def index_of(path: str) -> tuple[dict[str, int], int]:
    known = pieces(path)
    return {p: k + 1 for k, p in enumerate(known)}, max(map(len, known))


def expected_alone(word: str, index: dict[str, int], longest: int, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses [piece, language] in one word of any length, weighted by language; sums are logarithms."""
    n, logp = len(word), np.log(p)
    edges = []
    for t in range(1, n + 1):
        found = [(t - 1, index.get(word[t - 1], 0)), *((s, k) for s in range(max(0, t - longest), t - 1) if (k := index.get(word[s:t])) is not None)]
        edges.append(tuple(np.array(x, np.int64) for x in zip(*found)))
    alpha = np.full((n + 1, p.shape[1]), -np.inf)
    beta = alpha.copy()
    alpha[0], beta[n] = 0, 0
    for t, (starts, pieces_) in enumerate(edges, 1):
        alpha[t] = np.logaddexp.reduce(alpha[starts] + logp[pieces_], axis=0)
    uses = np.zeros_like(p)
    for t in range(n, 0, -1):
        starts, pieces_ = edges[t - 1]
        gain = beta[t] + logp[pieces_]
        beta[starts] = np.logaddexp(beta[starts], gain)  # starts are different places
        np.add.at(uses, pieces_, np.exp(alpha[starts] + gain - alpha[n]) * weight)
    return uses


def expected_uses(words: list[str], weight: np.ndarray, index: dict[str, int], longest: int, p: np.ndarray) -> np.ndarray:
    """Expected uses [piece, language] of each piece in words of any length, weighted by [word, language]."""
    uses, short = np.zeros_like(p), sorted((k for k, w in enumerate(words) if len(w) <= LONG), key=lambda k: len(words[k]))
    at = 0
    for block in blocks_of([words[k] for k in short]):  # of words of like length, as a lattice is as wide as its longest
        uses += Lattices(block, index, longest).expected(p, weight[short[at : at + len(block)]])
        at += len(block)
    for k, w in enumerate(words):
        if len(w) > LONG:
            uses += expected_alone(w, index, longest, p, weight[k])
    return uses


def fitted(path: str, priors: dict[str, float], step: Callable[[np.ndarray], np.ndarray], rounds: int) -> Model:
    """Expectation-maximisation from equal probabilities; step: from probabilities to expected uses. Languages are in order of their names."""
    index, _ = index_of(path)
    p = np.full((len(index) + 1, len(priors)), 1.0 / (len(index) + 1))
    for _ in range(rounds):
        uses = step(p) + 0.01
        p = uses / uses.sum(axis=0)
    prior = np.array([priors[x] for x in sorted(priors)], float)
    return Model(path, sorted(priors), p, prior / prior.sum())


def fit(counts: dict[str, Counter], path: str, priors: dict[str, float], rounds: int = 4) -> Model:
    """counts: words of each language, as many as one process holds."""
    index, longest = index_of(path)
    words = sorted(set().union(*counts.values()))
    weight = np.array([[counts[x][w] for x in sorted(counts)] for w in words], float).reshape(len(words), len(counts))
    return fitted(path, priors, lambda p: expected_uses(words, weight, index, longest, p), rounds)


def fit_words(spark: SparkSession, words: DataFrame, path: str, priors: dict[str, float], rounds: int = 4) -> Model:
    """words: word, counts (map from language to number), a row a word, read once a round. What a round brings to the driver is bounded by pieces times languages."""
    languages = sorted(priors)

    def step(p: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(p)  # pieces by languages: fixed by the vocabulary

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, longest = index_of(path)
            p = shared.value
            uses = np.zeros_like(p)
            for batch in batches:
                weight = np.array([[c.get(x, 0) for x in languages] for c in map(dict, batch.column("counts").to_pylist())], float).reshape(len(batch), len(languages))
                uses += expected_uses(batch.column("word").to_pylist(), weight, index, longest, p)
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses.ravel()[at])], names=["at", "uses"])

        found = words.mapInArrow(sums, "at long, uses double").groupBy("at").agg(F.sum("uses").alias("uses")).toArrow()
        shared.unpersist()
        out = np.zeros(p.size)
        out[found.column("at").to_numpy()] = found.column("uses").to_numpy()
        return out.reshape(p.shape)

    return fitted(path, priors, step, rounds)


def train(spark: SparkSession, labelled: DataFrame, path: str, per_language: int = 1500, scratch: Scratch | None = None) -> Model | None:
    """labelled: doc_id, text, lang, all of which may be learned from."""
    shares = {r.lang: r.n for r in labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    scratch = scratch or Scratch(spark, "languages")
    # a hash of doc_id in [0, 1) under the language's share of rows
    part = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) / 1_000_000.0
    bound = F.create_map(*[x for k, n in shares.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    chosen = labelled.where(F.col("lang").isNotNull()).where(part < bound[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text or ""))
        rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        for i in range(0, len(rows), 100_000):
            lang, w, n = zip(*rows[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(w), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    each = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = each.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts"))  # an entry a language
    words = scratch.save(words.repartition(spark.sparkContext.defaultParallelism, "word"), "words")
    known = [r.lang for r in words.select(F.explode(F.map_keys("counts")).alias("lang")).distinct().collect()]
    return fit_words(spark, words, path, {k: shares[k] for k in known}) if known else None


class Known:
    """A model's log sums of the words that a worker has met; once there are more than `most`, the half that came most often stays."""

    def __init__(self, model: Model, most: int):
        self.index, self.longest = index_of(model.path)
        self.p, self.most = model.p, most
        self.number: dict[str, int] = {}
        self.sums, self.used = np.zeros((0, model.p.shape[1])), np.zeros(0, np.int64)

    def thin(self) -> None:
        kept = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        new = np.full(len(self.used), -1)
        new[kept] = np.arange(len(kept))
        self.number = {w: k for w, k in zip(self.number, new[np.fromiter(self.number.values(), np.int64, len(self.number))].tolist()) if k >= 0}
        self.sums, self.used = self.sums[kept], self.used[kept] // 2

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """The log sums of all words of texts, one after another."""
        unseen = sorted(set().union(*texts).difference(self.number)) if texts else []
        if len(self.used) + len(unseen) > self.most and len(self.used):
            self.thin()
            unseen = sorted(set().union(*texts).difference(self.number))
        at = len(self.used)
        self.number.update(zip(unseen, range(at, at + len(unseen))))
        self.sums = np.concatenate([self.sums, *(log_totals(some, self.index, self.longest, self.p) for some in blocks_of(unseen))])
        which = np.fromiter((k for t in texts for k in map(self.number.__getitem__, t)), np.int64, sum(map(len, texts)))
        used = np.bincount(which, minlength=len(self.sums))
        used[:at] += self.used
        self.used = used
        for w in unseen:
            if len(w) > CACHED:  # scored anew each time; its sums go with the next thinning
                self.used[self.number.pop(w)] = 0
        return self.sums[which]


_ready: dict[str, Known] = kept("languages", {})


def known(model: Model, most: int) -> Known:
    """What the worker knows by a model; it lives as long as the worker. Named here, as what a task's function holds itself is new with each task."""
    alone("languages")
    key = f"{model.path} {most} {model.p.sum(axis=0).tobytes()!r} {model.p[::97].tobytes()!r}"
    if key not in _ready:
        _ready.clear()
        _ready[key] = Known(model, most)
    return _ready[key]


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, cache: int = 400_000) -> DataFrame:
    """docs (doc_id, text and others) with lang_pred, score: the posterior of that language."""
    if model is None:
        return docs.drop("lang_pred", "score").withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = spark.sparkContext.broadcast(model)  # pieces by languages: fixed by the vocabulary
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words, base = known(m, cache), np.log(m.prior)
        for batch in batches:
            texts = [words_of(t) if t else [] for t in batch.column("text").to_pylist()]
            counts = np.fromiter(map(len, texts), np.int64, len(texts))
            each = words.of(texts)
            sums = np.zeros((len(texts), len(m.languages)))
            some = counts > 0
            if some.any():
                sums[some] = np.add.reduceat(each, (np.cumsum(counts) - counts)[some], axis=0)
            sums += base
            best = sums.argmax(axis=1)
            odds = np.exp(sums - sums.max(axis=1, keepdims=True))
            score = np.where(some, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            lang = [m.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(spark: SparkSession, docs: DataFrame, path: str | None = None, per_language: int = 1500) -> DataFrame:
    """docs with held_out, lang_pred and score. Learns from labelled documents whose crc32(doc_id) mod 3 is not 1."""
    ship(spark)
    small_batches(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(spark, docs.where(fold != 1).select("doc_id", "text", "lang"), path, per_language)
    held = docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))
    return predict(spark, held, model)
