"""The fit of language models: in tasks as in one process, with rare words and long runs; brute force for long words; accuracy of the query."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.llm import langid
from gazeloom.llm.tokens import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")


def counts():
    rng = random.Random(7)
    parts = {"en": ("the", "ing", "tion", "wh", "ough"), "de": ("ung", "sch", "keit", "ein", "zu"), "th": ("ก", "ข", "ค", "กา")}
    out = {}
    for lang, some in parts.items():
        out[lang] = Counter("".join(rng.choice(some) for _ in range(rng.randrange(1, 5))) for _ in range(400))
        out[lang]["".join(rng.choice(some) for _ in range(300))] += 2  # a run of more letters than a lattice takes
    out["en"]["ungkeit"] += 1  # a word of two languages
    return out


def test_tasks_fit_as_one_process(spark):
    found = counts()
    rows = [(w, {x: c[w] for x, c in found.items() if w in c}) for w in sorted(set().union(*found.values()))]
    words = spark.createDataFrame(rows, "word string, counts map<string, long>").repartition(5)
    priors = {"en": 3.0, "de": 1.0, "th": 1.0}
    a, b = langid.fit(found, PATH, priors), langid.fit_words(spark, words, PATH, priors)
    assert a.languages == b.languages == ["de", "en", "th"] and np.allclose(a.prior, b.prior) and np.allclose(a.p, b.p, rtol=1e-9)
    # long runs teach too: without them the pieces of their language would have other shares
    short = {x: Counter({w: n for w, n in c.items() if len(w) <= langid.LONG}) for x, c in found.items()}
    assert not np.allclose(langid.fit(short, PATH, priors).p, a.p, rtol=1e-3)


@pytest.mark.parametrize("n", [1, 2, 9, 40, 64])
def test_long_words_are_counted_as_short_ones(n):
    index = {"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5}
    p = np.array([[1e-9, 0.1], [0.2, 1e-7], [0.3, 0.1], [0.25, 0.2], [0.1, 0.3], [0.05, 0.2]])
    rng = random.Random(n)
    word, weight = "".join(rng.choice("abc") for _ in range(n)), np.array([2.0, 5.0])
    want = langid.Lattices([word], index, 3).expected(p, weight[None])
    assert np.allclose(langid.expected_alone(word, index, 3, p, weight), want)


def test_very_long_runs_do_not_vanish():
    index = {"a": 1, "b": 2, "ab": 3}
    p = np.array([[1e-6], [0.2], [0.3], [0.5]])
    uses = langid.expected_alone("ab" * 20_000 + "c", index, 2, p, np.ones(1))
    assert np.isclose((uses[:, 0] * [1, 1, 1, 2]).sum(), 40_001) and np.isclose(uses[0, 0], 1)


def test_no_word_is_left_out(spark):
    """Each word of the sampled rows has its count, whatever its rank or length."""
    texts = [" ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x{'y' * (j % 3)}" for k in range(600) for j in range(1 + k % 2)), "z" * 5000]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    seen = []
    real = langid.fit_words

    def caught(spark, words, path, priors, rounds=4):
        seen.append({r.word: r.counts["en"] for r in words.collect()})
        return real(spark, words, path, priors, 1)

    langid.fit_words = caught
    try:
        langid.train(spark, docs, PATH)
    finally:
        langid.fit_words = real
    assert seen[0] == dict(Counter(w for t in texts for w in langid.words_of(t))) and "z" * 5000 in seen[0]


def test_query_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    from gazeloom.llm.queries import op2_language_id

    got = op2_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null and lang_pred <> 'und'")
    assert held.count() > 20 and held.where(F.col("lang") != F.col("lang_pred")).count() <= 0.02 * held.count()


def test_known_words_keep_their_sums(monkeypatch):
    """Sums are the same whether a word is new, kept, dropped and met again, or too long to be kept."""
    rng = random.Random(2)
    found = counts()
    model = langid.fit(found, PATH, {"en": 1.0, "de": 1.0, "th": 1.0}, 1)
    index, longest = langid.index_of(PATH)
    words = ["".join(rng.choice("theingsch") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    known = langid.Known(model, 60)
    for _ in range(20):
        texts = [rng.sample(words, rng.randrange(0, 12)) for _ in range(5)] + [["the"] * 3]
        flat = [w for t in texts for w in t]
        assert np.allclose(known.of(texts), langid.log_totals(flat, index, longest, model.p))
        assert len(known.used) <= 60 + len(set(flat)) and all(len(w) <= langid.CACHED for w in known.number)
    assert known.of([]).shape == (0, 3) and known.of([[]]).shape == (0, 3)
    assert langid.known(model, 60) is langid.known(model, 60)
