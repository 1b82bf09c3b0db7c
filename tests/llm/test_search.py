"""Ranked search against brute force, with nulls, ties, repeats, long texts, clashing columns and several blocks."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gazeloom.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(items, docs, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)] + ["été", "ÉTÉ", "Ab", "aB", "naïve", "中文", "x_y", "don't"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice((" ", ", ", "\n", "\x00", "-")) for _ in range(n))

    docs = [(k, text(rng.choice((0, 1, 3, 20, 90)))) for k in range(150)] + [(None, text(30)), (None, "w1"), (7, "w1 w2"), (7, "w1 w2"), (200, None), (201, ""), (202, " ,. "), (203, text(40_000))]
    docs += [(300 + k, "w3 w4 tie") for k in range(15)]
    items = [(k, text(rng.choice((1, 4, 12)))) for k in range(25)] + [(90, None), (91, "?!"), (92, "tie"), (None, "w5 w6"), (93, "w1"), (93, "w2 w3"), (94, "no such term zzz")]
    return items, docs


@pytest.mark.parametrize(("pairs", "entries"), [(10**6, 1 << 21), (40, 60)])
def test_search_equals_brute_force(spark, tables, monkeypatch, pairs, entries):
    items, docs = tables
    monkeypatch.setattr(search, "ENTRIES", entries)
    a = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    b = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(5)
    assert Counter(map(tuple, search.search(spark, a, b, 10, pairs).collect())) == ranked(items, docs, 10)


def test_empty_tables(spark, tables):
    a = spark.createDataFrame(tables[0], "item_id long, text string")
    b = spark.createDataFrame(tables[1], "doc_id long, text string")
    assert search.search(spark, a, b.where("false")).count() == 0
    assert search.search(spark, a.where("false"), b).count() == 0


def test_radix_order_sorts_packed_keys():
    rng = np.random.default_rng(1)
    item, doc = (rng.integers(0, n, 5000).astype(np.uint16) for n in (70, 65536))
    order = search.radix_order(item, doc)
    packed = (item.astype(np.int64) << 16) | doc
    assert (packed[order] == np.sort(packed)).all()
