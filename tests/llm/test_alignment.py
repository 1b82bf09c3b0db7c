"""Tokenizer alignment against brute force, with nulls, blanks of all kinds, long texts, repeats and clashing columns."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gazeloom.llm import alignment
from gazeloom.llm.tokens import vocabulary_path

PATHS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return alignment.Sides(*PATHS)


def texts():
    rng = random.Random(5)
    letters = "abcdefgh  \n\t\r\xa0\x1c\x85étz0123=+-_中😀\x00<s>.,'\" "
    words = ["the", " quick", "fox", "  and", "\n", "don't", "naïve", "1234", "...", "été", " "]
    drawn = ["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 2, 5, 50, 400)))) for _ in range(150)]
    drawn += ["".join(rng.choice(words) for _ in range(rng.choice((3, 30)))) for _ in range(100)]
    return drawn + [None, "", " ", "  ", " a ", "\n", "\n\n x", "a" * 3000, "a ▁b", "don't 'tis it's\n's", "<|endoftext|> a<|endoftext|>", "same text", "same text", "word " * 20_000]


def grouped(sides, text):
    """Ids of A and B, links and the groups as text; nothing where bytes differ."""
    if not text:
        return [], [], [], ""
    a, b = sides.a.encode(" " + text, add_special_tokens=False).ids, sides.b.encode(text)
    whole = f" {text}".encode()
    if any(b"".join(table[k] for k in ids) != whole for ids, table in ((a, sides.a_bytes), (b, sides.b_bytes))):
        return [], [], [], ""

    def ends(ids, table):
        out, n = {}, 0
        for at, k in enumerate(ids):
            n += len(table[k])
            out[n] = at
        return out

    x, y = ends(a, sides.a_bytes), ends(b, sides.b_bytes)
    links, out, i, j = [], [], 0, 0
    for e in sorted(x.keys() & y.keys()):
        links.append((a[x[e]], b[y[e]]))
        out.append(",".join(map(str, a[i : x[e] + 1])) + "|" + ",".join(map(str, b[j : y[e] + 1])))
        i, j = x[e] + 1, y[e] + 1
    return a, b, links, ";".join(out)


def expected(sides, rows):
    found = [(i, *grouped(sides, t)) for i, t in rows]
    counts = Counter(p for x in found for p in x[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    docs = Counter((i, len(a), len(b), len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if a else "") for i, a, b, links, g in found)
    return docs, {(*p, n, n == most[p[1]]) for p, n in counts.items()}


@pytest.mark.parametrize(("block", "at_once", "segments"), [(8 << 20, 1 << 20, 400_000), (400, 60, 50)])
def test_alignment_equals_brute_force(spark, sides, monkeypatch, block, at_once, segments):
    for name, value in (("BLOCK", block), ("AT_ONCE", at_once), ("SEGMENTS", segments), ("LISTED", 7 if block == 400 else 20_000)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string").repartition(4)
    got, pairs = alignment.align(spark, docs)
    want, want_pairs = expected(sides, rows)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == want
    assert {(r.a, r.b, r["count"], r.best) for r in pairs.collect()} == want_pairs


def test_groups_and_overlaps(spark, sides):
    docs = spark.createDataFrame([(1, "naïve tokenizers, aligned"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(spark, docs, keep_groups=True)[0].collect()}
    a, b, links, groups = grouped(sides, "naïve tokenizers, aligned")
    assert got[1].groups == groups and got[2].groups == ""
    # each group's tokens overlap in a chain: one pair less than they are
    assert got[1].n_overlaps == len(a) + len(b) - len(links)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").where(F.lit(False))
    got, pairs = alignment.align(spark, docs)
    assert got.count() == 0 and pairs.count() == 0
