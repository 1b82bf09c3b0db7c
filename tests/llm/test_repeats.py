"""Many rows that are equal in doc_id (or have none) and text: results as by brute force, and no more work than rows."""

import hashlib
import random
import time
from collections import Counter

import pytest

from gazeloom.llm import jaccard_trie, suffix_dedup


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def removed(texts, length):
    """Of each text (with its number of rows) the bytes left and the runs removed."""
    starts = Counter()
    for t, n in texts:
        for k in range(len(t) - length + 1):
            starts[t[k : k + length]] += n
    out = []
    for t, _ in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if starts[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        left = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    passage = words(rng, 60)
    texts = [words(rng, 150), f"{words(rng, 30)} {passage} {words(rng, 30)}", f"{passage} {words(rng, 40)}", words(rng, 50)]
    return [(None, texts[0], 200), (7, texts[1], 200), (8, texts[2], 1), (None, texts[3], 1), (9, "", 50), (None, None, 50)]


def table(spark, rows):
    return spark.createDataFrame([(i, t) for i, t, n in rows for _ in range(n)], "doc_id long, text string").repartition(4)


def test_suffixes_of_repeated_rows(spark, rows):
    got = Counter(map(tuple, suffix_dedup.deduplicated(spark, table(spark, rows), 200, digest=True).collect()))
    want = Counter()
    for (i, _, n), facts in zip(rows, removed([((t or "").encode(), n) for _, t, n in rows], 200)):
        want[(i, *facts)] += n
    assert got == want


def test_jaccard_of_repeated_rows(spark, rows):
    df = table(spark, [*rows, (3, rows[0][1] + " end", 1)])
    got = Counter((r.doc_id, r.component_id) for r in jaccard_trie.similar(spark, df, 3, 90, 100).collect())
    # the null ids' text is linked with document 3; the others stand alone
    assert got == Counter({(None, 3): 200, (3, 3): 1, (7, 7): 200, (8, 8): 1, (None, None): 1 + 50, (9, 9): 50})


def test_repeated_rows_cost_no_more_than_rows(spark):
    text = words(random.Random(1), 350)
    seconds = []
    for ids in (range(3000), [None] * 3000):
        df = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").repartition(4)
        began = time.time()
        assert suffix_dedup.deduplicated(spark, df, 200, digest=True).where("n_removed = n_bytes").count() == 3000
        seconds.append(time.time() - began)
    assert seconds[1] < 3 * seconds[0] + 5
