"""Token counts by the compiled transducer against the library, with nulls, empty and long texts, repeats and clashing columns."""

import random

import pytest
import sentencepiece

from gazeloom.llm import token_counts
from gazeloom.llm.tokens import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(11)
    letters = "abcdefghij  \n\t▁étz0123=+-_中😀\x00<s>.,'\""
    drawn = ["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 50, 400, 3000)))) for _ in range(120)]
    return drawn + [None, "", " ", "  a", "▁" * 1000, " " * 5000, "=" * 5000, "a" * 4000, "ab" * 3000, "0" * 9999, "the" * 2000, "<unk><s></s><0x41>", "=-" * 1500, "é" * 900, "same", "same"]


def wanted(library, some):
    return [len(library.encode(t)) if t else 0 for t in some]


# small chunks and few lanes: most chunks need tables and scans, and some texts single steps
@pytest.mark.parametrize(("width", "lanes", "block", "most"), [(256, 48, 1 << 21, 10**6), (7, 5, 210, 10**6), (16, 48, 320, 2000), (5, 3, 25, 10**6)])
def test_counts_equal_the_library(library, monkeypatch, width, lanes, block, most):
    for name, value in (("WIDTH", width), ("LANES", lanes), ("BLOCK", block)):
        monkeypatch.setattr(token_counts, name, value)
    some = texts()
    t = token_counts.Transducer(PATH, most)
    for _ in range(2):
        assert t.counts([x if x is None else x.encode() for x in some]).tolist() == wanted(library, some)


def test_a_text_longer_than_a_block(library):
    rng = random.Random(2)
    some = ["".join(rng.choice(("rain ", "falls", " on\n", "x1", "....")) for _ in range(700_000)), "end"]
    assert token_counts.Transducer(PATH).counts([x.encode() for x in some]).tolist() == wanted(library, some)


def test_settled_prefix_is_final(library):
    """What a state has closed does not change with what follows."""
    v, rng = token_counts.Vocabulary(PATH), random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("▁thereadsing") for _ in range(rng.randrange(1, 14)))
        pending, closed = v.settle(text)
        for _ in range(5):
            more = "".join(rng.choice("▁thereadsing") for _ in range(rng.randrange(6)))
            assert v.split(text + more)[0] == closed + v.split(pending + more)[0]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(PATH, "rb").read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        token_counts.Vocabulary(str(tmp_path / "other.model"))


def test_rows(spark, library):
    some = texts()
    rows = [(k if k else None, t, "x", 1.5) for k, t in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `N_Tokens` string, `a``b` double").repartition(3)
    got = token_counts.count(spark, docs, limit=900)
    assert got.columns == ["doc_id", "a`b", "n_bytes", "n_tokens", "over_limit"]
    want = wanted(library, some)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(r[0], 1.5, len((r[1] or "").encode()), n, n > 900) for r, n in zip(rows, want)], key=str)
    assert token_counts.count(spark, docs.where("false")).count() == 0
