"""Very long texts, clashing columns, repeats and ties that the operators' other tests leave out."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gazeloom.llm import langid, mixing, neardup_embed, packing, quality, sharding, warc
from gazeloom.llm.tokens import encoder, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(60_000))


def test_packing_of_a_long_text(spark, long_text):
    docs = spark.createDataFrame([(1, long_text, 5), (2, "short", 5)], "doc_id long, text string, sequence_id int")
    rows = packing.pack(spark, docs, 2048).where("doc_id = 1").orderBy("start").collect()
    ids, bounds = encoder(vocabulary_path()).encode([long_text.encode()], 1)
    assert sum(r.length for r in rows) == rows[0].doc_tokens == bounds[-1] > 50 * 2048
    at = 0
    for r in rows:
        assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
        at += r.length


def test_archives_of_a_long_page(spark, long_text):
    pages = spark.createDataFrame([(k, "http://x/", long_text if k < 3 else "<p>", 1) for k in range(5)], "page_id long, url string, html string, record_type int")
    got = {r.page_id: r for r in warc.read(spark, warc.write(spark, pages)).collect()}
    assert [(got[k].record_type, got[k].refers_to) for k in range(5)] == [("revisit", 2), ("revisit", 2), ("response", None), ("response", None), ("response", None)]
    assert got[0].payload_bytes == len(long_text) and got[0].payload_digest == hashlib.sha1(long_text.encode()).hexdigest()


def test_shards_of_a_long_text(spark, long_text):
    docs = spark.createDataFrame([(1, long_text, 1), (2, None, 1)], "doc_id long, text string, slot int")
    got = {r.doc_id: r for r in sharding.shard(spark, docs, 4).collect()}
    assert got[1].size == len(long_text) + 16 and got[1].text_crc32 == zlib.crc32(long_text.encode()) and got[2].size == 16


def test_mix_keeps_columns_of_any_name(spark, long_text):
    rows = [(k, long_text if k == 0 else "a few words here", None, f"s{k % 2}") for k in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    plain = {r.doc_id: r.taken for r in mixing.mix(spark, docs)[0].collect()}
    names = ("sid", "bucket", "block", "key", "start", "first", "words", "a.b", "size")
    wide = docs.withColumns({n: F.col("doc_id") * 10 for n in names})
    got, _ = mixing.mix(spark, wide, keep=names)
    assert got.columns == ["doc_id", "size", "source_size", "target", *names[:-1], "taken"]
    for r in got.collect():
        assert r.taken == plain[r.doc_id] and all(r[n] == r.doc_id * 10 for n in names[:-1])
    assert {r.doc_id: r["size"] for r in got.collect()}[0] == 60_000


def test_embeddings_with_clashing_columns(spark):
    rows = [(k, [1.0, 0.01 * k, 0.0], 1) for k in range(6)] + [(9, [0.0, 0.0, 1.0], 1)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(map(tuple, neardup_embed.near_duplicates(spark, base).collect()))
    clash = base.withColumns({n: F.lit("x") for n in ("node", "h1", "n", "root", "kept", "usable", "component_id")})
    assert sorted(map(tuple, neardup_embed.near_duplicates(spark, clash).collect())) == want and want[0][1] == 5


def test_languages_of_repeated_rows(spark):
    rng = random.Random(1)
    words = {"en": ("the", "ing", "tion", "ough"), "de": ("ung", "sch", "keit", "ein")}
    rows = [(i, " ".join(rng.choice(words[x]) + rng.choice(words[x]) for _ in range(30)), x, "s") for i in range(60) for x in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows + [rows[4]] * 5, DOCS)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(spark, docs).collect()]
    assert len(got) == 65 and len({x for x in got if x[0] == rows[4][0]}) == 1


def test_a_posterior_of_one_half_keeps(spark):
    """A document on which no rule votes is as likely good as bad, and stays."""
    text = " ".join(re.sub(r"\d", "", f"plain{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(30))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(spark, docs).collect()}
    assert got[3] == (True, False) and got[1] == got[2]
