"""The corpus pipeline's stages against plain Python, with columns that clash, nulls, repeats, long and empty texts."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gazeloom.llm import jaccard_trie, langid, mixing, neardup_embed, quality, suffix_dedup, token_codes, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("key", "th", "spans", "score", "text_hash", "n_removed", "lang_pred", "held_out", "size", "taken", "row", "kept_0", "doc_key", "copy", "sig")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def said(rng, language, n):
    parts = {"en": ("the", "ing", "tion", "wh", "ough"), "de": ("ung", "sch", "keit", "ein", "zu")}[language]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + rng.choice(("", ".", ",")) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(k, said(rng, ("en", "de")[k % 2], rng.randint(8, 90)), ("en", "de")[k % 2], f"s{k % 3}") for k in range(120)]
    base, passage = out[4][1], said(rng, "en", 60)
    near = base.split()
    near[0] = "changed"
    out += [(200, base, "en", "s0"), (201, " ".join(near + said(rng, "en", 3).split()), "en", "s1"), (202, passage + " a tail of its own", "en", None), (203, "a head of its own " + passage, "en", "s2")]
    out += [(204, None, "en", "s0"), (205, "", None, "s1"), (206, "12 34 ## 56", "en", "s0"), (207, "two words", "en", "s1"), (207, "two words", "en", "s1"), (None, said(rng, "de", 30), None, "s2"), (208, said(rng, "en", 9000), "en", "s2"), (209, "ung" * 400, "de", "s1")]
    return [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *(F.lit(f"user's {c}").alias(c) for c in CLASHING))


def own(df):
    """Rows of the five columns; the others must be as they were."""
    got = df.collect()
    assert all(r[c] == f"user's {c}" for r in got for c in CLASHING)
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got)


def test_language(spark, rows, docs):
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns
    got = own(out)
    assert not {204, 205, 206} & {r[0] for r in got}
    clean = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    assert len([r for r in clean if r in got]) > 0.97 * len([r for r in clean if r[2]])
    assert all(any(r[:2] == x[:2] for x in rows) for r in got)


def test_near_copies(spark, rows, docs):
    sets = []
    for r in rows:
        w = [x.lower() for x in WORD.findall(r[1] or "")]
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r)
    want = Counter()
    for members in groups.values():
        least = min((r[0] for r in members if r[0] is not None), default=None)
        want.update({r for r in members if r[0] == least})
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns and own(out) == want
    assert len(want) < len(rows) - 2


def test_repeated_passages(spark, rows, docs):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        if not any(gone):
            want[r] += 1
            continue
        left = bytes(c for c, g in zip(t, gone) if not g).decode(errors="ignore")
        if left.strip(" "):
            want[(r[0], left, r[2], r[3], len(left))] += 1
    out = corpus_pipeline.repeated_passages(spark, docs, "")
    assert out.columns == docs.columns and own(out) == want


def test_mixture(spark, rows, docs):
    out = corpus_pipeline.mixture(spark, docs, "")
    assert out.columns == docs.columns
    taken, _ = mixing.mix(spark, spark.createDataFrame(rows, DOCS))
    times = Counter()
    for r in taken.collect():
        if r["size"]:
            times[r.doc_id] += int(r.taken / r["size"] + 0.5)
    assert Counter(k for k, *_ in own(out).elements()) == +times
    assert all(any(x == r for r in rows) for x in own(out))


def test_packed(spark, rows, docs):
    t = tokens.Tokenizer.from_file(tokens.vocabulary_path())
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])
    got = corpus_pipeline.packed(spark, docs, "").collect()
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) == r.ids_crc32 for x in ids[r.doc_id])


def test_run(spark, rows, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and not {204, 205, 206} & {r.doc_id for r in got}
    seats = defaultdict(list)
    for r in got:
        seats[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(s)[k][0] == sum(n for _, n in sorted(s)[:k]) for s in seats.values() for k in range(len(s)))


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns
    plain = spark.createDataFrame([], DOCS)
    assert langid.identify(spark, plain).count() == jaccard_trie.similar(spark, plain).count() == suffix_dedup.deduplicated(spark, plain, 200, digest=True).count() == 0
    assert neardup_embed.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(12)
    long = said(rng, "en", 40_000)
    rows = [(1, long, "en", "a"), (2, long + " and a tail", "en", "b"), (3, said(rng, "en", 30), "en", "a"), (4, "ough" * 20_000, "en", "b"), (5, said(rng, "de", 30), "de", "b")]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], DOCS)
    assert {r.doc_id: r.component_id for r in jaccard_trie.similar(spark, df, 3, 90, 100).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    cut = {r.doc_id: r for r in suffix_dedup.deduplicated(spark, df, 200, digest=True).collect()}
    assert cut[1].n_removed == cut[2].n_removed == len(long) and cut[3].n_removed == 0 and cut[4].n_removed == 80_000
    assert {r.doc_id: r.n_words for r in quality.judge(spark, df).collect()} == {r[0]: len(WORD.findall(r[1])) for r in rows}
    t = tokens.Tokenizer.from_file(tokens.vocabulary_path())
    assert {r.doc_id: r.n_tokens for r in token_codes.read(spark, token_codes.write(spark, df, per_file=50_000)).collect()} == {r[0]: len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows}
    model = langid.fit({"en": Counter(langid.words_of(rows[2][1])), "de": Counter(langid.words_of(rows[4][1]))}, __import__("public_tokenizers").path("piece_bpe_32k.model"), {"en": 1, "de": 1})
    assert {r.doc_id: r.lang_pred for r in langid.predict(spark, df, model).collect()} == {1: "en", 2: "en", 3: "en", 4: "en", 5: "de"}


def test_schedule_is_even_in_every_prefix(spark):
    rows = [(k, "word " * 50, None, f"s{k % 3}", 250) for k in range(600)]
    _, schedule = mixing.mix(spark, spark.createDataFrame(rows, DOCS), block=50)
    slots = [r.sid for r in schedule.orderBy("slot").collect()]
    share = {s: n / len(slots) for s, n in Counter(slots).items()}
    seen = Counter()
    for k, s in enumerate(slots, 1):
        seen[s] += 1
        assert all(abs(seen[x] - k * share[x]) < 6 for x in share)  # a golden-ratio sequence's error grows with the logarithm of its length
