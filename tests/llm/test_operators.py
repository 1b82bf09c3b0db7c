"""The corpus operators against brute force on small tables, with nulls, empty texts, ties and repeats."""

import hashlib
import random
import re
import struct
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.llm import jaccard_trie, langid, mixing, neardup_embed, packing, quality, sharding, suffix_dedup, token_codes, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=("the", "of", "and", "rain", "falls", "on", "quiet", "hills", "where", "old", "men", "walk", "slowly", "home", "before", "night")):
    return " ".join(rng.choice(words) + rng.choice(("", "", "s", "ed", ".")) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (60, 120, 400, 45, 9)]
    passage = prose(rng, 70)
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    out += [(10, base[2], "en", "s0"), (11, base[2] + " end", "en", "s0"), (12, passage + " tail one", "en", "s1"), (13, "head two " + passage, "en", None), (14, None, "en", "s0"), (15, "", None, "s1"), (16, "two words", "de", "s2"), (17, "two words", "de", "s2"), (17, "two words", "de", "s2"), (None, "no id at all", "de", "s2"), (18, "été où naïve ÉTÉ " * 30, "fr", "s1"), (19, "ab" * 400, "en", "s1"), (20, "x\n" * 40 + "y ### z", "en", "s0")]
    return [(a, b, c, d, len(b or "")) for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("th", F.lit("a column of the same name")).withColumn("key", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard(spark, rows, docs, n, num):
    def shingles(t):
        w = [x.lower() for x in WORD.findall(t or "")]
        k = min(n, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [shingles(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = groups(len(rows), pairs)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[root[k]].append(r[0])
    want = Counter((r[0], len(sets[k]), min((x for x in least[root[k]] if x is not None), default=None)) for k, r in enumerate(rows))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_trie.similar(spark, docs, n, num, 100).collect())
    assert got == want


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > rng.choice([0.01, 0.05, 0.1])], rng.integers(1, 1 << 62, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(120)]
    pairs = [(i, j) for i in range(120) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert jaccard_trie.join(sets, 85, 100).tolist() == groups(120, pairs)


@pytest.mark.parametrize("block", [4000, 7])
def test_jaccard_counts_all_links(spark, rows, block, monkeypatch):
    monkeypatch.setattr(jaccard_trie, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    copies = [" ".join(f"new{k}" if rng.random() < 0.008 else w for w in words) for k in range(30)]  # not all are linked with each other
    said = [(r[0], r[1]) for r in rows] + [(100 + k, t) for k, t in enumerate([*copies, copies[0], copies[0]])]
    sets = []
    for _, t in said:
        w = [x.lower() for x in WORD.findall(t or "")]
        n = min(3, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    linked = [[i != j and bool(a) and bool(b) and 100 * len(a & b) >= 90 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert 0 < sum(map(sum, linked[-32:])) < 32 * 31
    got = jaccard_trie.similar(spark, spark.createDataFrame(said, "doc_id long, text string"), 3, 90, 100, links=True).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((s[0], sum(x)) for s, x in zip(said, linked))


@pytest.mark.parametrize("pivots", [64, 0])
def test_large_families_are_joined_block_by_block(spark, rows, pivots, monkeypatch):
    """Near copies of one text, chains that drift away from it, and copies of a chain's end, against all pairs."""
    monkeypatch.setattr(jaccard_trie, "BLOCK", 6)
    monkeypatch.setattr(jaccard_trie, "PIVOTS", pivots)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    said = [(100 + k, " ".join(f"new{k}" if rng.random() < 0.006 else w for w in base)) for k in range(40)]
    for chain in range(3):
        words = list(base)
        for k in range(18):
            at, step = rng.randrange(140), rng.choice((1, 5, 6, 6))  # six words are one too many
            words[at : at + step] = [f"c{chain}n{k}x{i}" for i in range(step)]
            said.append((200 + 100 * chain + k, " ".join(words)))
    said += [(r[0], r[1]) for r in rows]
    sets = []
    for _, t in said:
        w = [x.lower() for x in WORD.findall(t or "")]
        n = min(3, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = groups(len(sets), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 90 * len(a | b)])
    least = defaultdict(list)
    for k, r in enumerate(said):
        least[root[k]].append(r[0])
    want = Counter((r[0], min((x for x in least[root[k]] if x is not None), default=None)) for k, r in enumerate(said))
    assert len({c for _, c in want if c and c >= 100}) > 4
    saved, save = [], jaccard_trie.Scratch.save
    monkeypatch.setattr(jaccard_trie.Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    got = jaccard_trie.similar(spark, spark.createDataFrame(said, "doc_id long, text string"), 3, 90, 100).collect()
    assert "rest_links" in saved
    assert Counter((r.doc_id, r.component_id) for r in got) == want


def test_suffixes(spark, rows, docs):
    texts = [(r[1] or "").encode() for r in rows]
    for length in (200, 64):
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = []
        for r, t in zip(rows, texts):
            gone = bytearray(len(t))
            for i in range(len(t) - length + 1):
                if seen[t[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            kept = bytes(c for c, g in zip(t, gone) if not g)
            want.append((r[0], len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
        got = [tuple(r) for r in suffix_dedup.deduplicated(spark, docs, length, digest=True).collect()]
        assert Counter(got) == Counter(want)


def test_crowds_are_divided(spark, rows, docs, monkeypatch):
    want = Counter(map(tuple, suffix_dedup.deduplicated(spark, docs, 200, digest=True).collect()))
    for most in (1, 2):
        monkeypatch.setattr(suffix_dedup, "MOST", most)
        assert Counter(map(tuple, suffix_dedup.deduplicated(spark, docs, 200, digest=True).collect())) == want


def test_anchors_of_long_texts_meet(monkeypatch):
    text = np.random.default_rng(1).integers(97, 101, 5000, dtype=np.uint8).tobytes()
    whole = suffix_dedup.anchors(text, 200)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    for a, b in zip(whole, suffix_dedup.anchors(text, 200)):
        assert (a == b).all()


@pytest.fixture(scope="module")
def ids(rows):
    t = tokens.Tokenizer.from_file(tokens.vocabulary_path())
    return [t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows]


def crc(x):
    return zlib.crc32(struct.pack(f"<{len(x)}I", *x))


def test_encoder_equals_the_library():
    t, e = tokens.Tokenizer.from_file(tokens.vocabulary_path()), tokens.Encoder(tokens.vocabulary_path())
    texts = ["It's 3²½ o'clock— ÉTÉ İstanbul ΣΊΣΥΦΟΣ é <|endoftext|>a\x1cb", "", " \n", "日本語 text wide", "a" * 300]
    got, bounds = e.encode([x.encode() for x in texts])
    for x, a, b in zip(texts, bounds, bounds[1:]):
        assert got[a:b].tolist() == t.encode(x, add_special_tokens=False).ids


def test_encoder_equals_the_library_on_any_character():
    t, e = tokens.Tokenizer.from_file(tokens.vocabulary_path()), tokens.Encoder(tokens.vocabulary_path())
    rng = random.Random(1)
    pools = [[chr(c) for c in range(0x80)], [chr(c) for c in range(0x250)], ["\u0301", "\u0308", "é", "e", "İ", "ß", "Σ", "ς", "日", "ก", "\u200d", "🙂", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "\x85", "\xa0", "\u3000", "a", "9", "!", " "]]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(40))) for _ in range(3000)]
    got, bounds = e.encode([x.encode() for x in texts])
    for x, a, b in zip(texts, bounds, bounds[1:]):
        assert got[a:b].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_control_characters_keep_their_ids(spark):
    t = tokens.Tokenizer.from_file(tokens.vocabulary_path())
    said = [(k, x) for k, x in enumerate(["a\x00b", "a\x1cb \x7f x", "\x01", "plain", "\x1f\x1f\x00 \x0b"])]
    docs = spark.createDataFrame(said, "doc_id long, text string")
    want = {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in said}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_codes.read(spark, token_codes.write(spark, docs)).collect()} == {k: (len(x), crc(x)) for k, x in want.items()}
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(spark, docs, 2048).collect()} == {k: (len(x), crc(x)) for k, x in want.items()}


def test_codes(spark, rows, docs, ids, none):
    x = np.array([0, 255, 256, 65535, 65536, 1 << 31, 5] * 300, np.uint32)
    levels = token_codes.encode(x)
    at = np.random.default_rng(0).integers(0, len(x), 500)
    assert (token_codes.decode(levels) == x).all() and (token_codes.access(levels, at) == x[at]).all()
    r = token_codes.Reader(token_codes.dump([7, None], np.array([0, 3, 2100]), x))
    assert r.doc_ids == [7, None] and (r[[3, 2099]] == x[[3, 2099]]).all()
    with tempfile.TemporaryDirectory() as folder:
        token_codes.put(f"file://{folder}/x", token_codes.dump([7, None], np.array([0, 3, 2100]), x))
        f = token_codes.File(f"file://{folder}/x")
        assert [f[int(k)] for k in at] == x[at].tolist()
        with pytest.raises(IndexError):
            f[len(x)]
        f.close()
    got = token_codes.read(spark, token_codes.write(spark, docs, per_file=100)).orderBy("start").collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] or ""))
    start = 0
    for r, k in zip(got, order, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (rows[k][0], start, len(ids[k]), crc(ids[k]))
        start += len(ids[k])
    assert token_codes.read(spark, token_codes.write(spark, none)).count() == 0


def test_packing(spark, rows, docs, ids, none):
    by_doc = defaultdict(list)
    for r, x in zip(rows, ids):
        by_doc[r[0]].append(x)
    got = packing.pack(spark, docs, 64).collect()
    seats = defaultdict(list)
    for r in got:
        assert any(len(x) == r.doc_tokens and crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in by_doc[r.doc_id])
        seats[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids))
    for s in seats.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64
    assert packing.pack(spark, none, 64).count() == 0


def test_inverse_by_elimination():
    a = np.random.default_rng(0).normal(size=(40, 40))
    a[0, 0] = 0
    assert np.allclose(packing.inverse_of(a) @ a, np.eye(40))


def test_packing_plan_is_near_the_bound():
    demand = np.random.default_rng(2).integers(0, 300, 64)
    slots, n = packing.plan(demand)
    patterns, use = packing.solve(demand, gap=1e-9)
    assert (patterns.T @ use >= demand - 1e-6).all() and (patterns @ np.arange(1, 65) <= 64).all()
    assert use.sum() - 1e-6 <= n <= use.sum() * 1.002 + 20  # the relaxed optimum bounds any packing
    assert use.sum() >= (demand * np.arange(1, 65)).sum() / 64
    assert all(sum(1 for _ in slots.get(k + 1, [])) > 0 for k in np.flatnonzero(demand))


def test_packing_of_short_texts_is_tight(spark):
    none_said = spark.createDataFrame([(k, None) for k in range(2048)], "doc_id long, text string")
    got = packing.pack(spark, none_said, 2048).collect()
    assert len(got) == 2048 and {r.sequence_id for r in got} == {0} and sorted(r.offset for r in got) == list(range(2048))


def test_warc(spark, none):
    big = "<p>" + "z" * 1200
    rows = [(1, "u1", big), (5, "u5", big), (5, "u5", big), (3, "a\r\nb", big + "!"), (4, "u4", "short"), (2, "u2", "short"), (6, None, None), (None, "u", big), (7, "u", "é" * 700), (8, "u", "é" * 700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(map(tuple, warc.read(spark, warc.write(spark, pages)).collect()))
    best = {big: 5, "é" * 700: 8}
    want = []
    for k, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        copy = html in best and (page != best[html] or k == 2)
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if copy else "response", best[html] if copy else None))
    assert got == Counter(want)
    assert warc.read(spark, warc.write(spark, spark.createDataFrame([], pages.schema))).count() == 0


def test_archive_records_are_valid(spark):
    big = "z" * 1200
    rows = [(1, "u", big), (1, "u", big), (2, "u", big), (3, "u", "s"), (3, "u", "s"), (3, "w", "t"), (None, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("same", F.lit(1)).withColumn("payload", F.lit("p")).withColumn("kind", F.lit("k"))
    manifest = warc.write(spark, pages, date="2024-05-06T07:08:09Z")
    found = [f for r in manifest.collect() for f, _ in warc.records(warc.get(r.path))]
    names = [f["WARC-Record-ID"] for f in found]
    assert len(found) == len(rows) == len(set(names)) and {f["WARC-Date"] for f in found} == {"2024-05-06T07:08:09Z"}
    response = [f["WARC-Record-ID"] for f in found if f["X-Page-ID"] == "2"]
    assert [f["WARC-Refers-To"] for f in found if f["WARC-Type"] == "revisit"] == response * 2


def test_heavy_keys_are_dealt_to_several_tasks(spark):
    from gazeloom.llm.shared import heavy_join

    left = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), "id")
    counts = left.groupBy("k").agg(F.count("*").alias("n")).where("n > 1 or k % 2 = 0")
    got = heavy_join(left, counts, "k", "n", ["id"])
    assert got.where("k = 7").count() == 1000 and got.where("k = 7").select("__salt").distinct().count() > 100 and got.count() == 2000
    assert heavy_join(left, counts, "k", "n", ["id"], "left").where("n is null").count() == 1000
    assert heavy_join(left, counts.where("false"), "k", "n", ["id"]).count() == 0


def test_dictionary_opens_the_archive():
    samples = [f"<html><body>page {k} of the same site</body></html>".encode() * 4 for k in range(200)]
    records = [warc.record(k, "u", s, hashlib.sha1(s).digest(), "response", None, "2024-01-01T00:00:00Z") for k, s in enumerate(samples)]
    a = warc.Archive(records)
    for x in records:
        a.add(x)
    data = b"".join(a.parts)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_FRAME
    assert [b for _, b in warc.records(data)] == samples
    alone = warc.zstandard.ZstdCompressor(level=3)
    assert len(data) - len(a.parts[1]) < 0.6 * sum(len(alone.compress(x)) for x in records)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    vectors = [(i, (base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])).tolist(), int(i % 3 == 0)) for i in range(150)]
    odd = [(200, [0.0] * 16, 0), (201, None, 0), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (204, base[0].tolist(), None), (205, base[1].tolist()[:8], 1), (206, vectors[7][1], vectors[7][2]), (206, vectors[7][1], vectors[7][2])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>, label int")
    rows = vectors + odd
    ok = [v is not None and None not in v and np.isfinite(v).all() and any(v) and l is not None for _, v, l in rows]

    def linked(i, j):
        if not (ok[i] and ok[j]) or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = np.array(rows[i][1]), np.array(rows[j][1])
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if linked(i, j)]
    root, links = groups(len(rows), pairs), Counter(x for p in pairs for x in p)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[root[k]].append(r[0])
    want = Counter((r[0], links[k], min(least[root[k]]), r[0] == min(least[root[k]])) for k, r in enumerate(rows))
    for block in (2048, 8):
        neardup_embed.BLOCK = block
        got = Counter(map(tuple, neardup_embed.near_duplicates(spark, df, recall=1 - 1e-9).collect()))
        neardup_embed.BLOCK = 2048
        assert got == want


def test_languages(spark):
    rng = random.Random(1)
    words = {"en": ("the", "ing", "tion", "wh", "ough"), "de": ("ung", "sch", "keit", "ein", "zu"), "es": ("ción", "ado", "que", "los", "ñe")}
    rows = [(i, " ".join(rng.choice(words[x]) + rng.choice(words[x]) for _ in range(40)), x, "s", 1) for i in range(240) for x in [("en", "de", "es")[i % 3]]]
    rows += [(900, None, "en", "s", 1), (901, "123 ### 456", "en", "s", 1), (902, "", None, "s", 1), (None, "thetion ingough whthe", None, "s", 1), (903, "w" * 500, None, "s", 1)]
    got = {r.doc_id: r for r in langid.identify(spark, spark.createDataFrame(rows, DOCS)).collect()}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {r.doc_id for r in got.values() if r.held_out} == {r[0] for r in held}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held if r[0] < 900]) > 0.98
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0
    assert got[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    unlabelled = spark.createDataFrame([(1, "some text", None, "s", 1)], DOCS)
    assert langid.identify(spark, unlabelled).first().lang_pred == "und"


def test_forward_sums_all_segmentations():
    index = {"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5}
    p = np.array([[0.01], [0.2], [0.3], [0.25], [0.1], [0.05]])

    def total(w):
        return 1.0 if not w else sum((p[index[w[:k]], 0] if w[:k] in index else p[0, 0] if k == 1 else 0) * total(w[k:]) for k in range(1, len(w) + 1))

    words = ["abab", "c", "abacab"]
    assert np.allclose(np.exp(langid.log_totals(words, index, 3, p))[:, 0], [total(w) for w in words])
    uses = langid.Lattices(["aba"], index, 3).expected(p, np.ones((1, 1)))[:, 0]
    assert np.isclose(uses[5], p[5, 0] / total("aba"))


def test_runs_of_any_length_are_summed_whole(monkeypatch):
    index = {"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5}
    p = np.array([[1e-9, 0.1], [0.2, 1e-7], [0.3, 0.1], [0.25, 0.2], [0.1, 0.3], [0.05, 0.2]])
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (500, 1, 3000, 33, 64, 65, 500)]

    def log_total(w, x):
        alpha = [0.0]
        for t in range(1, len(w) + 1):
            alpha.append(np.logaddexp.reduce([alpha[s] + np.log(p[index.get(w[s:t], 0), x]) for s in range(max(0, t - 3), t) if w[s:t] in index or t - s == 1]))
        return alpha[-1]

    want = [[log_total(w, x) for x in (0, 1)] for w in words]
    assert np.allclose(langid.log_totals(words, index, 3, p), want)
    monkeypatch.setattr(langid, "POSITIONS", 7)
    assert np.allclose(langid.log_totals(words, index, 3, p), want)
    uses = langid.Lattices(words[3:5], index, 3).expected(p, np.ones((2, 2)))
    assert np.allclose((uses * np.array([1, 1, 1, 2, 2, 3])[:, None]).sum(axis=0), 33 + 64)  # each word's letters are covered once


def test_mix(spark, rows, docs, none):
    got, schedule = mixing.mix(spark, docs, block=7)
    got = got.collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1, 5)))
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s], left = 2.0 * size[s], left - 2.0 * size[s]
        open_ -= over
    target |= {s: weights[s] * level for s in open_}
    assert len(got) == len(rows)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(size[s], round(target[s], 6)) for s in size})
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == sum(int(t) for t in target.values()) == schedule.agg(F.sum("words")).first()[0]
    again, _ = mixing.mix(spark, docs.repartition(3), block=7)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    assert mixing.mix(spark, none)[0].count() == 0


def test_shards(spark, rows, docs, none):
    for n in (1, 2, 3, 40, 41, 1000):
        assert sorted(sharding.permuted(np.arange(n), n, 9).tolist()) == list(range(n))
    got = sharding.shard(spark, docs, 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sharding.shard(spark, none, 4).count() == 0


def test_quality(spark, rows, docs, none):
    got = Counter()
    for r in quality.judge(spark, docs).collect():
        got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] += 1
        assert not (r.kept and r.base_failed)
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        again = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 8)}
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)] += 1
    assert got == want
    assert quality.judge(spark, none).count() == 0


def test_em_equals_its_definition(spark):
    rng = np.random.default_rng(6)
    patterns = [(v.tolist(), int(n)) for v, n in zip(rng.integers(-1, 2, (40, len(quality.RULES))), rng.integers(1, 500, 40))]
    got = {tuple(r.votes): r.posterior for r in quality.posteriors(spark.createDataFrame(patterns, "votes array<int>, n long"), 5).collect()}
    v, n = np.array([p[0] for p in patterns]), np.array([p[1] for p in patterns], float)
    q = 1 / (1 + np.exp(-v.sum(axis=1)))
    for _ in range(5):
        good, bad = n * q, n * (1 - q)
        up, down = (np.log(((v == x) * good[:, None]).sum(axis=0) + 4) - np.log(good.sum() + 8) - np.log(((v == x) * bad[:, None]).sum(axis=0) + 4) + np.log(bad.sum() + 8) for x in (1, -1))
        q = 1 / (1 + np.exp(-((v == 1) @ np.maximum(up, 0) + (v == -1) @ np.minimum(down, 0))))
    assert all(np.isclose(got[tuple(p[0])], x) for p, x in zip(patterns, q))


def test_verdicts_agree_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = quality.judge(spark, spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert sum(bad) <= 0.03 * len(bad) and sum(good) >= 0.98 * len(good)


@pytest.mark.parametrize("shape", ["path", "random", "star", "none"])
def test_components(spark, shape):
    from gazeloom.llm.shared import Scratch, components

    rng = random.Random(8)
    edges = {"path": [(k, k + 1) for k in range(40)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], "star": [(0, k) for k in range(1, 9)], "none": []}[shape]
    got = {r.node: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    root = groups(200, edges)
    assert got == {x: root[x] for a, b in edges if a != b for x in (a, b)}
