"""The operators over whole driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm import alignment, jaccard_trie, langid, mixing, neardup_embed, packing, quality, search, sharding, suffix_dedup, token_codes, token_counts, warc
from gazeloom.llm.shared import documents


def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_embed.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, documents(spark, sf_dir, "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir, "doc_id", "text"), 2048).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.read(spark, token_codes.write(spark, documents(spark, sf_dir, "doc_id", "text")))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _ = mixing.mix(spark, documents(spark, sf_dir, "doc_id", "text", "source"))
    return result.select("doc_id", "size", "source_size", "target", "taken")


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(spark, documents(spark, sf_dir, "doc_id", "text"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.similar(spark, documents(spark, sf_dir, "doc_id", "text"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(spark, documents(spark, sf_dir, "doc_id", "text"), 200, digest=True)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(spark, documents(spark, sf_dir, "doc_id", "text"), limit=4096)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), documents(spark, sf_dir, "doc_id", "text"), 10)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = alignment.align(spark, documents(spark, sf_dir, "doc_id", "text"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_duplicates, op2_language_id, op3_packing, op4_warc_dictionary, op5_token_codes, op6_source_mix, op7_feistel_shards, op8_weak_supervision, op9_ngram_jaccard, op10_suffix_dedup, op11_token_counts, op12_ranked_search, op13_tokenizer_alignment, pipeline)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The closed form of the mix: each source is taken from its start, in hash order, up to the whole words of its target.
_OP6 = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as sid from d group by source),
w as (select *, [5, 2, 1][sid % 3 + 1] as weight, 2 * source_size as cap from s),
c as (select *, cap / weight as fill,
        coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
        sum(weight) over (order by cap / weight, sid rows between current row and unbounded following)::bigint as open,
        sum(source_size) over ()::bigint as total from w),
l as (select *, (total * 1.5::double - capped) / open as level from c),
f as (select fill as ffill, sid as fsid, level as flevel from l where level <= fill order by fill, sid limit 1),
t as (select l.sid, l.source, l.source_size,
        case when f.fsid is null or l.fill < f.ffill or (l.fill = f.ffill and l.sid < f.fsid) then l.cap::double else l.weight * f.flevel end as target
      from l left join f on true),
p as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as quota,
        coalesce(sum(d.size) over (partition by t.sid order by md5(coalesce(d.doc_id::varchar, '') || ':mix'), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  case when source_size = 0 then 0 else (quota // source_size) * size + greatest(0, least(start + size, quota % source_size) - start) end::bigint as taken
from p
"""


_OP4 = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as payload_digest, max(page_id) over (partition by body) as best, body from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> best then best end as refers_to
from d
"""


_COMPONENTS = """
pairs as (select a, b from l union select b, a from l),
r as (select a as doc, a as root from pairs union select r.doc, pairs.b from r join pairs on r.root = pairs.a),
c as (select doc, min(root) as root from r group by 1)
"""

_OP1 = f"""
with recursive v as (select vec_id, label, embedding::double[] as e, label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok from embeddings),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and x.ok and y.ok and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.93),
n as (select a, count(*) as n from l group by 1), {_COMPONENTS}
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(root, vec_id) as component_id, vec_id = coalesce(root, vec_id) as kept from v left join n on vec_id = n.a left join c on vec_id = doc
"""

_OP9 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i >= 90 * (x.n + y.n - i)), {_COMPONENTS}
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(root, doc_id) as component_id from documents left join n using (doc_id) left join c on doc_id = doc
"""


# bytes of a text as a list of numbers
_BYTES = "list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda c: ('0x' || c)::int)"


def _doubled() -> str:
    """CTEs w2, w4, ..., w128, w200: for each start, a hash of the string of so many bytes, from those of its parts."""
    out, have = [], 1
    for step, name in ((1, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 64), (64, 128), (72, 200)):
        out.append(f"w{name} as (select rid, list_transform(range(1, greatest(1, len(r) - {step - 1})), lambda i: hash(r[i], r[i + {step}])) as r from w{have})")
        have = name
    return ", ".join(out)


#: Every string of 200 bytes, by hashes that are doubled in length; bytes of those that start twice or more are removed.
_OP10 = rf"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, text from documents),
w1 as (select rid, {_BYTES} as r from t), {_doubled()},
s as (select rid, unnest(r) as h, generate_subscripts(r, 1) - 1 as i from w200),
m as (select rid, i from s where h in (select h from s group by h having count(*) > 1)),
g as (select *, case when i - lag(i) over (partition by rid order by i) <= 200 then 0 else 1 end as fresh from m),
k as (select *, sum(fresh) over (partition by rid order by i rows unbounded preceding) as run from g),
spans as (select rid, min(i) as a, max(i) + 200 as b from k group by rid, run),
edges as (select rid, coalesce(lag(b) over (partition by rid order by a), 0) as a, a as b from spans union all select rid, max(b), null from spans group by rid),
kept as (select rid, string_agg(substr(hex(t), 2 * a + 1, case when b is null then 2 * strlen(t) else 2 * (b - a) end), '' order by a) as h from edges join t using (rid) group by rid),
n as (select rid, sum(b - a)::bigint as n_removed, count(*) as n_spans from spans group by rid)
select doc_id, strlen(t)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(h, hex(t)))) as kept_sha256
from t left join n using (rid) left join kept using (rid)
"""


def _feistel() -> str:
    """Subqueries that take (id, x) through the rounds of the permutation once; a and b are sides of the square of row numbers."""
    two64 = "18446744073709551616"
    out = "select id, n, a, b, x // b as l, x % b as r from {source}"
    for k, key in enumerate(sharding.round_keys(0)):
        out = f"select *, ({'l' if k % 2 else 'r'}::uhugeint + {key}) % {two64} as m from ({out})"
        for shift, factor in ((30, "13787848793156543929"), (27, "10723151780598845931"), (31, None)):
            mixed = f"xor(m, m >> {shift})"
            out = f"select * replace ({f'({mixed} * {factor}::uhugeint) % {two64}' if factor else mixed} as m) from ({out})"
        turned = "((r + m % b::uhugeint) % b::uhugeint)::uhugeint as r" if k % 2 else "((l + m % a::uhugeint) % a::uhugeint)::uhugeint as l"
        out = f"select * exclude (m) replace ({turned}) from ({out})"
    return f"select id, n, a, b, l * b::uhugeint + r as x from ({out})"


_OP7 = rf"""
with recursive c as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) as byte),
d as (select doc_id, strlen(coalesce(text, ''))::bigint + 16 as size, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda x, y: xor(x >> 8, byte[(xor(x, y) & 255) + 1])), 4294967295)::bigint as text_crc32 from documents, c),
o as (select *, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as id from d),
n as (select count(*) as n, floor(sqrt(count(*) - 1))::bigint + 1 as a from d),
z as (select id, n::uhugeint as n, a::uhugeint as a, ((n + a - 1) // a)::uhugeint as b, id::uhugeint as x from o, n),
p as ({_feistel().format(source="z")} union all {_feistel().format(source="p where x >= n")})
select doc_id, size, text_crc32, 'rows' as law, (x % 40)::int as shard, (x // 40)::bigint as slot, null::int as grown_shard from o join p using (id) where x < n
"""


def _votes() -> str:
    return "[" + ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end" for bad, good in quality.RULES.values()) + "]"


def _less(text: str, pattern: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


def _rate(vote: int, q: str, whole: str) -> str:
    return f"ln((list_sum(list_transform(w, lambda x: case when x.votes[j] = {vote} then x.n * {q} else 0::double end)) + {quality.PSEUDO}) / ({whole} + {2 * quality.PSEUDO}))"


_RULES = f"range(1, {len(quality.RULES) + 1})"
_OP8 = rf"""
with recursive t as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, {_WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
g as (select rid, unnest(list_transform(range(1, len(w) - {quality.WINDOW - 2}), lambda i: array_to_string(w[i:i + {quality.WINDOW - 1}], ' '))) as g, unnest(range(1, len(w) - {quality.WINDOW - 2})) as i from t),
r as (select rid, i, count(*) over (partition by rid, g) as n from g),
v as (select rid, least({quality.WINDOW}, coalesce(lead(i) over (partition by rid order by i) - i, {quality.WINDOW})) as covered from r where n > 1),
u as (select rid, sum(covered) as n_repeat_words from v group by rid),
c as (select *, array_to_string(w, '') as c from t),
k as (select rid, doc_id, len(w) as n_words, length(c) as word_chars, {_less('c', quality.SYMBOLS)} as n_symbols, {_less('c', '[A-Z]')} as n_capitals, {_less('c', quality.MARKS)} as n_marks, len(list_distinct(w)) as n_distinct,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutter, len(regexp_extract_all(t, '[^!-@\[-`{{-~\t-\r ][.,](?:[\t-\r ]|$)')) as n_stops, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
      from c left join u using (rid)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {_votes()} as votes from k),
b as (select votes, count(*)::double as n from f where not base_failed group by votes),
em as (select 0 as k, list(struct_pack(votes := votes, n := n, q := 1 / (1 + exp(-list_sum(votes)::double))) order by votes) as w from b
  union all select k + 1, list_transform(w, lambda x: struct_pack(votes := x.votes, n := x.n, q := 1 / (1 + exp(-list_sum(list_transform({_RULES}, lambda j: case x.votes[j] when 1 then up[j] when -1 then down[j] else 0 end))))))
    from (select *, list_transform({_RULES}, lambda j: greatest(0, {_rate(1, 'x.q', 'good')} - {_rate(1, '(1 - x.q)', 'bad')})) as up, list_transform({_RULES}, lambda j: least(0, {_rate(-1, 'x.q', 'good')} - {_rate(-1, '(1 - x.q)', 'bad')})) as down
      from (select k, w, list_sum(list_transform(w, lambda x: x.n * x.q)) as good, list_sum(list_transform(w, lambda x: x.n * (1 - x.q))) as bad from em where k < 30))),
q as (select x.votes as votes, x.q as q from (select unnest(w) as x from em where k = 30))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and coalesce(q >= 0.5, false) as kept
from f left join q on f.votes = q.votes
"""


_TERMS = f"regexp_extract_all(translate(text, '{search.UPPER}', '{search.LOWER}'), '{search.TERM}')"
_OP12 = f"""
with q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
d as (select row_number() over () as rid, doc_id, {_TERMS} as t from documents),
s as (select rid, doc_id, len(t)::bigint as n from d where len(t) > 0),
g as (select count(*)::bigint as docs, sum(n)::bigint as l from s),
p as (select rid, term, count(*)::bigint as tf from (select rid, unnest(t) as term from d) where term in (select term from q) group by rid, term),
f as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from p, g group by term, docs),
m as (select rid, doc_id, 100 - 90 + ((90 * n * docs) // l) as m from s, g),
x as (select item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join p using (term) join f using (term) join m using (rid) group by item_id, doc_id, rid),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank from x where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_duplicates": _OP1, "op9_ngram_jaccard": _OP9, "op4_warc_dictionary": _OP4, "op6_source_mix": _OP6, "op7_feistel_shards": _OP7, "op8_weak_supervision": _OP8, "op10_suffix_dedup": _OP10, "op12_ranked_search": _OP12}
