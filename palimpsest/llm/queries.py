"""The corpus operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import embdedup, fim, kmeans, linededup, mixing, ngramjoin, packing, quality, repeats, sharding, suffix, tokens, vptree


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", "removed_from", "text")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeated_windows(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.with_inertia(*kmeans.cluster(_read(spark, sf_dir, "embeddings")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 on instruction data, where its limits on loss-bearing tokens and segments bind."""
    return packing.pack_conversations(_read(spark, sf_dir, "conversations"), _vocabulary("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_vptree_search, op2_token_counts, op3_packing, op4_sharding, op5_line_dedup, op6_embedding_dedup, op7_ngram_join, op8_mixing, op9_quality, op10_suffix_dedup, op11_fm_dedup, op12_dual_tree_lloyd, op13_fill_in_middle, pack_conversations)}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
# Rows that take part in comparisons of vectors.
_USABLE = """vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"""


def _lloyd(rounds: int) -> str:
    """Plain Lloyd, a round a table: every vector against every centroid."""
    near = "arg_min(j, {{'d': list_inner_product(z, z), 'j': j}})"
    pairs = "(select id, n, v, j, [p[1] - p[2] for p in list_zip(v, c)] as z from v, c{r})"
    out = """with w as (select vec_id, [floor(1024 * x::double) for x in embedding] as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as materialized (select *, vec_id as id, row_number() over () as n from w),
c0 as materialized (select row_number() over (order by sha256('3:' || id), v) - 1 as j, v as c from v where id is not null order by 1 limit 8)"""
    for r in range(rounds):
        out += f""",
a{r} as materialized (select n, any_value(v) as v, {near.format()} as j from {pairs.format(r=r)} group by n),
s{r} as (select j, i, sum(x)::bigint as s, count(*) as m from (select j, unnest(v)::bigint as x, generate_subscripts(v, 1) as i from a{r}) group by j, i),
c{r + 1} as materialized (select j, coalesce(m.c, c{r}.c) as c from c{r} left join (select j, list((s - ((s % m) + m) % m)::double / m order by i) as c from s{r} group by j) m using (j))"""
    last = f""",
f as materialized (select any_value(id) as vec_id, {near.format()} as cluster, min(list_inner_product(z, z))::bigint as distance from {pairs.format(r=rounds)} group by n)
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
 sha256(array_to_string([x::bigint for x in c], ',')) as centroid_sha256 from f join c{rounds} on j = cluster"""
    return out + last


SQL = {
    "op11_fm_dedup": r"""
with d as (select doc_id, row_number() over () as k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select k, i, array_to_string(w[i:i + 34], ' ') as t from (select k, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
x as (select k, i from s join (select t from s group by t having count(*) > 1) using (t)),
g as (select k, unnest(range(i, i + 35)) as i from x), r as (select k, list(distinct i) as gone from g group by k),
z as (select doc_id, w, coalesce(gone, []) as gone, len(w) as n from d left join r using (k)),
p as (select doc_id, n, len(gone) as m, list_filter(w, lambda x, i: not list_contains(gone, i)) as kept from z)
select doc_id, n::bigint as n_words, m::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from p
""",
    "op12_dual_tree_lloyd": _lloyd(10),
    "op1_vptree_search": f"""
with u as (select vec_id, embedding::double[] as v from embeddings where {_USABLE}),
p as (select q.vec_id as query_id, u.vec_id, list_inner_product(q.v, u.v) as score from u q join u on q.vec_id <> u.vec_id and len(q.v) = len(u.v) where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 20
""",
    "op4_sharding": """
with recursive crc(i, c, k) as (select i, i::bigint, 0 from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8),
tab as (select list(c order by i) as t from crc where k = 8),
d as (select doc_id, coalesce(text, '') as text from documents),
b as (select doc_id, octet_length(encode(text)) + 1 as size, hex(encode(text)) as h from d),
y as (select doc_id, size, [('0x' || substr(h, 2 * i - 1, 2))::bigint for i in range(1, size)] as bytes from b),
z as (select doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295::bigint) as crc from y, tab),
u as (select *, [-1.0 / ln((('0x' || substr(md5(j || '|' || coalesce('k' || doc_id, 'n')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double) for j in range(0, 9)] as s from z),
v as (select *, list_max(s[1:8]) as top, list_max(s) as top9 from u),
o as (select doc_id, size::bigint as size, crc::bigint as text_crc32, len(s[1:8]) - list_position(list_reverse(s[1:8]), top) as shard, len(s) - list_position(list_reverse(s), top9) as grown_shard from v)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by doc_id, size, text_crc32) - 1 as slot, grown_shard::int as grown_shard from o
""",
    "op6_embedding_dedup": f"""
with recursive u as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and {_USABLE}),
n as (select *, sqrt(list_inner_product(v, v)) as size from u),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98),
r as (select a, a as b from l union select r.a, l.b from r join l on r.b = l.a),
k as (select a, min(b) as component_id from r group by a), m as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id)::bigint as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join k on k.a = vec_id left join m on m.a = vec_id
""",
    "op7_ngram_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from w),
t as (select doc_id, len(s) as n, unnest(s) as t from s),
p as (select a.doc_id as a, b.doc_id as b from t a join t b on a.t = b.t and a.doc_id <> b.doc_id group by all having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r as (select a, a as b from p union select r.a, p.b from r join p on r.b = p.a),
k as (select a, min(b) as component_id from r group by a)
select doc_id, len(s)::bigint as n_shingles, coalesce(component_id, doc_id)::bigint as component_id from s left join k on k.a = doc_id
""",
    "op8_mixing": rf"""
with d as (select doc_id, source, {_WORDS}::bigint as size from documents),
t as (select source, sum(size)::bigint as source_size from d group by source),
i as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w, source_size * 3 as cap from t),
o as (select *, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
 sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as opened, sum(source_size) over () as total from i),
c as (select *, cap * opened <= (total - capped) * w as at_cap from o),
g as (select source, source_size, case when at_cap then cap::double
  else max(case when not at_cap then (total - capped)::double / opened::double end) over () * w end as target,
  ('0x' || substr(md5('mix|' || coalesce('v' || source, 'n')), 1, 8))::bigint::double / 4294967296.0::double as off from c),
r as (select d.doc_id, d.size, d.source, g.source_size, g.target, g.off, case when g.source_size > 0 then g.target / g.source_size else 0.0::double end as rate,
 row_number() over (partition by d.source order by d.size, d.doc_id) - 1 as k from d join g on d.source is not distinct from g.source)
select doc_id, size, source, source_size, target, copies, copies * size as taken from (
select *, least(floor((k + 1) * rate + off) - floor(k * rate + off), 3)::bigint as copies from r)
""",
    "op10_suffix_dedup": r"""
with d as (select doc_id, encode(coalesce(text, '')) as raw, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
s as (select doc_id, i, substr(h, 2 * i - 1, 100) as w from (select doc_id, h, unnest(range(1, n - 48)) as i from d where n >= 50)),
f as (select w, min(doc_id) as first from s group by w having min(doc_id) < max(doc_id)),
x as (select doc_id, i from s join f using (w) where doc_id > first),
g as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 50 then 1 when lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as new from x),
o as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from g),
e as (select doc_id, run, min(i) as b, max(i) + 49 as e from o group by 1, 2),
k as (select doc_id, sum(e - b + 1) as n_removed, count(*) as n_spans, list({'b': b, 'e': e} order by b) as l from e group by 1),
z as (select d.doc_id, n, n_removed, n_spans, case when l is null then h else array_to_string([substr(h, (case when j = 1 then 1 else 2 * l[j - 1].e + 1 end)::bigint, (case when j > len(l) then 2 * n else 2 * l[j].b - 2 end - case when j = 1 then 0 else 2 * l[j - 1].e end)::bigint) for j in range(1, len(l) + 2)], '') end as kept from d left join k on d.doc_id = k.doc_id)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(kept)) as kept_sha256 from z
""",
    "op13_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as b,
 case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
  when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form from d),
c as (select doc_id, text, n, form, least(a, b) as lo, greatest(a, b) as hi, text[1:least(a, b)] as p, text[least(a, b) + 1:greatest(a, b)] as m, text[greatest(a, b) + 1:n] as s from u)
select doc_id, n::bigint as n, form, case when form <> 'plain' then lo::bigint end as prefix_chars, case when form <> 'plain' then (hi - lo)::bigint end as middle_chars,
 sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256, sha256(text) as restored_sha256 from c
""",
}
