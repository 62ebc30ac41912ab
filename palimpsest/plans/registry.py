"""Every registered query of the engine, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import signals, text, vectors
from palimpsest.operators import dedup, entities, evaluate, filters, provenance, recall, search, sessions, tables, work
from palimpsest.operators.text_index import TextIndex
from palimpsest.operators.vector_index import VectorIndex
from palimpsest.plans.views import CTE, NOW, QUEUE_NOW, Views, now, with_views
from palimpsest.settings import workspace_settings
from palimpsest.sources.segments import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, root, f=f: f(Views(spark, root))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}"


FL = with_views("facts", "live")
COS = "list_cosine_similarity(embedding::double[], query_vector::double[])"

# Scans and pages


@query(f"{FL} select id, observer, observed, level, times_derived from live")
def live_pair_scan(v: Views) -> DataFrame:
    return tables.live_facts(v.facts(), now()).select("id", "observer", "observed", "level", "times_derived")


@query(f"{FL} select id, observer, observed, level from live where observer = 'src3' and observed = 'en'")
def live_one_pair(v: Views) -> DataFrame:
    return tables.live_facts(v.facts(), now(), ("w", "src3", "en")).select("id", "observer", "observed", "level")


@query(f"{FL} select id, level, {sql_stamp('created_at')} from live where observer = 'src0' and observed = 'en' and times_derived >= 3 order by live.created_at desc, id limit 10 offset 10")
def page_facts(v: Views) -> DataFrame:
    items, _ = tables.list_facts(v.facts(), ("w", "src0", "en"), now(), filters.fact_filter({"times_derived": {"gte": 3}}), page=1, size=10)
    return items.select("id", "level", stamp("created_at"))


@query(f"{FL} select count(*)::bigint as total, 20 < count(*) as has_next from live where observer = 'src0' and observed = 'en'")
def page_info(v: Views) -> DataFrame:
    return tables.list_facts(v.facts(), ("w", "src0", "en"), now(), page=1, size=10)[1]


@query(f"{FL} select id from live where observer = 'src1' and observed = 'en' order by created_at desc, id limit 5")
def newest_facts(v: Views) -> DataFrame:
    return tables.newest_facts(v.facts(), ("w", "src1", "en"), now(), 5).select("id")


@query(f"{FL} select observer, observed, level, count(*)::bigint as n from live group by all")
def count_by_level(v: Views) -> DataFrame:
    return tables.counts_by_level(v.facts(), now()).drop("workspace_name")


@query(f"{with_views('facts')} select id, level, deleted_at is not null as deleted from facts where id = '17'")
def find_fact(v: Views) -> DataFrame:
    return tables.find_fact(v.facts(), "w", "17").select("id", "level", F.col("deleted_at").isNotNull().alias("deleted"))


@query(f"{with_views('facts')} select id, level from facts where deleted_at is null and doc_id % 10 = 7")
def facts_by_ids(v: Views) -> DataFrame:
    ids = v.facts().where("doc_id % 10 = 7").select("workspace_name", "id")
    return tables.facts_by_ids(v.facts(), ids).select("id", "level")


@query(f"{with_views('facts')} select id from facts where deleted_at is null and (embedding is null or sync_state = 'pending') order by created_at, id limit 40")
def pending_embeddings(v: Views) -> DataFrame:
    return tables.pending_embeddings(v.facts(), 40).select("id")


@query(f"{with_views('facts')} select id from facts where deleted_at is null and expires_at <= {NOW} order by expires_at, id limit 40")
def expired_sweep(v: Views) -> DataFrame:
    return tables.expired_facts(v.facts(), now(), 40).select("id")


@query(f"{with_views('messages')} select id, session_name, seq_in_session from messages where session_name = '7' and seq_in_session >= 2")
def session_slice(v: Views) -> DataFrame:
    return tables.session_messages(v.messages(), "w", "7", 2).select("id", "session_name", "seq_in_session")


@query(f"{with_views('messages')} select id, session_name, seq_in_session from (select *, row_number() over (partition by session_name order by seq_in_session desc) as rn from messages) where rn <= 3")
def tail_session(v: Views) -> DataFrame:
    return tables.tails(v.messages(), 3).select("id", "session_name", "seq_in_session")


@query(f"{with_views('messages')} select session_name, count(*)::bigint as n from messages group by 1")
def count_in_session(v: Views) -> DataFrame:
    return tables.session_counts(v.messages()).select("session_name", "n")


@query(f"{with_views('messages')} select id from messages where peer_name = 'user' and token_count > 20 order by session_name, seq_in_session limit 25")
def search_messages(v: Views) -> DataFrame:
    return tables.search_messages(v.messages(), filters.message_filter({"peer_name": "user", "token_count": {"gt": 20}}), 0, 25)[0].select("id")


@query(f"{with_views('messages')} select session_name, max(seq_in_session)::bigint + 1 as first, max(seq_in_session)::bigint + 5 as last from messages group by 1")
def next_sequences(v: Views) -> DataFrame:
    m = v.messages()
    return tables.next_sequences(m, m.select("workspace_name", "session_name").distinct().withColumn("n", F.lit(5))).select("session_name", "first", "last")


@query(f"""{with_views('messages')}, n as (select session_name, max(seq_in_session) as top from messages group by 1), 
 s as (select *, sum(2) over (order by ('0x' || substr(md5('w:' || session_name), 1, 8))::bigint % 4096, session_name) - 2 as b from n)
 select (select max(id) from messages)::bigint + s.b::bigint + k as id, s.session_name, (s.top + k)::bigint as seq_in_session from s, (values (1), (2)) t(k)""")
def append_messages(v: Views) -> DataFrame:
    m = v.messages()
    new = m.select("workspace_name", "session_name").distinct().withColumn("position", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("content", F.lit("new"))
    return tables.append_messages(m, new).where("content = 'new'").select("id", "session_name", "seq_in_session")


@query("select source as name, 'seen' as metadata from documents group by 1 union all select 'extra', 'new'")
def get_or_create(v: Views) -> DataFrame:
    have = v.table("documents").select(F.col("source").alias("name")).distinct().withColumn("metadata", F.lit("seen"))
    new = v.spark.createDataFrame([("src0", "new"), ("extra", "new")], "name string, metadata string")
    return tables.insert_missing(have, new, ["name"])


@query("select c_custkey, case when c_nationkey = 3 then 0.0 else c_acctbal end as c_acctbal from customer")
def keyed_upsert(v: Views) -> DataFrame:
    c = v.table("customer").select("c_custkey", "c_acctbal")
    new = v.table("customer").where("c_nationkey = 3").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return tables.upsert(c, new, ["c_custkey"])


@query("select event_id as id, event_type as event from events where user_id = 46 order by ts desc, event_id desc limit 100")
def event_history(v: Views) -> DataFrame:
    e = v.table("events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("conclusion_id"), F.col("event_type").alias("event"), F.col("ts").alias("created_at"))
    return tables.fact_history(e, "46").select("id", "event")


@query("select event_id as id, event_type as event from events where user_id % 3 = 1 order by ts desc, event_id desc limit 50")
def recent_events(v: Views) -> DataFrame:
    e = v.table("events").select(F.col("event_id").alias("id"), F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("workspace_name"), F.col("event_type").alias("event"), F.col("ts").alias("created_at"))
    return tables.recent_events(e, "w1", 50).select("id", "event")


# Filters


def _filtered(v: Views, raw: dict) -> DataFrame:
    return v.facts().where(filters.fact_filter(raw)).select("id")


@query(f"{with_views('facts')} select id from facts where level is distinct from 'explicit' and session_name is null and times_derived = 3")
def filter_eq_ne_null(v: Views) -> DataFrame:
    return _filtered(v, {"level": {"ne": "explicit"}, "session_name": None, "times_derived": 3})


@query(f"{with_views('facts')} select id from facts where level in ('explicit', 'inductive') and (session_name is null or session_name not in ('s0', 's4', 's7'))")
def filter_in_nin(v: Views) -> DataFrame:
    return _filtered(v, {"level": ["explicit", "inductive"], "session_name": {"nin": ["s0", "s4", "s7"]}})


@query(f"{with_views('facts')} select id from facts where contains(content, 'the') and contains(lower(content), 'licensed') or starts_with(content, 'Th')")
def filter_text(v: Views) -> DataFrame:
    return _filtered(v, {"OR": [{"content": {"contains": "the", "icontains": "LICENSED"}}, {"content": {"starts_with": "Th"}}]})


@query(f"{with_views('facts')} select id from facts where not (session_name = 's3' or (times_derived < 4 and confidence <= 0.3)) and times_derived >= 2")
def filter_nested(v: Views) -> DataFrame:
    return _filtered(v, {"NOT": {"or": [{"session_name": "s3"}, {"and": [{"times_derived": {"lt": 4}}, {"confidence": {"lte": 0.3}}]}]}, "times_derived": {"gte": "2"}})


@query(f"{with_views('facts')} select id from facts where last_reinforced_at >= timestamp '2025-06-01' and last_reinforced_at < timestamp '2025-09-01' and expires_at is null and created_at > to_timestamp(1764979200)::timestamp")
def filter_temporal(v: Views) -> DataFrame:
    return _filtered(v, {"last_reinforced_at": {"gte": "2025-06-01T00:00:00Z", "lt": "2025-09-01T02:00:00+02:00"}, "expires_at": {"exists": False}, "created_at": {"gt": 1764979200}})


@query(f"{with_views('messages')} select id from messages where contains(lower(content), 'tion of')")
def grep_literal(v: Views) -> DataFrame:
    return search.grep(v.messages(), "TION of").select("id")


@query(f"{with_views('messages')} select id from messages where created_at >= timestamp '2024-01-02' and created_at < timestamp '2024-01-03'")
def messages_by_date(v: Views) -> DataFrame:
    return search.between(v.messages(), F.expr("timestamp '2024-01-02'"), F.expr("timestamp '2024-01-03'")).select("id")


_T = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"
_P = f"(' ' || array_to_string({_T}, ' ') || ' ')"


@query(f"{with_views('messages')} select id from messages where (contains({_P}, ' of the ') and contains({_P}, ' and ') and not contains({_P}, ' it ')) or contains({_P}, ' für ') order by created_at desc, id desc limit 40")
def websearch_messages(v: Views) -> DataFrame:
    return search.search_text(v.messages(), '"of the" and -it or für', 40).select("id")


@query(f"{with_views('messages')} select id from messages where contains({_P}, ' by ') or contains({_P}, ' in the ')")
def any_term_match(v: Views) -> DataFrame:
    m = v.messages()
    return m.where(search.any_term(text.tokens_simple(F.col("content")), ["by", "in-the", "by"])).select("id")


# Text


@query(f"{with_views('facts')} select id, content_hash, length(content_norm)::int as n from facts")
def norm_hash(v: Views) -> DataFrame:
    return dedup.with_derived(v.facts().select("id", "content")).select("id", "content_hash", F.length("content_norm").alias("n"))


@query(f"{with_views('facts')} select id, array_to_string(tokens, ' ') as tokens from facts")
def tokens_simple(v: Views) -> DataFrame:
    return v.facts().select("id", text.analyzed(F.col("content"), text.tokens_simple).alias("tokens"))


@query(r"select page_id, array_to_string(regexp_extract_all(trim(lower(html), chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}]+|[\p{L}\p{Nd}]+'), ' ') as tokens from pages")
def tokens_bigram(v: Views) -> DataFrame:
    """The pages hold none of the scripts that pairs are made of; tests cover those."""
    return v.table("pages").select("page_id", text.analyzed(F.col("html")).alias("tokens"))


# an apostrophe or point between letters, and a point or comma between digits, are marked on both sides, twice since matches do not overlap
_JOIN = "chr(57344)"
_MARKED = "lower(coalesce(content, ''))"
for _side, _marks in ((r"\p{L}", "''’."), (r"\p{N}", ".,")) * 2:
    _MARKED = f"regexp_replace({_MARKED}, '({_side})([{_marks}])({_side})', '\\1' || {_JOIN} || '\\2' || {_JOIN} || '\\3', 'g')"


@query(f"""{with_views('facts')} select id, replace(array_to_string(regexp_extract_all({_MARKED}, '(?:[\\p{{L}}\\p{{N}}_]|' || {_JOIN} || '[''’.,]' || {_JOIN} || ')+'), ' '), {_JOIN}, '') as tokens from facts""")
def tokens_english(v: Views) -> DataFrame:
    return v.facts().select("id", text.analyzed(F.col("content"), text.tokens_english).alias("tokens"))


@query(f"{with_views('facts')} select id, (len(tokens) + 2 * len(list_distinct(tokens)))::int as score from facts")
def information_score(v: Views) -> DataFrame:
    return v.facts().select("id", text.information_score(text.analyzed_tokens(F.col("content_analyzed")), 2).alias("score"))


@query("select page_id, replace(replace(url, '%', '%25'), ':', '%3A') || ':' || 'a%3Ab' as key, url as decoded from pages")
def key_codec(v: Views) -> DataFrame:
    k = text.key_of(F.col("url"), F.lit("a:b"))
    return v.table("pages").select("page_id", k.alias("key"), text.key_segment(k, 0).alias("decoded"))


@query(rf"select p_partkey, regexp_replace(lower(trim(p_name)), '[ \t\n\x0B\f\r]+', ' ', 'g') as name_norm from part")
def entity_names(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", text.entity_norm(F.col("p_name")).alias("name_norm"))


@query(f"{with_views('messages')} select session_name, string_agg(strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' ' || peer_name || ': ' || content, chr(10) order by seq_in_session) as text from messages group by 1")
def transcript(v: Views) -> DataFrame:
    return sessions.transcript(v.messages()).select("session_name", "text")


# Vectors and keywords


@query(f"""{with_views('facts', 'live', 'queries')}, d as (select qid, id, {COS} as sim from queries join live using (observer, observed) where embedding is not null)
 select qid, id, round(greatest(0, least(1, sim)), 6) as sem from (select *, row_number() over (partition by qid order by 1 - sim, id) as rn from d) where rn <= 10""")
def knn_cosine(v: Views) -> DataFrame:
    return recall.semantic(v.queries(), v.facts(), now(), 10).select("qid", "id", r("sem").alias("sem"))


@query()
def knn_by_code(v: Views) -> DataFrame:
    """Approximate; a test holds it against knn_cosine."""
    return recall.semantic_by_code(v.queries(), v.facts(), now(), 10).select("qid", "id", r("sem").alias("sem"))


def _flat_queries(v: Views) -> DataFrame:
    return v.queries().withColumn("observer", F.lit("all"))


_FLAT_KNN = f"""{with_views('facts', 'live', 'queries')}, d as (select qid, id, {COS} as sim from queries join live using (observed) where embedding is not null and MORE)
 select qid, id, round(greatest(0, least(1, sim)), 6) as sem from (select *, row_number() over (partition by qid order by 1 - sim, id) as rn from d) where rn <= 10"""


@query(_FLAT_KNN.replace("MORE", "true"))
def knn_indexed(v: Views) -> DataFrame:
    """Through an index of lists that is built here, all lists probed."""
    index = VectorIndex(v.spark, new_folder(v.spark, "vectors"), cells=16).build(v.flat_facts(), exact_below=50)
    return index.search(_flat_queries(v), now(), 10, nprobe=None).select("qid", "id", r("sem").alias("sem"))


@query()
def knn_probed(v: Views) -> DataFrame:
    """The nearest half of the lists; a test measures the recall."""
    index = VectorIndex(v.spark, new_folder(v.spark, "vectors"), cells=16).build(v.flat_facts(), exact_below=50)
    lists = index.centroids().groupBy("observed").count().agg(F.max("count")).first()[0] or 1
    return index.search(_flat_queries(v), now(), 10, nprobe=-(-lists // 2)).select("qid", "id", r("sem").alias("sem"))


@query(_FLAT_KNN.replace("MORE", "doc_id % 7 <> 3"))
def knn_indexed_writes(v: Views) -> DataFrame:
    """The same after later insertions and deletions, which the index takes up without being built anew."""
    facts = v.flat_facts()
    index = VectorIndex(v.spark, new_folder(v.spark, "vectors"), cells=16).build(facts.where("doc_id % 3 > 0"), exact_below=50)
    index.insert(facts.where("doc_id % 3 = 0"))
    index.delete(facts.where("doc_id % 7 = 3"))
    return index.search(_flat_queries(v), now(), 10, nprobe=None).select("qid", "id", r("sem").alias("sem"))


@query(f"""{with_views('facts', 'live', 'queries')}, d as (select qid, id, case when doc_id % 5 = 0 then 1.0 else 1 - {COS} end as d from queries join live using (observer, observed) where embedding is not null)
 select qid, id, round(greatest(0, least(1, 1 - d)), 6) as sem from (select *, row_number() over (partition by qid order by d, id) as rn from d) where rn <= 10""")
def knn_zero_vectors(v: Views) -> DataFrame:
    """A zero vector is at distance 1 from all others, and no query fails because of it."""
    zero = F.when(F.col("doc_id") % 5 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    return recall.semantic(v.queries(), v.facts().withColumn("embedding", zero), now(), 10).select("qid", "id", r("sem").alias("sem"))


@query(f"{with_views('facts', 'live', 'queries')} select qid, id, round(greatest(0, least(1, {COS})), 6) as sem from queries join live using (observer, observed) where embedding is not null")
def semantic_scores(v: Views) -> DataFrame:
    ids = v.facts().select("observer", "observed", "id").join(v.queries().select("qid", "observer", "observed"), ["observer", "observed"]).select("qid", "id")
    return recall.semantic_scores(v.queries(), v.facts(), now(), ids).select("qid", "id", r("sem").alias("sem"))


@query("select vec_id, len(embedding)::int as n, round(embedding[1]::double, 5) as first from embeddings")
def vector_codec(v: Views) -> DataFrame:
    back = vectors.parse_vector(vectors.vector_literal(F.col("embedding")))
    return v.table("embeddings").select("vec_id", F.size(back).alias("n"), F.round(F.get(back, 0).cast("double"), 5).alias("first"))


@query(f"{FL} select observer, observed, count(*)::bigint as n_docs, round(avg(case when len(tokens) > 0 then len(tokens) end), 6) as mean_length from live group by all")
def corpus_stats(v: Views) -> DataFrame:
    return recall.corpus_stats(v.facts(), now()).select("observer", "observed", "n_docs", r("mean_length").alias("mean_length"))


_KW = f"""{with_views('facts', 'live', 'queries')}, qt as (select distinct qid, observer, observed, unnest(query_tokens) as term from queries),
 post as (select observer, observed, id, term, count(*) as tf, any_value(n) as n from (select observer, observed, id, unnest(tokens) as term, len(tokens) as n from live) group by 1, 2, 3, 4),
 df as (select observer, observed, term, count(*) as df from post group by all),
 st as (select observer, observed, count(*) as big, avg(case when len(tokens) > 0 then len(tokens) end) as mean from live group by all),
 kw as (select qid, id, sum(ln(1 + (big - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean))) as kw_raw
  from qt join post using (observer, observed, term) join df using (observer, observed, term) join st using (observer, observed) group by all)"""


@query(f"{_KW} select qid, term, coalesce(df, 0)::bigint as df from qt left join df using (observer, observed, term)")
def document_frequency(v: Views) -> DataFrame:
    return recall.document_frequency(v.queries(), v.facts(), now())


@query(f"{_KW} select qid, id, round(kw_raw, 5) as kw_raw from kw")
def bm25_scores(v: Views) -> DataFrame:
    return recall.keyword_scores(v.queries(), v.facts(), now()).select("qid", "id", r("kw_raw", 5).alias("kw_raw"))


@query(f"{_KW} select qid, id, round(kw_raw, 5) as kw_raw from (select *, row_number() over (partition by qid order by kw_raw desc, id) as rn from kw) where rn <= 5")
def keyword_topk(v: Views) -> DataFrame:
    return recall.keyword(v.queries(), v.facts(), now(), 5).select("qid", "id", r("kw_raw", 5).alias("kw_raw"))


@query(f"{_KW} select qid, id, round(kw_raw, 5) as kw_raw from (select *, row_number() over (partition by qid order by kw_raw desc, id) as rn from kw) where rn <= 5")
def keyword_indexed(v: Views) -> DataFrame:
    """Through posting blocks that are built here."""
    index = TextIndex(v.spark, new_folder(v.spark, "texts"), cells=16).build(v.facts())
    index.expire(now())
    return index.search(v.queries(), 5).select("qid", "id", r("kw_raw", 5).alias("kw_raw"))


@query(f"{_KW.replace('from live', 'from live where doc_id % 7 <> 3')} select qid, id, round(kw_raw, 5) as kw_raw from (select *, row_number() over (partition by qid order by kw_raw desc, id) as rn from kw) where rn <= 5")
def keyword_indexed_writes(v: Views) -> DataFrame:
    """The same after insertions, deletions and expiry, with statistics as of the facts that are left."""
    facts = v.facts()
    index = TextIndex(v.spark, new_folder(v.spark, "texts"), cells=16).build(facts.where("doc_id % 3 > 0"))
    index.insert(facts.where("doc_id % 3 = 0"))
    index.delete(facts.where("doc_id % 7 = 3"))
    index.expire(now())
    return index.search(v.queries(), 5).select("qid", "id", r("kw_raw", 5).alias("kw_raw"))


_CURVE = "case when {x} <= 0 then 0 else 1 / (1 + exp(-(case when {n} <= 3 then 0.7 when {n} <= 6 then 0.6 else 0.5 end) * ({x} - (case when {n} <= 3 then 5 when {n} <= 6 then 7 when {n} <= 9 then 9 when {n} <= 15 then 10 else 12 end)))) end"


@query(f"select event_id, round({_CURVE.format(x='value - 1', n='(user_id % 20)')}, 6) as kw from events")
def signal_keyword_curve(v: Views) -> DataFrame:
    return v.table("events").select("event_id", r(signals.keyword_curve(F.col("value") - 1, F.col("user_id") % 20)).alias("kw"))


@query(f"{with_views('facts')} select id, round(case when epoch_ms({NOW}) <= epoch_ms(last_reinforced_at) then 1 else pow(0.5, (epoch_ms({NOW}) - epoch_ms(last_reinforced_at)) / 86400000.0 / 180) end, 6) as rec from facts")
def signal_recency(v: Views) -> DataFrame:
    return v.facts().select("id", r(signals.recency(F.col("last_reinforced_at"), now(), 180.0)).alias("rec"))


@query(f"{with_views('facts')} select id, round(1 - 1 / (1 + ln(1 + times_derived)), 6) as reinf, round(1 / (1 + 0.001 * (times_derived - 1) ** 2), 6) as weight, case level when 'explicit' then 1.0 when 'deductive' then 0.9 else 0.8 end::double as lvl from facts")
def signal_reinforcement(v: Views) -> DataFrame:
    t = F.col("times_derived")
    return v.facts().select("id", r(signals.reinforcement(t)).alias("reinf"), r(signals.count_weight(t)).alias("weight"), signals.level_weight(F.col("level")).alias("lvl"))


# Entities

_MATCH = f"""{with_views('facts', 'live', 'queries', 'entities', 'links')}, lc as (select l.observer, l.observed, entity_id, count(*) as link_count from links l join facts f on f.id = conclusion_id and f.deleted_at is null group by all),
 em as (select qid, q.observer, q.observed, entity_id, name_norm, link_count, greatest(0, least(1, {COS})) as sim, row_number() over (partition by qid order by 1 - {COS}, entity_id) as rn
  from queries q join lc using (observer, observed) join entities e on e.id = entity_id and embedding is not null),
 m as (select * from em where rn <= 10)"""
_BOOST = ", b as (select qid, conclusion_id as id, max(greatest(0, least(1, sim / (1 + 0.001 * (link_count - 1) ** 2)))) as ent, list_sort(list(distinct name_norm)) as matched_entities from m join links using (observer, observed, entity_id) where sim >= {cut} group by 1, 2)"


@query(f"{_MATCH} select qid, entity_id, name_norm, round(sim, 6) as sim, link_count::bigint as link_count from m")
def entity_match(v: Views) -> DataFrame:
    return entities.match_entities(v.queries(), v.entities(), v.links(), v.facts()).select("qid", "entity_id", "name_norm", r("sim").alias("sim"), "link_count")


@query(f"{_MATCH}{_BOOST.format(cut=0.2)} select qid, id as conclusion_id, round(ent, 6) as ent, array_to_string(matched_entities, '|') as names from b")
def entity_boost(v: Views) -> DataFrame:
    m = entities.match_entities(v.queries(), v.entities(), v.links(), v.facts())
    return entities.boosts(m, v.links(), 0.2).select("qid", "conclusion_id", r("ent").alias("ent"), F.array_join("matched_entities", "|").alias("names"))


@query(f"{with_views('entities', 'links')} select conclusion_id, entity_id, name_norm from (select distinct conclusion_id, entity_id from links) join entities on id = entity_id")
def entities_for_facts(v: Views) -> DataFrame:
    return entities.entities_for(v.links(), v.entities()).select("conclusion_id", "entity_id", "name_norm")


@query(f"{with_views('links')} select entity_id, conclusion_id from links where entity_id::int % 10 = 3 and conclusion_id::int % 4 = 1")
def links_among(v: Views) -> DataFrame:
    e = v.entities().where("cast(id as int) % 10 = 3").select(F.col("id").alias("entity_id"))
    c = v.facts().where("doc_id % 4 = 1").select(F.col("id").alias("conclusion_id"))
    return entities.links_among(v.links(), e, c).select("entity_id", "conclusion_id")


@query(f"{with_views('entities', 'links')} select id from entities where id not in (select entity_id from links where conclusion_id::int % 2 = 0)")
def orphan_entities(v: Views) -> DataFrame:
    gone = v.links().where("cast(conclusion_id as int) % 2 = 1").select("workspace_name", "conclusion_id")
    return entities.orphans(v.entities(), entities.unlink(v.links(), gone)).select("id")


@query(f"{with_views('queries', 'entities')} select qid, round(max({COS}), 6) as sim, arg_min(id, (1 - {COS}, id)) as entity_id from queries, entities where embedding is not null group by qid")
def nearest_entity(v: Views) -> DataFrame:
    return entities.nearest_entity(v.queries(), v.entities()).select("qid", "entity_id", r("sim").alias("sim"))


@query("select lower(p_name) as name_norm, min(p_partkey)::bigint as entity_id, count(*)::bigint as parts from part group by 1")
def entity_names_merged(v: Views) -> DataFrame:
    n = v.table("part").select(F.lit("w").alias("workspace_name"), F.col("p_partkey").cast("string").alias("conclusion_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("position"))
    return entities.named(n).groupBy("name_norm").agg(F.min("position").alias("entity_id"), F.count("*").alias("parts"))


@query("select lower(p_name) as name_norm, case when min(p_partkey) % 2 = 0 then 'exact' else 'new' end as how from part group by 1")
def entity_resolution(v: Views) -> DataFrame:
    first = v.entities().groupBy("name_norm").agg(F.min(F.col("id").cast("int")).alias("k"), F.lit("w").alias("workspace_name"))
    known = first.where("k % 2 = 0").select("workspace_name", "name_norm", F.col("k").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("embedding"))
    return entities.resolve(first.select("workspace_name", "name_norm", F.lit(None).cast("array<float>").alias("embedding")), known).select("name_norm", "how")


@query()
def entity_resolution_vectors(v: Views) -> DataFrame:
    """The parts' names, each with the vector of its smallest key, in order of it; even keys are known. The SQL of entity_resolution has no vectors."""
    k = F.col("id").cast("int")
    e = v.entities().groupBy("workspace_name", "name_norm").agg(F.min(k).alias("position"), F.min_by("embedding", k).alias("embedding")).withColumn("id", F.col("position").cast("string"))
    return entities.resolve(e.where("position % 2 = 1").unionByName(e.where("position % 2 = 0")), e.where("position % 2 = 0")).select("name_norm", "entity_id", "how")


# Recall

_CAND = ", sm as (select qid, id, {cos} as sim, row_number() over (partition by qid order by 1 - {cos}, id) as rn from queries join live using (observer, observed) where embedding is not null), kr as (select *, row_number() over (partition by qid order by kw_raw desc, id) as rn from kw), c as (select qid, id from sm where rn <= 20 union select qid, id from kr where rn <= 20)".format(cos=COS)
_SCORES = f""", x as (select c.qid, c.id, coalesce(greatest(0, least(1, {COS})), 0) as sem, {_CURVE.format(x='coalesce(kw_raw, 0)', n='len(query_tokens)')} as kw, coalesce(ent, 0) as ent,
 1 - 1 / (1 + ln(1 + times_derived)) as reinf, case when epoch_ms({NOW}) <= epoch_ms(last_reinforced_at) then 1 else pow(0.5, (epoch_ms({NOW}) - epoch_ms(last_reinforced_at)) / 86400000.0 / 180) end as rec,
 case level when 'explicit' then 1.0 when 'deductive' then 0.9 else 0.8 end as lvl, count(*) over (partition by c.qid) as candidates_considered
 from c join queries using (qid) join live using (id) left join kw on kw.qid = c.qid and kw.id = c.id left join b on b.qid = c.qid and b.id = c.id)"""
_RECALL = _KW + ", " + CTE["entities"] + ", " + CTE["links"] + _MATCH.split(CTE["links"])[1] + _BOOST.format(cut=0.5) + _CAND + _SCORES


@query(f"""{_RECALL}, s as (select *, 0.5 * sem + 0.22 * kw + 0.13 * ent + 0.08 * reinf + 0.05 * rec + 0.02 * lvl as score from x)
 select qid, rank::int as rank, id, round(score, 5) as score, round(sem, 5) as sem, round(kw, 5) as kw, round(ent, 5) as ent, candidates_considered::bigint as candidates_considered
 from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 5""")
def recall_fused(v: Views) -> DataFrame:
    out = recall.recall(v.queries(), v.facts(), v.entities(), v.links(), now(), limit=5)
    return out.select("qid", "rank", "id", *[r(c, 5).alias(c) for c in ("score", "sem", "kw", "ent")], "candidates_considered")


# Dedup


@query(f"""{with_views('facts')}, s as (select *, row_number() over w as rn, first(id) over w as survivor_id, sum(times_derived) over g as total from facts where deleted_at is null
 window w as (partition by observer, observed, level, coalesce(session_name, ''), content_hash order by created_at, id), g as (partition by observer, observed, level, coalesce(session_name, ''), content_hash))
 select id, survivor_id, rn = 1 as is_survivor, (case when rn = 1 then total else times_derived end)::int as times_derived from s""")
def dedup_scope_collapse(v: Views) -> DataFrame:
    return dedup.collapse_scopes(v.facts()).select("id", "survivor_id", "is_survivor", "times_derived")


_SCOPED = f"{FL}, old as (select * from live where doc_id % 2 = 0), new as (select * from facts where doc_id % 2 = 1)"


def _written(v: Views) -> tuple[DataFrame, DataFrame]:
    new = v.flat_facts().where("doc_id % 2 = 1").withColumns({"draft_id": F.col("id"), "position": F.col("doc_id")})
    return new, v.flat_facts().where("doc_id % 2 = 0")


@query(f"{_SCOPED} select n.id as draft_id, arg_min(o.id, (o.created_at, o.id)) as id, 1 as stage from new n join old o using (observed, content_hash) group by n.id")
def dedup_exact(v: Views) -> DataFrame:
    return dedup.exact_matches(*_written(v), now())


@query(f"""{_SCOPED}, p as (select n.id as draft_id, o.id, 1 - list_cosine_similarity(n.embedding::double[], o.embedding::double[]) as d from new n join old o using (observed) where n.embedding is not null and o.embedding is not null)
 select draft_id, id, round(d, 6) as distance from (select *, row_number() over (partition by draft_id order by d, id) as rn from p) where rn = 1 and d <= 0.7""")
def dedup_near(v: Views) -> DataFrame:
    return dedup.near_matches(*_written(v), now(), 0.7).select("draft_id", "id", r("distance").alias("distance"))


@query()
def upsert_in_order(v: Views) -> DataFrame:
    """All three stages in order; tests compare it with a plain loop."""
    return dedup.upsert_in_order(*_written(v), now())[0]


@query(f"{FL} select id from live l where level = 'explicit' and times_derived = 1 and last_reinforced_at < timestamp '2025-10-01' and not exists (select 1 from live o where list_contains(o.source_ids, l.id))")
def archive_candidates(v: Views) -> DataFrame:
    return dedup.archive_candidates(v.facts(), now(), F.expr("timestamp '2025-10-01'")).select("id")


@query(f"{with_views('facts')} select id, case when doc_id % 3 = 0 then 'synced' else sync_state end as sync_state, case when doc_id % 3 = 0 then 1.0 else embedding[1]::double end as first from facts")
def set_vectors_repeated(v: Views) -> DataFrame:
    """Vectors for a third of the facts, each given twice; the least counts."""
    ids = v.facts().where("doc_id % 3 = 0").select("id")
    vectors = ids.select("id", F.array(F.lit(2.0), F.lit(1.0)).cast("array<float>").alias("embedding")).union(ids.select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")))
    return dedup.set_vectors(v.facts(), vectors).select("id", "sync_state", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query(f"{with_views('facts')} select id as conclusion_id, 'delete' as event from facts where doc_id % 3 = 0 and deleted_at is null")
def soft_delete_events(v: Views) -> DataFrame:
    return dedup.set_deleted(v.facts(), v.facts().where("doc_id % 3 = 0").select("id"), now(), "api")[1].select("conclusion_id", "event")


@query(f"{with_views('facts')} select id as conclusion_id, 'restore' as event from facts where doc_id % 3 = 0 and deleted_at is not null")
def restore_events(v: Views) -> DataFrame:
    return dedup.restore(v.facts(), v.facts().where("doc_id % 3 = 0").select("id"), now(), "api")[1].select("conclusion_id", "event")


@query(f"{with_views('facts', 'links')} select count(*)::bigint as links from links where conclusion_id not in (select id from facts where deleted_at is null and expires_at <= {NOW})")
def expire_unlinks(v: Views) -> DataFrame:
    return dedup.expire(v.facts(), v.links(), now())[2].agg(F.count("*").alias("links"))


@query(f"{with_views('facts')} select id, (times_derived + case when doc_id % 5 = 0 then 2 else 0 end)::int as times_derived from facts")
def reinforce(v: Views) -> DataFrame:
    hits = v.facts().where("doc_id % 5 = 0").select("id")
    return dedup.reinforce(v.facts(), hits.union(hits), now()).select("id", "times_derived")


# Provenance

_WALK = f"""{with_views('facts', recursive=True)}, e as (select distinct id, unnest(source_ids) as premise from facts),
 w as (select id as root, premise, 1 as depth from e where premise <> id and premise in (select id from facts where deleted_at is null)
  union select root, e.premise, depth + 1 from w join e on e.id = w.premise where depth < 4 and e.premise <> root and e.premise in (select id from facts where deleted_at is null)),
 p as (select root, premise, min(depth)::int as depth from w group by all)"""
_CHAIN = f"""{_WALK}, {CTE['messages']}, {CTE['live']}, m as (select root, unnest(message_ids) as id from p join facts on facts.id = premise union select id, unnest(message_ids) from facts),
 u as (select id as root, premise as missing from e where premise not in (select id from facts where deleted_at is null)), d as (select distinct p as root, id from (select id, unnest(source_ids) as p from live)),
 pl as (select root, array_to_string(list_sort(list(premise)), '|') as premises from p group by 1), ml as (select root, array_to_string(list_sort(list(distinct id)), '|') as messages from m join messages using (id) group by 1),
 ul as (select root, array_to_string(list_sort(list(missing)), '|') as unresolved from u group by 1), dl as (select root, array_to_string(list_sort(list(id)), '|') as dependents from d group by 1)"""


def _every(v: Views) -> DataFrame:
    return v.facts().select("workspace_name", "id")


@query(f"{_WALK} select root, premise, depth from p")
def premise_walk(v: Views) -> DataFrame:
    return provenance.premises(_every(v), v.facts()).select("root", "premise", "depth")


@query(f"{_CHAIN} select root, id, session_name from m join messages using (id)")
def evidence_messages(v: Views) -> DataFrame:
    return provenance.evidence(_every(v), v.facts(), v.messages()).select("root", "id", "session_name")


@query(f"{_CHAIN} select root, missing from u")
def unresolved_premises(v: Views) -> DataFrame:
    return provenance.unresolved(_every(v), v.facts())


@query(f"{_CHAIN} select root, id from d where root in (select id from facts)")
def dependents(v: Views) -> DataFrame:
    return provenance.dependents(_every(v), v.facts(), now())


@query(f"{_CHAIN} select id as root, coalesce(premises, '') as premises, coalesce(messages, '') as messages, coalesce(unresolved, '') as unresolved, coalesce(dependents, '') as dependents from facts left join pl on pl.root = id left join ml on ml.root = id left join ul on ul.root = id left join dl on dl.root = id")
def reasoning_chain(v: Views) -> DataFrame:
    lists = ("premises", "messages", "unresolved", "dependents")
    return provenance.reasoning_chain(_every(v), v.facts(), v.messages(), now()).select("root", *[F.array_join(F.col(c).cast("array<string>"), "|").alias(c) for c in lists])


@query(f"{with_views('facts', 'links')} select id from links join facts on id = conclusion_id where entity_id = '7' and links.observer = 'src0' and links.observed = 'en' and deleted_at is null order by id limit 20")
def entity_provenance(v: Views) -> DataFrame:
    return provenance.entity_provenance("7", ("w", "src0", "en"), v.links(), v.facts(), 20).select("id")


@query(f"{with_views('facts')}, s as (select id, unnest(source_ids) as p from facts) select id as draft_id, count(*)::int as n from s where p in (select id from facts where deleted_at is null) group by 1")
def valid_premises(v: Views) -> DataFrame:
    d = v.facts().select(F.col("id").alias("draft_id"), "workspace_name", "source_ids")
    return provenance.valid_premises(d, v.facts()).select("draft_id", F.size("source_ids").alias("n"))


# Sessions


@query(f"{with_views('windows')} select session_name, peer_name, {sql_stamp('joined_at')}, {sql_stamp('left_at')} from windows")
def membership_windows(v: Views) -> DataFrame:
    return sessions.membership_windows(v.membership_events()).select("session_name", "peer_name", stamp("joined_at"), stamp("left_at"))


@query(f"{with_views('windows')} select distinct session_name, peer_name from windows where joined_at <= timestamp '2024-01-10' and (left_at is null or left_at > timestamp '2024-01-10')")
def members_at(v: Views) -> DataFrame:
    return sessions.members_at(sessions.membership_windows(v.membership_events()), F.expr("timestamp '2024-01-10'")).select("session_name", "peer_name")


@query(f"{with_views('messages', 'windows')} select id from messages m where exists (select 1 from windows w where w.session_name = m.session_name and peer_name = 'p0' and joined_at <= m.created_at and (left_at is null or left_at > m.created_at))")
def audible_messages(v: Views) -> DataFrame:
    return sessions.audible(v.messages(), sessions.membership_windows(v.membership_events()), "p0").select("id")


@query(f"""{with_views('messages', 'windows')}, cur as (select session_name, peer_name, max(joined_at) as joined_at, arg_max(left_at, joined_at) filter (true) as x from windows group by all),
 mem as (select c.session_name, c.peer_name, c.joined_at, w.left_at from cur c join windows w using (session_name, peer_name, joined_at))
 select m.id, peer_name as observer, peer_name as observed from messages m union all
 select m.id, w.peer_name, m.peer_name from messages m join mem w using (session_name) where joined_at <= m.created_at and (left_at is null or left_at > m.created_at) and w.peer_name <> m.peer_name""")
def fan_out_pairs(v: Views) -> DataFrame:
    members = sessions.current_members(v.membership_events()).withColumns({"observe_me": F.lit(None).cast("boolean"), "observe_others": F.lit(None).cast("boolean")})
    return sessions.fan_out(v.messages(), members).select("id", "observer", "observed")


_BUDGET = f"{with_views('messages')}, x as (select *, row_number() over w as rn, sum(token_count) over (w rows unbounded preceding) as s from messages window w as (partition by session_name order by seq_in_session desc))"


@query(f"{_BUDGET} select session_name, min(seq_in_session)::bigint as start_seq, count(*)::int as n, sum(token_count)::bigint as message_tokens from x where rn <= 200 and (rn = 1 or s <= 400) group by 1")
def context_budget(v: Views) -> DataFrame:
    m = v.messages()
    s = m.select("workspace_name", F.col("session_name").alias("name")).distinct().withColumn("summaries", F.lit(None).cast("map<string, struct<text: string, token_count: int, covers_through_seq: bigint>>"))
    return sessions.contexts(s, m, 400).select("session_name", "start_seq", F.size("messages").alias("n"), "message_tokens")


@query(f"""{_BUDGET} select session_name, 'Recent:' || chr(10) || string_agg(strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' ' || peer_name || ': ' || content, chr(10) order by seq_in_session) as text
 from x where rn <= 200 and (rn = 1 or s <= 400) group by 1""")
def context_text(v: Views) -> DataFrame:
    m = v.messages()
    s = m.select("workspace_name", F.col("session_name").alias("name")).distinct().withColumn("summaries", F.lit(None).cast("map<string, struct<text: string, token_count: int, covers_through_seq: bigint>>"))
    return sessions.render(sessions.contexts(s, m, 400)).select("session_name", "text")


@query(f"""{with_views('windows')} select session_name, peer_name, {sql_stamp('joined_at')},
 strftime(case when left_at is null and peer_name <> 'p0' and session_name in (select session_name from windows where peer_name = 'p0') then timestamp '2024-02-01' else left_at end, '%Y-%m-%d %H:%M:%S') as left_at from windows""")
def roster_replaced(v: Views) -> DataFrame:
    """The sessions of p0, of which p0 alone stays."""
    w = sessions.membership_windows(v.membership_events())
    out = sessions.replace_roster(w, w.where("peer_name = 'p0'"), F.expr("timestamp '2024-02-01 00:00:00'"))
    return out.select("session_name", "peer_name", stamp("joined_at"), stamp("left_at"))


@query(f"{_BUDGET} select id, s::bigint as running_tokens from x where s <= 300")
def history_within(v: Views) -> DataFrame:
    return sessions.history_within(v.messages(), 300).select("id", "running_tokens")


@query(f"{with_views('messages')} select session_name, count(*)::bigint as pending, least(count(*), 16)::bigint as fed from messages group by 1 having count(*) >= 4")
def due_summaries(v: Views) -> DataFrame:
    covered = v.spark.createDataFrame([], "workspace_name string, session_name string, covers_through_seq bigint")
    return sessions.due_summaries(v.messages(), covered, 4).select("session_name", "pending", "fed")


# Work


def _qnow() -> Column:
    return F.expr(QUEUE_NOW)


@query(f"""{with_views('queue', 'claims')} select work_unit_key, sum(token_count)::bigint as tokens, count(*)::bigint as items, {sql_stamp('min(created_at)').replace(' as min(created_at)', ' as oldest')} from queue q
 where not processed and not exists (select 1 from claims c where c.work_unit_key = q.work_unit_key and c.expires_at > {QUEUE_NOW}) group by 1
 having sum(token_count) >= 512 or min(created_at) <= {QUEUE_NOW} - interval 1800 second or max(created_at) <= {QUEUE_NOW} - interval 3 second""")
def queue_ready(v: Views) -> DataFrame:
    return work.ready_units(v.queue(), v.claims(), _qnow()).select("work_unit_key", "tokens", "items", stamp("oldest"))


@query(f"{with_views('queue')} select count(*)::bigint as pending, (epoch({QUEUE_NOW})::bigint - floor(epoch(min(created_at)))::bigint) as oldest_age_s from queue where not processed")
def queue_health(v: Views) -> DataFrame:
    return work.queue_health(v.queue(), _qnow()).select("pending", "oldest_age_s")


@query(f"{with_views('queue')} select distinct workspace_name from queue where not processed order by 1 limit 2")
def workspaces_with_work(v: Views) -> DataFrame:
    return tables.workspaces_with_work(v.queue(), 2)


@query(f"{with_views('queue')} select distinct work_unit_key from queue where not processed")
def undrained_keys(v: Views) -> DataFrame:
    return work.undrained(v.queue(), v.queue().select("work_unit_key"))


@query(f"{with_views('queue')} select id, processed or id % 3 = 0 as processed, (case when id % 3 = 0 then 1 else 0 end)::int as attempts from queue")
def record_failures(v: Views) -> DataFrame:
    return work.record_failure(v.queue(), v.queue().where("id % 3 = 0").select("id", F.lit("x").alias("error")), 1).select("id", "processed", "attempts")


@query(f"{with_views('queue')} select id, processed or id % 15 = 0 as processed, (case when id % 15 = 0 then 2 when id % 3 = 0 then 1 else 0 end)::int as attempts, case when id % 15 = 0 then 'y' when id % 3 = 0 then 'x' end as last_error from queue")
def record_failures_repeated(v: Views) -> DataFrame:
    """Ids given twice failed twice."""
    failed = v.queue().where("id % 3 = 0").select("id", F.lit("x").alias("error")).union(v.queue().where("id % 15 = 0").select("id", F.lit("y")))
    return work.record_failure(v.queue(), failed, 2).select("id", "processed", "attempts", "last_error")


@query(f"{with_views('queue', 'claims')} select work_unit_key, expires_at > {QUEUE_NOW} as held from claims where expires_at > {QUEUE_NOW} union select distinct work_unit_key, true from queue where work_unit_key not in (select work_unit_key from claims where expires_at > {QUEUE_NOW})")
def claim_units(v: Views) -> DataFrame:
    swept = work.sweep_claims(v.claims(), _qnow())
    return work.claim(swept, v.queue().select("work_unit_key"), "me", _qnow(), 60).select("work_unit_key", (F.col("expires_at") > _qnow()).alias("held"))


@query(f"{with_views('facts')} select observer, observed, count(*)::bigint as explicit_count from facts where deleted_at is null and level = 'explicit' group by all having count(*) >= 10")
def dreams_due(v: Views) -> DataFrame:
    none = v.spark.createDataFrame([], "workspace_name string, observer string, observed string, last_dream_at timestamp, explicit_at_last_dream int")
    dreams = v.spark.createDataFrame([], "id string, workspace_name string, observer string, observed string, status string")
    return work.due_dreams(v.facts(), none, dreams, now(), 10).select("observer", "observed", "explicit_count")


_DREAMS = f"""{with_views('facts')}, pr as (select distinct observer, observed, 'd' || observer || observed as id from facts where observer is not null and observed is not null),
 dr as (select *, ('0x' || substr(md5(id), 1, 6))::int % 4 as k, ('0x' || substr(md5(id), 7, 6))::int % 5 as requeues from pr)"""


def _dreams(v: Views) -> tuple[DataFrame, DataFrame]:
    """A dream for each pair, in one of four states by a hash of its id, and its pair."""
    pairs = v.facts().where("observer is not null and observed is not null").select("workspace_name", "observer", "observed").distinct()
    digits = lambda at: F.conv(F.substring(F.md5("id"), at, 6), 16, 10).cast("int")
    d = pairs.withColumn("id", F.concat(F.lit("d"), "observer", "observed"))
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "done", "failed"))), digits(1) % 4 + 1)
    d = d.withColumns({"status": status, "requeues": digits(7) % 5, "created_at": now(), "updated_at": now()})
    return pairs, d


@query(f"{_DREAMS} select observer, observed from dr where k >= 2")
def dreams_started(v: Views) -> DataFrame:
    pairs, d = _dreams(v)
    flying = d.where("status in ('pending', 'running')")
    return work.start_dreams(flying, pairs, now()).join(flying.select("id"), "id", "left_anti").select("observer", "observed")


@query(f"{_DREAMS} select id, case when k >= 2 then ['done', 'failed'][k - 1] when requeues < 3 then 'pending' else 'failed' end as status, (requeues + case when k < 2 and requeues < 3 then 1 else 0 end)::int as requeues from dr")
def dreams_swept(v: Views) -> DataFrame:
    """All in-flight ones have lost their queue item."""
    nothing = v.queue().where("false")
    return work.sweep_dreams(_dreams(v)[1], nothing, F.expr(f"{NOW} + interval 1 hour")).select("id", "status", "requeues")


@query(f"""{with_views('queue', 'claims')}, held as (select work_unit_key from claims where expires_at > {QUEUE_NOW}), u as (select workspace_name, work_unit_key, min(created_at) as oldest from queue where not processed and work_unit_key not in (select work_unit_key from held)
 group by all having sum(token_count) >= 512 or min(created_at) <= {QUEUE_NOW} - interval 30 minute or max(created_at) <= {QUEUE_NOW} - interval 3 second)
 select work_unit_key, row_number() over (partition by workspace_name order by oldest, work_unit_key)::int as turn from u""")
def fair_turns(v: Views) -> DataFrame:
    units = work.ready_units(v.queue(), v.claims(), _qnow()).join(v.queue().select("workspace_name", "work_unit_key").distinct(), "work_unit_key")
    return work.fair_order(units).select("work_unit_key", "turn")


@query(f"""{with_views('facts', 'links')}, gone as (select id from facts where session_name = 's3'), kept as (select * from links where conclusion_id not in (select id from gone))
 select 'event' as part, id, 0::bigint as n from gone join facts using (id) where deleted_at is null union all select 'link', entity_id, count(*) from kept group by 2
 union all select 'entity', p_partkey::varchar, 0 from part where p_partkey::varchar in (select entity_id from kept)""")
def session_deleted(v: Views) -> DataFrame:
    """The cascade of one session: events, links left by entity, and entities left."""
    _, events, links, left = work.delete_session(("w", "s3"), v.facts(), v.links(), v.entities(), now())
    part = lambda name, df: df.select(F.lit(name).alias("part"), "id", F.col("n").cast("bigint").alias("n"))
    out = part("event", events.select(F.col("conclusion_id").alias("id"), F.lit(0).alias("n")))
    out = out.unionByName(part("link", links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))))
    return out.unionByName(part("entity", left.select("id", F.lit(0).alias("n"))))


@query(f"{with_views('entities')} select id from entities where embedding is null or id::int % 4 = 0 order by id limit 25")
def entities_without_vectors(v: Views) -> DataFrame:
    """The next 25 of them; every fourth has lost its vector."""
    e = v.entities().withColumn("embedding", F.when(F.col("id").cast("int") % 4 != 0, F.col("embedding")))
    return entities.missing_vectors(e, 25).select("id")


@query(f"{with_views('facts')} select id from facts where level = 'explicit' and times_derived >= 4 and (content ilike '%the%' or session_name is null)")
def filter_merged(v: Views) -> DataFrame:
    raw = filters.all_of({"level": "explicit"}, None, {}, {"times_derived": {"gte": 4}, "OR": [{"content": {"icontains": "THE"}}, {"session_name": None}]})
    return v.facts().where(filters.fact_filter(raw)).select("id")


@query(f"{FL} select id from live where last_reinforced_at >= timestamp '2025-03-01' and last_reinforced_at < timestamp '2025-09-01'")
def reinforced_window(v: Views) -> DataFrame:
    when = lambda t: F.expr(f"timestamp '{t} 00:00:00'")
    return tables.live_facts(v.facts(), now()).where(recall.reinforced_between(when("2025-03-01"), when("2025-09-01"))).select("id")


@query(f"""{with_views('facts')} select id, case doc_id % 4 when 0 then 'IDENTITY: ' || id || '|INSTRUCTION: x' when 1 then 'RELATIONSHIP: ' || level else '' end as lines from facts""")
def profile_lines(v: Views) -> DataFrame:
    k = F.col("doc_id") % 4
    lines = F.when(k == 0, F.array(F.concat(F.lit("  IDENTITY: "), "id"), F.lit("identity: no"), F.lit("INSTRUCTION: x\n"))).when(k == 1, F.array(F.lit("OTHER: y"), F.concat(F.lit("RELATIONSHIP: "), "level"))).when(k == 2, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>"))
    return v.facts().select("id", F.array_join(text.card_lines(lines), "|").alias("lines"))


@query(f"""select event_id, strftime(case event_id % 3 when 0 then ts when 1 then date_trunc('day', ts) else {QUEUE_NOW} end, '%Y-%m-%d %H:%M:%S') as at from events""")
def instants_parsed(v: Views) -> DataFrame:
    k, ts = F.col("event_id") % 3, F.col("ts").cast("timestamp")
    given = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.lit("some day"))
    return v.table("events").select("event_id", F.date_format(text.parse_instant(given, _qnow()), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"{_SCOPED} select case when o.observed is null then 'INSERTED' else 'REINFORCED' end as kind, count(*)::bigint as n from new n left join (select distinct observed, content_hash from old) o using (observed, content_hash) group by 1")
def outcomes_counted(v: Views) -> DataFrame:
    new, old = _written(v)
    hit = dedup.exact_matches(new, old, now()).select("draft_id", F.lit("REINFORCED").alias("kind"))
    return dedup.outcome_counts(new.select("draft_id").join(hit, "draft_id", "left").select(F.coalesce("kind", F.lit("INSERTED")).alias("kind")))


@query(f"""{_RECALL}, s as (select *, 0.2 * sem + 0.5 * kw + 0.1 * ent + 0.1 * reinf + 0.05 * rec + 0.05 * lvl as score from x)
 select qid, rank::int as rank, id, round(score, 5) as score from (select *, row_number() over (partition by qid order by score desc, id) as rank from s where score >= 0.3) where rank <= 5""")
def recall_overridden(v: Views) -> DataFrame:
    """A workspace's own weights and threshold; an override out of range is ignored."""
    weights = {"semantic": 0.2, "keyword": 0.5, "entity": 0.1, "reinforcement": 0.1, "recency": 0.05, "level": 0.05}
    settings = workspace_settings({"weights": weights, "threshold": 0.3, "oversample": 99})
    return recall.recall(v.queries(), v.facts(), v.entities(), v.links(), now(), settings, limit=5).select("qid", "rank", "id", r("score", 5).alias("score"))


# Evaluation: benchmark items as queries, ranked by vector; grades from labels

_EVAL = f"""{with_views('queries')}, rk as (select qid, vec_id as id, row_number() over (partition by qid order by 1 - {COS}, vec_id) as rank from queries, embeddings),
 jd as (select qid, doc_id as id, quality * (3 - toxic) as rel from queries, labels), g as (select jd.qid, jd.id, rel, rank from jd left join rk using (qid, id)),
 ideal as (select qid, rel, row_number() over (partition by qid order by rel desc, id) as rank from jd)"""


def _eval(v: Views, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every question asked of one pair that holds all embeddings, and judged by all labels: (ranking of the k nearest, or all
    distances, and judgements)."""
    one = lambda d: d.withColumns(dict(zip(("workspace_name", "observer", "observed"), map(F.lit, "wab"))))
    q = one(v.queries())
    held = one(v.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")).withColumns({"deleted_at": F.lit(None).cast("timestamp"), "expires_at": F.lit(None).cast("timestamp")})
    if k:
        near = recall.semantic(q, held, now(), k)
        ranking = near.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")).alias("rank"))
    else:
        ranking = recall.distances(q, held, now())
    return ranking, _judged(v, v.table("labels").withColumnRenamed("doc_id", "id"))


def _judged(v: Views, labels: DataFrame) -> DataFrame:
    """Every question judged by these labels; the questions go to the labels."""
    return labels.withColumn("_all", F.lit(1)).join(recall.small(v.queries().select("qid", F.lit(1).alias("_all"))), "_all").select("qid", "id", (F.col("quality") * (3 - F.col("toxic"))).alias("rel"))


@query(f"""{_EVAL}, a as (select qid, sum(case when rank <= 10 then (2.0 ** rel - 1) / log2(rank + 1) end) as dcg from g group by 1), b as (select qid, sum((2.0 ** rel - 1) / log2(rank + 1)) as best from ideal where rank <= 10 group by 1)
 select qid, round(case when best > 0 then coalesce(dcg, 0) / best else 0 end, 6) as ndcg from a join b using (qid)""")
def eval_ndcg(v: Views) -> DataFrame:
    return evaluate.ndcg(*_eval(v, 10), 10).select("qid", r("ndcg").alias("ndcg"))


@query(f"{_EVAL} select qid, round(coalesce(1.0 / min(case when rel > 0 then rank end), 0), 6) as rr from g group by 1")
def eval_mrr(v: Views) -> DataFrame:
    return evaluate.reciprocal_rank_by(*_eval(v)).select("qid", r("rr").alias("rr"))


@query(f"{_EVAL} select qid, round(count(*) filter (rel > 0 and rank <= 10) / greatest(1, count(*) filter (rel > 0)), 6) as recall from g group by 1")
def eval_recall_k(v: Views) -> DataFrame:
    return evaluate.recall_at(*_eval(v, 10), 10).select("qid", r("recall").alias("recall"))


@query(f"{_EVAL} select qid, round(count(*) filter (rel > 0 and rank <= 10) / 10.0, 6) as precision from g group by 1")
def eval_precision_k(v: Views) -> DataFrame:
    return evaluate.precision_at(*_eval(v, 10), 10).select("qid", r("precision").alias("precision"))


@query(f"{_EVAL} select qid, id, rel::int as rel from jd where id not in (select vec_id from embeddings)")
def eval_unknown_judgements(v: Views) -> DataFrame:
    corpus = v.table("embeddings").select(F.col("vec_id").alias("id"))
    unknown = evaluate.unknown_judgements(v.table("labels").withColumnRenamed("doc_id", "id"), corpus)  # before the labels meet the questions
    return _judged(v, unknown).select("qid", "id", F.col("rel").cast("int").alias("rel"))


@query(f"""{with_views('facts')}, h as (select sha256(concat_ws(chr(31), id, coalesce(content, chr(0)), level)) as d from facts),
 k as (select greatest(1, ceil(ln(greatest(1, count(*))) / ln(256)))::int as digits, count(*) as n from h), c as (select d, count(*) as n from h group by d),
 g as (select substr(d, 1, digits) as p, sha256(string_agg(d || ':' || c.n, ',' order by d)) as d from c, k group by 1)
 select sha256(string_agg(d, '' order by p)) as fingerprint, any_value(k.n)::bigint as n from g, k""")
def corpus_fingerprint(v: Views) -> DataFrame:
    return evaluate.fingerprint(v.facts(), "id", "content", "level")


@query("select value from (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events) where i = floor(0.95 * (n - 1) + 0.5)")
def latency_percentile(v: Views) -> DataFrame:
    return evaluate.latency_percentile(v.table("events").select("value"), 0.95, "value")


@query("""with m as (select event_type, min(value) as p0, max(value) as p100, count(*)::bigint as n from events group by 1) select event_type, n, p0, p100, true as p95_near from m""")
def latency_sketched(v: Views) -> DataFrame:
    """Hourly sketches merged to one an event type: the ends are exact, and the 95th percentile's true rank is within 0.02 of it."""
    events = v.table("events")
    hours = evaluate.latency_sketches(events.withColumn("at", F.col("ts").cast("timestamp")), "at", "value", "1 hour", keys=("event_type",))
    got = evaluate.sketch_percentiles(evaluate.merged_sketches(evaluate.merged_sketches(hours, ("event_type",), "1 day"), ("event_type",)), 0, 0.95, 1)
    rank = events.select("event_type", "value").join(F.broadcast(got.select("event_type", "p95")), "event_type").groupBy("event_type")
    rank = rank.agg(F.avg((F.col("value") <= F.col("p95")).cast("int")).alias("to"), F.avg((F.col("value") < F.col("p95")).cast("int")).alias("from"))
    near = (F.col("from") <= 0.97) & (F.col("to") >= 0.93)
    return got.join(rank, "event_type").select("event_type", "n", "p0", "p100", near.alias("p95_near"))


