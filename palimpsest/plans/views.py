"""The test tables seen as the data model, in Spark and in the same words of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens_simple

NOW = "timestamp '2026-01-01 00:00:00'"
BENCH_LANGS = "('en', 'fr', 'de', 'es')"


def now():
    return F.expr(NOW)


class Views:
    """Model tables over one folder of test tables; each is a plan, nothing is read before an action."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def facts(self) -> DataFrame:
        d = self.table("documents")
        k = F.col("doc_id")
        d = d.join(self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
        level = F.element_at(F.array(*map(F.lit, ("explicit", "deductive", "inductive", "explicit"))), (k % 4 + 1).cast("int"))
        d = d.select(
            "doc_id", k.cast("string").alias("id"), F.lit("w").alias("workspace_name"), F.col("source").alias("observer"), F.col("lang").alias("observed"), level.alias("level"),
            F.when(level == "explicit", F.concat(F.lit("s"), (k % 50).cast("string"))).alias("session_name"), F.col("text").alias("content"),
            F.sha2(F.lower(F.btrim("text", F.lit(" \t\n\r\f\x0b"))), 256).alias("content_hash"), F.lower(F.btrim("text", F.lit(" \t\n\r\f\x0b"))).alias("content_norm"),
            F.array_join(tokens_simple(F.col("text")), " ").alias("content_analyzed"), (k % 10 / 10.0).cast("double").alias("confidence"),
            F.when(k > 0, F.array_distinct(F.array(F.floor(k / 2).cast("string"), F.floor(k / 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("source_ids"),
            F.array((k % 500).cast("bigint")).alias("message_ids"), (k % 7 + 1).cast("int").alias("times_derived"),
            F.expr(f"{NOW} - make_interval(0, 0, 0, cast(doc_id % 400 as int))").alias("last_reinforced_at"), F.expr(f"{NOW} - make_interval(0, 0, 0, 0, cast(doc_id % 900 as int))").alias("created_at"),
            F.expr(f"{NOW} - make_interval(0, 0, 0, 0, cast(doc_id % 900 as int))").alias("updated_at"),
            F.when(k % 13 == 0, F.expr(f"{NOW} - interval 1 day")).when(k % 13 == 1, F.expr(f"{NOW} + interval 1 day")).alias("expires_at"), F.when(k % 17 == 0, now()).alias("deleted_at"),
            F.when(F.col("embedding").isNull(), "pending").otherwise("synced").alias("sync_state"), "embedding",
        )
        return d

    def flat_facts(self) -> DataFrame:
        """All facts of a language in one scope, so that copies meet in writes."""
        return self.facts().withColumns({"observer": F.lit("all"), "level": F.lit("deductive"), "session_name": F.lit(None).cast("string")})

    def queries(self) -> DataFrame:
        """One question for each benchmark item, each to one pair, with the vector of the same number."""
        b = self.table("benchmark")
        k = F.col("item_id")
        lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (k % 4 + 1).cast("int"))
        q = b.select(k.alias("qid"), F.lit("w").alias("workspace_name"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("observer"), lang.alias("observed"), tokens_simple(F.col("text")).alias("query_tokens"))
        return q.join(self.table("embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector")), "qid")

    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("w").alias("workspace_name"), F.col("conv_id").cast("string").alias("session_name"), F.col("role").alias("peer_name"), F.col("text").alias("content"),
            (F.col("turn") + 1).alias("seq_in_session"), F.size(tokens_simple(F.col("text"))).alias("token_count"),
            F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(conv_id as int), cast(turn as int))").alias("created_at"),
        )

    def entities(self) -> DataFrame:
        p = self.table("part").join(self.table("embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding"), "p_partkey", "left")
        return p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("w").alias("workspace_name"), F.lower("p_name").alias("name_norm"), F.col("p_name").alias("name_display"), F.col("p_type").alias("kind"), "embedding", now().alias("created_at"))

    def links(self) -> DataFrame:
        e = self.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 50).cast("string").alias("entity_id")).distinct()
        return e.join(self.table("documents").select("doc_id", "source", "lang"), "doc_id").select(F.lit("w").alias("workspace_name"), F.col("source").alias("observer"), F.col("lang").alias("observed"), "entity_id", F.col("doc_id").cast("string").alias("conclusion_id"), F.expr(NOW).alias("created_at"))

    def queue(self) -> DataFrame:
        k, u = F.col("event_id"), F.col("user_id")
        return self.table("events").select(
            k.alias("id"), F.concat(F.lit("w"), (u % 3).cast("string")).alias("workspace_name"), F.concat_ws(":", u.cast("string"), "event_type").alias("work_unit_key"), F.lit("representation").alias("task_type"), k.cast("string").alias("payload"),
            F.floor("value").cast("int").alias("token_count"), (k % 5 == 0).alias("processed"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.col("ts").cast("timestamp").alias("created_at"),
        )

    def claims(self) -> DataFrame:
        u = self.table("events").where("user_id % 7 = 0").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("work_unit_key"), "user_id").distinct()
        return u.select("work_unit_key", F.lit("x").alias("worker_id"), F.expr(QUEUE_NOW).alias("claimed_at"), F.when(F.col("user_id") % 2 == 0, F.expr(f"{QUEUE_NOW} + interval 1 hour")).otherwise(F.expr(f"{QUEUE_NOW} - interval 1 hour")).alias("expires_at"))

    def membership_events(self) -> DataFrame:
        """Sign-ups join and errors leave a session numbered by user; five sessions share a user's events as peers."""
        e = self.table("events").where("event_type in ('signup', 'error')")
        return e.select(F.lit("w").alias("workspace_name"), (F.col("user_id") % 100).cast("string").alias("session_name"), F.concat(F.lit("p"), F.floor(F.col("user_id") / 100).cast("string")).alias("peer_name"), F.when(F.col("event_type") == "signup", "join").otherwise("leave").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))


QUEUE_NOW = "timestamp '2024-01-30 12:00:00'"

# The same views as common table expressions.
CTE = {
    "facts": rf"""facts as (select d.doc_id, d.doc_id::varchar as id, 'w' as workspace_name, source as observer, lang as observed,
 ['explicit', 'deductive', 'inductive', 'explicit'][doc_id % 4 + 1] as level, case when doc_id % 4 in (0, 3) then 's' || (doc_id % 50) end as session_name, text as content,
 lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) as content_norm, sha256(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)))) as content_hash,
 regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as tokens, (doc_id % 10 / 10.0)::double as confidence,
 case when doc_id > 0 then list_distinct([(doc_id // 2)::varchar, (doc_id // 3)::varchar]) else [] end as source_ids, [doc_id % 500] as message_ids, (doc_id % 7 + 1)::int as times_derived,
 {NOW} - to_days((doc_id % 400)::int) as last_reinforced_at, {NOW} - to_hours((doc_id % 900)::int) as created_at,
 case when doc_id % 13 = 0 then {NOW} - interval 1 day when doc_id % 13 = 1 then {NOW} + interval 1 day end as expires_at, case when doc_id % 17 = 0 then {NOW} end as deleted_at,
 case when e.embedding is null then 'pending' else 'synced' end as sync_state, e.embedding from documents d left join embeddings e on e.vec_id = d.doc_id)""",
    "live": f"live as (select * from facts where deleted_at is null and (expires_at is null or expires_at > {NOW}))",
    "queries": r"""queries as (select item_id as qid, 'src' || (item_id % 20) as observer, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] as observed,
 regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as query_tokens, e.embedding as query_vector from benchmark join embeddings e on vec_id = item_id)""",
    "messages": r"""messages as (select conv_id * 1000 + turn as id, conv_id::varchar as session_name, role as peer_name, text as content, turn + 1 as seq_in_session,
 len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::int as token_count, timestamp '2024-01-01 00:00:00' + to_hours(conv_id::int) + to_minutes(turn::int) as created_at from conversations)""",
    "entities": "entities as (select p_partkey::varchar as id, lower(p_name) as name_norm, e.embedding from part left join embeddings e on vec_id = p_partkey)",
    "links": "links as (select distinct source as observer, lang as observed, (l_partkey % 50)::varchar as entity_id, doc_id::varchar as conclusion_id from lineitem join documents on l_orderkey = doc_id)",
    "queue": "queue as (select event_id as id, 'w' || (user_id % 3) as workspace_name, user_id::varchar || ':' || event_type as work_unit_key, floor(value)::int as token_count, event_id % 5 = 0 as processed, ts as created_at from events)",
    "claims": f"claims as (select distinct user_id::varchar || ':' || event_type as work_unit_key, case when user_id % 2 = 0 then {QUEUE_NOW} + interval 1 hour else {QUEUE_NOW} - interval 1 hour end as expires_at from events where user_id % 7 = 0)",
    "windows": """moves as (select (user_id % 100)::varchar as session_name, 'p' || (user_id // 100) as peer_name, case when event_type = 'signup' then 'join' else 'leave' end as kind, ts as moved, event_id as seq from events where event_type in ('signup', 'error')),
 turns as (select * from (select *, lag(kind) over (partition by session_name, peer_name order by moved, seq) as before from moves) where kind <> coalesce(before, 'leave')),
 windows as (select session_name, peer_name, moved as joined_at, left_at from (select *, lead(moved) over (partition by session_name, peer_name order by moved, seq) as left_at from turns) where kind = 'join')""",
}
Query = Callable[[SparkSession, str], DataFrame]


def with_views(*names: str, recursive: bool = False) -> str:
    return "with " + ("recursive " if recursive else "") + ",\n".join(CTE[n] for n in names)
