"""Scans, pages and keyed writes over the model's tables; writes return the new table (copy on write)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.schemas import FACT_COLUMNS, PAIR, in_pair, is_alive
from palimpsest.settings import history_limit, page_number, page_size


def live_facts(facts: DataFrame, now: Column, pair: tuple[str, str, str] | None = None) -> DataFrame:
    out = facts.where(is_alive(now))
    return out if pair is None else out.where(in_pair(*pair))


def _no_vector(facts: DataFrame) -> DataFrame:
    return facts.select(*[c for c in FACT_COLUMNS if c in facts.columns])


def find_fact(facts: DataFrame, workspace: str, fact_id: str) -> DataFrame:
    """By id, deleted and expired ones too."""
    return _no_vector(facts.where((F.col("workspace_name") == workspace) & (F.col("id") == fact_id)))


def facts_by_ids(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose (workspace_name, id) is listed; not the deleted ones, but the expired ones."""
    return facts.where("deleted_at is null").join(ids.select("workspace_name", "id").distinct(), ["workspace_name", "id"], "left_semi")


def page_of(rows: DataFrame, order: Sequence[Column], page: int | None, size: int | None) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and a row (total, has_next)."""
    page, size = page_number(page), page_size(size)
    items = rows.orderBy(*order).offset(page * size).limit(size)
    info = rows.agg(F.count("*").alias("total")).withColumn("has_next", F.lit((page + 1) * size) < F.col("total"))
    return items, info


def list_facts(facts: DataFrame, pair: tuple[str, str, str], now: Column, where: Column | None = None, page: int = 0, size: int = 50) -> tuple[DataFrame, DataFrame]:
    rows = live_facts(facts, now, pair)
    return page_of(_no_vector(rows if where is None else rows.where(where)), [F.desc("created_at"), F.col("id")], page, size)


def newest_facts(facts: DataFrame, pair: tuple[str, str, str], now: Column, limit: int) -> DataFrame:
    return _no_vector(live_facts(facts, now, pair).orderBy(F.desc("created_at"), "id").limit(limit))


def counts_by_level(facts: DataFrame, now: Column) -> DataFrame:
    return live_facts(facts, now).groupBy(*PAIR, "level").agg(F.count("*").alias("n"))


def pending_embeddings(facts: DataFrame, limit: int) -> DataFrame:
    """Undeleted rows without a vector or marked pending, oldest first; failed ones that have a vector are left."""
    return facts.where("deleted_at is null and (embedding is null or sync_state = 'pending')").orderBy("created_at", "id").limit(limit)


def expired_facts(facts: DataFrame, now: Column, limit: int) -> DataFrame:
    return _no_vector(facts.where(F.col("deleted_at").isNull() & (F.col("expires_at") <= now)).orderBy("expires_at", "id").limit(limit))


def session_messages(messages: DataFrame, workspace: str, session: str, from_seq: int | None = None) -> DataFrame:
    rows = messages.where((F.col("workspace_name") == workspace) & (F.col("session_name") == session))
    return (rows if from_seq is None else rows.where(F.col("seq_in_session") >= from_seq)).orderBy("seq_in_session")


def tails(messages: DataFrame, n: int, from_seq: Column | None = None) -> DataFrame:
    """The newest n messages of every session (from a sequence number on), for all sessions in one plan."""
    rows = messages if from_seq is None else messages.where(F.col("seq_in_session") >= from_seq)
    newest = Window.partitionBy("workspace_name", "session_name").orderBy(F.desc("seq_in_session"))
    return rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def session_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("workspace_name", "session_name").agg(F.count("*").alias("n"))


def search_messages(messages: DataFrame, where: Column, page: int = 0, size: int = 50) -> tuple[DataFrame, DataFrame]:
    return page_of(messages.where(where), [F.col("session_name"), F.col("seq_in_session")], page, size)


def append_messages(messages: DataFrame, new: DataFrame, groups: int = 4096) -> DataFrame:
    """New messages (with `position` in their batch) numbered on from each session's last.

    Ids follow the largest one without gaps: by group of the sessions (a hash of their keys, `groups` at most), session
    and position. A group's sessions are numbered in one task, and only the groups' sizes meet in one place.
    """
    key = ["workspace_name", "session_name"]
    group = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 8), 16, 10).cast("long"), F.lit(groups))
    last = messages.groupBy(*key).agg(F.max("seq_in_session").alias("_last"))
    numbered = new.join(last, key, "left").withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("position")))
    sizes = numbered.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_g", group)
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups_before = sizes.groupBy("_g").agg(F.sum("_n").alias("_n")).select("_g", earlier(Window.orderBy("_g")).alias("_base"))
    before = sizes.withColumn("_before", earlier(Window.partitionBy("_g").orderBy(*key))).join(groups_before, "_g").drop("_n", "_g")
    top = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    out = numbered.join(before, key).join(F.broadcast(top))
    out = out.withColumns({"id": F.col("_top") + F.col("_base") + F.col("_before") + F.col("_at"), "seq_in_session": F.coalesce("_last", F.lit(0)) + F.col("_at")})
    return messages.unionByName(out.drop("_top", "_base", "_before", "_last", "_at", "position"), allowMissingColumns=True)


def next_sequences(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """First of the n numbers reserved for each session of wanted (workspace_name, session_name, n)."""
    key = ["workspace_name", "session_name"]
    last = messages.groupBy(*key).agg(F.max("seq_in_session").alias("_last"))
    return wanted.join(last, key, "left").select(*key, (F.coalesce("_last", F.lit(0)) + 1).alias("first"), (F.coalesce("_last", F.lit(0)) + F.col("n")).alias("last"))


def insert_missing(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add rows whose key the table lacks; the first of equal new keys in column order wins."""
    fresh = rows.join(table.select(*key), list(key), "left_anti")
    pick = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in rows.columns if c not in key] or [F.lit(0)])
    fresh = fresh.withColumn("_rn", F.row_number().over(pick)).where("_rn = 1").drop("_rn")
    return table.unionByName(fresh, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replace rows of equal key by the new ones and add the others (keys of rows must be unique)."""
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows, allowMissingColumns=True)


def fact_history(events: DataFrame, fact_id: str, limit: int | None = None) -> DataFrame:
    return events.where(F.col("conclusion_id") == fact_id).orderBy(F.desc("created_at"), F.desc("id")).limit(history_limit(limit))


def recent_events(events: DataFrame, workspace: str, limit: int | None = None) -> DataFrame:
    return events.where(F.col("workspace_name") == workspace).orderBy(F.desc("created_at"), F.desc("id")).limit(history_limit(limit))


def workspaces_with_work(queue: DataFrame, limit: int) -> DataFrame:
    return queue.where("not processed").select("workspace_name").distinct().orderBy("workspace_name").limit(limit)
