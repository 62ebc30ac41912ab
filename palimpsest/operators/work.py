"""The work queue as tables: gates, leases, retries, and the reconciler's sweeps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.schemas import PAIR


@dataclass(frozen=True)
class Gates:
    tokens: int = 512
    max_age_s: int = 1800
    idle_s: int = 3


def _seconds(n: int) -> Column:
    return F.make_interval(secs=F.lit(n))


def ready_units(queue: DataFrame, claims: DataFrame, now: Column, gates: Gates = Gates(), limit: int | None = None) -> DataFrame:
    """Unclaimed keys whose pending items have enough tokens, are old enough or have been idle: key, tokens, items, oldest, newest."""
    held = claims.where(F.col("expires_at") > now).select("work_unit_key").distinct()
    per = queue.where("not processed").join(held, "work_unit_key", "left_anti").groupBy("work_unit_key")
    per = per.agg(F.sum("token_count").alias("tokens"), F.count("*").alias("items"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    out = per.where((F.col("tokens") >= gates.tokens) | (F.col("oldest") <= now - _seconds(gates.max_age_s)) | (F.col("newest") <= now - _seconds(gates.idle_s)))
    return out if limit is None else out.orderBy("oldest", "work_unit_key").limit(limit)


def claim(claims: DataFrame, keys: DataFrame, worker: str, now: Column, ttl_s: int) -> DataFrame:
    """Claims with those keys added that nobody holds; an expired claim blocks until it is swept."""
    free = keys.select("work_unit_key").distinct().join(claims.select("work_unit_key"), "work_unit_key", "left_anti")
    return claims.unionByName(free.select("work_unit_key", F.lit(worker).alias("worker_id"), now.alias("claimed_at"), (now + _seconds(ttl_s)).alias("expires_at")))


def release_claims(claims: DataFrame, keys: DataFrame, worker: str) -> DataFrame:
    own = keys.select("work_unit_key").distinct().withColumn("_r", F.lit(True))
    return claims.join(own, "work_unit_key", "left").where(~(F.coalesce("_r", F.lit(False)) & (F.col("worker_id") == worker))).drop("_r")


def extend_claims(claims: DataFrame, worker: str, now: Column, ttl_s: int) -> DataFrame:
    return claims.withColumn("expires_at", F.when(F.col("worker_id") == worker, now + _seconds(ttl_s)).otherwise(F.col("expires_at")))


def sweep_claims(claims: DataFrame, now: Column) -> DataFrame:
    return claims.where(F.col("expires_at") > now)


def pending_items(queue: DataFrame, key: str, limit: int) -> DataFrame:
    return queue.where((F.col("work_unit_key") == key) & ~F.col("processed")).orderBy("id").limit(limit)


def mark_processed(queue: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_h", F.lit(True))
    return queue.join(hit, "id", "left").withColumn("processed", F.col("processed") | F.coalesce("_h", F.lit(False))).select(*queue.columns)


def record_failure(queue: DataFrame, failed: DataFrame, quarantine_at: int = 5) -> DataFrame:
    """Failures (id, error) counted as attempts; at quarantine_at attempts an item counts as processed and keeps its error.

    An id given several times failed several times; of its errors the last by `at` stays, or the greatest where failed
    has no such column. A null error counts and leaves the error as it was.
    """
    last = F.max_by("error", "at") if "at" in failed.columns else F.max("error")
    per = failed.groupBy("id").agg(F.count("*").alias("_n"), last.alias("_e"))
    n = F.coalesce("_n", F.lit(0))
    attempts = (F.col("attempts") + n).cast(queue.schema["attempts"].dataType)
    out = queue.join(per, "id", "left")
    return out.withColumns({"last_error": F.coalesce("_e", "last_error"), "processed": F.col("processed") | ((n > 0) & (attempts >= quarantine_at)), "attempts": attempts}).select(*queue.columns)


def trim_processed(queue: DataFrame, before: Column) -> DataFrame:
    return queue.where(~F.col("processed") | (F.col("created_at") >= before))


def queue_health(queue: DataFrame, now: Column) -> DataFrame:
    """One row: pending items, age of the oldest in seconds (0 if none) and when it came."""
    p = queue.where("not processed").agg(F.count("*").alias("pending"), F.min("created_at").alias("oldest"))
    return p.select("pending", F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("oldest"), F.lit(0)).alias("oldest_age_s"), "oldest")


def undrained(queue: DataFrame, keys: DataFrame) -> DataFrame:
    """Of the given keys those that still have pending items; none means drained."""
    return keys.select("work_unit_key").distinct().join(queue.where("not processed").select("work_unit_key").distinct(), "work_unit_key", "left_semi")


def fair_order(units: DataFrame) -> DataFrame:
    """Ready units (with workspace_name) dealt in turn over workspaces, oldest first within each."""
    turn = F.row_number().over(Window.partitionBy("workspace_name").orderBy("oldest", "work_unit_key"))
    return units.withColumn("turn", turn).orderBy("turn", "oldest", "work_unit_key")


def taken_turns(units: DataFrame, slots: int) -> DataFrame:
    """The units that a worker with `slots` free slots takes next, in turn over workspaces."""
    return fair_order(units).limit(max(0, slots))


def heartbeat_s(ttl_s: int) -> float:
    """How often a worker extends its claims: three times within their life."""
    return ttl_s / 3


def worker_round(queue: DataFrame, claims: DataFrame, handle: Callable[[DataFrame], DataFrame], worker: str, now: Column, slots: int, ttl_s: int = 300, gates: Gates = Gates(), batch: int = 100, quarantine_at: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of a worker as tables: (queue, claims, outcomes).

    Expired claims are swept, ready units are taken in turn up to `slots` and claimed, and handle gets their first `batch`
    pending items (the queue's columns) and returns (id, error), error null where an item went well. Those count as
    processed; failures count as attempts, at quarantine_at the last; items that handle leaves out stay as they are.
    A unit's items after its first failed one are not marked, since they come in order; claims are released at the end.
    """
    held = sweep_claims(claims, now)
    spaces = queue.select("work_unit_key", "workspace_name").distinct()
    taken = taken_turns(ready_units(queue, held, now, gates).join(spaces, "work_unit_key"), slots).select("work_unit_key")
    held = claim(held, taken, worker, now, ttl_s)
    mine = held.where(F.col("worker_id") == worker).select("work_unit_key").join(taken, "work_unit_key", "left_semi")
    first = Window.partitionBy("work_unit_key").orderBy("id")
    items = queue.where("not processed").join(mine, "work_unit_key", "left_semi").withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= batch).drop("_i")
    outcomes = items.select("id", "work_unit_key").join(handle(items).select("id", "error"), "id")
    broken = F.min(F.when(F.col("error").isNotNull(), F.col("id"))).over(Window.partitionBy("work_unit_key"))
    outcomes = outcomes.withColumn("_stop", broken).where(F.col("_stop").isNull() | (F.col("id") <= F.col("_stop"))).drop("_stop")
    after = record_failure(queue, outcomes.where("error is not null").select("id", "error"), quarantine_at)
    return mark_processed(after, outcomes.where("error is null")), release_claims(held, taken, worker), outcomes


def due_dreams(facts: DataFrame, collections: DataFrame, dreams: DataFrame, now: Column, least_new: int = 50, least_hours: int = 8) -> DataFrame:
    """Pairs with enough new explicit facts since their last dream, long enough ago, and none in flight."""
    n = facts.where(F.col("deleted_at").isNull() & (F.col("level") == "explicit")).groupBy(*PAIR).agg(F.count("*").alias("explicit_count"))
    c = n.join(collections, list(PAIR), "left")
    new = F.col("explicit_count") - F.coalesce("explicit_at_last_dream", F.lit(0))
    rested = F.col("last_dream_at").isNull() | (F.col("last_dream_at") <= now - _seconds(least_hours * 3600))
    return c.where((new >= least_new) & rested).join(dreams.where("status in ('pending', 'running')").select(*PAIR).distinct(), list(PAIR), "left_anti").select(*PAIR, "explicit_count", new.alias("new_facts"))


def start_dreams(dreams: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """One pending dream for each pair that has none in flight."""
    free = pairs.select(*PAIR).distinct().join(dreams.where("status in ('pending', 'running')").select(*PAIR), list(PAIR), "left_anti")
    fresh = free.withColumns({"id": F.substring(F.sha2(F.concat_ws(":", *PAIR, now.cast("string")), 256), 1, 21), "status": F.lit("pending"), "requeues": F.lit(0), "created_at": now, "updated_at": now})
    return dreams.unionByName(fresh, allowMissingColumns=True)


def sweep_dreams(dreams: DataFrame, queue: DataFrame, now: Column, grace_s: int = 900, most: int = 3) -> DataFrame:
    """In-flight dreams past their grace without a pending queue item: requeued up to `most` times, then failed."""
    waiting = queue.where("not processed and task_type = 'dream'").select(F.col("payload").alias("id")).distinct().withColumn("_w", F.lit(True))
    d = dreams.join(waiting, "id", "left")
    lost = F.col("status").isin("pending", "running") & F.col("_w").isNull() & (F.col("updated_at") <= now - _seconds(grace_s))
    again = lost & (F.col("requeues") < most)
    status = F.when(again, "pending").when(lost, "failed").otherwise(F.col("status"))
    return d.withColumns({"status": status, "requeues": F.when(again, F.col("requeues") + 1).otherwise(F.col("requeues")), "updated_at": F.when(lost, now).otherwise(F.col("updated_at"))}).select(*dreams.columns)


def backoff_s(idle_rounds: int, first: float = 1.0, most: float = 30.0) -> float:
    """Wait before the next poll: doubled with each idle round, up to a most."""
    return min(most, first * 2 ** max(0, min(60, idle_rounds)))


def delete_session(session: tuple[str, str], facts: DataFrame, links: DataFrame, entities: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The deletion cascade: (facts, events, links, entities) with the session's facts deleted, unlinked, and orphaned entities gone."""
    from palimpsest.operators.dedup import set_deleted
    from palimpsest.operators.entities import unlink, without_orphans

    ids = facts.where((F.col("workspace_name") == session[0]) & (F.col("session_name") == session[1])).select("workspace_name", "id")
    out, events = set_deleted(facts, ids, now, "api")
    left = unlink(links, ids.withColumnRenamed("id", "conclusion_id"))
    return out, events, left, without_orphans(entities, left)
