"""A worker that runs: at every trigger it sweeps, claims, works and records, beside other workers on the same tables."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palimpsest.operators import work
from palimpsest.operators.work import Gates
from palimpsest.sources.segments import Segments, staged

ITEMS = "id bigint, workspace_name string, work_unit_key string, task_type string, payload string, token_count int, created_at timestamp"
OUTCOMES = "id bigint, error string, worker_id string, at timestamp"
CLAIMS = "work_unit_key string, worker_id string, claimed_at timestamp, expires_at timestamp"


class WorkTables:
    """The queue as items and outcomes, which grow by segments, and the claims, which are few and written whole.

    A step reads the committed state and writes one segment; of two workers that do so at once, one finds the number
    taken and does its step again on the new state. So a claim is given once, and an outcome is recorded by the claim's holder only.
    """

    def __init__(self, spark: SparkSession, root: str, quarantine_at: int = 5):
        self.spark, self.root, self.quarantine_at = spark, root, quarantine_at

    def store(self) -> Segments:
        return Segments(self.spark, self.root)  # every step writes into folders of its own

    def add(self, items: DataFrame) -> None:
        def step(s: Segments, seq: int) -> None:
            s.write(items, "items", seq)

        self.change(step)

    def change(self, step: Callable[[Segments, int], object], tries: int = 20):
        """Do step on the present state and commit it, again if another writer was first. A step that returns False writes nothing."""
        for k in range(tries):
            s = self.store()
            seq = s.next()
            done = step(s, seq)
            if done is False:
                return done
            try:
                s.commit(seq)
                return done
            except RuntimeError:
                time.sleep(0.05 * (k + 1))
        raise RuntimeError(f"{tries} attempts to write to {self.root} met other writers")

    def claims(self, s: Segments | None = None) -> DataFrame:
        return (s or self.store()).last("claims", CLAIMS)

    def outcomes(self) -> DataFrame:
        return self.store().read("outcomes", OUTCOMES)

    def queue(self, s: Segments | None = None) -> DataFrame:
        """The queue's columns: an item is processed when it went well, or failed quarantine_at times."""
        s = s or self.store()
        per = s.read("outcomes", OUTCOMES).groupBy("id").agg(F.count("error").alias("_bad"), F.max(F.col("error").isNull()).alias("_ok"), F.max_by("error", "at").alias("last_error"))
        q = s.read("items", ITEMS).drop("seq").join(per, "id", "left").withColumn("attempts", F.coalesce("_bad", F.lit(0)).cast("int"))
        return q.withColumn("processed", F.coalesce("_ok", F.lit(False)) | (F.col("attempts") >= self.quarantine_at)).drop("_bad", "_ok")

    def compact(self) -> None:
        """One segment with the items that are still to be done, their failures, and the claims."""
        s = self.store()
        seq = s.next()
        todo = self.queue(s).where("not processed").select("id")
        for table, schema in (("items", ITEMS), ("outcomes", OUTCOMES)):
            s.write(s.read(table, schema).drop("seq").join(todo, "id", "left_semi"), table, seq)
        s.write(self.claims(s), "claims", seq)
        s.commit(seq, base=True)


@dataclass
class Worker:
    """Slots, lease and pace of one worker. handle gets items and returns (id, error), error null where one went well."""

    tables: WorkTables
    handle: Callable[[DataFrame], DataFrame]
    name: str
    slots: int = 4
    ttl_s: float = 300
    batch: int = 100
    gates: Gates = field(default_factory=Gates)
    clock: Callable[[], datetime] = lambda: datetime.now(UTC)
    first_wait_s: float = 1.0
    most_wait_s: float = 30.0

    def __post_init__(self):
        self.idle, self.not_before, self.failure = 0, self.clock(), None

    def now(self) -> Column:
        return F.timestamp_micros(F.lit(int(self.clock().timestamp() * 1_000_000)))

    def _expiry(self, now: Column) -> Column:
        return now + F.make_interval(secs=F.lit(float(self.ttl_s)))

    def take(self) -> list[str]:
        """Sweep expired claims and claim ready units, in turn over workspaces, up to the free slots: the units taken, at most `slots`."""

        def step(s: Segments, seq: int):
            now = self.now()
            queue, known = self.tables.queue(s), self.tables.claims(s)
            held = work.sweep_claims(known, now)
            free = self.slots - held.where(F.col("worker_id") == self.name).count()
            spaces = queue.select("work_unit_key", "workspace_name").distinct()
            ready = work.taken_turns(work.ready_units(queue, held, now, self.gates).join(spaces, "work_unit_key"), free).select("work_unit_key")
            units = [r.work_unit_key for r in ready.collect()]
            if not units:
                return False
            mine = self.tables.spark.createDataFrame([(u, self.name) for u in units], "work_unit_key string, worker_id string")
            s.write(held.unionByName(mine.withColumns({"claimed_at": now, "expires_at": self._expiry(now)})), "claims", seq)
            return units

        return self.tables.change(step) or []

    def beat(self, units: list[str]) -> None:
        """Extend the claims that this worker still holds."""

        def step(s: Segments, seq: int):
            now = self.now()
            mine = (F.col("worker_id") == self.name) & F.col("work_unit_key").isin(units) & (F.col("expires_at") > now)
            s.write(self.tables.claims(s).withColumn("expires_at", F.when(mine, self._expiry(now)).otherwise(F.col("expires_at"))), "claims", seq)

        self.tables.change(step)

    def items(self, units: list[str]) -> DataFrame:
        first = Window.partitionBy("work_unit_key").orderBy("id")
        q = self.tables.queue().where(~F.col("processed") & F.col("work_unit_key").isin(units))
        return q.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= self.batch).drop("_i")

    def record(self, units: list[str], done: DataFrame) -> int:
        """Write outcomes of units whose claims this worker still holds, and release these: how many outcomes count.

        What another worker has taken meanwhile is dropped, as that one does it again. A unit's items after its first failed one do not count,
        since they come in order.
        """
        done = staged(done.select("id", "work_unit_key", "error"))

        def step(s: Segments, seq: int) -> int:
            now = self.now()
            own = (F.col("worker_id") == self.name) & F.col("work_unit_key").isin(units)
            held = self.tables.claims(s).where(own & (F.col("expires_at") > now)).select("work_unit_key")
            broken = F.min(F.when(F.col("error").isNotNull(), F.col("id"))).over(Window.partitionBy("work_unit_key"))
            kept = done.join(held, "work_unit_key", "left_semi").withColumn("_stop", broken).where("_stop is null or id <= _stop")
            s.write(kept.select("id", "error", F.lit(self.name).alias("worker_id"), now.alias("at")), "outcomes", seq)
            s.write(self.tables.claims(s).where(~own), "claims", seq)
            return s.spark.read.schema(OUTCOMES).parquet(s.path("outcomes", seq)).count()

        return self.tables.change(step)

    def round(self) -> int:
        """One trigger: what is due is claimed, handled under a heartbeat of a third of the lease, and recorded. Rounds without work are followed by longer and longer waits."""
        if self.clock() < self.not_before:
            return 0
        units = self.take()
        if not units:
            wait = work.backoff_s(self.idle, self.first_wait_s, self.most_wait_s)
            self.idle, self.not_before = self.idle + 1, datetime.fromtimestamp(self.clock().timestamp() + wait, UTC)
            return 0
        self.idle = 0
        stop = threading.Event()

        def heartbeat() -> None:
            while not stop.wait(work.heartbeat_s(self.ttl_s)):
                self.beat(units)

        beats = threading.Thread(target=heartbeat, daemon=True)
        beats.start()
        try:
            items = self.items(units)
            done = staged(items.select("id", "work_unit_key").join(self.handle(items).select("id", "error"), "id"))
        finally:
            stop.set()
            beats.join()
        return self.record(units, done)

    def start(self, checkpoint: str, every: str = "1 second") -> StreamingQuery:
        """The running worker: a query whose ticks are rounds. A round that fails leaves its claims to expire, and the query goes on."""
        ticks = self.tables.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def tick(_: DataFrame, epoch: int) -> None:
            try:
                self.round()
            except Exception as e:  # noqa: BLE001 - the items stay where they are; the next holder of the claim tries again
                self.failure = e

        return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
