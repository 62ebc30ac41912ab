"""Workers on shared tables: leases, heartbeats, fencing, quarantine and back-off, and the running query."""

import time
from collections import Counter
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.operators.work import Gates
from palimpsest.streaming.worker import ITEMS, Worker, WorkTables

START = datetime(2026, 1, 1, 12, tzinfo=UTC)
NOTHING_WAITS = Gates(tokens=1)


class Clock:
    def __init__(self):
        self.at = START

    def __call__(self):
        return self.at

    def forward(self, seconds):
        self.at += timedelta(seconds=seconds)


def queue(spark, units, each=2):
    rows = [(10 * u + i, f"w{u % 2}", f"u{u}", "representation", "p", 600, START.replace(tzinfo=None) - timedelta(hours=1)) for u in range(units) for i in range(each)]
    return spark.createDataFrame(rows, ITEMS)


def well(items):
    return items.select("id", F.lit(None).cast("string").alias("error"))


def test_an_expired_lease_is_taken_by_another_and_work_is_recorded_once(spark, tmp_path):
    t, clock = WorkTables(spark, str(tmp_path / "q")), Clock()
    t.add(queue(spark, 4))
    a = Worker(t, well, "a", slots=2, ttl_s=60, gates=NOTHING_WAITS, clock=clock)
    b = Worker(t, well, "b", slots=4, ttl_s=60, gates=NOTHING_WAITS, clock=clock)
    taken = a.take()
    assert len(taken) == 2 and a.take() == []  # its slots are full
    late = a.items(taken).select("id", "work_unit_key", F.lit(None).cast("string").alias("error"))
    assert b.round() == 4 and b.round() == 0  # the two units that are free
    assert b.idle == 1 and b.round() == 0 and b.idle == 1  # it waits before it looks again
    clock.forward(61)
    assert b.round() == 4  # swept and taken over
    assert a.record(taken, late) == 0  # too late
    done = t.outcomes().collect()
    assert Counter(r.id for r in done) == {10 * u + i: 1 for u in range(4) for i in range(2)} and {r.worker_id for r in done} == {"b"}
    assert t.queue().where("not processed").count() == 0 and t.claims().count() == 0


def test_heartbeat_keeps_a_lease_over_long_work(spark, tmp_path):
    t, clock = WorkTables(spark, str(tmp_path / "q")), Clock()
    t.add(queue(spark, 1))
    b = Worker(t, well, "b", ttl_s=60, gates=NOTHING_WAITS, clock=clock)

    def slow(items):
        for _ in range(3):
            clock.forward(50)
            a.beat(["u0"])  # what its heartbeat thread does every ttl / 3
            assert b.take() == []
        return well(items)

    a = Worker(t, slow, "a", ttl_s=60, gates=NOTHING_WAITS, clock=clock)
    assert a.round() == 2 and {r.worker_id for r in t.outcomes().collect()} == {"a"}


def test_failures_stop_a_unit_and_are_quarantined(spark, tmp_path):
    t, clock = WorkTables(spark, str(tmp_path / "q"), quarantine_at=2), Clock()
    t.add(queue(spark, 1, each=3))
    w = Worker(t, lambda items: items.select("id", F.when(F.col("id") == 1, "broken").alias("error")), "a", gates=NOTHING_WAITS, clock=clock)
    assert w.round() == 2  # 0 went well, 1 failed, 2 comes after it
    assert {(r.id, r.processed, r.attempts, r.last_error) for r in t.queue().collect()} == {(0, True, 0, None), (1, False, 1, "broken"), (2, False, 0, None)}
    t.compact()
    assert {r.id for r in t.queue().collect()} == {1, 2} and t.queue().where("attempts = 1").count() == 1
    assert w.round() == 1
    assert {(r.id, r.processed, r.attempts) for r in t.queue().collect()} == {(1, True, 2), (2, False, 0)}
    assert w.round() == 1 and t.queue().where("not processed").count() == 0


def test_running_workers(spark, tmp_path):
    t = WorkTables(spark, str(tmp_path / "q"))
    t.add(queue(spark, 5))
    dead = Worker(t, well, "dead", slots=1, ttl_s=8, gates=NOTHING_WAITS)
    assert len(dead.take()) == 1  # and is not heard of again
    workers = [Worker(t, well, n, slots=2, ttl_s=60, gates=NOTHING_WAITS, first_wait_s=0.2, most_wait_s=1) for n in "ab"]
    running = [w.start(str(tmp_path / w.name)) for w in workers]
    try:
        for _ in range(120):
            if t.queue().where("not processed").isEmpty():
                break
            time.sleep(1)
        failures = [w.failure for w in workers]  # stopping ends a round in the middle
    finally:
        for q in running:
            q.stop()
    done = t.outcomes().collect()
    assert Counter(r.id for r in done) == {10 * u + i: 1 for u in range(5) for i in range(2)}
    assert {r.worker_id for r in done} <= {"a", "b"}
    assert failures == [None, None]
