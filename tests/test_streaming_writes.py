"""Streamed writes give what the batch form gives, over micro-batches and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import dedup
from palimpsest.streaming import ingest, writes
from tests.test_engine import NOW, facts


def made(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9)]
    rows = []
    for i in range(120):
        content = " ".join(rng.choices(words, k=rng.randrange(2, 6)))
        vector = None if i % 17 == 0 else [0.0] * 4 if i % 19 == 0 else [rng.choice([0.0, 1.0, 1.1]) for _ in range(4)]
        rows.append((f"f{i:03}", rng.choice([content, content.upper()]), vector))
    base = facts(spark, [(i, c, "deductive", None, 1, 1) for i, c, _ in rows]).drop("embedding")
    df = base.join(spark.createDataFrame([(i, v) for i, _, v in rows], "id string, embedding array<float>"), "id")
    df = df.withColumns({"observer": F.when(F.col("id").endswith("3"), "other").otherwise(F.col("observer")), "position": F.substring("id", 2, 3).cast("int")})
    return df


@pytest.mark.parametrize("most", [0.05, 0.3])
def test_replay_equals_the_batch(spark, tmp_path, most):
    writes.use_rocksdb(spark)
    made(spark).write.parquet(str(tmp_path / "all"))
    rows = lambda: spark.read.parquet(str(tmp_path / "all"))
    old, new = rows().where("position < 40"), rows().where("position >= 40").withColumn("draft_id", F.col("id"))
    want, changed = dedup.upsert_in_order(new, old, F.expr(NOW), most)
    want = sorted((r.draft_id, r.kind, r.stage, r.id, r.replaced_id, r.similarity) for r in want.collect())
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = new.schema

    def feed(part):
        new.where(part).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        s = writes.stream_writes(stream, old, F.expr(NOW), most)
        ingest.run_batches(s, lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/{epoch}"), str(tmp_path / "c")).awaitTermination()

    feed("position < 60")
    run()
    feed("position >= 60 and position < 95")  # started again: the state comes from the store
    run()
    feed("position >= 95")
    run()
    got = spark.read.parquet(f"{out}/*")
    assert sorted((r.draft_id, r.kind, r.stage, r.id, r.replaced_id, r.similarity) for r in got.collect()) == want
    assert {w[1] for w in want} == {"INSERTED", "REINFORCED", "REPLACED"}
    # the last outcome of a fact tells its row as the batch leaves it
    last = {}
    for r in got.orderBy("draft_id").collect():
        last[r.id] = (r.times_derived, r.content)
    after = {r.id: (r.times_derived, r.content) for r in changed.where("changed in ('insert', 'update')").collect()}
    gone = {r.id for r in changed.where("changed = 'delete'").collect()}
    assert {k: v for k, v in last.items() if k not in gone} == after
