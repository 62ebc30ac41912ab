"""Shared pieces of the corpus operators: staged tables, distributed ranks, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but only if
    driver and executors are one process; a cluster's executors would write to disks that the others do not see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return _local_dir[0]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """A table written once to the shared folder, which cuts lineage and survives lost executors.

    Its plan runs once, so the shuffle files of the write go at its end; a lost executor's are made anew before that.
    conf holds for this write alone, options are the writer's.
    """

    def __init__(self, df: DataFrame, conf: dict[str, str] | None = None, **options: str | int):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/stage-{uuid.uuid4().hex}"
        conf = {CLEANUP: "true"} | (conf or {})
        before = {key: self.spark.conf.get(key, None) for key in conf}
        for key, value in conf.items():
            self.spark.conf.set(key, value)
        try:
            df.write.options(**options).parquet(self.path)
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        self.schema = df.schema

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for stages that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Staging:
    """Stages tables within a with-block and deletes them at its end; what the block returns must be staged by itself."""

    def __enter__(self) -> Staging:
        self.stages: list[Stage] = []
        return self

    def __call__(self, df: DataFrame, conf: dict[str, str] | None = None, **options: str | int) -> DataFrame:
        self.stages.append(Stage(df, conf, **options))
        return self.stages[-1].df()

    def keep(self, stage: Stage) -> DataFrame:
        self.stages.append(stage)
        return stage.df()

    def __exit__(self, *_) -> None:
        for s in self.stages:
            s.drop()


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, and all others as one struct named rest, so that no name of theirs can clash with working columns."""
    others = [F.col(f"`{c}`").alias(c) for c in df.columns if c not in keep]
    return df.select(*[F.col(f"`{c}`") for c in keep], (F.struct(*others) if others else F.lit(None).cast("int")).alias("rest"))


def unpacked(columns: list[str], *keep: str) -> list[Column]:
    """What brings a packed frame's columns back, in their order."""
    return [F.col(f"`{c}`") if c in keep else F.col("rest").getField(c).alias(c) for c in columns]


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system, where that can be done."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: For tables of packed rows, which are large: few of them make a batch.
SMALL = {ARROW_ROWS: "200", "spark.sql.parquet.columnarReaderBatchSize": "200"}


def versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, v, text of the rows with an id: v tells apart the texts that share an id (their xxhash64), and is 0 for all others."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    hashed = F.xxhash64("text")
    several = Stage(texts.groupBy("doc").agg(F.min(hashed).alias("lo"), F.max(hashed).alias("hi")).where("lo < hi").select("doc", F.lit(1).alias("_s"))).df()
    if several.isEmpty():
        return texts.select("doc", F.lit(0).cast("long").alias("v"), "text")
    return texts.join(several, "doc", "left").select("doc", F.when(F.col("_s") == 1, hashed).otherwise(F.lit(0)).cast("long").alias("v"), "text")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def distributed_rank(df: DataFrame, part: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the gapless 0-based rank of each row within its part, however large one part is.

    Rows are range-partitioned by (part, order, tie), so a part may span many tasks; each task numbers its own
    runs, and the runs' offsets come from a table of one row per task and part. Nothing sits in one task.
    Parts may be null (they form one part). Equal rows get different ranks.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_part", F.when(part.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), part.cast("string"))))
    keyed = keyed.withColumns({f"_o{i}": c for i, c in enumerate(order)}).withColumn("_tie", F.monotonically_increasing_id())
    keys = ["_part", *[f"_o{i}" for i in range(len(order))], "_tie"]
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.StringType()), T.StructField("_pid", T.IntegerType()), T.StructField(name, T.LongType())])

    def number(batches):
        last, at = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(batch.schema.get_field_index("_part"))
            # runs of one part, found by comparing neighbours; the first may go on from the batch before
            begin = np.concatenate([[0], np.flatnonzero(pc.not_equal(parts.slice(1), parts.slice(0, len(parts) - 1)).to_numpy(zero_copy_only=False)) + 1])
            sizes = np.diff(np.append(begin, len(parts)))
            out = np.arange(len(parts)) - np.repeat(begin, sizes)
            if parts[0].as_py() == last:
                out[: sizes[0]] += at + 1
            last, at = parts[-1].as_py(), int(out[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, name])

    with Staging() as stage:
        base = stage(keyed)  # sampling for the ranges would otherwise compute the input twice
        runs = base.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop(*keys[1:])
        numbered = Stage(runs.withColumn("_pid", F.spark_partition_id()).mapInArrow(number, schema))
    counts = numbered.df().groupBy("_part", "_pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_part").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        numbered.df().join(offsets, ["_part", "_pid"])
        .withColumn(name, F.col(name) + F.col("_off")).drop("_part", "_pid", "_off")
    )


def connected_components(edges: DataFrame, stage: Staging | None = None) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b): component is the smallest node reachable.

    The result reads a staged table, which goes with `stage` if that is given.
    Alternates large-star and small-star steps until no edge changes. A step takes each node's least neighbour, with a
    map-side minimum first, and joins it to the node's edges. Edges and minima are staged before they are joined, so
    that both sides are plain exchanges and a hub's edges can be split over tasks; no list of neighbours is ever built.
    """

    def lowest(d: DataFrame) -> Stage:
        return Stage(d.groupBy("u").agg(F.min("v").alias("m")))

    e = Stage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        # large star: each node's larger neighbours point to the smallest of its closed neighbourhood
        both = e.df().union(e.df().select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both)
        large = Stage(both.where("v > u").join(low.df().select("u", F.least("u", "m").alias("m")), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low.drop()
        # small star: each node's smaller-or-equal neighbours point to its smallest
        low = lowest(large.df())
        small = large.df().join(low.df(), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.df().select("u", F.col("m").alias("v")))
        nxt = Stage(small.where("u <> v").distinct())
        for s in (e, large, low):
            s.drop()
        e = nxt
        row = e.df().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or row[0] == 0:
            break
        mark = tuple(row)
    if stage:
        stage.stages.append(e)
    d = e.df()
    return d.select(F.col("u").alias("node"), F.col("v").alias("component")).union(d.select("v", "v").distinct())
