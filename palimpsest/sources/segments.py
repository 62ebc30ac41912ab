"""Working tables in the folder that driver and executors share, and tables that grow by committed segments."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return _local[0]


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written once and read again: its lineage ends there, and a lost executor takes nothing with it."""
    path = path or new_folder(df.sparkSession, "staged")
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_together(*plans: Callable[[], DataFrame]) -> list[DataFrame]:
    """Tables that do not depend on each other, each made and staged in a thread of its own, so that the jobs share the executors."""
    with ThreadPoolExecutor(len(plans)) as pool:
        return [made.result() for made in [pool.submit(lambda p=p: staged(p())) for p in plans]]


class Segments:
    """Tables under one folder that grow by numbered segments, each visible, whole, once it is committed.

    A writer takes the next number, writes its part of every table into a folder of its own, locks the number by a file
    that must not be there yet, and then makes a file whose name tells the folder: of two writers with one number
    the second fails, and nothing that it wrote is read. A base segment stands for all before it. Readers list the
    committed segments only; `seq` is a column of what they read. Segments are few: a base puts them together.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.token = spark, root.rstrip("/"), uuid.uuid4().hex

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self) -> list[list[str]]:
        fs, p = self._at("commits")
        return [s.getPath().getName().split(".") for s in fs.listStatus(p)] if fs.exists(p) else []

    def commits(self) -> list[tuple[int, str]]:
        """(number, folder) of the segments that count, in order."""
        done = sorted((int(n[0]), n[1], n[2]) for n in self._names() if len(n) == 3)
        base = max((k for k, _, kind in done if kind == "base"), default=0)
        return [(k, folder) for k, folder, _ in done if k >= base]

    def next(self) -> int:
        return max((int(n[0]) for n in self._names() if n[0].isdigit()), default=0) + 1

    def path(self, table: str, seq: int) -> str:
        return f"{self.root}/{table}/{seq}-{self.token}"

    def write(self, df: DataFrame, table: str, seq: int, by: list[str] | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(self.path(table, seq))

    def commit(self, seq: int, base: bool = False) -> None:
        fs, lock = self._at(f"commits/{seq}.lock")
        if not fs.createNewFile(lock):
            raise RuntimeError(f"segment {seq} has been taken by another writer; read again and repeat the write")
        fs.createNewFile(self._at(f"commits/{seq}.{seq}-{self.token}.{'base' if base else 'more'}")[1])

    def read(self, table: str, schema: str) -> DataFrame:
        """All committed rows, with seq."""
        out = None
        for seq, folder in self.commits():
            fs, p = self._at(f"{table}/{folder}")
            if fs.exists(p):
                part = self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{folder}").withColumn("seq", F.lit(seq))
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema).withColumn("seq", F.lit(0)) if out is None else out

    def holds(self, table: str) -> bool:
        """Whether a segment that counts has the table."""
        return any(fs.exists(p) for fs, p in (self._at(f"{table}/{folder}") for _, folder in self.commits()))

    def last(self, table: str, schema: str) -> DataFrame:
        """What the last committed segment that holds the table has of it: for tables that are written whole."""
        for _, folder in reversed(self.commits()):
            fs, p = self._at(f"{table}/{folder}")
            if fs.exists(p):
                return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{folder}")
        return self.spark.createDataFrame([], schema)
