"""The model's tables as Parquet: written by workspace, read with their schema, checked on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schemas import schema, violations


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its declared schema; reads of one workspace prune to its folder, and of a few columns to these."""
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}")


def save(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write a table. Facts, messages and links are laid out by workspace and clustered by pair or session within files."""
    want = schema(name)
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want])
    cluster = [c for c in ("observer", "observed", "session_name") if c in out.columns]
    if "workspace_name" in out.columns:
        if cluster:
            out = out.repartitionByRange("workspace_name", *cluster).sortWithinPartitions("workspace_name", *cluster)
        out.write.mode(mode).partitionBy("workspace_name").parquet(f"{root}/{name}")
    else:
        out.write.mode(mode).parquet(f"{root}/{name}")


def check_facts(facts: DataFrame, dims: int | None = None) -> None:
    """Raise if any row breaks the model's rules; the message holds the first few."""
    bad = violations(facts, dims).limit(5).collect()
    if bad:
        raise ValueError("facts break the model: " + ", ".join(f"{r.id}: {r.problem}" for r in bad))


def check_width(facts: DataFrame, dims: int) -> None:
    """Fail when stored vectors don't have the embedder's width."""
    other = facts.where(F.col("embedding").isNotNull() & (F.size("embedding") != dims)).select(F.size("embedding").alias("n")).first()
    if other:
        raise ValueError(f"stored vectors have {other.n} components, the embedder {dims}")
