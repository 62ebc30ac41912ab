"""Evaluation sets and golden results in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SET = (
    "name string, note string, corpus array<struct<id: string, content: string, level: string, entities: array<string>, timesDerived: int, daysAgo: int,"
    " sourceIds: array<string>, confidence: double>>, queries array<struct<id: string, query: string, judgements: map<string, int>>>"
)
GOLDEN = (
    "analyzed_query string, candidates_considered int, hits array<struct<content: string, level: string, times_derived: int, sem: double, kw: double,"
    " ent: double, reinf: double, rec: double, lvl: double, score: double, matched_entities: array<string>>>"
)


def read_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, judgements), with the defaults of missing fields filled in, and the places of documents and queries in the file."""
    raw = spark.read.schema(SET).json(path, multiLine=True)
    c = raw.select(F.posexplode("corpus").alias("position", "c")).select("position", "c.*")
    corpus = c.select(
        "position", "id", "content", F.coalesce("level", F.lit("explicit")).alias("level"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("timesDerived", F.lit(1)).alias("times_derived"),
        F.coalesce("daysAgo", F.lit(0)).alias("days_ago"), F.coalesce("sourceIds", F.array().cast("array<string>")).alias("source_ids"), "confidence",
    )
    q = raw.select(F.posexplode("queries").alias("position", "q"))
    queries = q.select("position", F.col("q.id").alias("qid"), F.col("q.query").alias("query"))
    judgements = q.select(F.col("q.id").alias("qid"), F.explode("q.judgements").alias("id", "rel"))
    return corpus, queries, judgements


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """One row a hit, with its position."""
    raw = spark.read.schema(GOLDEN).json(path, multiLine=True)
    return raw.select("analyzed_query", "candidates_considered", F.posexplode("hits").alias("position", "h")).select("analyzed_query", "candidates_considered", "position", "h.*")
