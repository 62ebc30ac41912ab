"""Mixing sources to target weights by systematic sampling of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Stage, distributed_rank

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """target (double) of each row (source, source_size) of totals.

    Sources in order of code points, null last, weigh as weights says, repeating. They share all sizes by weight; a
    target stops at ceiling times its source's size and the excess is shared anew by weight until none is above. In
    closed form: with sources in order of ceiling / weight, those whose ceiling lies under their share of what the
    earlier ones leave are at their ceiling, and the others share the rest. One row per source is all this sees.
    """
    everything = Window.partitionBy(F.lit(0))
    w = totals.withColumn("_i", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_i") - 1) % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("_cap", F.col("source_size") * ceiling)
    order = everything.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_i"))
    w = w.withColumn("_capped", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("_open", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("_left", F.sum("source_size").over(everything) - F.col("_capped"))
    w = w.withColumn("_at_cap", F.col("_cap") * F.col("_open") <= F.col("_left") * F.col("_w"))
    # in this order the capped ones come first, so the first open row's level is that of all open ones
    level = F.col("_left") / F.col("_open")
    first_open = F.max(F.when(~F.col("_at_cap"), level)).over(everything)
    target = F.when(F.col("_at_cap"), F.col("_cap").cast("double")).otherwise(first_open * F.col("_w"))
    return w.select("source", "source_size", target.alias("target"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), ceiling: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """How often the mix takes each document; one row per row of docs.

    Columns: doc_id, size (words), source, source_size, target (both of its source),
    copies, taken (copies times size), and the columns named in keep as _keep_<name>.
    Every document of a source expects target / source_size copies. With documents in order of size (then id), their
    expectations are summed up within the source, one random offset from 0 to 1 is added, and a document is taken
    once for each integer that its stretch crosses: neighbours in size stand in for each other, so that taken words
    come near the target. The offset is hashed from seed and source, so reruns agree.
    Null text: size 0; null source: a source of its own; sources of size 0: target 0 and no copies; repeated rows are
    documents of their own; an empty table gives no row. The prefix sums of one source span many tasks.
    """
    base = Stage(docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), *[F.col(c).alias(f"_keep_{c}") for c in keep]))
    totals = source_targets(base.df().groupBy("source").agg(F.sum("size").alias("source_size")), weights, ceiling)
    ranked = distributed_rank(base.df(), F.col("source"), [F.col("size"), F.col("doc_id")], "_rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n")))), 1, 8), 16, 10)
    totals = totals.withColumn("_rate", rate).withColumn("_offset", bits.cast("double") / float(1 << 32)).withColumnRenamed("source", "_s")
    joined = ranked.join(totals, F.col("source").eqNullSafe(F.col("_s")))
    crossed = F.floor((F.col("_rank") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset"))
    copies = F.least(crossed, F.lit(ceiling)).cast("long")  # rounding at an integer must not add to the ceiling
    return joined.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_keep_{c}") for c in keep])
