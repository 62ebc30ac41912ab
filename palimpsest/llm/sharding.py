"""Weighted rendezvous hashing of stable record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import distributed_rank


def rendezvous_shard(key: Column, weights: Sequence[float], seed: str = "") -> Column:
    """The shard (0-based int) of a key: the one with the largest -weight / ln(u), u hashed from (key, shard).

    Only the key, the shard's number and its weight decide, so that adding a shard moves rows only into it, removing
    one moves only its own rows, and a larger weight attracts rows only to its shard. u has 52 random bits and lies
    strictly within 0 and 1; ties go to the larger shard number. A null key is a key of its own.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))
    scores = []
    for j, w in enumerate(weights):
        if w > 0:
            bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{j}|"), text)), 1, 13), 16, 10).cast("double")
            scores.append(F.struct((F.lit(-float(w)) / F.log((bits + 0.5) / float(1 << 52))).alias("s"), F.lit(j).alias("j")))
    return F.array_max(F.array(*scores))["j"]


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of every row by its id, and its place in the shard.

    Columns: doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (of the UTF-8 bytes, null as
    empty), law ('key'), shard, slot (0-based rank in the shard by doc_id, size and crc, gapless), grown_shard (the
    shard if one more of mean weight is added). Rows with equal ids share a shard; repeated rows get a slot each; null
    ids form one key; an empty table gives no row; other columns are not read. The text is reduced to size and
    checksum in the scan; the slots come from a range partition in which one shard spans many tasks.
    """
    grown = [*weights, sum(weights) / len(weights)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous_shard(F.col(id_col), weights).alias("shard"), rendezvous_shard(F.col(id_col), grown).alias("grown_shard"),
    )
    return distributed_rank(small, F.col("shard"), [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot")
