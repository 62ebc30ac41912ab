"""From raw documents to packed training sequences, in five stages of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import linededup, mixing, ngramjoin, packing, quality
from palimpsest.llm.common import Stage, distributed_rank, packed, unpacked


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, trained on the labelled ones among them, does not reject (score >= 0.3).

    Null and empty texts score as one empty chunk and go or stay as that does; repeated rows and null ids are scored like
    all others; without labels the network is untrained; an empty table stays empty.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(packed(docs, "text"), model).where("predicted = 1").select(*unpacked(docs.columns, "text"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines aligned with earlier documents; those of which nothing is left go. n_chars follows the text.

    Null and empty texts lose nothing and stay, as do rows without an id; rows of one doc_id take nothing from each other.
    """
    cut = linededup.dedup_lines(packed(docs, "doc_id", "text"))
    cut = cut.where("n_removed = 0 or trim(text) <> ''")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars")).alias("n_chars")
    return cut.select(*[chars if name == "n_chars" else c for name, c in zip(docs.columns, unpacked(docs.columns, "doc_id", "text"))])


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Rows of one doc_id with different texts are judged each by its own (the text of least hash stays); of equal rows
    one stays. Rows without an id, and rows without words, all stay; an empty table stays empty.
    """
    kept = ngramjoin.similar_documents(docs).where("keeper and n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_v")).distinct()
    rows = packed(docs, "doc_id", "text").withColumn("_v", F.xxhash64("text"))
    wordless = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    one = rows.where(~wordless).dropDuplicates(["doc_id", "_v"])  # equal rows meet in part before they are shuffled
    one = one.join(kept.withColumnRenamed("_v", "_w"), (F.col("doc_id") == F.col("_id")) & (F.col("_v") == F.col("_w"))).drop("_id", "_w")
    return one.union(rows.where(wordless)).select(*unpacked(docs.columns, "doc_id", "text"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, and no longer if that is never.

    Rows with one id and one text (null ids and null texts too) share their copies as evenly as can be; other rows are
    counted by themselves. Sources may be null; an empty table stays empty.
    """
    rows = packed(docs, "doc_id", "text").withColumn("_v", F.xxhash64("text"))
    taken = mixing.mix_documents(rows.select("doc_id", "text", "_v", F.col("rest.source").alias("source")), keep=["_v"])
    taken = Stage(taken.groupBy(F.col("doc_id").alias("_id"), F.col("_keep__v").alias("_w")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")).df()

    def with_copies(t: DataFrame) -> DataFrame:
        return rows.join(t, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_v") == F.col("_w")))

    joined = with_copies(taken.where("_rows = 1")).withColumn("_i", F.lit(1).cast("long"))
    more = taken.where("_rows > 1")
    if not more.isEmpty():  # rows that repeat are numbered in ranges, so that no group of them sits in one task
        same = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_v"))
        joined = joined.union(distributed_rank(with_copies(more), same, [], "_i").withColumn("_i", F.col("_i") + 1))
    share = F.floor(F.col("_copies") * F.col("_i") / F.col("_rows")) - F.floor(F.col("_copies") * (F.col("_i") - 1) / F.col("_rows"))
    out = joined.withColumn("_n", share.cast("int")).where("_n > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*unpacked(docs.columns, "doc_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, placed in sequences of at most 1024. Null and empty texts are their end id; repeated
    rows (the mix makes them) are packed once each. The pre-token cache is smaller than the operator's own, since the
    stages before have left their traces in the executors' memory."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=300_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: A network, a patience diff and a vocabulary's merges are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        after = Stage(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before, docs = after, after.df()
    return docs
