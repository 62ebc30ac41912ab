"""The bounded sample of the quality classifier."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import quality


@pytest.fixture(scope="module")
def labelled(spark):
    good, bad = "clear sentences about useful things. ", "zzxx qqkk 0000 ;;;; "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    first = labels.where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", 2000)).otherwise(F.col("text")))
    return long, labels


def test_a_long_text_in_front_is_passed_over(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, sample_bytes=60_000)
    scored = quality.score_documents(docs.where("length(text) < 5000"), model).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in scored) > 0.95 * len(scored)


def test_nothing_fits(labelled):
    docs, labels = labelled
    with pytest.raises(ValueError, match="sample_bytes=10"):
        quality.fit(docs, labels, sample_bytes=10)


def test_no_labels(spark, labelled):
    docs, labels = labelled
    assert quality.score_documents(docs.limit(3), quality.fit(docs, labels.limit(0))).count() == 3
