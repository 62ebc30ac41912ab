import pytest


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """Write rows as a table, so that queries run on scans as they do in use."""

    def to(rows, schema, n=3):
        p = str(tmp_path_factory.mktemp("t") / "x.parquet")
        spark.createDataFrame(rows, schema).repartition(n).write.parquet(p)
        return spark.read.parquet(p)

    return to


DOC = "doc_id bigint, text string"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
