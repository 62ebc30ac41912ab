import random

import corpus_pipeline
import pytest

import __spark_entry__
from palimpsest.llm import queries
from tests.conftest import SMALL
from tests.llm.conftest import words

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _id string, rest int, copies int"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(15)
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        text = " ".join(rng.choice(["BUY", "NOW", "$$$"]) for _ in range(90)) if bad else "\n".join(words(rng, 15) for _ in range(5))
        rows.append([i, text, "en", rng.choice(["a", "b", "b", None]), len(text), 0.1, "x", i, 9])
        labels.append((i, int(not bad)))
    for k, j in enumerate((1, 7, 13)):
        rows.append([500 + k, *rows[j][1:]])
    near = rows[19][1].split(" ")
    near[30] = "changed"
    rows.append([600, " ".join(near).replace("\n", " "), "en", "a", 1, 0.1, "x", 1, 9])
    rows += [[700, None, None, None, None, None, None, None, None], [701, "", "en", "a", 0, 0.1, "x", 1, 9], [None, rows[8][1] + " unlike", "en", "b", 3, 0.1, "x", 2, 9], rows[2]]
    root = str(tmp_path_factory.mktemp("p"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{root}/labels.parquet")
    return root, rows


def test_stages(spark, made):
    root, rows = made
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    good = stage["quality classifier"](spark, docs, root)
    assert good.columns == docs.columns
    ids = {r.doc_id for r in good.collect()}
    assert not ids & {i for i in range(0, 240, 6)} and {i for i in range(240) if i % 6} <= ids
    assert {r.score for r in good.collect()} <= {0.1, None}
    cut = stage["line dedup"](spark, docs, root)
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and not {500, 501, 502} & set(got) and {1, 7, 13, 600, 700, 701, None} <= set(got)
    assert got[7].text == rows[7][1] and got[7].n_chars == rows[7][4] and got[7]["_id"] == "x"
    one = stage["n-gram Jaccard join"](spark, docs, root)
    got = [r.doc_id for r in one.collect()]
    assert one.columns == docs.columns and not {500, 501, 502, 600} & set(got) and len(got) == len(set(got))
    assert {1, 2, 7, 13, 19, 700, 701, None} <= set(got)
    mix = stage["mixing sources"](spark, docs, root)
    n = {}
    for r in mix.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert mix.columns == docs.columns and max(n.values()) <= 6 and {r.copies for r in mix.collect()} <= {9, None}
    packed = stage["packing"](spark, docs, root)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in rows}


def test_empty_stages(spark, made, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    empty.write.parquet(str(tmp_path / "e.parquet"))
    docs = spark.read.parquet(str(tmp_path / "e.parquet"))
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, made[0]).count() == 0


def test_run(spark, made):
    out = corpus_pipeline.run(spark, made[0])
    rows = out.collect()
    assert {500, 501, 502, 600}.isdisjoint({r.doc_id for r in rows}) and len(rows) > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered(spark):
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_mixing_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = c.sql(queries.SQL["op8_mixing"]).df().sort_values("doc_id")
    got = queries.op8_mixing(spark, SMALL).toPandas().sort_values("doc_id")
    for col in want.columns:
        assert list(want[col]) == list(got[col]), col
