"""Plans that must stay as they are: filters and columns reach the scan, nothing is compared across pairs."""

import pytest

from palimpsest.operators import filters
from palimpsest.plans import registry
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("1", "s", 1, "explicit")], "id string, session_name string, times_derived int, level string").write.parquet(str(tmp_path / "f"))
    facts = spark.read.parquet(str(tmp_path / "f"))
    for raw, pushed in (({"level": "explicit"}, "EqualTo(level,explicit)"), ({"times_derived": {"gte": 3}}, "GreaterThanOrEqual(times_derived,3)"), ({"session_name": ["a", "b"]}, "In(session_name, [a,b])")):
        p = plan(facts.where(filters.fact_filter(raw)).select("id"))
        assert pushed in p.replace("\n", " "), p


def test_columns_are_pruned(spark):
    p = plan(registry.QUERIES["live_pair_scan"](spark, SMALL))
    assert "text" not in p.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["recall_fused", "knn_cosine", "bm25_scores", "entity_match", "dedup_exact", "dedup_near", "premise_walk", "fan_out_pairs", "audible_messages", "queue_ready"])
def test_no_cross_join(spark, name):
    p = plan(registry.QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    if name not in ("premise_walk",):
        assert "Python" not in p and "Pandas" not in p
