"""Queries do the whole job, with no filter to keep the comparison cheap."""

import numpy as np

from palimpsest.operators import entities
from palimpsest.plans import registry
from tests.conftest import SMALL


def run(spark, name):
    return registry.QUERIES[name](spark, SMALL).toPandas()


def test_search_by_code(spark):
    """At least nine of ten neighbours of the exact search, with the same similarities; and a pair's size decides the way."""
    from pyspark.sql import functions as F

    from palimpsest.operators import recall

    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 48))
    pair = {"workspace_name": F.lit("w"), "observer": F.when(F.col("n") < 200, "few").otherwise("many"), "observed": F.lit("b"), "deleted_at": F.lit(None).cast("timestamp"), "expires_at": F.lit(None).cast("timestamp")}
    facts = spark.createDataFrame([(f"{i}", i, [float(y) for y in v]) for i, v in enumerate(x)], "id string, n int, embedding array<float>").withColumns(pair)
    asked = facts.where("n % 75 in (0, 1)").withColumns({"qid": F.col("n"), "query_vector": F.col("embedding")}).select("qid", "workspace_name", "observer", "observed", "query_vector")
    now = F.expr("timestamp '2026-01-01'")
    got = lambda f, **kw: {(r.qid, r.id): round(r.distance, 9) for r in f(asked, facts, now, 10, **kw).collect()}
    exact, code, mixed = got(recall.semantic), got(recall.semantic_by_code), got(recall.semantic_by_size, exact_below=1000)
    assert len(exact) == len(code) == len(mixed) == 800 and all(exact.get(k, d) == d for k, d in code.items())
    few = {k for k in exact if k[0] < 200}
    assert few <= set(mixed) and set(mixed) - few <= set(code) and len(set(exact) & set(code)) >= 0.9 * len(exact)


def test_every_fact_is_a_root(spark):
    docs = set(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("string(doc_id) as id").toPandas().id)
    chain = run(spark, "reasoning_chain")
    assert set(chain.root) == docs and len(chain) == len(docs) and all((chain[c] != "").any() for c in ("premises", "messages", "unresolved", "dependents"))
    for name in ("premise_walk", "evidence_messages", "unresolved_premises", "dependents"):
        assert len({int(x) % 10 for x in run(spark, name).root}) > 1, name


def test_resolve_in_order(spark):
    """Names of one call see each other, in order; against a fold by brute force."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 8))
    vec = lambda: [float(x) for x in base[rng.integers(4)] + rng.standard_normal(8) * rng.choice([0.05, 0.3])]
    known = [("w", f"k{i}", f"id{i}", vec()) for i in range(3)] + [("w", "k3", "id3", None), ("v", "k0", "idv", vec())]
    names = [(w, f"n{i}", None if i == 5 else vec(), 100 - i) for w in "wv" for i in range(30)] + [("w", "k1", vec(), 50)]
    schema = "workspace_name string, name_norm string, id string, embedding array<double>"
    got = entities.resolve(spark.createDataFrame(names, "workspace_name string, name_norm string, embedding array<double>, position int"), spark.createDataFrame(known, schema)).collect()

    have = [list(x) for x in known]
    want = {}
    fresh = {(r.workspace_name, r.name_norm): r.entity_id for r in got if r.how == "new"}
    for w, name, x, _ in sorted(names, key=lambda r: r[3]):
        same = [i for a, n, i, _ in have if (a, n) == (w, name)]
        sims = [(-float(np.dot(x, e) / np.linalg.norm(x) / np.linalg.norm(e)), i) for a, _, i, e in have if a == w and e is not None] if x is not None else []
        if same:
            want[w, name] = (same[0], "exact")
        elif sims and -min(sims)[0] >= 0.95:
            want[w, name] = (min(sims)[1], "merged")
        else:
            want[w, name] = (fresh.get((w, name)), "new")
            have.append([w, name, fresh.get((w, name)), x])
    assert {(r.workspace_name, r.name_norm): (r.entity_id, r.how) for r in got} == want
    assert sum(how == "merged" and i in fresh.values() for i, how in want.values()) > 5


def test_entity_vectors_are_used(spark):
    got = run(spark, "entity_resolution_vectors")
    assert got.name_norm.is_unique and got.entity_id.notna().all() and set(got.how) >= {"exact", "new"}


def test_every_label_and_key(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality > 0").count()
    p = run(spark, "eval_recall_k")
    ranking, judged = registry._eval(registry.Views(spark, SMALL))
    assert judged.where("rel > 0").groupBy("qid").count().where(f"count <> {labels}").count() == 0 and len(p) > 0
    assert {x[0] for x in run(spark, "undrained_keys").work_unit_key} > {"1"}
    assert {int(x) % 3 for x in run(spark, "semantic_scores").id} == {0, 1, 2}


def test_evaluation_leaves_no_product_to_one_task(spark):
    """Questions go to the vectors and labels: neither is dealt by its one pair, and a question's rows are cut to k where they are."""
    for name in ("eval_recall_k", "eval_unknown_judgements", "eval_ndcg", "eval_mrr", "eval_precision_k"):
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(observer" not in plan and "hashpartitioning(workspace_name" not in plan and "2147483647" not in plan, name


def test_reciprocal_rank_by_distance(spark):
    from palimpsest.operators import evaluate

    d = spark.createDataFrame([(q, i, float(i * (q + 3) % 5)) for q in range(4) for i in range(12)], "qid int, id int, distance double")
    j = spark.createDataFrame([(q, i, int(q < 3 and i % (q + 4) == 3)) for q in range(4) for i in range(0, 14)], "qid int, id int, rel int")
    w = evaluate.Window.partitionBy("qid").orderBy("distance", "id")
    want = evaluate.reciprocal_rank(d.withColumn("rank", evaluate.F.row_number().over(w)), j)
    got = {r.qid: r.rr for r in evaluate.reciprocal_rank_by(d, j).collect()}
    assert got == {r.qid: r.rr for r in want.collect()} and got[3] == 0.0 and len(set(got.values())) > 2


def test_unknown_labels_are_found_before_questions(spark):
    plan = registry.QUERIES["eval_unknown_judgements"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftAnti")
