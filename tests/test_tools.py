import datetime as dt

from palimpsest.functions import text, tokens, vectors
from palimpsest.operators import dedup, tools
from pyspark.sql import functions as F
from tests.test_engine import NOW, facts


def test_tools(spark):
    f = facts(spark, [("a", "alice likes green tea", "explicit", "s", 2, 5), ("b", "alice likes hot drinks", "deductive", None, 1, 100)]).drop("source_ids", "message_ids")
    f = f.withColumns({"source_ids": F.when(F.col("id") == "b", F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")), "message_ids": F.array(F.lit(1).cast("long"))})
    at = dt.datetime(2026, 8, 1)
    m = spark.createDataFrame([(1, "w", "s", "bob", "I saw 100% tea", at), (2, "w", "s", "bob", "unheard tea", at - dt.timedelta(days=9))], "id bigint, workspace_name string, session_name string, peer_name string, content string, created_at timestamp")
    w = spark.createDataFrame([("w", "s", "alice", dt.datetime(2026, 7, 30), None)], "workspace_name string, session_name string, peer_name string, joined_at timestamp, left_at timestamp")
    e = spark.createDataFrame([("e", "w", "tea", "Tea")], "id string, workspace_name string, name_norm string, name_display string").withColumn("embedding", vectors.embed_text(F.col("name_norm"), 1536, text.tokens_simple))
    links = spark.createDataFrame([("w", "alice", "alice", "e", "a", at)], "workspace_name string, observer string, observed string, entity_id string, conclusion_id string, created_at timestamp")
    embed = lambda c: vectors.embed_text(c, 1536, text.tokens_simple)
    t = tools.Memory(("w", "alice", "alice"), f, m, w, e, links, dt.datetime(2026, 8, 31, 12, tzinfo=dt.UTC), embed).tools()
    assert len(t) == 7
    assert t["recall"]({"query": "green tea"}).startswith("[a] alice likes green tea (derived 2x, explicit)")
    assert t["search_temporal"]({"query": "likes", "from": "2026-08-01"}) == "[a] alice likes green tea (derived 2x, explicit)"
    assert t["grep_messages"]({"text": "100%"}) == t["search_messages"]({"query": "tea"}) == t["messages_by_date"]({"from": "2026-07-01", "to": "soon"}) == "2026-08-01 00:00:00 bob: I saw 100% tea"
    assert "supports: b" in t["reasoning_chain"]({"conclusion_id": "a"}) and t["reasoning_chain"]({}) == "(no such conclusion)"
    assert t["entity_provenance"]({"entity": " TEA "}) == "[a] alice likes green tea" and t["entity_provenance"]({}) == "(no such entity)"
    outcomes, _, events = dedup.inject("Alice likes GREEN tea ", ("w", "alice", "alice"), "s", f, F.expr(NOW), embed, text.tokens_simple)
    assert [(r.kind, r.stage, r.id) for r in outcomes.collect()] == [("REINFORCED", 1, "a")] and events.first().actor == "api"


class Words:
    encode = staticmethod(str.split)
    decode = staticmethod(" ".join)


def test_tokens(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    rows = df.select(tokens.token_count(F.col("t"), Words, "w").alias("n"), tokens.truncate_tokens(F.col("t"), 2, Words, "w").alias("c")).collect()
    assert [(r.n, r.c) for r in rows] == [(3, "a b"), (0, None), (0, "")]


def test_entities_and_cascade(spark):
    from palimpsest.operators import entities, work

    e = spark.createDataFrame([("e1", "w", "tea", None), ("e2", "w", "cup", [1.0] * 8)], "id string, workspace_name string, name_norm string, embedding array<float>").withColumn("created_at", F.expr(NOW))
    assert [r.id for r in entities.missing_vectors(e, 5).collect()] == ["e1"]
    filled = {r.id: r.embedding for r in entities.with_vectors(e, lambda c: vectors.embed_text(c, 8)).collect()}
    assert filled["e2"] == [1.0] * 8 and len(filled["e1"]) == 8
    f = facts(spark, [("a", "x", "explicit", "s", 1, 1), ("b", "y", "explicit", "t", 1, 1)])
    links = spark.createDataFrame([("w", "e1", "a"), ("w", "e2", "b")], "workspace_name string, entity_id string, conclusion_id string")
    out, events, left, kept = work.delete_session(("w", "s"), f, links, e, F.expr(NOW))
    assert {r.id: r.deleted_at is not None for r in out.collect()} == {"a": True, "b": False}
    assert [r.conclusion_id for r in events.collect()] == ["a"] and [r.entity_id for r in left.collect()] == ["e2"] and [r.id for r in kept.collect()] == ["e2"]
    assert entities.add_links(links, links).count() == 2 and [r.conclusion_id for r in entities.linked_conclusions(links.withColumn("created_at", F.expr(NOW)), "e1").collect()] == ["a"]
