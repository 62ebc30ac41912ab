"""Formulas, null rules and branches that the query comparison does not reach."""

import datetime as dt
import hashlib
import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import guards, signals, text, vectors
from palimpsest.operators import dedup, evaluate, filters, model, provenance, recall, search, sessions, tables, work
from palimpsest.settings import FusionWeights, RecallSettings, page_size, result_limit, token_budget, tool_limit, workspace_settings
from palimpsest.sources import evalset, providers
from palimpsest.sources import tables as store
from palimpsest.streaming import ingest

NOW = "timestamp '2026-08-31 12:00:00'"
NOW_AT = dt.datetime(2026, 8, 31, 12)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def facts(spark, rows):
    """Rows (id, content, level, session, times_derived, days_old) of one pair."""
    df = spark.createDataFrame(rows, "id string, content string, level string, session_name string, times_derived int, days int")
    df = df.withColumns({"workspace_name": F.lit("w"), "observer": F.lit("alice"), "observed": F.lit("alice"), "last_reinforced_at": F.expr(f"{NOW} - make_interval(0, 0, 0, days)"), "deleted_at": F.lit(None).cast("timestamp"), "expires_at": F.lit(None).cast("timestamp"), "source_ids": F.array().cast("array<string>"), "message_ids": F.array().cast("array<bigint>"), "sync_state": F.lit("synced")})
    df = df.withColumn("created_at", F.col("last_reinforced_at")).withColumn("content_analyzed", text.analyzed(F.col("content"), text.tokens_simple))
    return dedup.with_derived(df).withColumn("embedding", vectors.embed_text(F.col("content"), 1536, text.tokens_simple))


GOLDEN = {  # fixed values: sem, kw, ent, reinf, rec, lvl, score
    "a": (0.5, 0.092241, 0.7064, 0.641803, 0.962224, 1.0, 0.481581),
    "b": (0.25, 0.044931, 0.7064, 0.409384, 0.462937, 1.0, 0.302614),
    "c": (0.0, 0.0, 0.0, 0.719491, 0.996157, 1.0, 0.127367),
    "d": (0.0, 0.0, 0.0, 0.523495, 0.890899, 0.8, 0.102425),
}


def test_golden_recall(spark):
    f = facts(spark, [
        ("a", "alice works at a bank in seoul gangnam", "explicit", "s1", 5, 10), ("b", "alice enjoys hiking in the mountains near seoul", "explicit", "s1", 1, 200),
        ("c", "alice drinks coffee every morning", "explicit", "s1", 12, 1), ("d", "alice prefers routine over spontaneity", "inductive", None, 2, 30),
    ])
    pair = {"workspace_name": F.lit("w"), "observer": F.lit("alice"), "observed": F.lit("alice")}
    q = spark.range(1).select(F.lit(1).alias("qid"), F.lit("seoul bank").alias("t")).withColumns(pair)
    q = q.withColumns({"query_tokens": text.tokens_simple(F.col("t")), "query_vector": vectors.embed_text(F.col("t"), 1536, text.tokens_simple)})
    e = spark.range(1).select(F.lit("e").alias("id"), F.lit("w").alias("workspace_name"), F.lit("seoul").alias("name_norm")).withColumn("embedding", vectors.embed_text(F.col("name_norm"), 1536, text.tokens_simple))
    links = spark.createDataFrame([("e", "a"), ("e", "b")], "entity_id string, conclusion_id string").withColumns(pair)
    got = {r.id: r for r in recall.recall(q, f, e, links, F.expr(NOW)).collect()}
    for k, want in GOLDEN.items():
        r = got[k]
        assert [round(x, 6) for x in (r.sem, r.kw, r.ent, r.reinf, r.rec, r.lvl, r.score)] == list(want)
    assert [r.id for r in sorted(got.values(), key=lambda r: r["rank"])] == ["a", "b", "c", "d"]
    assert got["a"].matched_entities == ["seoul"] and got["a"].candidates_considered == 4
    other = q.withColumn("observer", F.lit("bot"))
    assert recall.recall(other, f, e, links, F.expr(NOW)).count() == 0


def test_signals(spark):
    weights = FusionWeights()
    r = one(
        spark, signals.fused(weights, F.lit(1.0), F.lit(0.0), F.lit(0.0), signals.reinforcement(F.lit(1)), F.lit(1.0), F.lit(1.0)).alias("fused"),
        *[signals.keyword_curve(F.lit(m), F.lit(n)).alias(f"k{n}") for n, m in ((2, 5.0), (5, 7.0), (8, 9.0), (12, 10.0), (30, 12.0))], signals.keyword_curve(F.lit(0.0), F.lit(2)).alias("none"),
        *[signals.recency(F.expr(f"{NOW} - interval {d} day"), F.expr(NOW), 180.0).alias(f"r{d}") for d in (0, 180, 360)], signals.recency(F.lit(None).cast("timestamp"), F.expr(NOW), 180.0).alias("rn"),
        signals.recency(F.expr(f"{NOW} - interval 9 day"), F.expr(NOW), 0).alias("r0h"), signals.count_weight(F.lit(1)).alias("c1"), signals.count_weight(F.lit(11)).alias("c11"), signals.count_weight(F.lit(501)).alias("c501"),
    )
    assert abs(r.fused - 0.6027507112680288) < 1e-12
    assert [r[f"k{n}"] for n in (2, 5, 8, 12, 30)] == [0.5] * 5 and r.none == 0
    assert (r.r0, r.r180, r.r360, r.rn, r.r0h) == (1.0, 0.5, 0.25, 1.0, 1.0)
    assert r.c1 == 1 and abs(r.c11 - 1 / 1.1) < 1e-12 and r.c501 < 0.005


def test_settings():
    with pytest.raises(ValueError):
        FusionWeights(semantic=0.6)
    with pytest.raises(ValueError):
        workspace_settings({"oversample": 0}, strict=True)
    assert workspace_settings({"oversample": 0, "threshold": 0.5}) == RecallSettings(threshold=0.5)
    assert (page_size(0), page_size(999), result_limit(-1), token_budget(10**9), tool_limit(0), tool_limit(99)) == (50, 200, 10, 128000, 1, 50)
    assert RecallSettings().candidates(100) == 400 and RecallSettings(oversample=50).candidates(100) == 1000


def test_filter_nulls(spark):
    df = spark.createDataFrame([("1", "a", 1), ("2", None, 2), ("3", "b", None)], "id string, session_name string, times_derived int")
    ids = lambda raw: sorted(r.id for r in df.where(filters.fact_filter(raw)).collect())
    assert ids({"session_name": {"ne": "a"}}) == ["2", "3"]
    assert ids({"session_name": {"nin": ["a"]}}) == ["2", "3"]
    assert ids({"NOT": {"session_name": "a"}}) == ["3"]
    assert ids({"session_name": None}) == ["2"] and ids({"session_name": {"ne": None}}) == ["1", "3"]
    assert ids({}) == ids(None) == ["1", "2", "3"]
    assert ids({"session_name": []}) == []
    assert ids({"times_derived": {"gte": "1", "lt": 2.9}}) == ["1"]  # 2.9 becomes 2


@pytest.mark.parametrize("raw", [{"nope": 1}, {"AND": []}, {"OR": {}}, {"NOT": []}, {"id": {}}, {"id": {"like": "x"}}, {"session_name": {"in": []}}, {"session_name": {"exists": 1}}, {"times_derived": {"gt": None}}, {"times_derived": "x"}, {"times_derived": {"contains": "1"}}, {"created_at": "yesterday"}, {"session_name": {"eq": [1]}}])
def test_filter_errors(spark, raw):
    with pytest.raises(filters.FilterError):
        filters.fact_filter(raw)


def test_filter_limits(spark):
    def nested(n):
        f = {"id": "x"}
        for _ in range(n):
            f = {"not": f}
        return f

    filters.fact_filter(nested(16))
    filters.fact_filter({"OR": [{"id": str(i)} for i in range(256)]})
    with pytest.raises(filters.FilterError, match="nested"):
        filters.fact_filter(nested(17))
    with pytest.raises(filters.FilterError, match="predicates"):
        filters.fact_filter({"OR": [{"id": str(i)} for i in range(257)]})
    assert filters.all_of(None, {}, {"id": "x"}) == {"id": "x"} and filters.all_of(None, {}) == {}
    assert filters.all_of({"id": "x"}, None, {"level": "y"}) == {"AND": [{"id": "x"}, {"level": "y"}]}


def test_filter_values(spark):
    df = spark.sql("select '7' id, 'true' session_name, timestamp'2026-01-01 00:00:00' created_at, 2 times_derived, 0.5D confidence")
    holds = lambda raw: df.where(filters.fact_filter(raw)).count() == 1
    assert holds({"id": 7, "session_name": True, "created_at": 1767225600, "times_derived": [1, 2], "confidence": {"LT": " 0.75"}})
    assert holds({"created_at": {"gte": "2026-01-01T01:00:00+01:00", "exists": True}, "Or": [{"id": "x"}, {"id": {"starts_with": "7"}}]})
    assert holds({"session_name": {"icontains": "TRU"}, "and": [{"AND": [{}]}]}) and not holds({"not": {}})


def test_text(spark):
    s = lambda x: F.lit(x)
    r = one(
        spark, text.tokens_bigram(s("alice 서울강남 2024")).alias("bigram"), text.tokens_english(s("Alice works AT a Bank, alice's 50,000")).alias("english"), text.entity_norm(s("\u3000 New \t York ")).alias("entity"),
        text.normalize(s("\x0b A  b\n")).alias("norm"), text.strip(s("\u2003x\u00a0")).alias("strip"), text.key_segment(text.key_of(s("a:b%"), s("c"), s("")), 0).alias("seg"), text.key_of(s("a:b%"), s("c")).alias("key"),
        text.parse_instant(s("2024-05-01"), F.expr(NOW)).alias("date"), text.parse_instant(s("2024-05-01T10:00:00+02:00"), F.expr(NOW)).alias("instant"), text.parse_instant(s("soon"), F.expr(NOW)).alias("none"),
        text.card_lines(F.array(s(" IDENTITY: x "), s("OTHER: y"), s("ATTRIBUTE: z"))).alias("card"), text.information_score(F.array(s("a"), s("a"), s("b")), 2).alias("score"),
        text.analyzer_for("ko-KR")(s("서울")).alias("ko"), text.analyzer_for("en")(s("A b")).alias("en"),
    )
    assert r.bigram == ["alice", "서울", "울강", "강남", "2024"] and r.english == ["alice", "works", "at", "a", "bank", "alice's", "50,000"]
    assert (r.entity, r.norm, r.strip, r.seg, r.key) == ("new york", "a  b", "x\u00a0", "a:b%", "a%3Ab%25:c")
    assert str(r.date) == "2024-05-01 00:00:00" and str(r.instant) == "2024-05-01 08:00:00" and str(r.none) == "2026-08-31 12:00:00"
    assert r.card == ["IDENTITY: x", "ATTRIBUTE: z"] and r.score == 7 and r.ko == ["서울"] and r.en == ["a", "b"]
    assert providers.bigram_tokens("alice 서울강남 2024") == r.bigram


def test_search(spark):
    df = spark.createDataFrame([(1, "at 50% off"), (2, "report_final"), (3, "C:\\temp"), (4, "the big bank"), (5, "big the bank"), (6, None)], "id int, content string")
    ids = lambda c: sorted(r.id for r in df.where(c).collect())
    t = text.tokens_simple(F.col("content"))
    assert [sorted(r.id for r in search.grep(df, n).collect()) for n in ("%", "repo_t", "REPORT_", "\\T")] == [[1], [], [2], [3]]
    assert ids(search.websearch('"the big"', t)) == [4] and ids(search.websearch("the big", t)) == [4, 5]
    assert ids(search.websearch("off or temp", t)) == [1, 3] and ids(search.websearch('bank -"the big"', t)) == [5]
    assert ids(search.websearch("", t)) == [] and ids(search.any_term(t, ["c:temp", "50%"])) == [1, 3]


def test_dedup_in_order(spark):
    base = " ".join(f"word{i}" for i in range(30))
    old = facts(spark, [("o", base, "explicit", "s1", 1, 1), ("other", "something else", "inductive", None, 1, 1)])
    rows = [("n1", base.upper() + "  ", "explicit", "s1"), ("n2", base + " punctually", "explicit", "s1"), ("n3", base, "explicit", "s1"), ("n4", base, "explicit", "s2"), ("n5", base, "deductive", None), ("n6", base, "deductive", None)]
    new = facts(spark, [(i, c, lv, s, 1, 0) for i, c, lv, s in rows]).withColumns({"draft_id": F.col("id"), "position": F.substring("id", 2, 1).cast("int")}).drop("id")
    outcomes, changed = dedup.upsert_in_order(new, old, F.expr(NOW))
    got = {r.draft_id: (r.kind, r.stage, r.id, r.replaced_id) for r in outcomes.collect()}
    assert got == {"n1": ("REINFORCED", 1, "o", None), "n2": ("REPLACED", 3, "n2", "o"), "n3": ("REINFORCED", 3, "n2", None), "n4": ("INSERTED", 0, "n4", None), "n5": ("INSERTED", 0, "n5", None), "n6": ("REINFORCED", 1, "n5", None)}
    after = {r.id: (r.times_derived, r.changed) for r in changed.collect()}
    assert after["n2"] == (4, "insert") and after["o"][1] == "delete" and after["n5"] == (2, "insert")
    assert {r.kind: r.n for r in dedup.outcome_counts(outcomes).collect()} == {"INSERTED": 2, "REINFORCED": 3, "REPLACED": 1}
    assert dedup.outcome_events(outcomes, "deriver", F.expr(NOW)).count() == 7
    legacy = old.withColumn("content_hash", F.lit("0" * 64))
    hit = dedup.exact_matches(new.where("draft_id in ('n1', 'n4')"), legacy, F.expr(NOW)).collect()
    assert [(r.draft_id, r.id, r.stage) for r in hit] == [("n1", "o", 2)]


def plain_fold(old, new, most, weight=1):
    """The ordered write as one loop over everything, for one scope."""
    score = lambda r: len(r["content_analyzed"].split()) + weight * len(set(r["content_analyzed"].split()))

    def far(a, b):
        dot, size = sum(x * y for x, y in zip(a, b)), math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
        return 1 - dot / size if size else 1.0

    live, out = sorted((r.asDict() for r in old), key=lambda r: (r["created_at"], r["id"])), []
    for r in sorted(new, key=lambda r: r["position"]):
        hit = next(((x, 1) for x in live if x["content_hash"] == r["content_hash"]), None) or next(((x, 2) for x in live if x["content_norm"] == r["content_norm"]), None)
        if hit is None and r["embedding"] is not None:
            near = min(((far(x["embedding"], r["embedding"]), x["id"]) for x in live if x["embedding"] is not None), default=(9, ""))
            hit = (next(x for x in live if x["id"] == near[1]), 3) if near[0] <= most else None
        if hit and not (hit[1] == 3 and score(r) >= score(hit[0])):
            out.append((r["draft_id"], "REINFORCED", hit[1], hit[0]["id"], None))
            continue
        out.append((r["draft_id"], "REPLACED", 3, r["draft_id"], hit[0]["id"]) if hit else (r["draft_id"], "INSERTED", 0, r["draft_id"], None))
        live = [x for x in live if not hit or x is not hit[0]] + [dict(r, id=r["draft_id"])]
    return out


def test_dedup_against_a_loop(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    made = []
    for i in range(140):
        content = " ".join(rng.choices(words, k=rng.randrange(3, 7)))
        vector = None if i % 17 == 0 else [0.0] * 4 if i % 19 == 0 else [rng.choice([0.0, 1.0, 1.1]) for _ in range(4)]
        made.append((f"f{i:03}", rng.choice([content, content.upper()]), vector))

    def table(rows):
        base = facts(spark, [(i, c, "deductive", None, 1, 1) for i, c, _ in rows]).drop("embedding")
        return base.join(spark.createDataFrame([(i, v) for i, _, v in rows], "id string, embedding array<float>"), "id")

    old, new = table(made[:60]), table(made[60:]).withColumns({"draft_id": F.col("id"), "position": F.substring("id", 2, 3).cast("int")})
    for most in (0.05, 0.3):
        got, changed = dedup.upsert_in_order(new, old, F.expr(NOW), most)
        columns = ["content_hash", "content_norm", "content_analyzed", "embedding"]
        want = plain_fold(old.select("id", "created_at", *columns).collect(), [r.asDict() for r in new.select("draft_id", "position", F.expr(NOW).alias("created_at"), *columns).collect()], most)
        assert sorted((r.draft_id, r.kind, r.stage, r.id, r.replaced_id) for r in got.collect()) == sorted(want)
        assert {k for _, k, *_ in want} == {"INSERTED", "REINFORCED", "REPLACED"} and changed.where("changed = 'delete'").count() == sum(k == "REPLACED" for _, k, *_ in want)


def test_repeated_ids_and_zero_vectors(spark):
    q = spark.createDataFrame([(1, False, 0, None), (2, False, 3, "old"), (3, False, 0, None)], "id int, processed boolean, attempts int, last_error string")
    failed = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, None, 5), (2, "c", 4)], "id int, error string, at int")
    assert sorted(map(tuple, work.record_failure(q, failed).collect())) == [(1, False, 2, "a"), (2, True, 5, "old"), (3, False, 0, None)]
    f = facts(spark, [("a", "x", "explicit", "s", 1, 1), ("b", "y", "explicit", "s", 1, 1)])
    v = spark.createDataFrame([("a", [2.0, 0.0]), ("a", [1.0, 5.0]), ("b", None)], "id string, embedding array<float>")
    got = {r.id: r for r in dedup.set_vectors(f, v).collect()}
    assert len(got) == 2 == dedup.set_vectors(f, v).count() and got["a"].embedding == [1.0, 5.0] and got["a"].sync_state == "synced"
    d = lambda a, b: one(spark, vectors.cosine_distance(F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>")).alias("d")).d
    assert d([0.0, 0.0], [1.0, 0.0]) == 1.0 == d([0.0, 0.0], [0.0, 0.0]) and d(None, [1.0]) is None and d([2.0, 0.0], [3.0, 0.0]) == 0.0 and d([1.0], [1.0, 1.0]) == 1.0


def test_worker_round(spark):
    at = lambda minutes: NOW_AT - dt.timedelta(minutes=minutes)
    rows = [(1, "w", "a", at(60), 600, False), (2, "w", "a", at(50), 1, False), (3, "w", "a", at(40), 1, False), (4, "w", "b", at(90), 600, False), (5, "v", "c", at(10), 600, False), (6, "v", "d", at(5), 600, False), (7, "v", "e", at(500), 9, False), (8, "w", "a", at(99), 5, True)]
    q = spark.createDataFrame([(i, w, k, t, n, p, 0, None) for i, w, k, t, n, p in rows], "id int, workspace_name string, work_unit_key string, created_at timestamp, token_count int, processed boolean, attempts int, last_error string")
    claims = spark.createDataFrame([("e", "other", at(1), NOW_AT + dt.timedelta(minutes=4)), ("d", "gone", at(30), at(20))], "work_unit_key string, worker_id string, claimed_at timestamp, expires_at timestamp")
    handle = lambda items: items.select("id", F.when(F.col("id") == 2, "broken").alias("error"))
    queue, left, done = work.worker_round(q, claims, handle, "me", F.expr(NOW), 3)
    assert sorted((r.id, r.error) for r in done.collect()) == [(1, None), (2, "broken"), (4, None), (5, None)]  # turns: b and c, then a; 3 comes after the broken one
    assert sorted((r.id, r.processed, r.attempts, r.last_error) for r in queue.collect()) == [(1, True, 0, None), (2, False, 1, "broken"), (3, False, 0, None), (4, True, 0, None), (5, True, 0, None), (6, False, 0, None), (7, False, 0, None), (8, True, 0, None)]
    assert [(r.work_unit_key, r.worker_id) for r in left.collect()] == [("e", "other")]
    assert work.heartbeat_s(300) == 100 and work.taken_turns(q.select("work_unit_key", "workspace_name", F.col("created_at").alias("oldest")), 0).count() == 0


def test_answer_bounds():
    words = type("Words", (), {"encode": staticmethod(str.split), "decode": staticmethod(" ".join)})()
    silent = providers.Scripted(lambda r: {"tool_calls": [{"name": "t", "arguments": {"n": 1}}]} if r["tools"] else {"text": "" if len(r["turns"]) > 4 else "from findings"})
    history = [{"role": "user", "text": "old " * 3000}, {"role": "assistant", "text": "mid " * 5000}, {"role": "user", "text": "new " * 2999}]
    got = model.answer("ask " * 5000, silent, {"t": lambda a: "found " * 7000}, "minimal", max_chars=10**6, history=history, encoding=words)
    first, last = silent.requests[0]["turns"][:3], silent.requests[-1]["turns"]
    assert [t["text"][:3] for t in first] == ["mid", "new", "ask"] and len(first[2]["text"].split()) == 4000
    found = last[-1]["text"]
    assert got["text"] == "from findings" and len(found.split()) == 6000 and found.startswith(model.FOUND) and found.endswith(model.ADVICE)


def test_append_messages(spark):
    cols = "id bigint, workspace_name string, session_name string, seq_in_session bigint, content string"
    old = spark.createDataFrame([(7, "w", "a", 1, "x"), (9, "w", "a", 2, "x")], cols)
    new = spark.createDataFrame([("w", s, p, "n") for s in "abcdefgh" for p in range(3)] + [("v", "a", 0, "n")], "workspace_name string, session_name string, position int, content string")
    got = [r for r in tables.append_messages(old, new, groups=3).collect() if r.content == "n"]
    assert sorted(r.id for r in got) == list(range(10, 35))
    per = {}
    for r in sorted(got, key=lambda r: r.id):
        per.setdefault((r.workspace_name, r.session_name), []).append((r.id, r.seq_in_session))
    assert all([i for i, _ in x] == list(range(x[0][0], x[0][0] + len(x))) for x in per.values())
    assert [s for _, s in per["w", "a"]] == [3, 4, 5] and [s for _, s in per["v", "a"]] == [1]


def test_set_fingerprint(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text('{"name": "n", "corpus": [{"id": "b", "content": "x", "entities": ["e", "f"], "confidence": 0.5}, {"id": "a", "content": "y", "daysAgo": 3}], "queries": [{"id": "q", "query": "z", "judgements": {"b": 1, "a": 3}}]}')
    text = "b\x1fx\x1fexplicit\x1f[e, f]\x1f1\x1f0\x1f[]\x1f0.5\x1ea\x1fy\x1fexplicit\x1f[]\x1f1\x1f3\x1f[]\x1fnull\x1eq\x1fz\x1fa=3,b=1,\x1e"
    assert evaluate.set_fingerprint(*evalset.read_set(spark, str(path))).first().fingerprint == hashlib.sha256(text.encode()).hexdigest()


def test_provenance(spark):
    f = facts(spark, [(x, x, "deductive", None, 1, 1) for x in "abcdefg"])
    src = {"a": ["b", "x"], "b": ["c"], "c": ["d", "a"], "d": ["e"], "e": ["f"], "f": ["g"], "g": []}
    links = spark.createDataFrame([(k, v, [ord(k)]) for k, v in src.items()], "id string, source_ids array<string>, message_ids array<bigint>")
    f = f.drop("source_ids", "message_ids").join(links, "id").withColumn("deleted_at", F.when(F.col("id") == "e", F.expr(NOW)))
    root = f.where("id = 'a'").select("workspace_name", "id")
    assert {(r.premise, r.depth) for r in provenance.premises(root, f).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert [r.missing for r in provenance.unresolved(root, f).collect()] == ["x"]
    m = spark.createDataFrame([("w", ord(x)) for x in "abcz"], "workspace_name string, id bigint")
    chain = provenance.reasoning_chain(root, f, m, F.expr(NOW)).first()
    assert chain.premises == ["b", "c", "d"] and chain.messages == [97, 98, 99] and chain.unresolved == ["x"] and chain.dependents == ["c"]
    d = spark.createDataFrame([("1", "w", ["a", "zz"]), ("2", "w", ["zz"])], "draft_id string, workspace_name string, source_ids array<string>")
    assert [(r.draft_id, r.source_ids) for r in provenance.valid_premises(d, f).collect()] == [("1", ["a"])]


def test_sessions(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    moves = spark.createDataFrame([("w", "s", "p", k, t(m), i) for i, (k, m) in enumerate([("join", 1), ("join", 2), ("leave", 4), ("leave", 5), ("join", 7)])], "workspace_name string, session_name string, peer_name string, kind string, at timestamp, seq int")
    windows = sessions.membership_windows(moves)
    assert sorted((r.joined_at, r.left_at) for r in windows.collect() if r.left_at) == [(t(1), t(4))] and windows.count() == 2
    said = [(m, "w", "s", who, t(m), 10, m, "hi") for m, who in ((0, "q"), (3, "p"), (5, "q"), (8, "p"))]
    messages = spark.createDataFrame(said, "id bigint, workspace_name string, session_name string, peer_name string, created_at timestamp, token_count int, seq_in_session bigint, content string")
    assert sorted(r.id for r in sessions.audible(messages, windows, "p").collect()) == [3, 8]
    members = spark.createDataFrame([("w", "s", "p", None, None, t(7), None), ("w", "s", "q", False, True, t(0), t(4))], "workspace_name string, session_name string, peer_name string, observe_me boolean, observe_others boolean, joined_at timestamp, left_at timestamp")
    pairs = {(r.id, r.observer, r.observed) for r in sessions.fan_out(messages, members).collect()}
    assert pairs == {(3, "p", "p"), (8, "p", "p"), (3, "q", "p")}
    assert {r.observer for r in sessions.fan_out(messages, members, observe_me=False).collect()} == {"q"}
    left = sessions.replace_roster(members, members.where("peer_name = 'q'"), F.expr(NOW)).collect()
    assert {r.peer_name: r.left_at is not None for r in left} == {"p": True, "q": True}


def test_context(spark):
    rows = [(i, "w", s, "p", i, n, "m", dt.datetime(2024, 1, 1)) for s, n, k in (("ten", 10, 10), ("big", 100, 5)) for i in range(1, k + 1)]
    m = spark.createDataFrame(rows, "id bigint, workspace_name string, session_name string, peer_name string, seq_in_session bigint, token_count int, content string, created_at timestamp")
    summary = "map<string, struct<text: string, token_count: int, covers_through_seq: bigint>>"
    s = spark.createDataFrame([("w", "ten", None), ("w", "big", None)], f"workspace_name string, name string, summaries {summary}")
    got = {r.session_name: r for r in sessions.contexts(s, m, 50).collect()}
    assert got["ten"].start_seq == 6 and [x.seq_in_session for x in got["ten"].messages] == [6, 7, 8, 9, 10]
    assert {r.session_name: r.start_seq for r in sessions.contexts(s, m, 10).collect()}["big"] == 5
    s = spark.createDataFrame([("w", "ten", {"long": ("long one", 90, 9), "short": ("short one", 20, 7)})], f"workspace_name string, name string, summaries {summary}")
    r = sessions.contexts(s, m, 100).first()
    assert (r.summary, r.start_seq, r.message_tokens) == ("short one", 8, 30)
    assert sessions.render(sessions.contexts(s, m, 100)).first().text.startswith("Earlier:\nshort one\n\nRecent:\n2024-01-01 00:00:00 p: m")
    assert sessions.history_within(m.where("session_name = 'big'"), 50).count() == 0
    covered = spark.createDataFrame([("w", "ten", 4)], "workspace_name string, session_name string, covers_through_seq bigint")
    assert {(r.session_name, r.pending, r.fed) for r in sessions.due_summaries(m, covered, 5).collect()} == {("ten", 6, 6), ("big", 5, 5)}


def test_ingest(spark):
    m = spark.createDataFrame([(5, "w", "s", "p", "old", 3, 1, dt.datetime(2024, 1, 1))], "id bigint, workspace_name string, session_name string, peer_name string, content string, seq_in_session bigint, token_count int, created_at timestamp")
    new = spark.createDataFrame([("w", "s", "p", "one two", 0, dt.datetime(2024, 1, 2)), ("w", "s", "p", "three", 1, dt.datetime(2024, 1, 2))], "workspace_name string, session_name string, peer_name string, content string, position int, created_at timestamp")
    members = spark.createDataFrame([("w", "s", "q", None, None, dt.datetime(2024, 1, 1), None)], "workspace_name string, session_name string, peer_name string, observe_me boolean, observe_others boolean, joined_at timestamp, left_at timestamp")
    table, items = sessions.ingest(m, new, members, lambda c: F.size(F.split(c, " ")))
    assert sorted((r.id, r.seq_in_session, r.token_count) for r in table.collect()) == [(5, 3, 1), (6, 4, 2), (7, 5, 1)]
    got = sorted((r.task_type, r.work_unit_key, r.payload) for r in items.collect())
    assert len(got) == 6 and got[0] == ("representation", "representation:w:s:p:p", "6") and got[-1] == ("summary", "summary:w:s:s:s", "7")


def test_work(spark):
    now = dt.datetime(2026, 8, 31, 12)
    ago = lambda s: now - dt.timedelta(seconds=s)
    rows = [(1, "big", 600, ago(1)), (2, "idle", 1, ago(5)), (3, "fresh", 1, ago(1)), (4, "old", 1, ago(2000)), (5, "old", 1, ago(0)), (6, "held", 999, ago(9))]
    q = spark.createDataFrame([(i, "w", k, n, False, 4, None, "dream", str(i), t) for i, k, n, t in rows], "id bigint, workspace_name string, work_unit_key string, token_count int, processed boolean, attempts int, last_error string, task_type string, payload string, created_at timestamp")
    c = spark.createDataFrame([("held", "x", now, now + dt.timedelta(hours=1)), ("gone", "x", now, ago(1))], "work_unit_key string, worker_id string, claimed_at timestamp, expires_at timestamp")
    assert sorted(r.work_unit_key for r in work.ready_units(q, c, F.expr(NOW)).collect()) == ["big", "idle", "old"]
    got = work.claim(c, q.select("work_unit_key"), "me", F.expr(NOW), 60)
    assert {r.work_unit_key for r in got.where("worker_id = 'me'").collect()} == {"big", "idle", "fresh", "old"}
    assert work.release_claims(got, q.select("work_unit_key"), "me").count() == 2 and work.sweep_claims(c, F.expr(NOW)).count() == 1
    failed = work.record_failure(q, spark.createDataFrame([(1, "e")], "id bigint, error string"))
    assert failed.where("id = 1").first().processed and not failed.where("id = 2").first().processed
    assert work.queue_health(q, F.expr(NOW)).first().oldest_age_s == 2000
    assert work.mark_processed(q, q.where("id < 3").select("id")).where("processed").count() == 2
    assert [work.backoff_s(i) for i in (0, 3, 99)] == [1, 8, 30]
    d = spark.createDataFrame([("9", "w", "a", "b", "running", 3, ago(5000), ago(5000)), ("1", "w", "a", "c", "running", 0, ago(5000), ago(5000)), ("8", "w", "a", "d", "pending", 0, ago(5000), ago(5000))], "id string, workspace_name string, observer string, observed string, status string, requeues int, created_at timestamp, updated_at timestamp")
    assert {r.id: (r.status, r.requeues) for r in work.sweep_dreams(d, q, F.expr(NOW)).collect()} == {"9": ("failed", 3), "1": ("running", 0), "8": ("pending", 1)}
    assert work.start_dreams(d, d.where("id <> '9'").withColumn("observed", F.lit("new")), F.expr(NOW)).count() == 4


def test_evaluate(spark):
    rank = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")], "qid int, rank int, id string")
    judged = spark.createDataFrame([(1, "b", 3), (1, "c", 1), (1, "x", 2), (2, "a", 0)], "qid int, id string, rel int")
    r = evaluate.report(rank, judged).first()
    want = (7 / math.log2(3) + 1 / 2) / (7 + 3 / math.log2(3) + 1 / 2)
    assert abs(r["ndcg@5"] - want / 2) < 1e-12 and r.mrr == 0.25 and abs(r["recall@10"] - 1 / 3) < 1e-12 and r.queries == 2
    assert {x.qid: x.precision for x in evaluate.precision_at(rank, judged, 10).collect()} == {1: 2 / 3, 2: 0}
    corpus = spark.createDataFrame([("a", "t"), ("b", None)], "id string, content string")
    assert evaluate.fingerprint(corpus, "id", "content").first() == evaluate.fingerprint(corpus.orderBy(F.desc("id")).repartition(3), "id", "content").first()


def test_guard():
    assert guards.check_schema('{"type": "object", "properties": {"a": {"type": "string"}}}')
    deep = {"type": "object"}
    for _ in range(6):
        deep = {"type": "object", "properties": {"x": deep}}
    some = {str(i): {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "number", "enum": [1]}}} for i in range(40)}
    assert guards.check_schema({"type": "object", "properties": some, "required": ["0"], "additionalProperties": {"anything": 1}})
    for bad in ({"properties": {}}, {"type": ["string", "object"]}, {"type": "array", "items": [{"type": "string"}]}, {"type": "object", "properties": []}, {"type": "array", "items": {}}, "not json", "[]"):
        with pytest.raises(ValueError):
            guards.check_schema(bad)
    for bad in ({"$ref": "x"}, {"type": "null"}, deep, {"type": "object", "properties": {str(i): {"type": "string"} for i in range(41)}}, '{"description": "' + "가" * 6000 + '"}', ""):
        with pytest.raises(ValueError):
            guards.check_schema(bad)


def test_model_stages(spark):
    units = spark.createDataFrame([("w", "a", "b", "s", "hello", [1, 2])], "workspace_name string, observer string, observed string, session_name string, text string, message_ids array<bigint>")
    extract = lambda u: [{"content": " Fact of " + u.text.iloc[0] + " "}, {"content": "  "}]
    d = model.derive(units, extract).collect()
    assert [(x.content, x.content_norm, x.level, x.session_name, x.message_ids) for x in d] == [("Fact of hello", "fact of hello", "explicit", "s", [1, 2])]
    f = facts(spark, [("x1", "likes tea", "explicit", "s", 1, 1)])
    dream = lambda u: [{"content": "drinks tea", "source_ids": ["x1", "nope"], "confidence": 7.0}, {"content": "unfounded", "source_ids": ["nope"]}]
    out = model.consolidate(f, f, [("inductive", dream)], F.expr(NOW)).collect()
    assert [(x.content, x.level, x.confidence, x.source_ids, str(x.expires_at)) for x in out] == [("drinks tea", "inductive", 1.0, ["x1"], "2027-08-31 12:00:00")]
    cards = model.refresh_cards(f, f, lambda u: [{"content": "IDENTITY: tea"}, {"content": "nonsense"}], F.expr(NOW)).collect()
    assert cards[0].lines == ["IDENTITY: tea"]
    backend = providers.Scripted(lambda r: {"tool_calls": [{"name": "t", "arguments": {}}, {"name": "bad"}]} if r["tools"] else {"text": "done"})
    got = model.answer("q", backend, {"t": lambda a: "x" * 9000}, "minimal")
    assert got["text"] == "done" and got["calls"] == [{"name": "t", "failed": False}, {"name": "bad", "failed": True}]
    assert len(backend.requests[1]["turns"][2]["results"][0]["content"]) == 8000


def test_providers(spark, tmp_path):
    live = providers.Scripted(lambda r: {"text": r["q"]})
    recorder = providers.Replay(str(tmp_path), live)
    assert recorder.complete({"q": "x", "id": 1}) == recorder.complete({"q": "x", "id": 2}) and len(live.requests) == 1
    with pytest.raises(providers.MissingRecording):
        providers.Replay(str(tmp_path)).complete({"q": "y"})
    broken = providers.Scripted(lambda r: 1 / 0)
    assert providers.Fallback(broken, live).complete({"q": "z"}) == {"text": "z"}
    e = providers.embed_rows(spark.createDataFrame([("a b",), ("",)], "content string"), providers.HashingEmbedder(16)).collect()
    native = spark.createDataFrame([("a b",), ("",)], "content string").select(vectors.embed_text(F.col("content"), 16).alias("embedding")).collect()
    assert [x.embedding for x in e] == [x.embedding for x in native]


def test_storage(spark, tmp_path):
    f = facts(spark, [("x", "c", "explicit", "s", 1, 1)])
    store.save(f, str(tmp_path), "conclusions")
    back = store.load(spark, str(tmp_path), "conclusions")
    assert back.count() == 1 and "PartitionFilters: [isnotnull" in back.where("workspace_name = 'w'")._jdf.queryExecution().toString()
    store.check_facts(back, 1536)
    with pytest.raises(ValueError):
        store.check_width(back, 5)
    with pytest.raises(ValueError):
        store.check_facts(back.withColumn("session_name", F.lit(None).cast("string")))
    assert tables.upsert(back, back.withColumn("content", F.lit("n")), ["id"]).first().content == "n"


def test_evalset(spark, tmp_path):
    p = tmp_path / "e.json"
    p.write_text('{"name": "n",\n "corpus": [{"id": "a", "content": "c"}], "queries": [{"id": "q", "query": "t", "judgements": {"a": 3, "b": 1}}]}')
    corpus, queries, judged = evalset.read_set(spark, str(p))
    r = corpus.first()
    assert (r.level, r.times_derived, r.days_ago, r.entities) == ("explicit", 1, 0, []) and queries.first().qid == "q"
    assert [x.id for x in evaluate.unknown_judgements(judged, corpus).collect()] == ["b"]


def test_streaming_gate(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = pd.DataFrame({"work_unit_key": ["a", "a", "b"], "token_count": [300, 300, 5], "created_at": pd.to_datetime(["2024-01-01"] * 3)})
    spark.createDataFrame(rows).write.parquet(src)
    stream = spark.readStream.schema("work_unit_key string, token_count long, created_at timestamp").parquet(src)
    q = ingest.gate(stream, work.Gates(max_age_s=10**9, idle_s=1)).writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(80):
        if spark.table("gated").count() == 2:
            break
        time.sleep(0.5)
    q.stop()
    assert {(r.work_unit_key, r.tokens, r["items"], r.reason) for r in spark.table("gated").collect()} == {("a", 600, 2, "tokens"), ("b", 5, 1, "idle")}


def test_streaming_fan_out(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    m = spark.createDataFrame([(1, "w", "s", "p", dt.datetime(2024, 1, 2))], "id bigint, workspace_name string, session_name string, peer_name string, created_at timestamp")
    m.write.parquet(src)
    members = spark.createDataFrame([("w", "s", "q", None, None, dt.datetime(2024, 1, 1), None)], "workspace_name string, session_name string, peer_name string, observe_me boolean, observe_others boolean, joined_at timestamp, left_at timestamp")
    s = ingest.stream_fan_out(spark.readStream.schema(m.schema).parquet(src), members)
    ingest.run_batches(s, lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/{epoch}"), str(tmp_path / "c")).awaitTermination()
    assert {(r.observer, r.observed) for r in spark.read.parquet(f"{out}/*").collect()} == {("p", "p"), ("q", "p")}
