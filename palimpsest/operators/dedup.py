"""Deduplicating writes of facts: exact in set form, near-duplicates in order within a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import content_hash, information_score, normalize
from palimpsest.functions.vectors import cosine_distance, norm
from palimpsest.operators import near
from palimpsest.operators.entities import unlink
from palimpsest.operators.tables import live_facts
from palimpsest.schemas import PAIR
from palimpsest.sources.segments import staged

NEAR_DISTANCE = 0.05


def scope_session() -> Column:
    """Explicit facts are told apart by session; the other levels share one scope of the pair."""
    return F.when(F.col("level") == "explicit", F.coalesce("session_name", F.lit(""))).otherwise(F.lit(""))


SCOPE = [*PAIR, "level", "scope_session"]


def with_derived(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"content_norm": normalize(F.col("content")), "content_hash": content_hash(F.col("content"))})


def collapse_scopes(facts: DataFrame) -> DataFrame:
    """Live rows of one scope and content hash become one: the first by (created_at, id), with summed counts and the newest
    reinforcement; the others are soft-deleted. Adds survivor_id. One window, with the counts' partial sums in it."""
    key = [*PAIR, "level", F.coalesce("session_name", F.lit("")), "content_hash"]
    rows = facts.where("deleted_at is null")
    w = Window.partitionBy(*key).orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"survivor_id": F.first("id").over(w), "_sum": F.sum("times_derived").over(w), "_max": F.max("last_reinforced_at").over(w)})
    last = F.col("id") == F.col("survivor_id")
    return rows.withColumns({
        "times_derived": F.when(last, F.col("_sum")).otherwise(F.col("times_derived")).cast("int"),
        "last_reinforced_at": F.when(last, F.col("_max")).otherwise(F.col("last_reinforced_at")),
        "is_survivor": last,
    }).drop("_sum", "_max")


def exact_matches(drafts: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Stages one and two: for each draft (draft_id and fact columns) the earliest live fact in its scope with its hash, else with
    its normalised text: draft_id, id, stage. The two stages are equi-joins; a draft found by hash is not looked up by text."""
    d = drafts.withColumn("scope_session", scope_session()).select("draft_id", *SCOPE, "content_hash", "content_norm")
    f = live_facts(facts, now).withColumn("scope_session", scope_session())
    first = F.min_by("id", F.struct("created_at", "id")).alias("id")
    by_hash = f.groupBy(*SCOPE, "content_hash").agg(first)
    by_norm = f.groupBy(*SCOPE, "content_norm").agg(first)
    one = d.join(by_hash, [*SCOPE, "content_hash"]).select("draft_id", "id", F.lit(1).alias("stage"))
    rest = d.join(one.select("draft_id"), "draft_id", "left_anti")
    two = rest.join(by_norm, [*SCOPE, "content_norm"]).select("draft_id", "id", F.lit(2).alias("stage"))
    return one.union(two)


def near_matches(drafts: DataFrame, facts: DataFrame, now: Column, most: float = NEAR_DISTANCE) -> DataFrame:
    """Stage three for given drafts: draft_id, id, distance of the nearest live fact in scope, if at most `most` (inclusive).

    Exact, so a draft meets every vector of its scope, in blocks of matrices (near.nearest); equal vectors of a scope are
    compared once. The pairs' best are computed here and written. A vector without a direction lies at distance 1 from all,
    so that for `most` of 1 and more every pair is computed by itself."""
    rows = lambda d, c: d.withColumn("scope_session", scope_session()).where("embedding is not null").select(*SCOPE, c, F.col("embedding").alias("v"), norm(F.col("embedding")).alias("n"))
    d, f = rows(drafts, "draft_id"), rows(live_facts(facts, now), "id")
    if most < 1:
        d, f = (staged(x.where((F.col("n") > 0) & (F.col("n") < float("inf")))) for x in (d, f))
        one = staged(d.groupBy(*SCOPE, "v").agg(F.min("draft_id").alias("lid"), F.min("n").alias("n")))
        best = staged(near.nearest(one, f.groupBy(*SCOPE, "v").agg(F.min("id").alias("id"), F.min("n").alias("n")), SCOPE, most))
        d = d.join(one.drop("n"), [*SCOPE, "v"]).join(best, [*SCOPE, "lid"])
    else:
        d = d.join(f.select(*SCOPE, "id", F.col("v").alias("_v"), F.col("n").alias("_n")), SCOPE).withColumn("distance", cosine_distance(F.col("_v"), F.col("v"), F.col("_n"), F.col("n")))
    best = d.groupBy("draft_id").agg(F.min(F.struct("distance", "id")).alias("m"))
    return best.select("draft_id", "m.id", "m.distance").where(F.col("distance") <= most)


def _missing(x) -> bool:
    """What pandas makes of a null: None, NaN or NaT."""
    return x is None or (not hasattr(x, "__len__") and x != x)


OUTCOME = ("draft_id", "kind", "stage", "id", "replaced_id", "similarity")


PART_ROWS = 2000
# What str.split takes as white space.
_SPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _score(analyzed: Column, distinct_weight: int) -> Column:
    return information_score(F.filter(F.split(F.coalesce(analyzed, F.lit("")), _SPACE), lambda t: t != ""), distinct_weight)


def _in_parts(d: DataFrame, f: DataFrame, most: float, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """d and f with _part: rows of a scope that can touch each other, directly or over others, have one part.

    Nodes are hashes of (scope, content_hash); a collision only puts more rows together."""
    if not most < 1:  # a vector without a direction lies at distance 1 from all
        return d.withColumn("_part", F.lit(0)), f.withColumn("_part", F.lit(0))
    node = F.xxhash64(*SCOPE, F.lit("h"), "content_hash")
    scope = F.xxhash64(*SCOPE).alias("scope")
    rows = [x.select(F.lit(new).alias("new"), scope, node.alias("node"), F.xxhash64(*SCOPE, F.lit("n"), "content_norm").alias("text"), F.col("embedding").alias("v")) for x, new in ((d, True), (f, False))]
    rows = staged(rows[0].union(rows[1]))
    parts = max(1, -(-rows.count() // part_rows))
    texts = rows.groupBy("text").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("text", "a")
    pointed = rows.where(F.col("v").isNotNull() & near.directed(F.col("v")))
    vectors = staged(pointed.groupBy("scope", "v").agg(F.min("node").alias("node"), F.max("node").alias("b"), F.max("new").alias("new")))
    equal = pointed.join(vectors.where("node <> b").select("scope", "v", F.col("node").alias("a")), ["scope", "v"])
    edges = rows.join(texts, "text").select("a", F.col("node").alias("b")).union(equal.select("a", F.col("node").alias("b")))
    v = vectors.select("scope", "v", "node")
    edges = staged(edges.union(near.linked(vectors.where("new").select("scope", "v", "node"), v, ["scope"], most)))
    joined = near.components(edges).select(F.col("node").alias("_node"), "component")
    joined = F.broadcast(joined) if joined.count() <= near.SMALL_SCOPES else joined
    deal = lambda x: x.withColumn("_node", node).join(joined, "_node", "left").withColumn("_part", F.pmod(F.coalesce("component", "_node"), F.lit(parts)).cast("int")).drop("_node", "component")
    return deal(d), deal(f)


def upsert_in_order(drafts: DataFrame, facts: DataFrame, now: Column, most: float = NEAR_DISTANCE, distinct_weight: int = 1, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """All three stages for drafts in order of `position`, each seeing the earlier ones' effects: (outcomes, changed facts).

    drafts: draft_id (becomes the id of an inserted fact), position, fact columns. Only scopes that drafts touch are read.
    Writes depend on each other only where hash, text or a vector within `most` connects them, so a scope is dealt, whole
    connected sets at a time, into cogroups of about PART_ROWS rows; what is connected is one task, as its order matters. Outcomes: draft_id, kind (INSERTED, REINFORCED,
    REPLACED), stage (0 for an insertion), id of the fact that now holds the content, replaced_id, similarity.
    changed facts: the rows of touched scopes as they are after the batch, with `changed` (insert, update, delete or none).
    A near-duplicate with at least the old one's information score replaces it, counting on; else the old one is reinforced.
    """
    import numpy as np
    import pandas as pd

    cols = ["id", "content", "content_norm", "content_hash", "content_analyzed", "session_name", "times_derived", "last_reinforced_at", "created_at", "embedding"]
    d = drafts.withColumn("scope_session", scope_session()).withColumn("now", now).select(*SCOPE, "draft_id", "position", "now", *[c for c in cols if c not in ("id", "times_derived", "last_reinforced_at", "created_at")])
    f = live_facts(facts, now).withColumn("scope_session", scope_session()).select(*SCOPE, *cols).join(d.select(*SCOPE).distinct(), SCOPE, "left_semi")
    d, f = (x.withColumn("_score", _score(F.col("content_analyzed"), distinct_weight)) for x in _in_parts(d, f, most, part_rows))
    state = T.StructType.fromDDL(
        "workspace_name string, observer string, observed string, level string, scope_session string, id string, content string, content_norm string, content_hash string,"
        " content_analyzed string, session_name string, times_derived int, last_reinforced_at timestamp, created_at timestamp, embedding array<float>, changed string"
    )

    class Scope:
        """Rows in order of creation, found by hash, by text and by vector."""

        def __init__(self):
            self.rows, self.by, self.at, self.held, self.norms, self.gone = [], {"content_hash": {}, "content_norm": {}}, [], None, None, None

        def add(self, row: dict) -> None:
            for name, index in self.by.items():
                index.setdefault(row[name], []).append(len(self.rows))
            v = row["embedding"]
            if v is not None and len(v) and np.isfinite(np.asarray(v, np.float64)).all():
                n = len(self.at)
                if self.held is None:
                    self.held, self.norms, self.gone = np.zeros((64, len(v))), np.zeros(64), np.zeros(64, bool)
                elif n == len(self.held):
                    self.held, self.norms = np.concatenate([self.held, np.zeros_like(self.held)]), np.concatenate([self.norms, np.zeros_like(self.norms)])
                    self.gone = np.concatenate([self.gone, np.zeros_like(self.gone)])
                self.held[n] = v
                self.norms[n] = np.sqrt((self.held[n] ** 2).sum())
                row["at"] = n
                self.at.append(len(self.rows))
            self.rows.append(row)

        def remove(self, row: dict) -> None:
            row["alive"], row["changed"] = False, "delete"
            if "at" in row:
                self.gone[row["at"]] = True

        def same(self, name: str, value) -> dict | None:
            return next((self.rows[i] for i in self.by[name].get(value, ()) if self.rows[i]["alive"]), None)

        def nearest(self, v) -> tuple[float, dict] | None:
            """Distance 1 where a vector is zero; ties to the smaller id."""
            if not self.at or not np.isfinite(np.asarray(v, np.float64)).all():
                return None
            n, q = len(self.at), np.asarray(v, np.float64)
            size = self.norms[:n] * np.sqrt((q * q).sum())
            far = 1 - np.divide(self.held[:n] @ q, size, out=np.zeros(n), where=size > 0)
            far[self.gone[:n]] = np.inf
            low = far.min()
            if low == np.inf:
                return None
            ties = np.flatnonzero(far <= low + 1e-12)  # products of a matrix may differ in the last digit from single ones
            dots = [float((self.held[i] * q).sum()) for i in ties]
            exact = [(1 - d / size[i] if size[i] else 1.0, self.rows[self.at[i]]["id"], i) for d, i in zip(dots, ties)]
            d, _, i = min(exact)
            return d, self.rows[self.at[i]]

    def write(new: pd.DataFrame, old: pd.DataFrame, cols: list[str]) -> tuple[list[dict], list[tuple]]:
        held, out = Scope(), []
        for r in old.sort_values(["created_at", "id"], na_position="last").to_dict("records"):
            held.add(r | {"changed": "none", "alive": True, "embedding": None if _missing(r["embedding"]) else r["embedding"]})
        for r in new.sort_values(["position", "draft_id"]).to_dict("records"):
            hit, stage, sim, replace = held.same("content_hash", r["content_hash"]), 1, None, False
            if hit is None:
                hit, stage = held.same("content_norm", r["content_norm"]), 2
            if hit is None and not _missing(r["embedding"]) and (found := held.nearest(r["embedding"])) and found[0] <= most:
                hit, stage, sim = found[1], 3, max(0.0, min(1.0, 1 - found[0]))
                replace = r["_score"] >= hit["_score"]
            if hit is not None and not replace:
                hit["times_derived"] += 1
                hit["last_reinforced_at"] = r["now"]
                hit["changed"] = "insert" if hit["changed"] == "insert" else "update"
                out.append((r["draft_id"], "REINFORCED", stage, hit["id"], None, sim))
                continue
            fresh = {c: r.get(c) for c in [*cols, "_score"]} | {"id": r["draft_id"], "times_derived": 1, "last_reinforced_at": r["now"], "created_at": r["now"], "changed": "insert", "alive": True}
            fresh["embedding"] = None if _missing(fresh["embedding"]) else fresh["embedding"]
            if replace:
                fresh["times_derived"] = hit["times_derived"] + 1
                held.remove(hit)
                out.append((r["draft_id"], "REPLACED", 3, fresh["id"], hit["id"], sim))
            else:
                out.append((r["draft_id"], "INSERTED", 0, fresh["id"], None, None))
            held.add(fresh)
        return held.rows, out

    def table(made: list[dict], names: list[str]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([None if _missing(m.get(c)) else m[c] for m in made], dtype=object) for c in names})

    def outcomes(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        return table([dict(zip(OUTCOME, x)) for x in write(new, old, lean)[1]], list(OUTCOME))

    def after(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        scope = dict(zip(SCOPE, key))
        return table([scope | x for x in write(new, old, cols)[0]], state.names)

    by = [*SCOPE, "_part"]
    lean = ["id", "content_norm", "content_hash", "times_derived", "created_at", "embedding"]
    # outcomes need no text: equal ones have equal digests
    short = [x.withColumn("content_norm", F.sha2("content_norm", 256)).drop("content", "content_analyzed", "session_name", "last_reinforced_at") for x in (d, f)]
    kinds = "draft_id string, kind string, stage int, id string, replaced_id string, similarity double"
    done = short[0].groupBy(*by).cogroup(short[1].groupBy(*by)).applyInPandas(outcomes, kinds)
    return done.select(*OUTCOME), d.groupBy(*by).cogroup(f.groupBy(*by)).applyInPandas(after, state)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("kind").agg(F.count("*").alias("n"))


def outcome_events(outcomes: DataFrame, actor: str, now: Column) -> DataFrame:
    """Audit rows of a batch: add, reinforce, or for a replacement one of the old and one of the new fact."""
    kinds = F.when(F.col("kind") == "INSERTED", F.array(F.struct(F.lit("add").alias("event"), F.col("id").alias("on")))).when(F.col("kind") == "REINFORCED", F.array(F.struct(F.lit("reinforce").alias("event"), F.col("id").alias("on"))))
    kinds = kinds.otherwise(F.array(F.struct(F.lit("replace").alias("event"), F.col("replaced_id").alias("on")), F.struct(F.lit("replace").alias("event"), F.col("id").alias("on"))))
    detail = F.to_json(F.struct("stage", "similarity", F.col("replaced_id").alias("replaces")))
    return outcomes.withColumn("_e", F.explode(kinds)).select(F.col("_e.on").alias("conclusion_id"), F.col("_e.event").alias("event"), F.lit(actor).alias("actor"), detail.alias("detail"), now.alias("created_at"))


def reinforce(facts: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Facts with each listed id (once for each row of hits) derived once more; content, session and messages stay."""
    n = hits.groupBy("id").agg(F.count("*").alias("_n"))
    out = facts.join(n, "id", "left")
    return out.withColumns({"times_derived": (F.col("times_derived") + F.coalesce("_n", F.lit(0))).cast("int"), "last_reinforced_at": F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_reinforced_at"))}).drop("_n").select(*facts.columns)


def set_deleted(facts: DataFrame, ids: DataFrame, now: Column, actor: str, event: str = "delete") -> tuple[DataFrame, DataFrame]:
    """Soft-delete listed facts: (facts, events), an event only for rows that were not deleted before."""
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = facts.join(mark, "id", "left")
    change = F.col("_hit") & F.col("deleted_at").isNull()
    events = joined.where(change).select("workspace_name", F.col("id").alias("conclusion_id"), F.lit(event).alias("event"), F.lit(actor).alias("actor"), F.col("content").alias("before"), now.alias("created_at"))
    return joined.withColumn("deleted_at", F.when(change, now).otherwise(F.col("deleted_at"))).select(*facts.columns), events


def restore(facts: DataFrame, ids: DataFrame, now: Column, actor: str) -> tuple[DataFrame, DataFrame]:
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = facts.join(mark, "id", "left")
    change = F.col("_hit") & F.col("deleted_at").isNotNull()
    events = joined.where(change).select("workspace_name", F.col("id").alias("conclusion_id"), F.lit("restore").alias("event"), F.lit(actor).alias("actor"), F.col("content").alias("after"), now.alias("created_at"))
    return joined.withColumn("deleted_at", F.when(~F.coalesce(change, F.lit(False)), F.col("deleted_at"))).select(*facts.columns), events


def expire(facts: DataFrame, links: DataFrame, now: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Soft-delete due facts (the first `limit` of them, if given) and unlink their entities: (facts, events, links)."""
    due = facts.where(F.col("deleted_at").isNull() & (F.col("expires_at") <= now))
    due = (due if limit is None else due.orderBy("expires_at", "id").limit(limit)).select("workspace_name", "id")
    out, events = set_deleted(facts, due, now, "reconciler", "expire")
    return out, events, unlink(links, due.withColumnRenamed("id", "conclusion_id"))


def archive_candidates(facts: DataFrame, now: Column, before: Column) -> DataFrame:
    """Explicit facts derived once and not reinforced since `before`, on which no live fact rests."""
    live = live_facts(facts, now)
    used = live.select("workspace_name", F.explode("source_ids").alias("id")).distinct()
    return live.where((F.col("level") == "explicit") & (F.col("times_derived") == 1) & (F.col("last_reinforced_at") < before)).join(used, ["workspace_name", "id"], "left_anti")


def set_vectors(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Fill in (id, embedding) and mark synced. Of an id given several times the least vector counts; null ones set nothing."""
    v = vectors.where("embedding is not null").groupBy("id").agg(F.min("embedding").alias("_v"))
    out = facts.join(v, "id", "left")
    return out.withColumns({"embedding": F.coalesce("_v", "embedding"), "sync_state": F.when(F.col("_v").isNotNull(), F.lit("synced")).otherwise(F.col("sync_state"))}).select(*facts.columns)


def mark_failed(facts: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = facts.join(hit, "id", "left")
    events = out.where("_hit").select("workspace_name", F.col("id").alias("conclusion_id"), F.lit("sync_failed").alias("event"), F.lit("reconciler").alias("actor"), now.alias("created_at"))
    return out.withColumn("sync_state", F.when(F.col("_hit"), F.lit("failed")).otherwise(F.col("sync_state"))).select(*facts.columns), events


def inject(content: str, pair: tuple[str, str, str], session: str, facts: DataFrame, now: Column, embed, analyzer, actor: str = "api") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One explicit fact written by hand through all three stages: (outcomes, changed facts, events)."""
    from palimpsest.operators.model import finish_drafts

    row = facts.sparkSession.range(1).select(*[F.lit(v).alias(c) for c, v in zip(PAIR, pair)], F.lit(session).alias("session_name"), F.lit(content).alias("content"), F.lit("explicit").alias("level"), F.lit(0).alias("position"))
    draft = finish_drafts(row, analyzer).withColumn("embedding", embed(F.col("content")))
    outcomes, changed = upsert_in_order(draft, facts, now)
    return outcomes, changed, outcome_events(outcomes, actor, now)
