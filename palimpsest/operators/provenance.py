"""What facts rest on: premises over several steps, the messages behind them, and what rests on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.tables import live_facts
from palimpsest.sources.segments import new_folder, staged

DEPTH = 4


def premise_edges(facts: DataFrame) -> DataFrame:
    """(workspace_name, id, premise): one row for each source id of a fact."""
    return facts.select("workspace_name", "id", F.explode("source_ids").alias("premise")).where("premise is not null").distinct()


def premise_table(facts: DataFrame) -> DataFrame:
    """What walks need of facts, without texts and vectors, written once: each step reads this narrow table."""
    columns = ["workspace_name", "id", "source_ids", *[c for c in ("message_ids", "expires_at") if c in facts.columns]]
    return staged(facts.select(*columns, "deleted_at"))


def premises(roots: DataFrame, facts: DataFrame, depth: int = DEPTH, table: DataFrame | None = None) -> DataFrame:
    """(workspace_name, root, premise, depth): undeleted facts below each root, at their least depth, at most `depth` steps away.

    Each step is one join of the frontier with the edges; what a root has seen (itself too) is not visited again, so
    cycles end. A deleted premise is not shown, and nothing below it is reached through it. Every frontier is written
    before the next step reads it, so that a step's plan does not hold the steps before, and a walk ends when nothing
    is left to visit. table: premise_table(facts), if there is one already.
    """
    known = premise_table(facts) if table is None else table
    edges = known.select("workspace_name", F.col("id").alias("at"), F.explode("source_ids").alias("to")).where("to is not null").distinct()
    alive = known.where("deleted_at is null").select("workspace_name", F.col("id").alias("to"), F.lit(True).alias("alive"))
    edges = staged(edges.join(alive, ["workspace_name", "to"], "left").select("workspace_name", "at", "to", F.coalesce("alive", F.lit(False)).alias("alive")))
    path = new_folder(facts.sparkSession, "walk")
    start = roots.select("workspace_name", F.col("id").alias("root")).distinct()
    seen = staged(start.select("workspace_name", "root", F.col("root").alias("at"), F.lit(0).alias("depth"), F.lit(True).alias("alive")), path)
    for step in range(1, depth + 1):
        # a root itself may be deleted; other deleted facts have been seen, but lead nowhere
        frontier = seen.where(f"depth = {step - 1} and alive")
        found = frontier.select("workspace_name", "root", "at").join(edges, ["workspace_name", "at"]).select("workspace_name", "root", F.col("to").alias("at"), "alive").distinct()
        found = found.join(seen.select("workspace_name", "root", "at"), ["workspace_name", "root", "at"], "left_anti")
        seen = staged(found.select("workspace_name", "root", "at", F.lit(step).alias("depth"), "alive"), path)  # seen was listed before it grows
        if step < depth and seen.where(f"depth = {step} and alive").isEmpty():
            break
    return seen.where("depth > 0 and alive").select("workspace_name", "root", F.col("at").alias("premise"), "depth")


def evidence(roots: DataFrame, facts: DataFrame, messages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root, message columns): the messages of each root and of all its premises, each once."""
    table = premise_table(facts)
    below = premises(roots, facts, depth, table).select("workspace_name", "root", F.col("premise").alias("id"))
    own = roots.select("workspace_name", F.col("id").alias("root")).distinct().withColumn("id", F.col("root"))
    ids = below.unionByName(own).join(table.select("workspace_name", "id", "message_ids"), ["workspace_name", "id"])
    ids = ids.select("workspace_name", "root", F.explode("message_ids").alias("id")).distinct()
    return ids.join(messages, ["workspace_name", "id"])


def unresolved(roots: DataFrame, facts: DataFrame) -> DataFrame:
    """(root, missing): direct source ids of a root that no undeleted fact answers to."""
    direct = roots.select("workspace_name", F.col("id").alias("root")).join(facts.select("workspace_name", F.col("id").alias("root"), F.explode("source_ids").alias("id")), ["workspace_name", "root"]).distinct()
    return direct.join(facts.where("deleted_at is null").select("workspace_name", "id"), ["workspace_name", "id"], "left_anti").select("root", F.col("id").alias("missing"))


def dependents(roots: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """(root, id): live facts that name a root as a source."""
    return premise_edges(live_facts(facts, now)).join(roots.select("workspace_name", F.col("id").alias("premise")).distinct(), ["workspace_name", "premise"]).select(F.col("premise").alias("root"), "id")


def reasoning_chain(roots: DataFrame, facts: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """One row a root: its premises, messages, unresolved ids and dependents, as sorted arrays."""
    facts, roots = premise_table(facts), staged(roots.select("workspace_name", "id").distinct())
    ids = roots.select(F.col("id").alias("root")).distinct()
    own = roots.select("workspace_name", F.col("id").alias("root")).withColumns({"premise": F.lit(None).cast("string"), "id": F.col("root")})
    # one walk gives the premises and, with the roots themselves, the facts whose messages count
    walk = premises(roots, facts, table=facts).select("workspace_name", "root", "premise", F.col("premise").alias("id")).unionByName(own)
    rows = walk.join(facts.select("workspace_name", "id", F.explode_outer("message_ids").alias("_m")), ["workspace_name", "id"], "left")
    rows = rows.join(messages.select("workspace_name", F.col("id").alias("_m"), F.col("id").alias("_known")), ["workspace_name", "_m"], "left")
    chain = rows.groupBy("root").agg(F.array_sort(F.collect_set("premise")).alias("premises"), F.array_sort(F.collect_set("_known")).alias("messages"))
    u = unresolved(roots, facts).groupBy("root").agg(F.array_sort(F.collect_set("missing")).alias("unresolved"))
    d = dependents(roots, facts, now).groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("dependents"))
    out = ids.join(chain, "root", "left").join(u, "root", "left").join(d, "root", "left")
    return out.select("root", *[F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c) for c in ("premises", "messages", "unresolved", "dependents")])


def entity_provenance(entity_id: str, pair: tuple[str, str, str], links: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """The first `limit` undeleted facts linked to an entity within a pair, in order of linking; give them to reasoning_chain."""
    own = links.where((F.col("entity_id") == entity_id) & (F.col("workspace_name") == pair[0]) & (F.col("observer") == pair[1]) & (F.col("observed") == pair[2]))
    rows = own.select("workspace_name", F.col("conclusion_id").alias("id"), F.col("created_at").alias("linked_at")).join(facts.where("deleted_at is null").drop("embedding"), ["workspace_name", "id"])
    return rows.orderBy("linked_at", "id").limit(limit)


def valid_premises(drafts: DataFrame, facts: DataFrame) -> DataFrame:
    """Drafts (draft_id, workspace_name, source_ids) with only the sources that exist undeleted; those left without any go."""
    ok = drafts.select("draft_id", "workspace_name", F.posexplode("source_ids").alias("_i", "id")).join(facts.where("deleted_at is null").select("workspace_name", "id"), ["workspace_name", "id"], "left_semi")
    kept = ok.groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "id"))), lambda x: x["id"]).alias("source_ids"))
    return drafts.drop("source_ids").join(kept, "draft_id")
