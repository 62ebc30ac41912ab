"""Named entities of a workspace and their links to the facts of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.signals import clamp01, count_weight
from palimpsest.functions.text import entity_norm, strip
from palimpsest.functions.vectors import cosine_distance, norm, similarity
from palimpsest.schemas import PAIR

MERGE_AT = 0.95


def link_counts(links: DataFrame, facts: DataFrame) -> DataFrame:
    """Links of an entity within a pair to facts that are not deleted (expired ones count)."""
    live = facts.where("deleted_at is null").select(*PAIR, F.col("id").alias("conclusion_id"))
    return links.join(live, [*PAIR, "conclusion_id"], "left_semi").groupBy(*PAIR, "entity_id").agg(F.count("*").alias("link_count"))


def match_entities(queries: DataFrame, entities: DataFrame, links: DataFrame, facts: DataFrame, top_k: int = 10) -> DataFrame:
    """For each query (qid, pair, query_vector) the entities of its pair nearest to it: entity_id, name_norm, sim, link_count."""
    held = link_counts(links, facts).join(entities.where("embedding is not null").select("workspace_name", F.col("id").alias("entity_id"), "name_norm", "embedding", norm(F.col("embedding")).alias("_n")), ["workspace_name", "entity_id"])
    near = queries.select("qid", *PAIR, "query_vector", norm(F.col("query_vector")).alias("_qn")).join(held, list(PAIR)).withColumn("distance", cosine_distance(F.col("embedding"), F.col("query_vector"), F.col("_n"), F.col("_qn")))
    first = Window.partitionBy("qid").orderBy("distance", "entity_id")
    return near.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= top_k).select("qid", *PAIR, "entity_id", "name_norm", similarity(F.col("distance")).alias("sim"), "link_count")


def boosts(matches: DataFrame, links: DataFrame, cut: float = 0.5) -> DataFrame:
    """(qid, conclusion_id, ent, matched_entities): the best discounted similarity of a fact's entities at or above cut."""
    good = matches.where(F.col("sim") >= cut).withColumn("boost", clamp01(F.col("sim") * count_weight(F.col("link_count"))))
    per = good.join(links.select(*PAIR, "entity_id", "conclusion_id"), [*PAIR, "entity_id"])
    return per.groupBy("qid", "conclusion_id").agg(F.max("boost").alias("ent"), F.array_sort(F.collect_set("name_norm")).alias("matched_entities"))


def entities_for(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(conclusion_id, entity columns) of all links; order by name_norm to list one fact's."""
    named = entities.select("workspace_name", F.col("id").alias("entity_id"), "name_norm", "name_display", "kind")
    return links.select("workspace_name", "conclusion_id", "entity_id").distinct().join(named, ["workspace_name", "entity_id"])


def links_among(links: DataFrame, entity_ids: DataFrame, conclusion_ids: DataFrame) -> DataFrame:
    return links.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi").join(conclusion_ids.select("conclusion_id").distinct(), "conclusion_id", "left_semi")


def linked_conclusions(links: DataFrame, entity_id: str) -> DataFrame:
    return links.where(F.col("entity_id") == entity_id).orderBy("created_at", "conclusion_id").select("conclusion_id")


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    key = ["workspace_name", "entity_id", "conclusion_id"]
    fresh = new.dropDuplicates(key).join(links.select(*key), key, "left_anti")
    return links.unionByName(fresh, allowMissingColumns=True)


def unlink(links: DataFrame, conclusion_ids: DataFrame) -> DataFrame:
    return links.join(conclusion_ids.select("workspace_name", "conclusion_id").distinct(), ["workspace_name", "conclusion_id"], "left_anti")


def without_orphans(entities: DataFrame, links: DataFrame) -> DataFrame:
    used = links.select("workspace_name", F.col("entity_id").alias("id")).distinct()
    return entities.join(used, ["workspace_name", "id"], "left_semi")


def orphans(entities: DataFrame, links: DataFrame) -> DataFrame:
    return entities.join(links.select("workspace_name", F.col("entity_id").alias("id")).distinct(), ["workspace_name", "id"], "left_anti")


def named(names: DataFrame) -> DataFrame:
    """Names of facts (workspace_name, conclusion_id, name, position) normalised: blank ones go, the first display form of a name stays."""
    rows = names.withColumn("name_norm", entity_norm(F.col("name"))).where("name_norm <> ''")
    first = F.min_by(strip(F.col("name")), "position").over(Window.partitionBy("workspace_name", "name_norm"))
    return rows.withColumn("name_display", first).dropDuplicates(["workspace_name", "conclusion_id", "name_norm"]).drop("name")


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Where each distinct (workspace_name, name_norm, embedding) goes: entity_id, how ('exact', 'merged' or 'new').

    An equal name wins; else the nearest entity of the workspace with a similarity of 0.95 or more, ties to the smaller
    id; else a new entity, its id hashed from workspace and name. Names go in order of `position` (of name_norm, where
    that is missing or equal), and each sees the entities that earlier ones of the call have become. Names without an
    equal one are folded in one task a workspace, since each depends on those before it; the entities given are compared
    in a join before. Of a name given twice the first counts.
    """
    import numpy as np
    import pandas as pd

    order = "position" if "position" in names.columns else "name_norm"
    first = names.groupBy("workspace_name", "name_norm").agg(F.min_by("embedding", F.col(order)).alias("embedding"), F.min(order).alias("_at"))
    exact = first.join(entities.groupBy("workspace_name", "name_norm").agg(F.min("id").alias("entity_id")), ["workspace_name", "name_norm"], "left")
    have = exact.where("entity_id is not null").select("workspace_name", "name_norm", "entity_id", F.lit("exact").alias("how"))
    rest = exact.where("entity_id is null").drop("entity_id")
    near = rest.where("embedding is not null").withColumn("_qn", norm(F.col("embedding"))).join(entities.where("embedding is not null").select("workspace_name", F.col("id").alias("entity_id"), F.col("embedding").alias("_e"), norm(F.col("embedding")).alias("_n")), "workspace_name")
    near = near.withColumn("sim", similarity(cosine_distance(F.col("_e"), F.col("embedding"), F.col("_n"), F.col("_qn")))).where(F.col("sim") >= MERGE_AT)
    best = near.groupBy("workspace_name", "name_norm").agg(F.min(F.struct((-F.col("sim")).alias("far"), F.col("entity_id").alias("id"))).alias("best"))
    fresh = F.substring(F.sha2(F.concat_ws(":", "workspace_name", "name_norm"), 256), 1, 21)
    rest = rest.join(best, ["workspace_name", "name_norm"], "left")
    rest = rest.select("workspace_name", "name_norm", "embedding", "_at", F.col("best.id").alias("id"), (-F.col("best.far")).alias("sim"), fresh.alias("fresh"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_at", "name_norm"], na_position="last")
        ids: list[str] = []
        held, out = None, []
        for x, old, sim, new in zip(rows["embedding"], rows["id"], rows["sim"], rows["fresh"]):
            at, score = (old, sim) if isinstance(old, str) else (None, -1.0)
            v = None
            if x is not None and len(x):
                v = np.asarray(x, np.float64)
                n = np.sqrt((v * v).sum())
                v = v / n if n else None
            if v is not None and ids:
                sims = np.clip(held[: len(ids)] @ v, 0, 1)
                top = float(sims.max())
                if top >= MERGE_AT and top >= score:
                    least = min(ids[i] for i in np.flatnonzero(sims == top))
                    at = min(at, least) if top == score else least
            out.append((at or new, "merged" if at else "new"))
            if not at and v is not None:
                if held is None:
                    held = np.zeros((64, len(v)))
                elif len(ids) == len(held):
                    held = np.concatenate([held, np.zeros_like(held)])
                held[len(ids)] = v
                ids.append(new)
        return pd.DataFrame({"workspace_name": rows["workspace_name"], "name_norm": rows["name_norm"], "entity_id": [i for i, _ in out], "how": [h for _, h in out]})

    return have.union(rest.groupBy("workspace_name").applyInPandas(fold, "workspace_name string, name_norm string, entity_id string, how string"))


def missing_vectors(entities: DataFrame, limit: int) -> DataFrame:
    return entities.where("embedding is null").orderBy("created_at", "id").limit(limit)


def with_vectors(entities: DataFrame, embed, column: str = "name_norm") -> DataFrame:
    """Fill missing vectors by embed(Column) -> Column; the others stay."""
    lacking = entities.where("embedding is null").withColumn("embedding", embed(F.col(column)))
    return entities.where("embedding is not null").unionByName(lacking)


def nearest_entity(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, entity_id, sim): the nearest entity of the query's workspace."""
    d = queries.select("qid", "workspace_name", "query_vector", norm(F.col("query_vector")).alias("_qn")).join(entities.where("embedding is not null").select("workspace_name", F.col("id").alias("entity_id"), "embedding", norm(F.col("embedding")).alias("_n")), "workspace_name")
    d = d.withColumn("_d", cosine_distance(F.col("embedding"), F.col("query_vector"), F.col("_n"), F.col("_qn")))
    return d.groupBy("qid").agg(F.min_by("entity_id", F.struct("_d", "entity_id")).alias("entity_id"), similarity(F.min("_d")).alias("sim"))


