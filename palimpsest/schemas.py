"""Tables of the data model and checks on their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations of the data model.
LEVEL_WEIGHTS = {"explicit": 1.0, "deductive": 0.9, "inductive": 0.8, "contradiction": 0.6}
EVENTS = ("add", "reinforce", "replace", "delete", "expire", "restore", "sync_failed")
ACTORS = ("deriver", "dreamer", "dedup", "api", "reconciler")
SYNC_STATES = ("pending", "synced", "failed")
TASKS = ("representation", "summary", "reconciler", "deletion", "dream", "card_refresh")
OUTCOMES = ("INSERTED", "REINFORCED", "REPLACED")

PAIR = ("workspace_name", "observer", "observed")


# Column lists, parsed on use (parsing needs a session).
TABLES = {
    "workspaces": ("name string not null, metadata string, configuration string, created_at timestamp"),
    "peers": ("workspace_name string not null, name string not null, metadata string, configuration string, created_at timestamp"),
    "sessions": (
        "workspace_name string not null, name string not null, is_active boolean, message_seq bigint, metadata string, configuration string,"
        " summaries map<string, struct<text: string, token_count: int, covers_through_seq: bigint>>, created_at timestamp"
    ),
    "session_peers": ("workspace_name string, session_name string, peer_name string, observe_me boolean, observe_others boolean, joined_at timestamp, left_at timestamp"),
    "session_peer_windows": ("workspace_name string, session_name string, peer_name string, joined_at timestamp, left_at timestamp"),
    "messages": ("id bigint, workspace_name string, session_name string, peer_name string, content string, seq_in_session bigint, token_count int, metadata string, created_at timestamp"),
    "collections": ("workspace_name string, observer string, observed string, last_dream_at timestamp, explicit_at_last_dream int"),
    "conclusions": (
        "id string, workspace_name string, observer string, observed string, session_name string, content string, content_norm string, content_analyzed string,"
        " content_hash string, level string, confidence float, source_ids array<string>, message_ids array<bigint>, times_derived int, last_reinforced_at timestamp,"
        " embedding array<float>, created_at timestamp, updated_at timestamp, expires_at timestamp, deleted_at timestamp, sync_state string"
    ),
    "entities": ("id string, workspace_name string, name_norm string, name_display string, kind string, embedding array<float>, created_at timestamp"),
    "entity_links": ("workspace_name string, observer string, observed string, entity_id string, conclusion_id string, created_at timestamp"),
    "conclusion_events": ("id bigint, workspace_name string, conclusion_id string, event string, actor string, before string, after string, detail string, created_at timestamp"),
    "queue": ("id bigint, workspace_name string, work_unit_key string, task_type string, payload string, token_count int, processed boolean, attempts int, last_error string, created_at timestamp"),
    "work_unit_claims": ("work_unit_key string, worker_id string, claimed_at timestamp, expires_at timestamp"),
    "dreams": ("id string, workspace_name string, observer string, observed string, status string, requeues int, created_at timestamp, updated_at timestamp"),
    "peer_cards": ("workspace_name string, observer string, observed string, lines array<string>, updated_at timestamp"),
}



def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


#: What fact reads return: all columns but the vector.
FACT_COLUMNS = [c.split()[0] for c in TABLES["conclusions"].split(", ") if not c.startswith("embedding ")]


def is_alive(now: Column) -> Column:
    return F.col("deleted_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def in_pair(workspace: str, observer: str, observed: str) -> Column:
    return (F.col("workspace_name") == workspace) & (F.col("observer") == observer) & (F.col("observed") == observed)


def violations(facts: DataFrame, dims: int | None = None) -> DataFrame:
    """(id, problem) of fact rows that the model forbids: levels, sync states, explicit facts without a session, vector width."""
    checks = [
        ("unknown level", ~F.col("level").isin(*LEVEL_WEIGHTS)),
        ("unknown sync state", ~F.col("sync_state").isin(*SYNC_STATES)),
        ("explicit without session", (F.col("level") == "explicit") & F.col("session_name").isNull()),
    ]
    if dims is not None:
        checks.append(("vector width", F.col("embedding").isNotNull() & (F.size("embedding") != dims)))
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks]), lambda x: x.isNotNull())
    return facts.select("id", F.explode(found).alias("problem"))


def duplicate_scopes(facts: DataFrame) -> DataFrame:
    """Live keys that occur more than once, which the model's uniqueness rule forbids."""
    live = facts.where("deleted_at is null")
    return live.groupBy(*PAIR, "level", F.coalesce("session_name", F.lit("")).alias("scope_session"), "content_hash").agg(F.count("*").alias("n")).where("n > 1")
