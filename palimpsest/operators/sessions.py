"""Sessions: membership over time, who could hear what, fan-out to observers, and context within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import format_message

MEMBER = ["workspace_name", "session_name", "peer_name"]
SUMMARY_SHARE = 0.40
MAX_WINDOW = 5000


def present_at(t: Column, joined: str = "joined_at", left: str = "left_at") -> Column:
    return (F.col(joined) <= t) & (F.col(left).isNull() | (F.col(left) > t))


def membership_windows(events: DataFrame) -> DataFrame:
    """Half-open windows from join and leave events (member key, kind, at, seq): a join opens one if none is open, a leave closes it."""
    w = Window.partitionBy(*MEMBER).orderBy("at", "seq")
    turn = events.withColumn("_before", F.lag("kind").over(w)).where("kind <> coalesce(_before, 'leave')")
    closed = turn.withColumn("left_at", F.lead("at").over(w)).where("kind = 'join'")
    return closed.select(*MEMBER, F.col("at").alias("joined_at"), "left_at")


def current_members(events: DataFrame) -> DataFrame:
    """The single membership row of each member: joined_at of the last (re-)entry, left_at if it left since."""
    rows = membership_windows(events)
    last = rows.groupBy(*MEMBER).agg(F.max(F.struct("joined_at", "left_at")).alias("m"))
    return last.select(*MEMBER, "m.joined_at", "m.left_at")


def members_at(windows: DataFrame, t: Column) -> DataFrame:
    return windows.where(present_at(t)).select(*MEMBER).distinct().orderBy(*MEMBER)


def all_members(members: DataFrame) -> DataFrame:
    return members.select(*MEMBER).distinct().orderBy(*MEMBER)


def replace_roster(members: DataFrame, staying: DataFrame, now: Column) -> DataFrame:
    """Members of the sessions that `staying` lists, marked left unless listed; other sessions are unchanged."""
    sessions = staying.select("workspace_name", "session_name").distinct().withColumn("_s", F.lit(True))
    keep = staying.select(*MEMBER).distinct().withColumn("_k", F.lit(True))
    j = members.join(sessions, ["workspace_name", "session_name"], "left").join(keep, MEMBER, "left")
    gone = F.col("_s") & F.col("_k").isNull() & F.col("left_at").isNull()
    return j.withColumn("left_at", F.when(gone, now).otherwise(F.col("left_at"))).select(*members.columns)


def audible(messages: DataFrame, windows: DataFrame, peer: str) -> DataFrame:
    """Messages sent while the peer was in the session: a semi-join on the session with a range condition."""
    w = windows.where(F.col("peer_name") == peer).select(F.col("workspace_name").alias("_w"), F.col("session_name").alias("_s"), "joined_at", "left_at")
    return messages.join(w, (F.col("workspace_name") == F.col("_w")) & (F.col("session_name") == F.col("_s")) & present_at(F.col("created_at")), "left_semi")


def fan_out(messages: DataFrame, members: DataFrame, observe_me: bool = True, observe_others: bool = True) -> DataFrame:
    """(message id, observer, observed): the speaker's own pair if it observes itself (present or not), and every other member's
    that was present and observes others. Null flags take the workspace's default."""
    own = messages.join(members.select(*MEMBER, "observe_me"), MEMBER, "left").where(F.coalesce("observe_me", F.lit(observe_me)))
    own = own.select("id", "workspace_name", F.col("peer_name").alias("observer"), F.col("peer_name").alias("observed"))
    m = members.select("workspace_name", "session_name", F.col("peer_name").alias("observer"), "observe_others", "joined_at", "left_at")
    heard = messages.join(m, ["workspace_name", "session_name"])
    heard = heard.where((F.col("observer") != F.col("peer_name")) & present_at(F.col("created_at")) & F.coalesce("observe_others", F.lit(observe_others)))
    return own.unionByName(heard.select("id", "workspace_name", "observer", F.col("peer_name").alias("observed")))


def budgeted_tail(messages: DataFrame, budget: Column, from_seq: Column, most: int | Column = MAX_WINDOW) -> DataFrame:
    """The newest messages of each session from from_seq on whose running token sum stays within budget; the newest one always."""
    w = Window.partitionBy("workspace_name", "session_name").orderBy(F.desc("seq_in_session"))
    rows = messages.where(F.col("seq_in_session") >= from_seq)
    rows = rows.withColumn("_rn", F.row_number().over(w)).withColumn("running_tokens", F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("_rn") <= most) & ((F.col("_rn") == 1) | (F.col("running_tokens") <= budget))).drop("_rn")


def choose_summary(sessions: DataFrame, budget: int) -> DataFrame:
    """Session key with the long summary if it fits the summaries' share of the budget, else the short one, else none."""
    share = int(budget * SUMMARY_SHARE)
    fits = lambda k: F.when(F.col("summaries")[k]["token_count"] <= share, F.col("summaries")[k])
    s = sessions.select("workspace_name", F.col("name").alias("session_name"), F.coalesce(fits("long"), fits("short")).alias("s"))
    return s.select(
        "workspace_name", "session_name", F.coalesce("s.text", F.lit("")).alias("summary"), F.coalesce("s.token_count", F.lit(0)).alias("summary_tokens"),
        (F.coalesce("s.covers_through_seq", F.lit(0)) + 1).alias("from_seq"),
    )


def contexts(sessions: DataFrame, messages: DataFrame, budget: int) -> DataFrame:
    """Per session: summary, kept messages (oldest first), start_seq and token counts, for a token budget."""
    chosen = choose_summary(sessions, budget)
    rows = messages.join(chosen, ["workspace_name", "session_name"])
    kept = budgeted_tail(rows, F.lit(budget) - F.col("summary_tokens"), F.col("from_seq"), max(1, min(MAX_WINDOW, budget // 2)))
    per = kept.groupBy("workspace_name", "session_name").agg(
        F.array_sort(F.collect_list(F.struct("seq_in_session", "peer_name", "content", "created_at"))).alias("messages"), F.min("seq_in_session").alias("_start"), F.sum("token_count").alias("message_tokens"),
    )
    out = chosen.join(per, ["workspace_name", "session_name"], "left")
    return out.select("workspace_name", "session_name", "summary", "summary_tokens", F.coalesce("messages", F.array()).alias("messages"), F.coalesce("_start", "from_seq").alias("start_seq"), F.coalesce("message_tokens", F.lit(0)).alias("message_tokens"))


def render(context: DataFrame) -> DataFrame:
    """Session key and one text: the earlier summary, then the recent messages."""
    lines = F.array_join(F.transform("messages", lambda m: format_message(m["peer_name"], m["content"], m["created_at"])), "\n")
    earlier = F.when(F.col("summary") != "", F.concat(F.lit("Earlier:\n"), F.col("summary")))
    recent = F.when(F.size("messages") > 0, F.concat(F.lit("Recent:\n"), lines))
    return context.select("workspace_name", "session_name", F.concat_ws("\n\n", earlier, recent).alias("text"))


def transcript(messages: DataFrame) -> DataFrame:
    """One text a session, messages in order."""
    line = F.struct("seq_in_session", format_message(F.col("peer_name"), F.col("content"), F.col("created_at")).alias("l"))
    return messages.groupBy("workspace_name", "session_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("text"))


def history_within(messages: DataFrame, budget: int) -> DataFrame:
    """Newest messages of each session while the running sum does not exceed budget; possibly none."""
    w = Window.partitionBy("workspace_name", "session_name").orderBy(F.desc("seq_in_session")).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("running_tokens", F.sum("token_count").over(w)).where(F.col("running_tokens") <= budget)


def due_summaries(messages: DataFrame, covered: DataFrame, every: int = 20) -> DataFrame:
    """Sessions with at least `every` messages after the covered ones: key, pending, and how many of them are fed (at most 4 * every)."""
    n = messages.groupBy("workspace_name", "session_name").agg(F.count("*").alias("total"))
    d = n.join(covered, ["workspace_name", "session_name"], "left").withColumn("pending", F.col("total") - F.coalesce("covers_through_seq", F.lit(0)))
    return d.where(F.col("pending") >= every).select("workspace_name", "session_name", "pending", F.least("pending", F.lit(4 * every)).alias("fed"))


def ingest(messages: DataFrame, new: DataFrame, members: DataFrame, count_tokens, observe_me: bool = True, observe_others: bool = True) -> tuple[DataFrame, DataFrame]:
    """Number new messages, count their tokens by count_tokens(Column), and queue one representation item for each message and
    pair and one summary item for each message: (messages, queue items). Limits on batch size are the caller's."""
    from palimpsest.functions.text import key_of
    from palimpsest.operators.tables import append_messages

    new = new.withColumn("token_count", count_tokens(F.col("content")).cast("int"))
    table = append_messages(messages, new)
    key = ["workspace_name", "session_name"]
    last = messages.groupBy(*key).agg(F.max("seq_in_session").alias("_last"))
    added = table.join(new.select(*key).distinct(), key, "left_semi").join(last, key, "left").where(F.col("seq_in_session") > F.coalesce("_last", F.lit(0)))
    pairs = fan_out(added, members, observe_me, observe_others).join(added.select("id", "session_name", "token_count", "created_at"), "id")
    work = pairs.select("workspace_name", key_of(F.lit("representation"), F.col("workspace_name"), F.col("session_name"), F.col("observer"), F.col("observed")).alias("work_unit_key"), F.lit("representation").alias("task_type"), F.col("id").cast("string").alias("payload"), "token_count", "created_at")
    s = F.col("session_name")
    summary = added.select("workspace_name", key_of(F.lit("summary"), F.col("workspace_name"), s, s, s).alias("work_unit_key"), F.lit("summary").alias("task_type"), F.col("id").cast("string").alias("payload"), "token_count", "created_at")
    return table, work.unionByName(summary)
