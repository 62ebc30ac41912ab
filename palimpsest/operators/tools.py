"""The seven look-ups that an answering model may call, each a bounded query over one pair rendered as text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import entity_norm, format_message, tokens_simple
from palimpsest.operators import provenance, recall, search, sessions
from palimpsest.schemas import in_pair
from palimpsest.settings import RecallSettings, tool_limit


@dataclass
class Memory:
    """The tables a tool set reads, for one pair at one instant. embed and analyze make Columns of a query's text."""

    pair: tuple[str, str, str]
    facts: DataFrame
    messages: DataFrame
    windows: DataFrame
    entities: DataFrame
    links: DataFrame
    now: dt.datetime
    embed: Callable[[Column], Column]
    analyze: Callable[[Column], Column] = tokens_simple
    settings: RecallSettings = RecallSettings()

    def instant(self, text: str | None, fallback: dt.datetime) -> dt.datetime:
        """An ISO instant, or a date at midnight UTC; anything else is the fallback."""
        try:
            at = dt.datetime.fromisoformat(str(text))
        except ValueError:
            return fallback
        return at if at.tzinfo else at.replace(tzinfo=dt.UTC)

    def heard(self) -> DataFrame:
        """Messages that the observer could hear."""
        return sessions.audible(self.messages.where(F.col("workspace_name") == self.pair[0]), self.windows, self.pair[1])

    def _rows(self, df: DataFrame, limit: int) -> str:
        lines = df.limit(limit).select(format_message(F.col("peer_name"), F.col("content"), F.col("created_at")).alias("l")).collect()
        return "\n".join(r.l for r in lines) or "(nothing found)"

    def recall(self, args: dict, where: Column | None = None) -> str:
        spark = self.facts.sparkSession
        limit = tool_limit(args.get("limit"))
        q = spark.range(1).select(F.lit(0).alias("qid"), *[F.lit(v).alias(k) for k, v in zip(("workspace_name", "observer", "observed"), self.pair)], F.lit(str(args.get("query", ""))).alias("t"))
        q = q.withColumns({"query_tokens": self.analyze(F.col("t")), "query_vector": self.embed(F.col("t"))})
        hits = recall.recall(q, self.facts, self.entities, self.links, F.lit(self.now), self.settings, limit, where).orderBy("rank").collect()
        return "\n".join(f"[{h.id}] {h.content} (derived {h.times_derived}x, {h.level})" for h in hits) or "(nothing found)"

    def search_temporal(self, args: dict) -> str:
        start, end = self.instant(args.get("from"), dt.datetime(1970, 1, 1, tzinfo=dt.UTC)), self.instant(args.get("to"), self.now)
        return self.recall(args, recall.reinforced_between(F.lit(start), F.lit(end)))

    def search_messages(self, args: dict) -> str:
        limit = tool_limit(args.get("limit"))
        return self._rows(search.search_text(self.heard(), str(args.get("query", "")), limit), limit)

    def grep_messages(self, args: dict) -> str:
        rows = search.grep(self.heard(), str(args.get("text", ""))).orderBy(F.desc("created_at"), F.desc("id"))
        return self._rows(rows, tool_limit(args.get("limit")))

    def messages_by_date(self, args: dict) -> str:
        start, end = self.instant(args.get("from"), dt.datetime(1970, 1, 1, tzinfo=dt.UTC)), self.instant(args.get("to"), self.now)
        return self._rows(search.between(self.heard(), F.lit(start), F.lit(end)), tool_limit(args.get("limit")))

    def reasoning_chain(self, args: dict) -> str:
        own = self.facts.where(in_pair(*self.pair))
        root = own.where(F.col("id") == str(args.get("conclusion_id", "")))
        chain = provenance.reasoning_chain(root.select("workspace_name", "id"), self.facts, self.messages, F.lit(self.now)).first()
        if chain is None:
            return "(no such conclusion)"
        part = lambda name, items: f"{name}: " + (", ".join(map(str, items)) or "none")
        return "\n".join([f"conclusion: {root.first().content}", part("derived from", chain.premises), part("said in", chain.messages), part("unresolved", chain.unresolved), part("supports", chain.dependents)])

    def entity_provenance(self, args: dict) -> str:
        name = self.facts.sparkSession.range(1).select(entity_norm(F.lit(str(args.get("entity", "")))).alias("n")).first().n
        entity = self.entities.where((F.col("workspace_name") == self.pair[0]) & (F.col("name_norm") == name)).first()
        if entity is None:
            return "(no such entity)"
        rows = provenance.entity_provenance(entity.id, self.pair, self.links, self.facts, tool_limit(args.get("limit"))).collect()
        return "\n".join(f"[{r.id}] {r.content}" for r in rows) or "(nothing linked)"

    def tools(self) -> dict[str, Callable[[dict], str]]:
        """By the names a model calls them; give them to palimpsest.operators.model.answer."""
        names = ("recall", "search_messages", "grep_messages", "messages_by_date", "search_temporal", "reasoning_chain", "entity_provenance")
        return {n: getattr(self, n) for n in names}
