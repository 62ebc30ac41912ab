"""Stages that need a model: deriving facts, consolidating them, refreshing cards, answering questions. The model is injected."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import analyzed, card_lines, content_hash, normalize, strip, tokens_bigram
from palimpsest.operators.provenance import valid_premises
from palimpsest.schemas import PAIR

# Tool rounds by level of reasoning, and token bounds of the answering loop.
ROUNDS = {"minimal": 1, "low": 3, "medium": 6, "high": 10, "max": 16}
HISTORY_TOKENS, QUESTION_TOKENS, FINDING_TOKENS = 8000, 4000, 6000
INDUCTIVE_DAYS, DEFAULT_CONFIDENCE, CARD_FACTS = 365, 0.5, 150

DRAFT = "workspace_name string, observer string, observed string, session_name string, content string, level string, confidence double, source_ids array<string>, message_ids array<bigint>, entity_names array<string>, position int"
Extract = Callable[[pd.DataFrame], list[dict]]


def derive(units: DataFrame, extract: Extract, analyzer=tokens_bigram) -> DataFrame:
    """Drafts from units of work (pair, session_name, text, message_ids): extract gets one unit's row at a time, in its task.

    A draft lacks nothing that writing needs: stripped content, its normal form, hash and analysis, an id hashed from
    unit and place. Blank contents go. Explicit drafts get the unit's session.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in DRAFT.split(", ")]
        for pdf in batches:
            out = []
            for _, unit in pdf.iterrows():
                for i, d in enumerate(extract(unit.to_frame().T)):
                    base = {k: unit[k] for k in (*PAIR, "session_name")} | {"message_ids": list(unit["message_ids"]), "level": "explicit", "source_ids": [], "entity_names": [], "confidence": None}
                    out.append(base | d | {"position": i})
            yield pd.DataFrame(out, columns=names)

    return finish_drafts(units.mapInPandas(run, DRAFT), analyzer)


def finish_drafts(drafts: DataFrame, analyzer=tokens_bigram) -> DataFrame:
    d = drafts.withColumn("content", strip(F.col("content"))).where("content <> ''")
    d = d.withColumns({"content_norm": normalize(F.col("content")), "content_hash": content_hash(F.col("content")), "content_analyzed": analyzed(F.col("content"), analyzer)})
    return d.withColumn("draft_id", F.substring(F.sha2(F.concat_ws(":", *PAIR, "level", F.coalesce("session_name", F.lit("")), "content_hash", F.col("position").cast("string")), 256), 1, 21))


def consolidate(pairs: DataFrame, facts: DataFrame, specialists: list[tuple[str, Extract]], now: Column) -> DataFrame:
    """Drafts of the specialists (level, extract) over each pair's live facts: premises must exist, drafts without any go.

    Inductive drafts get a confidence within 0 and 1 (0.5 by default) and end after 365 days. One row of a pair
    carries its newest facts, 150 at most, so that a pair with many facts stays one bounded request.
    """
    from pyspark.sql import Window

    from palimpsest.operators.tables import live_facts

    rows = live_facts(facts, now).join(pairs.select(*PAIR).distinct(), list(PAIR), "left_semi")
    newest = Window.partitionBy(*PAIR).orderBy(F.desc("created_at"), "id")
    rows = rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= CARD_FACTS)
    units = rows.groupBy(*PAIR).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "id", "content"))), lambda x: F.concat(x["id"], F.lit("\t"), x["content"])), "\n").alias("text"))
    units = units.withColumns({"session_name": F.lit(None).cast("string"), "message_ids": F.array().cast("array<bigint>")})
    out = None
    for level, extract in specialists:
        d = derive(units, extract).withColumn("level", F.lit(level))
        out = d if out is None else out.unionByName(d)
    out = valid_premises(out.withColumn("draft_id", F.concat_ws("-", "level", "draft_id")), facts)
    inductive = F.col("level") == "inductive"
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))))
    return out.withColumns({"confidence": F.when(inductive, confidence).otherwise(F.col("confidence")), "expires_at": F.when(inductive, now + F.make_interval(days=F.lit(INDUCTIVE_DAYS)))})


def refresh_cards(pairs: DataFrame, facts: DataFrame, propose: Extract, now: Column) -> DataFrame:
    """(pair, lines): at most 40 valid profile lines that propose returns as contents for a pair's newest 150 facts."""
    from pyspark.sql import Window

    from palimpsest.operators.tables import live_facts

    rows = live_facts(facts, now).join(pairs.select(*PAIR).distinct(), list(PAIR), "left_semi")
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.desc("created_at"), "id"))).where(F.col("_rn") <= CARD_FACTS)
    units = rows.groupBy(*PAIR).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "content"))), lambda x: x["content"]), "\n").alias("text"))
    units = units.withColumns({"session_name": F.lit(None).cast("string"), "message_ids": F.array().cast("array<bigint>")})
    lines = derive(units, propose).groupBy(*PAIR).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]).alias("lines"))
    return lines.withColumn("lines", card_lines(F.col("lines")))


FOUND, ADVICE = "Results of the searches so far, newest first:", "The searches were cut short. Answer from these results alone, and say so if they do not suffice."


class _Meter:
    """Token counts and cuts by an encoding (encode, decode); without one, four characters count as a token."""

    def __init__(self, encoding=None):
        self.encoding = encoding

    def count(self, text: str) -> int:
        return len(self.encoding.encode(text)) if self.encoding else -(-len(text) // 4)

    def cut(self, text: str, most: int) -> str:
        if self.count(text) <= most:
            return text
        return self.encoding.decode(self.encoding.encode(text)[:most]) if self.encoding else text[: 4 * most]


def newest_within(turns: list[dict], most: int, meter: _Meter) -> list[dict]:
    """The longest run of last turns whose texts have at most `most` tokens together."""
    left = most
    for i in reversed(range(len(turns))):
        left -= meter.count(turns[i].get("text", ""))
        if left < 0:
            return turns[i + 1 :]
    return turns


def answer(question: str, backend, tools: dict[str, Callable[[dict], str]], level: str = "medium", now: dt.datetime | None = None, max_chars: int = 8000, history: list[dict] = (), encoding=None) -> dict:
    """Ask a chat back end, running the tools it calls, for as many rounds as the level allows; the last round has no tools.

    The back end returns {"text": ...} or {"tool_calls": [{"name", "arguments"}]}. A tool's error becomes its output, and an
    output is cut to max_chars. history (turns {"role", "text"}, oldest first) loses its oldest turns beyond HISTORY_TOKENS,
    and the question is cut to QUESTION_TOKENS. If the last round brings no text, the back end is asked once more with what
    the tools returned, newest first and cut to FINDING_TOKENS together with its frame, which is never cut itself.
    Returns text, rounds and the calls made.
    """
    meter = _Meter(encoding)
    start = [*newest_within(list(history), HISTORY_TOKENS, meter), {"role": "user", "text": meter.cut(question, QUESTION_TOKENS)}]
    turns: list[dict] = list(start)
    calls: list[dict] = []
    notes: list[str] = []
    ask = lambda turns, offered: backend.complete({"turns": turns, "tools": offered, "now": now.isoformat() if now else None})
    for i in range(ROUNDS[level] + 1):
        offered = sorted(tools) if i < ROUNDS[level] else []
        reply = ask(turns, offered)
        wanted = reply.get("tool_calls") or []
        if not wanted or not offered:
            text = reply.get("text") or ""
            if text.strip() or not notes:
                return {"text": text, "rounds": i + 1, "calls": calls}
            room = FINDING_TOKENS - meter.count(FOUND) - meter.count(ADVICE)
            found = "\n\n".join([FOUND, meter.cut("\n\n".join(reversed(notes)), room), ADVICE])
            return {"text": ask([*start, {"role": "user", "text": found}], []).get("text") or "", "rounds": i + 2, "calls": calls}
        turns.append({"role": "assistant_tool_use", "uses": [{"name": c["name"], "arguments": c.get("arguments", {})} for c in wanted]})
        results = []
        for c in wanted:
            try:
                text, failed = str(tools[c["name"]](c.get("arguments", {})))[:max_chars], False
            except Exception as e:  # the model may mend its call
                text, failed = f"{type(e).__name__}: {e}"[:max_chars], True
            calls.append({"name": c["name"], "failed": failed})
            notes.append(f"{c['name']} {json.dumps(c.get('arguments', {}), ensure_ascii=False)}: {'error: ' if failed else ''}{text}")
            results.append({"name": c["name"], "content": text, "is_error": failed})
        turns.append({"role": "tool_results", "results": results})
    raise AssertionError("unreachable")
