"""Streaming forms: messages that arrive are fanned out, and work units are gated by tokens, age and idleness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.sessions import fan_out
from palimpsest.operators.work import Gates

GATED = "work_unit_key string, tokens long, items long, oldest timestamp, newest timestamp, reason string"
STATE = "tokens long, items long, oldest long, newest long"


def stream_fan_out(messages: DataFrame, members: DataFrame, observe_me: bool = True, observe_others: bool = True) -> DataFrame:
    """Pairs to serve for each arriving message: a stream joined with the (static) membership table."""
    return fan_out(messages, members, observe_me, observe_others)


def gate(queue: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Units that become ready, from a stream of queue items (work_unit_key, token_count, created_at).

    A unit's state is its sums and times. Enough tokens release it at once; else a processing-time timer releases it
    when its last item is idle_s old or its first max_age_s. Released units start afresh. State is four numbers a key.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, items, oldest, newest = state.get if state.exists else (0, 0, None, None)
        if state.hasTimedOut:
            state.remove()
            now = state.getCurrentProcessingTimeMs()
            reason = "age" if oldest is not None and now - oldest >= gates.max_age_s * 1000 else "idle"
            yield _released(key[0], tokens, items, oldest, newest, reason)
            return
        for pdf in batches:
            at = pdf["created_at"].astype("datetime64[ms]").astype("int64")
            tokens += int(pdf["token_count"].sum())
            items += len(pdf)
            oldest = int(at.min()) if oldest is None else min(oldest, int(at.min()))
            newest = int(at.max()) if newest is None else max(newest, int(at.max()))
        now = state.getCurrentProcessingTimeMs()
        if tokens >= gates.tokens or now - oldest >= gates.max_age_s * 1000:
            if state.exists:
                state.remove()
            yield _released(key[0], tokens, items, oldest, newest, "tokens" if tokens >= gates.tokens else "age")
            return
        state.update((tokens, items, oldest, newest))
        state.setTimeoutDuration(max(1, min(gates.idle_s * 1000, gates.max_age_s * 1000 - (now - oldest))))

    return queue.groupBy("work_unit_key").applyInPandasWithState(step, GATED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _released(key: str, tokens: int, items: int, oldest: int, newest: int, reason: str) -> pd.DataFrame:
    return pd.DataFrame({"work_unit_key": [key], "tokens": [tokens], "items": [items], "oldest": pd.to_datetime([oldest], unit="ms"), "newest": pd.to_datetime([newest], unit="ms"), "reason": [reason]})


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Feed a stream's micro-batches to a writer of tables. handle gets (batch, epoch) and must be idempotent by epoch:
    after a failure Spark repeats an epoch with the same rows."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def token_windows(queue: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tokens and items a key and event-time window, with a watermark that bounds the state."""
    w = queue.withWatermark("created_at", late).groupBy(F.window("created_at", every), "work_unit_key")
    return w.agg(F.sum("token_count").alias("tokens"), F.count("*").alias("items")).select(F.col("window.start").alias("window_start"), "work_unit_key", "tokens", "items")
