"""Deduplicating writes as a stream: each scope's facts are keyed state that outlives batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.dedup import NEAR_DISTANCE, SCOPE, scope_session

# Schemas are built without a session, since the processor asks for them in workers.
_STRING, _STAMP = T.StringType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FACT = _struct(**dict.fromkeys(("content", "content_analyzed", "content_hash", "content_norm", "session_name"), _STRING), times_derived=T.IntegerType(), last_reinforced_at=_STAMP, created_at=_STAMP)
COLUMNS = FACT.names
OUTCOMES = _struct(
    **dict.fromkeys((*SCOPE, "draft_id", "kind"), _STRING), stage=T.IntegerType(), id=_STRING, replaced_id=_STRING, similarity=T.DoubleType(),
    times_derived=T.IntegerType(), last_reinforced_at=_STAMP, content=_STRING,
)
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind is kept by RocksDB, with changes alone written at each batch."""
    for key, value in ROCKS.items():
        spark.conf.set(key, value)


def _null(x):
    return None if x is None or (not hasattr(x, "__len__") and x != x) else x


def _stamp(x):
    return None if _null(x) is None else pd.Timestamp(x).to_pydatetime()


class ScopeWriter(StatefulProcessor):
    """One scope: its facts by id, ids by content hash and by normalised text in order of writing, and vectors by id.

    A draft that is found by hash or by text reads its entries alone; the scope's vectors are read once a batch, and only
    if some draft gets to the third stage.
    """

    def __init__(self, most: float, distinct_weight: int):
        self.most, self.distinct_weight = most, distinct_weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        one, ids = _struct(v=_STRING), _struct(ids=T.ArrayType(_STRING))
        self.facts = handle.getMapState("facts", one, FACT)
        self.vectors = handle.getMapState("vectors", one, _struct(x=T.ArrayType(T.FloatType())))
        self.by_hash = handle.getMapState("by_hash", one, ids)
        self.by_norm = handle.getMapState("by_norm", one, ids)

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.held = None
        for r in initialState.sort_values(["created_at", "id"], na_position="last").to_dict("records"):
            self._add(r["id"], r)

    def _ids(self, index, value) -> list[str]:
        k = (str(value),)
        return list(index.getValue(k)[0]) if value is not None and index.containsKey(k) else []

    def _add(self, fact_id: str, r: dict) -> None:
        row = {c: _null(r[c]) for c in COLUMNS}
        row |= {"times_derived": int(row["times_derived"]), "last_reinforced_at": _stamp(row["last_reinforced_at"]), "created_at": _stamp(row["created_at"])}
        self.facts.updateValue((fact_id,), tuple(row[c] for c in COLUMNS))
        for index, name in ((self.by_hash, "content_hash"), (self.by_norm, "content_norm")):
            if row[name] is not None:
                index.updateValue((row[name],), ([*self._ids(index, row[name]), fact_id],))
        if _null(r["embedding"]) is not None and len(r["embedding"]):
            self.vectors.updateValue((fact_id,), ([float(x) for x in r["embedding"]],))
            if self.held is not None:
                self.held[fact_id] = np.asarray(r["embedding"], np.float64)

    def _remove(self, fact_id: str) -> None:
        row = dict(zip(COLUMNS, self.facts.getValue((fact_id,))))
        for index, name in ((self.by_hash, "content_hash"), (self.by_norm, "content_norm")):
            left = [i for i in self._ids(index, row[name]) if i != fact_id]
            if left:
                index.updateValue((row[name],), (left,))
            elif row[name] is not None:
                index.removeKey((row[name],))
        self.facts.removeKey((fact_id,))
        self.vectors.removeKey((fact_id,))
        if self.held is not None:
            self.held.pop(fact_id, None)

    def _nearest(self, v) -> tuple[float, str] | None:
        """Distance 1 where a vector is zero or of another length; ties to the smaller id."""
        if self.held is None:
            self.held = {k[0]: np.asarray(x[0], np.float64) for k, x in self.vectors.iterator()}
        q = np.asarray(v, np.float64)
        best = None
        same = [i for i, x in self.held.items() if len(x) == len(q)]
        if same:
            x = np.stack([self.held[i] for i in same])
            size = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
            far = 1 - np.divide(x @ q, size, out=np.zeros(len(same)), where=size > 0)
            for j in np.flatnonzero(far <= far.min() + 1e-12):
                d = 1 - float((x[j] * q).sum()) / size[j] if size[j] else 1.0
                best = min(filter(None, (best, (d, same[j]))))
        if len(same) < len(self.held):
            best = min(filter(None, (best, (1.0, min(i for i, x in self.held.items() if len(x) != len(q))))))
        return best

    def _score(self, analyzed) -> int:
        t = (_null(analyzed) or "").split()
        return len(t) + self.distinct_weight * len(set(t))

    def _settle(self, r: dict) -> tuple:
        """Apply a draft; (kind, stage, id, replaced_id, similarity)."""
        for stage, index, name in ((1, self.by_hash, "content_hash"), (2, self.by_norm, "content_norm")):
            if found := self._ids(index, _null(r[name])):
                return self._reinforce(found[0], r, stage, None)
        if _null(r["embedding"]) is not None and len(r["embedding"]) and (near := self._nearest(r["embedding"])) and near[0] <= self.most:
            sim, old = max(0.0, min(1.0, 1 - near[0])), near[1]
            row = dict(zip(COLUMNS, self.facts.getValue((old,))))
            if self._score(r["content_analyzed"]) < self._score(row["content_analyzed"]):
                return self._reinforce(old, r, 3, sim)
            self._remove(old)
            self._add(r["draft_id"], r | {"times_derived": row["times_derived"] + 1, "last_reinforced_at": r["now"], "created_at": r["now"]})
            return "REPLACED", 3, r["draft_id"], old, sim
        self._add(r["draft_id"], r | {"times_derived": 1, "last_reinforced_at": r["now"], "created_at": r["now"]})
        return "INSERTED", 0, r["draft_id"], None, None

    def _reinforce(self, fact_id: str, r: dict, stage: int, sim: float | None) -> tuple:
        row = dict(zip(COLUMNS, self.facts.getValue((fact_id,))))
        row |= {"times_derived": row["times_derived"] + 1, "last_reinforced_at": _stamp(r["now"])}
        self.facts.updateValue((fact_id,), tuple(row[c] for c in COLUMNS))
        return "REINFORCED", stage, fact_id, None, sim

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.held = None
        drafts = pd.concat(list(rows)).sort_values(["position", "draft_id"])
        made = []
        for r in drafts.to_dict("records"):
            outcome = self._settle(r)
            now = dict(zip(COLUMNS, self.facts.getValue((outcome[2],))))
            made.append((*key, r["draft_id"], *outcome, now["times_derived"], now["last_reinforced_at"], now["content"]))
        yield pd.DataFrame(made, columns=OUTCOMES.names)


def stream_writes(drafts: DataFrame, facts: DataFrame | None = None, now: Column | None = None, most: float = NEAR_DISTANCE, distinct_weight: int = 1) -> DataFrame:
    """Outcomes of a stream of drafts, as dedup.upsert_in_order gives them, with the count, the time and the text of the fact that then holds the content.

    drafts: draft_id, position, fact columns; order holds within a micro-batch, and batches follow each other. facts: what the
    scopes held before the stream began, read by its first batch alone. now: a column of the drafts' time, else the clock.
    A scope's state is in the state store (see use_rocksdb), so that a stream that is started again goes on where it was; a
    batch that is repeated after a failure finds the state of the batch before it. A scope's drafts of a batch are one group.
    """
    at = F.current_timestamp() if now is None else now
    plain = ["content", "content_analyzed", "content_hash", "content_norm", "session_name", "embedding"]
    d = drafts.withColumn("scope_session", scope_session()).withColumn("now", at).select(*SCOPE, "draft_id", "position", "now", *plain)
    start = None
    if facts is not None:
        f = facts.where("deleted_at is null").withColumn("scope_session", scope_session())
        start = f.select(*SCOPE, "id", *plain, "times_derived", "last_reinforced_at", "created_at").groupBy(*SCOPE)
    return d.groupBy(*SCOPE).transformWithStateInPandas(
        statefulProcessor=ScopeWriter(most, distinct_weight), outputStructType=OUTCOMES, outputMode="Append", timeMode="None", initialState=start
    )
