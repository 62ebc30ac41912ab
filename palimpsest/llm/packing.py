"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions, trim
from palimpsest.llm.tokens import CACHE, Encoder, kept


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


def pack_block(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool = False, close: bool = True, least_cut: int = 8) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Pack examples (tokens, loss-bearing tokens) into bins of (example, start, length); also what stays open.

    The open bin takes, again and again, the fitting example whose demand vector has the largest dot product with
    the bin's remaining capacity, each dimension weighed by the examples' mean demand of it; ties go to the first.
    With cut, an example that fits in no bin as a whole may be divided: its beginning fills the gap (if that is of
    least_cut tokens at least) and the rest stays in the pool; loss-bearing tokens are divided from the example's
    end, where answers stand. Without close, the last bin is handed back as open pieces instead; with close and cut
    it is divided into bins whose lengths are powers of two, which need no padding.
    An example that exceeds a limit alone is an error without cut.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    n = len(tokens)
    demand = np.stack([np.asarray(tokens, float), np.ones(n), np.asarray(loss, float)], 1)
    if n and not cut and (demand > cap).any():
        raise ValueError("an example exceeds the limits alone")
    weight = demand.mean(0) / cap if n else cap * 0
    scaled = demand / cap * weight
    start = np.zeros(n, np.int64)
    live = np.ones(n, bool)
    left = n
    bins: list[list[tuple[int, int, int]]] = []
    while left:
        total = demand[live, 0].sum()
        room = cap.copy()
        last = total < limits.tokens
        if last and not close:
            return bins, [(int(i), int(start[i]), int(demand[i, 0])) for i in np.flatnonzero(live)]
        if last and cut:
            room[0] = 1 << (int(total).bit_length() - 1)
        content: list[tuple[int, int, int]] = []
        while left:
            score = np.where(live & (demand <= room).all(1), scaled @ (room / cap), -1.0)
            i = int(score.argmax())
            if score[i] >= 0:
                content.append((i, int(start[i]), int(demand[i, 0])))
                room -= demand[i]
                live[i] = False
                left -= 1
                if room[0] <= 0 or room[1] <= 0:
                    break
                continue
            if not (cut and room[1] >= 1 and (room[0] >= least_cut or last or not content)):
                break
            # the part before an example's loss-bearing tokens needs no room in that dimension
            part = np.minimum(demand[:, 0] - 1, np.minimum(room[0], demand[:, 0] - demand[:, 2] + room[2]))
            part = np.where(live, part, 0)
            i = int(part.argmax())
            k = int(part[i])
            if k < 1:
                break
            content.append((i, int(start[i]), k))
            took = max(0.0, k - (demand[i, 0] - demand[i, 2]))
            room -= (k, 1, took)
            start[i] += k
            demand[i, 0] -= k
            demand[i, 2] -= took
            scaled[i] = demand[i] / cap * weight
            if room[0] <= 0 or room[1] <= 0:
                break
        bins.append(content)
    return bins, []


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits(), block: int = 2048) -> DataFrame:
    """Place whole examples: id, n_tokens, n_loss, sequence_id, offset. No shuffle; each task packs blocks of rows.

    Null counts are 0. Examples above a limit raise an error (divide them first, or use pack_documents). Repeated
    rows are placed once each; an empty table gives no row; other columns are not read.
    """
    kind = examples.schema[id_col].dataType.simpleString()

    def run(batches):
        ids, sizes, losses, serial = [], [], [], [TaskContext.get().partitionId() << 40]
        id_type = None

        def flush():
            out = []
            for content in pack_block(np.array(sizes), np.array(losses), limits)[0]:
                at = 0
                for i, _, k in content:
                    out.append((ids[i], k, losses[i], serial[0], at))
                    at += k
                serial[0] += 1
            ids.clear(), sizes.clear(), losses.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate([id_type, *[pa.int64()] * 4])], names=["id", "n_tokens", "n_loss", "sequence_id", "offset"])

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t, x in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i), sizes.append(t), losses.append(x)
                if len(ids) == block:
                    yield flush()
        if ids:
            yield flush()

    src = examples.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"c{k}") for k, c in enumerate((tokens_col, loss_col))])
    return src.mapInArrow(run, f"id {kind}, n_tokens long, n_loss long, sequence_id long, offset long")


def pack_conversations(turns: DataFrame, path: str, end_id: int = 0, limits: Limits = Limits(2048, 8, 1536), block: int = 2048, cache: int = CACHE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", answers: str = "assistant") -> DataFrame:
    """Pack conversations whole into sequences; the ids of turns whose role is `answers` bear loss.

    One row per example: conv_id, part, n_tokens, n_loss, sequence_id, offset. A turn's ids are those of its text and
    end_id. A conversation within the limits is one example; a longer one is parted between turns as late as the limits
    allow, and a turn that exceeds them alone is cut. Null texts are empty, null roles bear no loss, turns of one number
    come in order of role and text, rows without a conv_id are conversations of one turn each, repeated rows are turns
    of their own, an empty table gives no row, other columns are not read. One shuffle brings a conversation's turns
    together; a task holds one turn and one block of counts.
    """
    kind = turns.schema[id_col].dataType.simpleString()
    names = ["conv_id", "part", "n_tokens", "n_loss", "sequence_id", "offset"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = kept(Encoder, path, cache)
        serial = TaskContext.get().partitionId() << 40
        wait: list[tuple] = []  # (conv_id, part, tokens, loss)
        now, part, tokens, loss = None, 0, 0, 0
        id_type = None

        def flush() -> pa.RecordBatch:
            nonlocal serial
            out = []
            for content in pack_block(np.array([w[2] for w in wait]), np.array([w[3] for w in wait]), limits)[0]:
                at = 0
                for i, _, k in content:
                    out.append((*wait[i], serial, at))
                    at += k
                serial += 1
            wait.clear()
            cols = list(zip(*out)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

        for b in batches:
            id_type = b.schema.field(0).type
            for c, text, answer in zip(*(x.to_pylist() for x in b.columns)):
                if c != now or c is None:
                    if tokens:
                        wait.append((now, part, tokens, loss))
                    now, part, tokens, loss = c, 0, 0, 0
                left = len(enc.ids(text)) // 4 + 1
                most = min(limits.tokens, limits.loss_tokens) if answer else limits.tokens
                while left:
                    k = min(left, most)
                    if tokens and (tokens + k > limits.tokens or loss + k * answer > limits.loss_tokens):
                        wait.append((now, part, tokens, loss))
                        part, tokens, loss = part + 1, 0, 0
                    tokens, loss, left = tokens + k, loss + k * answer, left - k
                if len(wait) >= block:
                    yield flush()
        if tokens:
            wait.append((now, part, tokens, loss))
        if id_type is not None:
            yield flush()
        trim()

    src = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # rows without an id have no conversation to meet, so they are spread
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0))
    dealt = src.withColumn("_s", spread).repartition(partitions(turns.sparkSession), "conv_id", "_s").sortWithinPartitions("conv_id", "_s", "turn", "role", "text")
    flag = F.coalesce(F.col("role") == answers, F.lit(False))
    return dealt.select("conv_id", "text", flag.alias("answer")).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, limits: Limits = Limits(), block: int = 2048, cache: int = CACHE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of every whole text, each ended by end_id, into sequences; one row per piece.

    Columns: doc_id, start (of the piece among its document's ids), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), doc_tokens, sequence_id, offset (in the sequence), segment (the piece's number there),
    loss_tokens (ids of the piece with a context in it or before it: all but the document's first).
    Whole stretches of as many ids as a sequence may hold are sequences of their own; the tails are packed by pack_block in blocks of
    rows, dividing some to fill gaps. Sequence ids are unique in the result, not consecutive. Null and empty texts have
    the end id alone; repeated rows are packed once each; null ids stay; an empty table gives no row; other columns are
    not read. In plain documents all ids bear loss but a first one, so that limits.loss_tokens binds only below
    limits.tokens; pack_conversations takes loss from roles. No shuffle: a task holds one block of tails and `cache` pre-tokens. Rerunning a task numbers its sequences as before.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size = min(limits.tokens, limits.loss_tokens)  # all ids but a document's first bear loss
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = kept(Encoder, path, cache)
        end = int(end_id).to_bytes(4, "little")
        serial = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        tails: list[tuple] = []  # (doc_id, ids of the tail, start of the tail, tokens of the document)

        def place(close: bool) -> None:
            nonlocal tails, serial
            lens = np.array([len(t[1]) // 4 for t in tails], np.int64)
            bins, still = pack_block(lens, lens - np.array([t[2] == 0 for t in tails], np.int64), limits, cut=True, close=close)
            for content in bins:
                at = 0
                for seg, (i, s, k) in enumerate(content):
                    d, ids, base, n = tails[i]
                    rows.append((d, base + s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n, serial, at, seg, k - (base + s == 0)))
                    at += k
                serial += 1
            tails = [(tails[i][0], tails[i][1][4 * s : 4 * (s + k)], tails[i][2] + s, tails[i][3]) for i, s, k in still]

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.ids(text) + end
                n = len(ids) // 4
                whole = n - n % size
                for s in range(0, whole, size):
                    rows.append((d, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)]), n, serial, 0, 0, size - (s == 0)))
                    serial += 1
                if n > whole:
                    tails.append((d, ids[4 * whole :], whole, n))
                if len(tails) >= block:
                    place(False)
                if len(rows) >= 20_000:
                    yield out()
        if tails:
            place(True)
        if id_type is not None:
            yield out()
        trim()

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
