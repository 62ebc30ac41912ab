"""A byte-level convolutional network in numpy that scores whole texts for quality."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Staging, packed, trim, unpacked

HALF, EMBED, FILTERS, HIDDEN = 4, 8, 32, 16  # a filter sees two halves of HALF bytes; filters step by HALF bytes
STEP, CHUNK = 112, 128  # halves between chunks, and in a chunk
STEP_BYTES, CHUNK_BYTES = STEP * HALF, CHUNK * HALF


@dataclass
class Model:
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # 2 * HALF * EMBED x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def new_model(seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    n = 2 * HALF * EMBED
    return Model(f(256, EMBED, scale=0.5), f(n, FILTERS, scale=(2 / n) ** 0.5), np.zeros(FILTERS, np.float32), f(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=HIDDEN**-0.5), np.zeros(1, np.float32))


def chunk_logits(m: Model, pooled: np.ndarray) -> np.ndarray:
    return np.maximum(pooled @ m.hidden + m.hidden_bias, 0) @ m.out + m.out_bias[0]


def document_logits(m: Model, texts: list[bytes], group: int = 1 << 18) -> np.ndarray:
    """One logit for each text: the mean over its chunks, which overlap and cover it to its end.

    Texts are laid end to end in groups of about `group` bytes; a longer text is worked through in parts.
    """
    n = 2 * HALF * EMBED
    both = np.concatenate([m.conv[: n // 2], m.conv[n // 2 :]], 1)
    sums, counts = np.zeros(len(texts)), np.array([max(1, -(-len(t) // STEP_BYTES)) for t in texts])

    def run(parts: list[tuple[int, bytes, int]]) -> None:
        """parts: text's number, bytes, chunks to count (one block more may follow, for the last one's overlap)."""
        blocks = [-(-(len(b) + HALF) // STEP_BYTES) for _, b, _ in parts]  # at least a half of nothing ends each text
        at = np.concatenate([[0], np.cumsum(blocks)])
        flat = np.zeros((at[-1] + 1) * STEP_BYTES, np.uint8)
        valid = np.zeros((at[-1] + 1) * STEP, bool)
        for (_, b, _), s in zip(parts, at):
            flat[s * STEP_BYTES : s * STEP_BYTES + len(b)] = np.frombuffer(b, np.uint8)
            valid[s * STEP : s * STEP + -(-len(b) // HALF)] = True
        y = m.embed[flat].reshape(-1, HALF * EMBED) @ both
        z = y[:, :FILTERS]
        z[:-1] += y[1:, FILTERS:]
        z = np.maximum(z + m.bias, 0)
        z *= valid[:, None]
        z = z.reshape(-1, STEP, FILTERS)
        pooled, head = z.max(1), z[:, : CHUNK - STEP - 1].max(1)
        inner = np.ones(at[-1] + 1, bool)
        inner[at[1:] - 1] = False  # a text's last chunk has nothing of its own behind it
        pooled[:-1] = np.where(inner[:-1, None], np.maximum(pooled[:-1], head[1:]), pooled[:-1])
        logits = chunk_logits(m, pooled)
        for (i, _, k), s in zip(parts, at):
            sums[i] += logits[s : s + k].sum(dtype=np.float64)

    parts, size = [], 0
    step = max(1, group // STEP_BYTES)
    for i, t in enumerate(texts):
        for c in range(0, counts[i], step):
            k = min(step, counts[i] - c)
            part = t[c * STEP_BYTES : (c + k + 1) * STEP_BYTES]
            parts.append((i, part, k))
            size += len(part) + STEP_BYTES
            if size >= group:
                run(parts)
                parts, size = [], 0
    if parts:
        run(parts)
    return sums / counts


def train(texts: list[bytes], labels: np.ndarray, steps: int = 1500, batch: int = 128, rate: float = 4e-3, seed: int = 7) -> Model:
    """Fit by Adam on whole texts: a text's logit is the mean over all its chunks, as in scoring.

    A step takes texts in random order until they have `batch` chunks; each text weighs the same, however long.
    """
    m = new_model(seed)
    if texts:
        lens = np.array([len(t) for t in texts], np.int64)
        counts = np.maximum(1, -(-lens // STEP_BYTES))
        flat = np.frombuffer(b"".join(texts) + bytes(CHUNK_BYTES), np.uint8)
        starts = np.cumsum(lens) - lens
        _descend(m, flat, starts, lens, counts, np.asarray(labels, np.float32), steps, batch, rate, np.random.default_rng(seed))
    return m


def gradients(m: Model, x: np.ndarray, ok: np.ndarray, doc: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Summed cross entropy of texts and its gradients. x: chunks (rows of CHUNK_BYTES bytes), ok: their frames that hold
    bytes, doc: the text of each chunk, counts: chunks of each text."""
    k = len(x)
    e = m.embed[x].reshape(k, CHUNK, HALF * EMBED)
    win = np.concatenate([e[:, :-1], e[:, 1:]], 2)
    z = np.maximum(win @ m.conv + m.bias, 0) * ok[:, :, None]
    where = z.argmax(1)
    pooled = np.take_along_axis(z, where[:, None], 1)[:, 0]
    h = np.maximum(pooled @ m.hidden + m.hidden_bias, 0)
    logit = np.bincount(doc, h @ m.out + m.out_bias[0], len(counts)) / counts
    loss = float((np.logaddexp(0, logit) - labels * logit).sum())
    d = (((1 / (1 + np.exp(-logit)) - labels) / counts)[doc]).astype(m.out.dtype)
    dh = d[:, None] * m.out * (h > 0)
    dp = (dh @ m.hidden.T) * (pooled > 0)
    rows = np.arange(k)[:, None]
    hit = win[rows, where]  # chunks x FILTERS x frame width
    dwin = dp[:, :, None] * m.conv.T[None]
    dembed = np.zeros_like(m.embed)
    byte_at = where[:, :, None] * HALF + np.arange(2 * HALF)
    np.add.at(dembed, x[rows[:, :, None], byte_at].ravel(), dwin.reshape(-1, EMBED))
    return loss, [dembed, np.einsum("bf,bfn->nf", dp, hit, optimize=True), dp.sum(0), pooled.T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True)]


def _descend(m: Model, flat, starts, lens, counts, labels, steps: int, batch: int, rate: float, r: np.random.Generator) -> None:
    params = m.arrays()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    usual = max(1.0, batch / counts.mean())  # texts in a step
    queue = np.empty(0, np.int64)
    span = np.arange(CHUNK_BYTES)
    frames = np.arange(CHUNK - 1) * HALF
    for t in range(1, steps + 1):
        while counts[queue].sum() < batch:
            queue = np.concatenate([queue, r.permutation(len(lens))])
        n = int(np.searchsorted(np.cumsum(counts[queue]), batch)) + 1
        pick, queue = queue[:n], queue[n:]
        doc = np.repeat(np.arange(n), counts[pick])
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(counts[pick]) - counts[pick], counts[pick])) * STEP_BYTES
        left = lens[pick][doc] - at
        x = np.where(span < left[:, None], flat[np.minimum((starts[pick][doc] + at)[:, None] + span, len(flat) - 1)], np.uint8(0))
        _, grads = gradients(m, x, frames < left[:, None], doc, counts[pick], labels[pick])
        lr = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for q, g, a, b in zip(params, grads, first, second):
            g = g / usual
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= (lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12000, sample_bytes: int = 48 << 20, label_col: str = "quality") -> Model:
    """Train on whole texts of at most `sample` labelled documents outside the held-out fold, in order of a hash of doc_id,
    as many as hold sample_bytes bytes together: a text for which no room is left is passed over, and the next one
    tried. That is all the driver gets. An error tells when there are labelled texts and none of them fits.

    Null ids, labels and texts are no examples; of a doc_id labelled twice the larger label counts, and of one with
    several texts the least. Without examples the network stays as initialised (one fixed seed).
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    with Staging() as stage:
        texts = stage(joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("y")).withColumn("o", F.xxhash64("doc_id")))
        sizes = sorted((r.o, str(r.doc_id), r.n) for r in texts.select("o", "doc_id", F.octet_length("text").alias("n")).collect())
        fit_in, left = [], sample_bytes
        for _, d, n in sizes:
            if n <= left:
                fit_in.append((d,))
                left -= n
        if sizes and not fit_in:
            raise ValueError(f"none of {len(sizes)} labelled texts fits into sample_bytes={sample_bytes}; the shortest has {min(n for *_, n in sizes)} bytes")
        named = texts.withColumn("d", F.col("doc_id").cast("string"))
        rows = named.join(F.broadcast(texts.sparkSession.createDataFrame(fit_in, "d string")), "d", "left_semi").select("d", "text", "y").toArrow().to_pylist() if fit_in else []
    rows.sort(key=lambda r: (zlib.crc32(r["d"].encode()), r["d"]))
    return train([r["text"].encode() for r in rows], np.array([r["y"] for r in rows], np.float32))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of docs, with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Null and empty texts score as one empty chunk. Every row is scored by its whole text alone; repeated rows score
    alike; an empty table stays empty. Columns named score or predicted are replaced. No shuffle.
    """
    from pyspark.sql import types as T

    src = docs.drop("score", "predicted")
    part = packed(src, "text")
    schema = T.StructType([*part.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            n = max(1, b.nbytes // (4 << 20))
            for s in range(0, b.num_rows, step := max(1, b.num_rows // n)):
                some = b.slice(s, step)
                logits = document_logits(model, [(t or "").encode() for t in some.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(1 / (1 + np.exp(-np.clip(logits, -50, 50))))], names=[*b.schema.names, "score"])
        trim()

    scored = part.mapInArrow(run, schema)
    return scored.select(*unpacked(src.columns, "text"), "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
