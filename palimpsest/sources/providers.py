"""The boundary to models: embedders, extractors and chat back ends that callers inject, with recording and replay."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import bigram_tokens
from palimpsest.functions.vectors import hash_embedding

BATCH = 96


class Embedder(Protocol):
    dims: int

    def embed(self, texts: Sequence[str]) -> list[Sequence[float]]: ...


class ChatBackend(Protocol):
    def complete(self, request: dict) -> dict: ...


class HashingEmbedder:
    """Works without a model: hashed bigram tokens, unit length."""

    def __init__(self, dims: int = 1536):
        self.dims = dims

    def embed(self, texts: Sequence[str]) -> list[Sequence[float]]:
        return [hash_embedding(bigram_tokens(t), self.dims).tolist() for t in texts]


def embed_rows(rows: DataFrame, embedder: Embedder, text_col: str = "content", out_col: str = "embedding", retries: int = 3) -> DataFrame:
    """Fill out_col by the embedder, called with 96 texts at a time inside each task; a wrong number or width of vectors fails."""
    schema = rows.drop(out_col).withColumn(out_col, F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop(columns=[out_col], errors="ignore")
            vectors: list = []
            for s in range(0, len(pdf), BATCH):
                texts = pdf[text_col].iloc[s : s + BATCH].tolist()
                got = with_retries(lambda: embedder.embed(texts), retries)
                if len(got) != len(texts) or any(len(v) != embedder.dims for v in got):
                    raise ValueError("the embedder's answer does not match its input")
                vectors += [list(map(float, v)) for v in got]
            pdf[out_col] = pd.Series(vectors, index=pdf.index, dtype=object)
            yield pdf

    return rows.drop(out_col).mapInPandas(run, schema)


def with_retries(call: Callable[[], Any], attempts: int = 3, first_s: float = 0.2, most_s: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Call until it works: waits double from first_s up to most_s, each with full jitter; the last error is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i == attempts - 1:
                raise
            sleep(random.uniform(0, min(most_s, first_s * 2**i)))


class Fallback:
    """The first back end of a chain that answers."""

    def __init__(self, *backends: ChatBackend, attempts: int = 2):
        self.backends, self.attempts = backends, attempts

    def complete(self, request: dict) -> dict:
        error: Exception | None = None
        for b in self.backends:
            try:
                return with_retries(lambda: b.complete(request), self.attempts, first_s=0.01)
            except Exception as e:  # the next one may answer
                error = e
        raise RuntimeError("no back end answered") from error


def canonical_request(request: dict) -> str:
    """The part of a request that decides its answer, in one fixed form; call ids, which differ from run to run, are left out."""

    def clean(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in ("id", "call_id") and not (k == "stream" and not v)}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return json.dumps(clean(request), ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def request_key(request: dict) -> str:
    return hashlib.sha256(canonical_request(request).encode()).hexdigest()


class MissingRecording(KeyError):
    pass


class Replay:
    """Answers from recordings in a folder, one JSON file a request, named by its key. With a live back end, missing ones are
    asked and recorded (or all, with refresh)."""

    def __init__(self, folder: str, live: ChatBackend | None = None, refresh: bool = False):
        self.folder, self.live, self.refresh = Path(folder), live, refresh

    def complete(self, request: dict) -> dict:
        path = self.folder / f"{request_key(request)}.json"
        if path.exists() and not self.refresh:
            return json.loads(path.read_text(encoding="utf-8"))["response"]
        if self.live is None:
            raise MissingRecording(path.name)
        response = self.live.complete(request)
        self.folder.mkdir(parents=True, exist_ok=True)
        body = {"key": path.stem, "recorded_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "canonical_request": canonical_request(request), "response": response}
        path.write_text(json.dumps(body, ensure_ascii=False, indent=1), encoding="utf-8")
        return response


class Scripted:
    """A back end for tests: answers by a function of the request."""

    def __init__(self, answer: Callable[[dict], dict]):
        self.answer, self.requests = answer, []

    def complete(self, request: dict) -> dict:
        self.requests.append(request)
        return self.answer(request)
