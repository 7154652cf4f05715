"""Texts to vectors, batch by batch in the tasks of a DataFrame."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text, vector


class Embedder(Protocol):
    """Vectors of `dims` numbers by the model `model`. Must be picklable."""

    model: str
    dims: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Feature hashing of words and word pairs; needs no model, and is the same everywhere."""

    def __init__(self, model: str = "hashing", dims: int = 256) -> None:
        self.model, self.dims = model, dims

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            words = re.findall(r"[^\W_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t).lower())
            for w in [*words, *(" ".join(p) for p in zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, (h >> 1) % self.dims] += 1.0 if h & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0).tolist()


class HttpEmbedder:
    """POST {url}/api/embed with model and input; as many vectors of the right size must come back."""

    def __init__(self, url: str, model: str, dims: int, timeout: float = 120.0) -> None:
        self.url, self.model, self.dims, self.timeout = url.rstrip("/"), model, dims, timeout

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        found = self._call("/api/embed", {"model": self.model, "input": list(texts)}).get("embeddings") or []
        if len(found) != len(texts) or any(len(v) != self.dims for v in found):
            raise ValueError(f"the model server returned {len(found)} vectors for {len(texts)} texts, or not of {self.dims} dimensions")
        return found

    def ping(self) -> None:
        self._call("/api/tags")

    def tags(self) -> list[str]:
        return [m["name"] for m in self._call("/api/tags").get("models", [])]

    def has_model(self) -> bool:
        return any(t in (self.model, f"{self.model}:latest") for t in self.tags())

    def probe(self) -> int:
        """The dimension of the model's vectors."""
        found = self._call("/api/embed", {"model": self.model, "input": ["probe"]}).get("embeddings") or [[]]
        return len(found[0])


def _one_by_one(embedder: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """A batch, or each text alone if the batch fails; a text that fails alone has an error instead of a vector."""
    try:
        return [(v, None) for v in embedder.embed(texts)]
    except Exception:  # noqa: BLE001
        out: list[tuple[list[float] | None, str | None]] = []
        for t in texts:
            try:
                out.append((embedder.embed([t])[0], None))
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{type(e).__name__}: {e}"))
        return out


def embedded(chunks: DataFrame, embedder: Embedder, batch_size: int = 50, concurrency: int = 4) -> DataFrame:
    """chunks with text, embedding, norm and error. Batches reach across files; some are under way at once in each task."""
    if batch_size < 1 or concurrency < 1:
        raise ValueError("batch size and concurrency must be at least 1")
    full = text.cut_bytes(text.embedding_text("file_path", "language", "symbol_name", "chunk_type", "start_line", "end_line", "content"), text.EMBED_BYTES)
    chunks = chunks.withColumn("text", full)
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                parts = [texts[k : k + batch_size] for k in range(0, len(texts), batch_size)]
                done = [x for part in pool.map(lambda p: _one_by_one(embedder, p), parts) for x in part]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v for v, _ in done], pa.list_(pa.float32())), pa.array([e for _, e in done], pa.string())], names=[*names, "embedding", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    out = chunks.mapInArrow(run, f"{schema}, embedding array<float>, error string")
    return out.withColumn("norm", vector.norm(F.col("embedding")))
