"""Texts to vectors: a protocol, a deterministic embedder without network, batching and retries."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from typing import Protocol
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamdex.config import EmbedSettings
from loamdex.operators.python_columns import with_python_columns

_WORD = re.compile(r"\w+")


class Embedder(Protocol):
    """One vector per text, in their order; must be picklable."""

    width: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def validate(self) -> None: ...


class HashingEmbedder:
    """Words hashed to signed dimensions, at length 1: the same text gives the same vector on every machine."""

    def __init__(self, width: int = 768):
        self.width = width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            for w in _WORD.findall(text.lower()):
                h = crc32(w.encode())
                row[(h >> 1) % self.width] += 1 if h & 1 else -1
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()

    def validate(self) -> None:
        pass


def retried(call: Callable[[], object], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of ``call``; after an error that may pass it waits 1, 2, 4 ... seconds. Errors of the request itself (4xx) are raised at once."""
    for k in range(attempts):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 or k + 1 == attempts:
                raise
        except OSError:
            if k + 1 == attempts:
                raise
        sleep(2.0**k)
    raise AssertionError("no attempt")


class ServiceEmbedder:
    """An HTTP service that takes one text or a list; the answer must hold as many vectors as texts."""

    def __init__(self, settings: EmbedSettings, send: Callable[[str, dict | None], dict] | None = None):
        self.settings, self.width, self.send = settings, settings.embedding_dimension, send

    def _send(self, path: str, body: dict | None = None) -> dict:
        if self.send:
            return self.send(path, body)
        request = urllib.request.Request(self.settings.url + path, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=30) as answer:
            return json.loads(answer.read())

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.settings.batch_size):
            part = list(texts[at : at + self.settings.batch_size])
            got = retried(lambda part=part: self._send("/api/embed", {"model": self.settings.model, "input": part if len(part) > 1 else part[0]}))
            vectors = got.get("embeddings", [])
            if len(vectors) != len(part):
                raise ValueError(f"{len(part)} texts, {len(vectors)} vectors")
            out += vectors
        return out

    def validate(self) -> None:
        names = [m.get("name") for m in retried(lambda: self._send("/api/tags")).get("models", [])]
        if self.settings.model not in names:
            raise ValueError(f"the service has no model {self.settings.model}")


def embed_column(df: DataFrame, embedder: Embedder, text: str = "content", into: str = "vector") -> DataFrame:
    """``df`` with the vector of a text column, which stays in its row; null and blank texts have none."""

    def compute(texts):
        at = [k for k, t in enumerate(texts) if t and t.strip()]
        vectors = dict(zip(at, embedder.embed([texts[k] for k in at]), strict=True)) if at else {}
        for v in vectors.values():
            if len(v) != embedder.width:
                raise ValueError(f"a vector of {len(v)}, not {embedder.width}")
        for k in range(len(texts)):
            yield (vectors.get(k),)

    return with_python_columns(df, [text], [(into, T.ArrayType(T.FloatType()))], compute)
