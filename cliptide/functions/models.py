"""Interfaces to embedding, chat and judge models, with offline stand-ins.

Models run inside Arrow batches; Spark partitions take the place of client threads.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def encode_documents(self, texts: list[str]) -> np.ndarray: ...

    def encode_queries(self, texts: list[str]) -> np.ndarray: ...


class Chat(Protocol):
    def complete(self, messages: list[dict], temperature: float, max_tokens: int) -> str: ...


class HashingEmbedder:
    """Deterministic offline embedder: signed hashed word counts, unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                code = zlib.crc32(word.encode("utf-8"))
                out[row, code % self.dim] += 1.0 if (code >> 16) & 1 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length <= 1e-12, 1.0, length)

    encode_queries = encode_documents


class EchoChat:
    """Offline chat model: answers with the last word of the last message."""

    def complete(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 512) -> str:
        words = messages[-1]["content"].split()
        return words[-1] if words else ""


def endpoint(base: str, resource: str) -> str:
    """``<base>/v1/<resource>`` without repeating a version or the resource."""
    root = base.rstrip("/")
    if root.endswith(f"/{resource}"):
        return root
    return f"{root}/{resource}" if root.endswith("/v1") else f"{root}/v1/{resource}"


def post_json(url: str, payload: dict, key: str = "", timeout: float = 60.0, retries: int = 3) -> dict:
    """POST a JSON body; waits 1, 2, 4, … seconds between attempts."""
    headers = {"Content-Type": "application/json"}
    if key:
        headers["Authorization"] = f"Bearer {key}"
    body = json.dumps(payload).encode("utf-8")
    for attempt in range(retries):
        try:
            request = urllib.request.Request(url, data=body, headers=headers)
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.loads(reply.read().decode("utf-8"))
        except (urllib.error.URLError, TimeoutError) as exc:
            if attempt == retries - 1:
                raise RuntimeError(f"request to {url} failed") from exc
            time.sleep(2**attempt)
    raise RuntimeError(f"request to {url} failed")


class HttpChat:
    """Chat completions over HTTP."""

    def __init__(self, base: str, model: str, key: str = "") -> None:
        self.url, self.model, self.key = endpoint(base, "chat/completions"), model, key

    def complete(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 512) -> str:
        payload = {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}
        return post_json(self.url, payload, self.key)["choices"][0]["message"]["content"]


class HttpEmbedder:
    """Embeddings over HTTP."""

    def __init__(self, base: str, model: str, key: str = "") -> None:
        self.url, self.model, self.key = endpoint(base, "embeddings"), model, key

    def encode_documents(self, texts: list[str]) -> np.ndarray:
        data = post_json(self.url, {"model": self.model, "input": texts}, self.key)["data"]
        return np.asarray([d["embedding"] for d in sorted(data, key=lambda d: d["index"])], dtype=np.float32)

    encode_queries = encode_documents


def embed(text: Column, model: Embedder, role: str = "document", batch: int = 32) -> Column:
    """Embedding column; texts go to the model in batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model.encode_queries if role == "query" else model.encode_documents
        for series in batches:
            texts = series.fillna("").tolist()
            parts = [encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series([row.tolist() for part in parts for row in part], index=series.index)

    return run(text)


def chat(prompt: Column, model: Chat, system: str = "", temperature: float = 0.0, max_tokens: int = 512) -> Column:
    """Reply column, one request per row."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lead = [{"role": "system", "content": system}] if system else []
        for series in batches:
            yield series.map(
                lambda p: model.complete([*lead, {"role": "user", "content": p or ""}], temperature, max_tokens)
            )

    return run(prompt)


def judged_yes(reply: Column, anywhere: bool = False) -> Column:
    """Whether a judge's reply says yes (at its start, or anywhere)."""
    plain = F.lower(F.trim(F.coalesce(reply, F.lit(""))))
    return plain.contains("yes") if anywhere else plain.startswith("yes")


Judge = Callable[[Column], Column]
