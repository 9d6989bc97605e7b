"""Models behind plain interfaces: embedding, language model, bounded retry; and stand-ins that need no network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """name and dim identify the model; called with a list of texts it returns an array of len x dim."""

    name: str
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Bag of hashed words, scaled to length one unless ``normalise`` is off: deterministic, no model file.

    A word adds 1 or -1 (by the first bit of its MD5) to one of ``dim`` places (by the 32 bits behind the first four).
    """

    def __init__(self, dim: int = 64, normalise: bool = True):
        self.name, self.dim, self.normalise = f"hashing-{dim}" + "-raw" * (not normalise), dim, normalise

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, memo = np.zeros((len(texts), self.dim)), {}
        for i, t in enumerate(texts):
            for w in (t or "").split():
                at = memo.get(w)
                if at is None:
                    h = hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()
                    at = memo[w] = (int(h[1:9], 16) % self.dim, 1.0 if h[0] >= "8" else -1.0)
                out[i, at[0]] += at[1]
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(n > 0, n, 1) if self.normalise else out


def embed(df: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """df with the embedding of a text column; batches of Arrow rows, null for null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = np.flatnonzero(s.notna())
            out: list = [None] * len(s)
            for i, v in zip(known, embedder(s.iloc[known].tolist()).astype(np.float32)):
                out[i] = v
            yield pd.Series(out, index=s.index)

    return df.withColumn(name, run(text))


class LLM(Protocol):
    """A prompt to its answer.  temperature and max_tokens are passed where they are set; None leaves the model's own."""

    def __call__(self, prompt: str, **options) -> str: ...


def echo_llm(prompt: str, temperature: float | None = None, max_tokens: int | None = None) -> str:
    """Stand-in: the last line of the prompt that is not blank, its first max_tokens words."""
    lines = [x for x in prompt.splitlines() if x.strip()]
    last = lines[-1] if lines else ""
    return last if max_tokens is None else " ".join(last.split()[:max_tokens])


def classify(message: str) -> str:
    if "rate limit" in message.lower() or "429" in message:
        return "rate_limit"
    return "unavailable" if "503" in message or "Service Unavailable" in message else "unknown"


def with_retry(models: list[LLM], prompt: str, attempts: int = 5, wait: Callable[[float], None] = time.sleep, at: int = 0, **options) -> tuple[str | None, int, str | None, int]:
    """(answer, attempts, error, model): the next model and 2 s after a rate limit or unknown error, the same and 5 s after unavailability.

    No wait follows the last attempt.  ``at`` is the model to begin with.
    """
    error = None
    for n in range(1, attempts + 1):
        try:
            return models[at](prompt, **options), n, None, at
        except Exception as e:  # noqa: BLE001
            error = str(e)
            away = classify(error) == "unavailable"
            at = at if away else (at + 1) % len(models)
            if n < attempts:
                wait(5 if away else 2)
    return None, attempts, error, at


def generate(df: DataFrame, prompt: str, models: list[LLM] | None = None, name: str = "response", attempts: int = 5, wait: Callable[[float], None] = time.sleep, temperature: float | None = None, max_tokens: int | None = None) -> DataFrame:
    """df with the model's response to a prompt column, attempts and error; a failed call is a row with its error.

    A task stays with the model that worked last.  Null prompts are not asked.  A model is passed only the options that
    are set, so any function of a prompt will do without them (the reference asks for temperature 0.7).
    """
    models = models or [echo_llm]
    options = {k: v for k, v in (("temperature", temperature), ("max_tokens", max_tokens)) if v is not None}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{name} string", "attempts int", "error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for pdf in batches:
            got = []
            for p in pdf[prompt]:
                if p is None:
                    got.append((None, 0, None))
                    continue
                *row, at = with_retry(models, p, attempts, wait, at, **options)
                got.append(tuple(row))
            yield pdf.assign(**{name: [g[0] for g in got], "attempts": [g[1] for g in got], "error": [g[2] for g in got]})

    return df.mapInPandas(run, schema)
