"""A linear adapter on query embeddings, trained on triplets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.operators.numbering import by_hash

#: Triplets of a block, which one task trains on (about 80 MB at 64 dimensions).
TRIPLETS = 50_000


def schedule(step: int, warmup: int, total: int) -> float:
    return step / max(1, warmup) if step < warmup else max(0.0, (total - step) / max(1, total - warmup))


def loss_and_gradient(w: np.ndarray, b: np.ndarray, q: np.ndarray, p: np.ndarray, n: np.ndarray, margin: float, eps: float = 1e-6) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of max(|y - p| - |y - n| + margin, 0), y = W q + b, and its gradients."""
    y = q @ w.T + b
    dp, dn = y - p + eps, y - n + eps
    lp, ln = np.sqrt((dp * dp).sum(1)), np.sqrt((dn * dn).sum(1))
    each = lp - ln + margin
    on = (each > 0)[:, None]
    g = np.where(on, dp / np.maximum(lp, 1e-12)[:, None] - dn / np.maximum(ln, 1e-12)[:, None], 0.0)
    return float(np.maximum(each, 0).sum()), g.T @ q, g.sum(0)


class AdamW:
    def __init__(self, shapes: list[tuple], lr: float, decay: float = 0.01, betas: tuple = (0.9, 0.999), eps: float = 1e-8):
        self.m, self.v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        self.lr, self.decay, self.betas, self.eps, self.t = lr, decay, betas, eps, 0

    def step(self, params: list[np.ndarray], grads: list[np.ndarray], factor: float) -> None:
        self.t += 1
        b1, b2 = self.betas
        for x, g, m, v in zip(params, grads, self.m, self.v):
            x *= 1 - self.lr * factor * self.decay
            m += (1 - b1) * (g - m)
            v += (1 - b2) * (g * g - v)
            x -= self.lr * factor * (m / (1 - b1**self.t)) / (np.sqrt(v / (1 - b2**self.t)) + self.eps)


def clip(grads: list[np.ndarray], most: float) -> list[np.ndarray]:
    n = np.sqrt(sum(float((g * g).sum()) for g in grads))
    return [g * min(1.0, most / (n + 1e-6)) for g in grads]


def _start(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng, a = np.random.default_rng(seed), 1 / np.sqrt(dim)
    return rng.uniform(-a, a, (dim, dim)), rng.uniform(-a, a, dim)


class Settings:
    """Fixed values of the reference: 30 epochs in batches of 32, rate 0.003, warmup 100 steps, clip 1, margin 1."""

    def __init__(self, epochs: int = 30, batch: int = 32, lr: float = 0.003, warmup: int = 100, max_norm: float = 1.0, margin: float = 1.0, seed: int = 0):
        self.epochs, self.batch, self.lr, self.warmup, self.max_norm, self.margin, self.seed = epochs, batch, lr, warmup, max_norm, margin, seed


class State:
    """Weights, bias and the optimiser's moments, as one vector between rounds."""

    def __init__(self, dim: int, s: Settings, vector: np.ndarray | None = None, steps: int = 0):
        self.w, self.b = _start(dim, s.seed)
        self.opt = AdamW([self.w.shape, self.b.shape], s.lr)
        self.parts = [self.w, self.b, *self.opt.m, *self.opt.v]
        self.opt.t = steps
        if vector is not None:
            at = 0
            for x in self.parts:
                x[...] = vector[at : at + x.size].reshape(x.shape)
                at += x.size

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])


def train_block(state: State, s: Settings, q: np.ndarray, p: np.ndarray, n: np.ndarray, first: int, last: int) -> list[float]:
    """Epochs first to last - 1 over one block in mini-batches, in a new order each: mean loss of the batches of each epoch."""
    steps, losses = -(-len(q) // s.batch), []
    for epoch in range(first, last):
        order, total = np.random.default_rng((s.seed, epoch)).permutation(len(q)), 0.0
        for i in range(0, len(q), s.batch):
            at = order[i : i + s.batch]
            loss, gw, gb = loss_and_gradient(state.w, state.b, q[at], p[at], n[at], s.margin)
            total += loss / len(at)
            state.opt.step([state.w, state.b], clip([gw / len(at), gb / len(at)], s.max_norm), schedule(epoch * steps + i // s.batch, s.warmup, steps * s.epochs))
        losses.append(total / steps)
    return losses


def train_local(triplets: pd.DataFrame, epochs: int = 30, batch: int = 32, lr: float = 0.003, warmup: int = 100, max_norm: float = 1.0, margin: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Mini-batch training in memory (columns query, positive, negative): weight, bias, mean batch loss per epoch."""
    q, p, n = (np.stack(triplets[c].to_numpy()).astype(np.float64) for c in ("query", "positive", "negative"))
    s = Settings(epochs, batch, lr, warmup, max_norm, margin, seed)
    state = State(q.shape[1], s)
    losses = train_block(state, s, q, p, n, 0, epochs)
    return state.w, state.b, losses


def _part(shared, dim: int, s: Settings, steps: int):
    """Training of one block from the shared state: the new state and the losses, times the block's size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vector, first, last = shared.value
        pdf = pdf.sort_values("_p")
        state = State(dim, s, vector, first * steps)
        some = train_block(state, s, *(np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("query", "positive", "negative")), first, last)
        x = np.concatenate([state.vector(), some])
        return pd.DataFrame({"i": np.arange(len(x)), "x": x * len(pdf)})

    return run


def train(triplets: DataFrame, dim: int, key: str, block: int = TRIPLETS, settings: Settings | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weight, bias and mean loss per epoch of mini-batch training on any number of triplets (query, positive, negative).

    Triplets are put into blocks of at most ``block`` in the order of a hash of ``key``.  In every epoch each block is
    trained on in mini-batches by one task, from the same state, and the states are averaged by the blocks' sizes
    (iterative parameter mixing).  One block, as the reference's own data make, is its training exactly.  The driver
    holds one state, of 3 * dim * (dim + 1) numbers.
    """
    s = settings or Settings()
    rows = by_hash(triplets.select(key, "query", "positive", "negative"), [key], "adapter", "_p")
    count = rows.count()
    if not count:
        state = State(dim, s)
        return state.w, state.b, []
    blocks = -(-count // block)
    rows = rows.withColumn("_block", (F.col("_p") % blocks).cast("int"))
    steps, losses, vector = -(-(-(-count // blocks)) // s.batch), [], None
    for epoch in range(0, s.epochs, s.epochs if blocks == 1 else 1):
        last = s.epochs if blocks == 1 else epoch + 1
        shared = rows.sparkSession.sparkContext.broadcast((vector, epoch, last))
        got = rows.groupBy("_block").applyInPandas(_part(shared, dim, s, steps), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # one number of the state a row
        shared.unpersist()
        x = np.array([r.x for r in got]) / count
        vector, losses = x[: len(x) - (last - epoch)], losses + x[len(x) - (last - epoch) :].tolist()
    state = State(dim, s, vector)
    return state.w, state.b, losses


def apply(df: DataFrame, vector: str, w: np.ndarray, b: np.ndarray, name: str = "adapted") -> DataFrame:
    """df with W x + b of a vector column; on queries only, documents keep their vectors."""
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        w, b = shared.value
        known = np.flatnonzero(s.notna())
        out: list = [None] * len(s)
        if len(known):
            for i, v in zip(known, (np.stack(s.iloc[known].to_numpy()).astype(np.float64) @ w.T + b).astype(np.float32)):
                out[i] = v
        return pd.Series(out, index=s.index)

    return df.withColumn(name, run(vector))
