"""Expectation-maximisation for substitution ciphers, from counts of symbol pairs and a bigram language model."""

from __future__ import annotations

import numpy as np

ITERATIONS, PRIOR = 60, 5.0
#: Pairs that are worked on at a time.
PAIRS = 20_000


def learn(i: np.ndarray, j: np.ndarray, n: np.ndarray, joint: np.ndarray, allowed: np.ndarray, first: np.ndarray, iterations: int = ITERATIONS, prior: float = PRIOR) -> np.ndarray:
    """P(letter | symbol), letters x symbols.

    i, j, n: symbol i is followed by symbol j n times; only pairs that occur are held, so a text of very many symbols
    costs letters x (symbols + pairs).  joint: P(letter l is followed by letter m).  allowed: which letters a symbol
    may stand for.  first: the starting emissions P(symbol | letter), which also weigh as ``prior`` occurrences of
    each letter.  E step: expected letters of every pair of symbols under the model; M step: emissions in proportion
    to them.
    """
    b = first * allowed
    b /= np.maximum(b.sum(1, keepdims=True), 1e-300)
    weight = prior * b
    expected = b
    by = [np.argsort(x, kind="stable") for x in (i, j)]
    for _ in range(iterations):
        pb, bp = joint @ b, joint.T @ b
        w = n / np.maximum(_at_pairs(b, i, pb, j), 1e-300)
        expected = b * _summed(pb, j, w, i, by[0], b.shape[1]) + b * _summed(bp, i, w, j, by[1], b.shape[1]) + weight
        b = expected / np.maximum(expected.sum(1, keepdims=True), 1e-300)
    return expected / np.maximum(expected.sum(0, keepdims=True), 1e-300)


def _at_pairs(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of columns i of a and j of b."""
    return np.concatenate([np.zeros(0), *(np.einsum("lp,lp->p", a[:, i[k : k + PAIRS]], b[:, j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS))])


def _summed(a: np.ndarray, j: np.ndarray, w: np.ndarray, i: np.ndarray, order: np.ndarray, symbols: int) -> np.ndarray:
    """For each symbol the sum of w times column j of a over the pairs whose i is the symbol."""
    out = np.zeros((len(a), symbols))
    for k in range(0, len(order), PAIRS):
        o = order[k : k + PAIRS]
        head = np.flatnonzero(np.r_[True, i[o][1:] != i[o][:-1]])
        out[:, i[o][head]] += np.add.reduceat(a[:, j[o]] * w[o], head, axis=1)
    return out


def by_rank(often: np.ndarray, single: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Starting emissions without a known key: letters and symbols of like frequency go together."""
    f = often / max(often.sum(), 1.0)
    far = np.abs(np.log(np.maximum(single, 1e-9))[:, None] - np.log(np.maximum(f, 1e-9))[None, :])
    return np.exp(-far) * f[None, :] * allowed + 1e-9 * allowed
