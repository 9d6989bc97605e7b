"""Batches of texts as one array of code points.

Python loops over characters cost about 100 ns each; numpy over a whole batch costs a few.  Everything in this
module takes a list of texts (None counts as empty), concatenates them, maps every code point through a lookup
table and works on the resulting arrays.  No text is cut.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

from daftar.llm.lookalikes_table import PROTOTYPES

SPACE = 32
_P = np.uint64(0x9E3779B97F4A7C15)


def nfkc(texts: list) -> list[str]:
    """Compatibility composition; the quick check leaves ordinary texts alone."""
    ok, norm = unicodedata.is_normalized, unicodedata.normalize
    return ["" if t is None else t if ok("NFKC", t) else norm("NFKC", t) for t in texts]


@functools.cache
def table(kind: str) -> np.ndarray:
    """Code point -> code point; 0 drops it, SPACE separates words.

    ``key``: letters and digits in lower case, all else dropped (lines of one site).
    ``words``: as key, but blanks separate words, and look-alikes, digit forms and letter marks are folded.
    """
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000 or 0x30000 <= c:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co"):
            continue
        if kind == "words":
            if ch.isspace() or cat[0] == "Z":
                out[c] = SPACE
                continue
            base = unicodedata.normalize("NFKD", PROTOTYPES.get(ch, ch))
            base = "".join(x for x in base if unicodedata.category(x)[0] in "LN")
            if base:
                x = PROTOTYPES.get(base[0], base[0])
                d = unicodedata.digit(x, None)
                x = str(d) if d is not None else x.lower()[0]
                out[c] = ord(PROTOTYPES.get(x, x))
        elif cat[0] in "LN" and c != 0x0640:
            out[c] = ord(ch.lower()[0])
    if kind == "words":
        out[0x0640] = 0
        out[out == 0x0649] = 0x064A  # the two yehs are written for each other
    return out


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, each text followed by a line break, and where each text starts (one more at the end)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    return codes, np.concatenate([[0], np.cumsum(lens + 1)])


@functools.cache
def _powers() -> np.ndarray:
    return np.cumprod(np.full(4096, _P, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the bits of uint64 values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a batch of texts, normalised by ``table('words')``.

    hashes: uint64 of every word of all texts, in order; first: index of each text's first word, one more at the
    end; begin, end: code point offsets of each word within its own text (before normalisation by the table); number:
    words of digits only; raw, at_begin, at_end: all code points and the words' offsets in them.
    """

    def __init__(self, texts: list, already: bool = False):
        texts = texts if already else nfkc(texts)
        raw, starts = flatten(texts)
        low = table("words")[raw]
        low[starts[1:] - 1] = SPACE
        at = np.flatnonzero(low)  # drops marks
        c = low[at]
        blank = c == SPACE
        head = ~blank
        head[1:] &= blank[:-1]
        tail = ~blank
        tail[:-1] &= blank[1:]
        b, e = np.flatnonzero(head), np.flatnonzero(tail)
        n = len(b)
        if n:
            keep = ~blank
            size = e - b + 1
            local = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            vals = (c[keep].astype(np.uint64) + np.uint64(1)) * _powers()[local & 4095]
            heads = np.cumsum(size) - size
            self.hashes = mix(np.add.reduceat(vals, heads) + size.astype(np.uint64))
            self.number = (np.minimum.reduceat(c[keep], heads) >= 48) & (np.maximum.reduceat(c[keep], heads) <= 57)
        else:
            self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.raw = raw
        pos = at[b] if n else np.zeros(0, np.int64)
        self.at_begin, self.at_end = pos, (at[e] if n else pos) + 1
        self.text = np.searchsorted(starts, pos, "right") - 1
        self.begin = pos - starts[self.text]
        self.end = (at[e] if n else pos) + 1 - starts[self.text]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def grams(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k words in a row that lie in one text, and the index of the first of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * _P + h[j : j + n]
    ok = np.flatnonzero(text[:n] == text[k - 1 : k - 1 + n])
    return mix(g[ok]), ok


def winnow(g: np.ndarray, at: np.ndarray, text: np.ndarray, w: int) -> np.ndarray:
    """Indices into g of the minima of all windows of w grams of one text (of fewer, where a text has fewer).

    Every run of k + w - 1 words that two texts share gives them one selected gram in common.
    """
    n = len(g)
    if not n:
        return np.zeros(0, np.int64)
    t = text[at]
    best = np.arange(n)
    for j in range(1, w):
        other = np.minimum(np.arange(n) + j, n - 1)
        better = (t[other] == t) & (g[other] <= g[best])
        best = np.where(better, other, best)
    last = np.searchsorted(t, t, "right")  # end of the text's grams
    first = np.searchsorted(t, t, "left")
    full = (np.arange(n) + w <= last) | (np.arange(n) == first)
    return np.unique(best[full])
