"""Problem 8: passages of evaluation items inside a training corpus.

Method: CGK random-walk embedding.  A window of words is read by a pointer; at every step the word under the pointer
is put out and a pseudo-random bit of (step, word) decides whether the pointer moves on.  Windows at small edit
distance walk together again after an edit, so their outputs have a small Hamming distance.  Each of REPEATS walks
is sampled at SAMPLES steps and hashed; equal hashes of a document window and an item window make a candidate.
Every candidate is verified exactly: edit distance, in words, of the item's words before and behind the common
position against the document's, by a banded dynamic program run over all candidates of a block at once.  A document
holds an item if at least WINDOW running words of the item are there with at most one word in ten added, dropped or
replaced.  Every such passage holds one of PASSAGES (words, edits): a passage of 50 words or more can be divided so
that one part is within its own bound, and shorter ones need no more words than the least that allow their edits.

Windows begin at every word of the items and at every second word of the documents.  A walk covers about half as
many words as it has steps, so it needs a short run without change somewhere in the passage.  Every one of PASSAGES
has at least SEED + STRIDE - 1 words without change in a row (27 words in 4 runs), so hashes of SEED words in a row,
taken besides the walks, make each a candidate.

Spacing, punctuation, diacritics, letter case, digit forms and look-alikes are set aside first (codes.Words).

The items are a stated query set: they are read in blocks of at most ITEM_WORDS words, each block is broadcast
(a bound of about 60 MB) and compared with all documents.  Documents are never shuffled.

Nulls and empty texts hold nothing.  Very long texts are windowed like any others.  Repeated documents each count.
Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.codes import Words, mix

WINDOW = 25
#: Words and edits: the shortest passages that may have 2, 3 and 4 edits.
PASSAGES = ((WINDOW, 2), (30, 3), (40, 4))
MAX_EDITS = 4
SEED = 6
REPEATS, STEPS, SAMPLES, STRIDE = 4, 14, 8, 2
ITEM_WORDS = 200_000
BLOCK = 500
_MASK_BITS = 22
SCHEMA = "doc_id long, item_id long, item_words_leaked int, edits int"


def _padded(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with one zero after each text; for each of these words its text; for each text where its zero is."""
    size = np.diff(w.first)
    end = np.cumsum(size + 1) - 1
    h = np.zeros(len(w.hashes) + n, np.uint64)
    at = np.arange(len(w.hashes)) + w.text
    h[at] = w.hashes
    text = np.repeat(np.arange(n), size + 1)
    return h, text, end


def _samples(r: int) -> list[int]:
    """The steps at which walk r is sampled; the first always is."""
    rng = np.random.default_rng(100 + r)
    return sorted([0, *(rng.choice(STEPS - 1, SAMPLES - 1, replace=False) + 1).tolist()])


def walks(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """For each repeat the sampled hash of the walk that begins at each of ``begin`` and may not pass ``end``; last the hash of SEED words in a row."""
    for r in range(REPEATS):
        m = mix(h ^ np.uint64(0xA24BAED4963EE407 + 0x1000003 * r))
        pos, key = begin.copy(), np.zeros(len(begin), np.uint64)
        take = set(_samples(r))
        for j in range(max(take) + 1):
            v = m[pos]
            if j in take:
                key = key * np.uint64(0x9E3779B97F4A7C15) + v
            pos += ((v >> np.uint64(j)) & np.uint64(1)).astype(pos.dtype)
            np.minimum(pos, end, out=pos)
        yield key ^ (key >> np.uint64(29))
    key = np.zeros(len(begin), np.uint64)
    for j in range(SEED):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(begin + j, end)]
    yield mix(key)


class Index:
    """Sampled walks of all windows of a block of items."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = Words(texts)
        self.ids = np.array(ids, np.int64)
        self.h, self.text, self.end = _padded(w, len(texts))
        real = np.flatnonzero(self.end[self.text] != np.arange(len(self.h))).astype(np.int32)
        # a passage needs WINDOW words of the item
        real = real[np.diff(w.first)[self.text[real]] >= WINDOW]
        self.keys, self.at, self.mask = [], [], []
        for key in walks(self.h, real, self.end[self.text[real]].astype(np.int32)):
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.at.append(real[order])
            mask = np.zeros(1 << _MASK_BITS, bool)
            mask[key >> np.uint64(64 - _MASK_BITS)] = True
            self.mask.append(mask)

    def candidates(self, h: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h and in the items' words with an equal sampled walk."""
        begin = np.arange(0, len(h), STRIDE, dtype=np.int32)
        ps, qs = [], []
        for r, key in enumerate(walks(h, begin, end[text[begin]].astype(np.int32))):
            hit = np.flatnonzero(self.mask[r][key >> np.uint64(64 - _MASK_BITS)])
            k = key[hit]
            lo, hi = np.searchsorted(self.keys[r], k, "left"), np.searchsorted(self.keys[r], k, "right")
            n = hi - lo
            ps.append(np.repeat(begin[hit], n))
            qs.append(self.at[r][np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        both = np.unique(np.concatenate(ps).astype(np.int64) << 32 | np.concatenate(qs))
        p, q = both >> 32, both & 0xFFFFFFFF
        # an alignment through (p, q) also goes through the candidate STRIDE words before, where all words between are equal
        before = both - (STRIDE << 32 | STRIDE)
        known = np.isin(before, both, assume_unique=True) & (q >= STRIDE)
        for j in range(1, STRIDE + 1):
            known &= (h[p - j] == self.h[q - j]) & (h[p - j] != 0)  # not across the ends of two texts
        return p[~known], q[~known]


def _edits(dh: np.ndarray, p: np.ndarray, dend: np.ndarray, ih: np.ndarray, q: np.ndarray, iend: np.ndarray, step: int, rows: int) -> np.ndarray:
    """E[l] for l up to rows: edits between l item words from q (going by step) and the best as-long run from p.

    dend, iend: first position that may not be read.  Edits beyond MAX_EDITS are not told apart.  A word behind the
    document's end equals no word, so it costs what leaving out the item's word costs.
    """
    big, band = np.int8(MAX_EDITS + 1), MAX_EDITS
    width, n, one = 2 * band + 1, len(p), np.int8(1)
    cost = np.full((width, n), big, np.int8)
    cost[band:] = np.arange(band + 1, dtype=np.int8)[:, None]  # document words before any item word
    out = np.full((rows + 1, n), big, np.int8)
    out[0] = 0
    j = p + step * np.arange(-band, rows + band)[:, None]
    i = q + step * np.arange(rows)[:, None]
    ok, there = (j < dend, i < iend) if step > 0 else (j > dend, i > iend)
    words = np.where(ok, dh[np.where(ok, j, 0).clip(0, len(dh) - 1)], np.uint64(0))
    asked = ih[np.where(there, i, 0)]
    none = np.where(there, np.int8(0), big)
    for row in range(rows):
        new = cost + (words[row : row + width] != asked[row])
        np.minimum(new[:-1], cost[1:] + one, out=new[:-1])  # the item's word is missing
        for d in range(1, width):
            np.minimum(new[d], new[d - 1] + one, out=new[d])  # a word was added
        np.minimum(new, big, out=new)
        cost = np.maximum(new, none[row])
        out[row + 1] = cost.min(0)
    return out


def leaks_in(index: Index, ids: np.ndarray, texts: list) -> pd.DataFrame:
    w = Words(texts)
    h, text, end = _padded(w, len(texts))
    p, q = index.candidates(h, text, end)
    if not len(p):
        return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "item_id": pd.Series(dtype="int64"), "item_words_leaked": pd.Series(dtype="int32"), "edits": pd.Series(dtype="int32")})
    dt, it = text[p], index.text[q]
    ends, iends = end[dt], index.end[it]
    starts = ends - np.diff(w.first)[dt]
    istarts = np.r_[0, index.end[:-1] + 1][it]
    # the longer side of any passage through the position has at least half of it: most candidates fail there, many within WINDOW / 2 words
    live = np.zeros(len(p), bool)
    for step, at, iat, stop, istop in ((1, p, q, ends, iends), (-1, p - 1, q - 1, starts - 1, istarts - 1)):
        rest = np.flatnonzero(~live)
        for rows in ((WINDOW + 1) // 2, (PASSAGES[-1][0] + 1) // 2):
            e = _edits(h, at[rest], stop[rest], index.h, iat[rest], istop[rest], step, rows)
            rest = rest[np.any([e[min(rows, (n + 1) // 2)] <= most for n, most in PASSAGES], axis=0)]
        live[rest] = True
    p, q, dt, it, ends, iends, starts, istarts = (x[live] for x in (p, q, dt, it, ends, iends, starts, istarts))
    ahead = _edits(h, p, ends, index.h, q, iends, 1, PASSAGES[-1][0])
    behind = _edits(h, p - 1, starts - 1, index.h, q - 1, istarts - 1, -1, PASSAGES[-1][0])
    found = []
    for n, most in PASSAGES:
        for o in range(n + 1):
            total = behind[o] + ahead[n - o]
            ok = np.flatnonzero(total <= most)
            found.append((dt[ok], it[ok], q[ok] - o, q[ok] - o + n, total[ok]))
    f = pd.DataFrame(dict(zip(("d", "i", "at", "to", "e"), map(np.concatenate, zip(*found))))).sort_values(["d", "i", "at"])
    if not len(f):
        return f.assign(doc_id=f.d.astype("int64"), item_id=f.d.astype("int64"), item_words_leaked=f.d.astype("int32"), edits=f.d.astype("int32"))[["doc_id", "item_id", "item_words_leaked", "edits"]]
    by = [f.d, f.i]
    reached = f.to.groupby(by).cummax().groupby(by).shift().fillna(0)
    gap = (f.to - np.maximum(f["at"], reached)).clip(lower=0)  # words that a passage adds to the ones before
    g = f.assign(n=gap).groupby(["d", "i"], as_index=False).agg(n=("n", "sum"), e=("e", "min"))
    return pd.DataFrame({"doc_id": ids[g.d], "item_id": index.ids[g.i], "item_words_leaked": g.n.astype("int32"), "edits": g.e.astype("int32")})


def _blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    ids, texts, words = [], [], 0
    for row in items.select("item_id", "text").where("text is not null").toLocalIterator():
        n = row.text.count(" ") + 1
        if ids and words + n > ITEM_WORDS:
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        words += n
    if ids:
        yield ids, texts


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words_leaked, edits of the best window: one row per document and item it holds."""
    docs = documents.where("text is not null and text <> ''").select("doc_id", "text")
    spark = documents.sparkSession
    out = None
    for ids, texts in _blocks(items):
        shared = spark.sparkContext.broadcast((ids, texts))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(*shared.value)
            for pdf in batches:
                for i in range(0, len(pdf), BLOCK):
                    p = pdf.iloc[i : i + BLOCK]
                    yield leaks_in(index, p.doc_id.to_numpy(), list(p.text))

        part = docs.mapInPandas(scan, SCHEMA)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that hold it and the most words leaked into one of them; items without leak have 0."""
    n = leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("item_words_leaked").alias("most_words"))
    return items.select("item_id", "split").join(n, "item_id", "left").select("item_id", "split", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_words", F.lit(0)).alias("most_words"))
