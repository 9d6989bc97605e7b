"""Problem 5: cutting texts that are larger than a limit at natural places, with an overlap.

Method: lexical-cohesion segmentation.  A text is taken as a row of units (sentences, cut further at clauses and
words where one is too long).  At each gap between units the words of the BLOCK_WORDS words before and behind are
compared (cosine of their counts, sliding); how deep the similarity lies below the peaks on both sides is the depth
of the gap.  Within each window of permitted sizes the gap that is deepest, with a bonus for paragraph ends, is cut.
The next piece begins ``overlap`` characters before the cut.  Where a window has no gap at all (one word longer than
the limit) the cut is made at the limit.

Sizes count code points.  Every piece is at most the limit; consecutive pieces share exactly ``overlap`` characters
(less where the piece before is not longer than that); the pieces without their overlaps are the text.  A text within
the limit is one piece.  The limit must be larger than the overlap; else the overlap is limit - 1.  Null text: no
piece; empty text: one empty piece.  A kind without limits: one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.codes import Words
from daftar.session import cut, small

BLOCK_WORDS = 40
#: A cut may lie in the last so many of the window; bonus of a paragraph's end, of a sentence's, of a clause's.
LATEST = 0.6
PARAGRAPH, SENTENCE, CLAUSE, WORD = 0.6, 0.4, 0.15, 0.0
_GAP = re.compile(r"(\n\s*)|((?<=[.!?؟…])[\"'»”’)]*\s+)|((?<=[,،;؛:])\s+)|(\s+)")


def gaps(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets behind the blanks at which a text may be cut, and how natural each is."""
    at, kind = [], []
    for m in _GAP.finditer(text):
        at.append(m.end())
        kind.append(PARAGRAPH if m.group(1) is not None else SENTENCE if m.group(2) is not None else CLAUSE if m.group(3) is not None else WORD)
    return np.array(at, np.int64), np.array(kind)


def cohesion(w: Words, at: np.ndarray) -> np.ndarray:
    """Cosine of the word counts on both sides of each offset, in sliding blocks of at most BLOCK_WORDS words."""
    n = len(w.hashes)
    if not n:
        return np.ones(len(at))
    _, ids = np.unique(w.hashes, return_inverse=True)
    place = np.searchsorted(w.begin, at)
    out = np.zeros(len(at))
    left: dict = {}
    right: dict = {}
    a = b = c = 0  # blocks [a, b) and [b, c)
    dot = ll = rr = 0

    def change(one: dict, other: dict, x: int, by: int) -> tuple[int, int]:
        old = one.get(x, 0)
        one[x] = old + by
        return by * other.get(x, 0), by * (2 * old + by)

    for g, p in enumerate(place.tolist()):
        while b < p:
            if c == b:
                d, s = change(right, left, ids[b], 1)
                dot, rr, c = dot + d, rr + s, c + 1
            d, s = change(right, left, ids[b], -1)
            dot, rr = dot + d, rr + s
            d, s = change(left, right, ids[b], 1)
            dot, ll, b = dot + d, ll + s, b + 1
        while c < min(n, p + BLOCK_WORDS):
            d, s = change(right, left, ids[c], 1)
            dot, rr, c = dot + d, rr + s, c + 1
        while a < p - BLOCK_WORDS:
            d, s = change(left, right, ids[a], -1)
            dot, ll, a = dot + d, ll + s, a + 1
        out[g] = dot / (ll * rr) ** 0.5 if ll and rr else 0.0
    return out


def depths(sim: np.ndarray) -> np.ndarray:
    """How far each place lies below the nearest peaks on its two sides, together."""
    out = np.zeros(len(sim))
    for one in (slice(None), slice(None, None, -1)):
        peak = last = -1.0
        some = []
        for x in sim[one].tolist():
            peak = x if x >= last else peak  # climbing: the peak is here so far
            some.append(peak - x)
            last = x
        out[one] += some
    return out


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of each piece."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    at, kind = gaps(text)
    real = kind > WORD
    score = kind.copy()
    if real.any():
        sim = cohesion(Words([text], already=True), at[real])
        score[real] += depths(sim)
    out, begin = [], 0
    while n - begin > limit:
        last = begin + limit
        first = begin + overlap + 1  # the next piece must begin later than this one
        wanted = max(first, begin + int(LATEST * limit))
        best = -1
        for low in (wanted, first):
            lo, hi = np.searchsorted(at, low), np.searchsorted(at, last, "right")
            if hi > lo:
                s = score[lo:hi]
                best = int(at[lo + len(s) - 1 - int(np.argmax(s[::-1]))])
                break
        end = best if best > 0 else last
        out.append((begin, end))
        begin = end - overlap
    out.append((begin, n))
    return out


SCHEMA = "chunk_key long, source string, old_chunk_id long, piece int, begin int, size int, page_content string"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, source, number, text, limit, overlap in zip(pdf.chunk_key, pdf.source, pdf.chunk_id, pdf.page_content, pdf.max_chars, pdf.overlap_chars):
            where = [(0, len(text))] if pd.isna(limit) else cuts(text, int(limit), int(overlap))
            out += [(key, source, number, i, a, b - a, text[a:b]) for i, (a, b) in enumerate(where)]
        yield pd.DataFrame(out, columns=["chunk_key", "source", "old_chunk_id", "piece", "begin", "size", "page_content"]).astype({"old_chunk_id": "Int64"})


def pieces(chunks: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of all chunks, in order of piece within a chunk (from 0), with their offsets."""
    kinds = sources.select("source", "kind").dropDuplicates(["source"])
    c = chunks.where("page_content is not null").select("chunk_key", "source", "chunk_id", "page_content")
    c = c.join(F.broadcast(kinds) if small(kinds, 10_000) else kinds, "source", "left").withColumn("kind", F.when(F.col("source").isNull(), "none").otherwise(F.col("kind")))
    lim = limits.select("kind", F.greatest("max_chars", F.lit(1)).alias("max_chars"), F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).dropDuplicates(["kind"])
    c = c.join(F.broadcast(lim) if small(lim, 10_000) else lim, "kind", "left")
    return c.select("chunk_key", "source", "chunk_id", "page_content", "max_chars", "overlap_chars").mapInPandas(_cut, SCHEMA)


def numbered(chunks: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces with new chunk_id, from 1 within a source in order of the old number, the chunk and the piece.

    The numbers come from counts per block of old numbers, so a source with a third of all rows is no single task.
    """
    p = pieces(chunks, sources, limits)
    block = (F.coalesce("old_chunk_id", F.lit(0)) / 1024).cast("long")
    p = cut(p.withColumn("_block", block).withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))  # null is no source named ""
    n = p.groupBy("_source", "_block").agg(F.count("*").alias("n"))
    # one row per 1024 old numbers
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy("_source", "_block").orderBy("old_chunk_id", "chunk_key", "piece"))
    j = p.withColumn("_here", here).join(before, ["_source", "_block"])
    return j.select("chunk_key", "source", (F.col("before") + F.col("_here")).alias("chunk_id"), "old_chunk_id", "piece", "begin", "size", "page_content")


def found(chunks: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_key of the chunks that had to be cut."""
    return pieces(chunks, sources, limits).where("piece = 1").select("chunk_key")
