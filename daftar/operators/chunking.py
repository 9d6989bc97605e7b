"""Splitters: text to chunks, as one Catalyst expression per text."""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import clean_arabic, col, source_label, strip
from daftar.operators.numbering import by_order


def marker_split(text: Column | str, separator: str, size: int, overlap: int = 0) -> Column:
    """Array of chunks: pieces between separators (kept at a piece's start) merged up to ``size`` characters.

    A piece of ``size`` or more is a chunk of its own, as it is; merged chunks are stripped, empty ones dropped.  At
    an overflow leading pieces are dropped until at most ``overlap`` characters stay and the next piece fits.
    """
    pieces = F.filter(F.split(col(text), f"(?={re.escape(separator)})", -1), lambda p: p != "")
    none = F.array().cast("array<string>")
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, p: s + F.length(p))

    def emit(out: Column, cur: Column) -> Column:
        joined = strip(F.array_join(cur, ""))
        return F.when(joined == "", out).otherwise(F.concat(out, F.array(joined)))

    def step(state: Column, p: Column) -> Column:
        out, cur = state["out"], state["cur"]
        n = F.length(p)
        tails = F.transform(F.sequence(F.lit(0), F.size(cur)), lambda j: F.slice(cur, j + 1, F.size(cur) + 1))
        fits = F.filter(tails, lambda t: ((length(t) <= overlap) & (length(t) + n <= size)) | (F.size(t) == 0))
        rest = F.get(fits, F.lit(0))
        big = F.struct(F.concat(emit(out, cur), F.array(p)).alias("out"), none.alias("cur"))
        over = F.struct(emit(out, cur).alias("out"), F.concat(rest, F.array(p)).alias("cur"))
        more = F.struct(out.alias("out"), F.concat(cur, F.array(p)).alias("cur"))
        return F.when(n >= size, big).when((F.size(cur) > 0) & (length(cur) + n > size), over).otherwise(more)

    return F.when(col(text).isNotNull(), F.aggregate(pieces, F.struct(none.alias("out"), none.alias("cur")), step, lambda s: emit(s["out"], s["cur"])))


#: Separators in the order in which they are tried; the last one stands between all characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def words(text: str) -> int:
    return len(text.split())


class TokenCounter:
    """Tokens of a public byte-level BPE vocabulary; the file of ranks travels with the counter and is loaded once a worker."""

    def __init__(self, path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"):
        with open(path, "rb") as f:
            self.raw = f.read()
        self.encode = None

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "encode": None}

    def __call__(self, text: str) -> int:
        if self.encode is None:
            import tiktoken

            # Fixed value: the public split pattern of this vocabulary.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}
            self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return len(self.encode(text))


def _merge(parts: list[tuple[str, int]], size: int, overlap: int) -> list[str]:
    """Parts packed into chunks of at most size; leading parts go until at most overlap stays and the next part fits."""
    out: list[str] = []
    cur: deque = deque()
    total = 0
    for p, n in parts:
        if cur and total + n > size:
            out.append("".join(x for x, _ in cur).strip())
            while cur and (total > overlap or total + n > size):
                total -= cur.popleft()[1]
        cur.append((p, n))
        total += n
    out.append("".join(x for x, _ in cur).strip())
    return [x for x in out if x]


def token_chunks(text: str, size: int, overlap: int, count: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` by ``count``, cut at the first separator that the text has, finer ones where a part is too large.

    A separator stays at the start of the part behind it.  Parts are measured one by one and merged, so a chunk's own
    count may differ a little from the sum.  Chunks are stripped, empty ones dropped.  A single character that counts
    more than ``size`` is a chunk of its own.
    """
    at = next((i for i, x in enumerate(separators) if not x or x in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    parts = [p for p in (re.split(f"(?={re.escape(sep)})", text) if sep else text) if p]
    out: list[str] = []
    fit: list[tuple[str, int]] = []
    for p in parts:
        n = count(p)
        if n < size or not finer and len(p) == 1:
            fit.append((p, n))
            continue
        out += _merge(fit, size, overlap)
        fit = []
        out += token_chunks(p, size, overlap, count, finer) if finer else [p]
    return out + _merge(fit, size, overlap)


def token_split(df: DataFrame, text: str, size: int = 600, overlap: int = 100, count: Callable[[str], int] = words) -> DataFrame:
    """df with one row per chunk of the text (column chunk) and its position from 0; other columns are kept."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "position int", "chunk string"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chunks = [[] if t is None else token_chunks(t, size, overlap, count) for t in pdf[text]]
            rows = np.repeat(np.arange(len(pdf)), [len(c) for c in chunks])
            out = {c: pdf[c].to_numpy()[rows] for c in pdf.columns}
            yield pd.DataFrame({**out, "position": [i for c in chunks for i in range(len(c))], "chunk": pd.Series([x for c in chunks for x in c], dtype=object)})

    return df.mapInPandas(split, schema)


def process_documents(docs: DataFrame, key: list[str], size: int = 600, overlap: int = 100, count: Callable[[str], int] | None = None) -> DataFrame:
    """Clean, then split, then number: source (label), chunk_id (from 1, over all documents), page_content, and the key.

    ``key`` tells the documents apart and gives their order; count defaults to the tokens of a public vocabulary.
    """
    clean = docs.select(*key, source_label("source").alias("source"), clean_arabic("page_content").alias("_t"))
    c = token_split(clean, "_t", size, overlap, count or TokenCounter()).drop("_t")
    return by_order(c, [*key, "position"], "chunk_id").select(*key, "source", "chunk_id", F.col("chunk").alias("page_content"))
