"""Problem 6: lines that one source repeats over and over (notices, share prompts, bylines).

Method: numbers, dates and names of a line are masked, and the set of its masked shingles is hashed to BANDS pairs of
minima (locality-sensitive hashing).  Within each source, bands that stand in many chunks are candidates for clusters.
A candidate's most frequent masked line stands for it; lines of the band whose masked shingles have a similarity of at
least SIMILAR with it are its members.  A cluster whose members stand in at least MIN_CHUNKS chunks of the source and
in at least MIN_SHARE of the source's rows is repeated: report() lists such clusters and clean() removes their lines
("Published on 3 May 2024" is repeated, whatever the date).

repeated() and found() hold to the narrower rule of exact lines: two lines of a source are the same if their letters
and digits are the same, in order, once spacing, punctuation, diacritics, elongation, invisible characters and letter
case are set aside and compatibility forms are taken as ordinary ones, with the same two bounds.  Equal lines have
equal bands, so the candidates lose none.  clean() removes these lines, too.

Scale: lines are counted with map-side aggregation by (source, band) and (source, hash of the line); a source with a
third of all rows is spread over the partitions by its lines.  Bands in at least MIN_SHARE of a source's rows are at
most (bands of a row) / MIN_SHARE a source, so their table is small; it is broadcast only after a count.

Null sources and null page_content have no repeated lines (clean() returns such chunks as they are).  Empty lines
and lines without letters or digits never count.  Equal lines within one chunk count once.  Empty tables give empty
results.  Extra columns are kept by clean() and ignored by repeated().
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.codes import _powers, flatten, mix, nfkc, table
from daftar.session import cut, small

MIN_CHUNKS, MIN_SHARE = 5, 0.05
BANDS = 2
#: Share of the masked shingles that a line and the line that stands for its cluster have in common.
SIMILAR = 0.8
BLOCK = 1000
SHINGLE = 5


@functools.cache
def _masks() -> np.ndarray:
    """Of code points: 1 Arabic letters, 2 Latin letters, 3 digits, else 0."""
    t = table("key")
    c = np.arange(len(t))
    out = np.zeros(len(t), np.uint8)
    out[(t > 0) & ((c >= 0x600) & (c < 0x780) | (c >= 0xFB50) & (c < 0xFF00))] = 1
    out[(t > 0) & (c < 0x250)] = 2
    out[[i for i in np.flatnonzero(t) if unicodedata.category(chr(i))[0] == "N"]] = 3
    return out


def _sum_hash(codes: np.ndarray, head: np.ndarray) -> np.ndarray:
    size = np.diff(np.r_[head, len(codes)])
    local = np.arange(len(codes)) - np.repeat(head, size)
    vals = (codes.astype(np.uint64) + np.uint64(7)) * _powers()[local & 4095] * (np.uint64(2) * (local >> 12).astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(vals, head) + size.astype(np.uint64))


def keyed(lines: list[str], bands: int = BANDS, masked: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each NFKC line: hash of its letters and digits, whether it has any, and ``bands`` hashes of the masked line.

    Masked are numbers and dates (runs of digits become one sign) and names (in lines mostly in Arabic letters, runs of
    Latin letters become one sign); the mask sees only what the key sees, so equal keys have equal bands.  The masked lines are put
    into ``masked``, where one is given.
    """
    raw, starts = flatten(lines)
    low = table("key")[raw]
    at = np.flatnonzero(low)
    key, real, band = np.zeros(len(lines), np.uint64), np.zeros(len(lines), bool), np.zeros((len(lines), bands), np.int64)
    if not len(at):
        return key.view(np.int64), real, band
    c = low[at]
    line = np.searchsorted(starts, at, "right") - 1
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    key[line[head]] = _sum_hash(c, head)
    real[line[head]] = True
    if bands:
        kind = _masks()[c]
        size = np.diff(np.r_[head, len(at)])
        arabic = np.repeat(2 * np.add.reduceat(kind == 1, head, dtype=np.int32) > size, size)
        c = np.where(kind == 3, 48, np.where(arabic & (kind == 2), 110, c))
        run = (c[1:] == c[:-1]) & (line[1:] == line[:-1]) & ((kind[1:] == 3) | arabic[1:] & (kind[1:] == 2))
        keep = np.r_[True, ~run]
        c, line = c[keep], line[keep]
        if masked is not None:
            per = np.bincount(line, minlength=len(lines))
            text = c.astype(np.uint32).tobytes().decode("utf-32-le", "replace")
            ends = np.cumsum(per)
            masked += [text[e - n : e] for e, n in zip(ends.tolist(), per.tolist())]
        head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        size = np.diff(np.r_[head, len(c)])
        left = np.repeat(head + size, size) - np.arange(len(c))  # letters up to the end of the line
        g = np.zeros(len(c), np.uint64)
        for j in range(SHINGLE):
            v = np.zeros(len(c), np.uint64)
            v[: len(c) - j] = c[j:]
            g = g * np.uint64(0x100000001B3) + np.where(left > j, v, np.uint64(0))
        # shingles that run beyond the line count only in lines shorter than a shingle
        g = np.where((left >= SHINGLE) | (np.repeat(size, size) < SHINGLE), mix(g), np.uint64(0xFFFFFFFFFFFFFFFF))
        for b in range(bands):
            first = np.minimum.reduceat(g * np.uint64(0x9E3779B97F4A7C15 + 2 * b), head)
            second = np.minimum.reduceat(g * np.uint64(0xC2B2AE3D27D4EB4F + 2 * b), head)
            band[line[head], b] = mix(first * np.uint64(31) + second + np.uint64(b)).view(np.int64)
    return key.view(np.int64), real, band


def _lines(batches: Iterator[pd.DataFrame], masks: bool = False) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            p = pdf.iloc[i : i + BLOCK]
            texts = nfkc(list(p.page_content))
            parts = [t.split("\n") for t in texts]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            flat = [x for part in parts for x in part]
            masked: list | None = [] if masks else None
            key, real, band = keyed(flat, masked=masked)
            no = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1
            f = pd.DataFrame({"source": np.repeat(p.source.to_numpy(), size), "chunk_key": np.repeat(p.chunk_key.to_numpy(), size), "line_no": no.astype(np.int32), "key": key, **{f"b{b}": band[:, b] for b in range(BANDS)}})
            yield (f.assign(masked=pd.Series(masked or [""] * len(f), dtype=object)) if masks else f)[real]


def _often(n: DataFrame, totals: DataFrame) -> DataFrame:
    return n.join(F.broadcast(totals) if small(totals) else totals, "source").where((F.col("chunks") >= MIN_CHUNKS) & (F.col("chunks") >= MIN_SHARE * F.col("rows")))


def _candidates(chunks: DataFrame, masks: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines with a frequent band (bands that are not are null), the frequent bands, the sources' rows."""
    ok = chunks.where("source is not null").select("source", "chunk_key", "page_content")
    totals = cut(ok.groupBy("source").agg(F.count("*").alias("rows")))
    schema = "source string, chunk_key long, line_no int, key long, " + ", ".join(f"b{b} long" for b in range(BANDS)) + (", masked string" if masks else "")
    lines = cut(ok.where("page_content is not null").mapInPandas(lambda x: _lines(x, masks), schema))
    bands = functools.reduce(DataFrame.union, [lines.select("source", F.col(f"b{b}").alias("band")) for b in range(BANDS)])
    n = bands.groupBy("source", "band").agg(F.count("*").alias("chunks"))  # at least the distinct chunks
    n = cut(_often(n, totals).select("source", "band"))
    side = F.broadcast if small(n) else lambda x: x
    for b in range(BANDS):
        lines = lines.join(side(n.select("source", F.col("band").alias(f"b{b}"), F.lit(True).alias(f"in{b}"))), ["source", f"b{b}"], "left")
    lines = lines.where(" or ".join(f"in{b}" for b in range(BANDS)))
    kept = [F.when(F.col(f"in{b}"), F.col(f"b{b}")).alias(f"b{b}") for b in range(BANDS)]
    return cut(lines.select("source", "chunk_key", "line_no", "key", *kept, *(["masked"] if masks else []))), n, totals


def _exact(lines: DataFrame, totals: DataFrame) -> DataFrame:
    once = lines.select("source", "key", "chunk_key").distinct()
    exact = cut(_often(once.groupBy("source", "key").agg(F.count("*").alias("chunks")), totals))
    return lines.select("source", "chunk_key", "line_no", "key").join(F.broadcast(exact) if small(exact) else exact, ["source", "key"])


def repeated(chunks: DataFrame) -> DataFrame:
    """source, chunk_key, line_no, key, chunks (rows of the source with this line), rows (of the source)."""
    lines, _, totals = _candidates(chunks, masks=False)
    return _exact(lines, totals)


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    def shingles(t: str) -> set:
        return {t[i : i + SHINGLE] for i in range(max(1, len(t) - SHINGLE + 1))}

    memo: dict = {}
    out = []
    for x, y in zip(a, b):
        if y not in memo:
            memo[y] = shingles(y)
        s = shingles(x)
        out.append(len(s & memo[y]) >= SIMILAR * len(s | memo[y]))
    return pd.Series(out, dtype=bool)


def clusters(chunks: DataFrame) -> DataFrame:
    """source, chunk_key, line_no, cluster (its masked line), of all lines of repeated clusters, exact ones included."""
    lines, _, totals = _candidates(chunks, masks=True)
    long = lines.select("source", "chunk_key", "line_no", "masked", F.explode(F.array_compact(F.array(*[f"b{b}" for b in range(BANDS)]))).alias("band"))
    n = long.groupBy("source", "band", "masked").agg(F.count("*").alias("n"))
    first = n.groupBy("source", "band").agg(F.max_by("masked", F.struct("n", "masked")).alias("cluster"))
    # one comparison for each different masked line of a band
    near = n.select("source", "band", "masked").join(first, ["source", "band"]).where((F.col("masked") == F.col("cluster")) | F.pandas_udf(_similar, "boolean")("masked", "cluster"))
    near = cut(near.select("source", "masked", "cluster").distinct())
    members = lines.select("source", "chunk_key", "line_no", "masked").join(F.broadcast(near) if small(near) else near, ["source", "masked"]).drop("masked")
    often = members.select("source", "cluster", "chunk_key").distinct().groupBy("source", "cluster").agg(F.count("*").alias("chunks"))
    often = cut(_often(often, totals).select("source", "cluster"))
    members = members.join(F.broadcast(often) if small(often) else often, ["source", "cluster"], "left_semi")
    members = cut(members.groupBy("source", "chunk_key", "line_no").agg(F.min("cluster").alias("cluster")))
    same = _exact(lines, totals).select("chunk_key", "line_no").join(members, ["chunk_key", "line_no"], "left_anti")
    same = same.join(lines, ["chunk_key", "line_no"]).select("source", "chunk_key", "line_no", F.col("masked").alias("cluster"))
    return members.union(same)


def found(chunks: DataFrame) -> DataFrame:
    return repeated(chunks).select("chunk_key", "line_no")


def report(chunks: DataFrame) -> DataFrame:
    """Per source and repeated cluster: the chunks and lines it stands on, and one way it is written."""
    r = clusters(chunks)
    n = r.groupBy("source", "cluster").agg(F.countDistinct("chunk_key").alias("chunks"), F.countDistinct("chunk_key", "line_no").alias("lines"), F.min(F.struct("chunk_key", "line_no")).alias("at"))
    c = chunks.select("chunk_key", "page_content")
    n = n.select("source", "chunks", "lines", F.col("at.chunk_key").alias("chunk_key"), F.col("at.line_no").alias("line_no")).join(c, "chunk_key")
    return n.select("source", "chunks", "lines", F.get(F.split("page_content", "\n", -1), F.col("line_no") - 1).alias("line"))


def clean(chunks: DataFrame) -> DataFrame:
    """The chunks with page_content without the lines of repeated clusters, and lines_removed."""
    drops = clusters(chunks).groupBy(F.col("chunk_key").alias("_chunk")).agg(F.collect_list("line_no").alias("_drop"))
    j = chunks.join(drops, F.col("chunk_key") == F.col("_chunk"), "left")
    kept = F.array_join(F.filter(F.split("page_content", "\n", -1), lambda x, i: ~F.array_contains("_drop", i + 1)), "\n")
    return j.withColumn("page_content", F.when(F.col("_drop").isNull(), F.col("page_content")).otherwise(kept)).withColumn("lines_removed", F.coalesce(F.size("_drop"), F.lit(0))).drop("_chunk", "_drop")
