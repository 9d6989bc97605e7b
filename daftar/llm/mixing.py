"""Problem 9: combining documents so that each source contributes its target share of all tokens.

Method: systematic sampling.  A source with rate r (expected copies of each of its documents) gets the prefix sums of
r over its documents, plus one random offset per source; a document is emitted once per integer boundary its interval
crosses: floor(u + r * i) - floor(u + r * (i - 1)) times.  With r at most max_repeats no document is used more often.
The documents lie in order of the size class of their token count, then of a hash, so that large and small ones are
sampled alike and the reached share is close to the wanted one.

Total: a parameter; by default the largest at which every source can reach its share within max_repeats.  With a
larger total, sources that cannot are used max_repeats times throughout, and the report shows what they reach.

Prefix sums are two-level: counts per (source, size class, hash bucket), summed over that small table, then a position
within the bucket.  So a source with a third of all rows is spread over its buckets.

Tokens are those of a public tokenizer; its file is a parameter, read on the driver (some MB) and broadcast.  Null
and empty texts have no tokens and are left out, as are null sources and sources without target.  Copies of a text
under another doc_id are documents of their own.  Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.session import cut, small

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS, PER_BUCKET = 64, 50_000
SEED = 20
#: Parts of an octave that token counts are sorted into.
CLASSES = 4
_LOADED: dict = {}


def _encoding(raw: bytes):
    import tiktoken

    name = hashlib.md5(raw).digest()
    known = _LOADED.get(name)
    if known is None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        known = _LOADED[name] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return known


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of all documents with text."""
    with open(tokenizer, "rb") as f:
        raw = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(raw.value).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "n_tokens": [len(encode(t)) for t in pdf.text]})

    return documents.where("text <> ''").select("doc_id", "source", "text").mapInPandas(count, "doc_id long, source string, n_tokens long")


def rates(counts: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """source, target_share, max_repeats, tokens, documents, rate (expected copies of each document)."""
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    r = cut(targets.where("source is not null").join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents")))
    if total is None:
        total = r.where("target_share > 0 and tokens > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).first()[0] or 0.0
    wanted = F.when(F.col("tokens") > 0, F.col("target_share") * F.lit(float(total)) / F.col("tokens")).otherwise(0.0)
    return r.withColumn("rate", F.least(wanted, F.col("max_repeats").cast("double")))


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, copies of every document that is used at least once."""
    counts = cut(token_counts(documents.where("source is not null"), tokenizer))
    buckets = max(BUCKETS, counts.count() // PER_BUCKET)  # a source of all documents in one size class still makes small buckets
    r = rates(counts, targets, total)
    side = F.broadcast if small(r, 10_000) else lambda x: x
    size = F.floor(F.log2("n_tokens") * CLASSES).cast("int")
    h = F.xxhash64("doc_id", F.lit(seed))
    d = counts.join(side(r.select("source", "rate")), "source").withColumns({"_size": size, "_bucket": F.pmod(h, F.lit(buckets)).cast("int"), "_hash": h})
    n = d.groupBy("source", "_size", "_bucket").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_size", "_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy("source", "_size", "_bucket").orderBy("_hash", "doc_id"))
    d = d.withColumn("_here", here).join(side(before) if small(before) else before, ["source", "_size", "_bucket"])
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.col("before") + F.col("_here")
    copies = F.floor(offset + F.col("rate") * place) - F.floor(offset + F.col("rate") * (place - 1))
    return d.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(documents: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per source with a target: target and reached share of all tokens, documents used, most copies of one."""
    m = mixture(documents, targets, total, tokenizer).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    m = cut(m)
    whole = m.agg(F.sum("tokens")).first()[0] or 0
    j = targets.select("source", "target_share", "max_repeats").join(m, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select("source", "target_share", "max_repeats", zero(F.col("tokens")).alias("tokens"), (zero(F.col("tokens")) / F.lit(float(max(1, whole)))).alias("reached_share"), zero(F.col("documents")).alias("documents"), zero(F.col("most_copies")).alias("most_copies"))
