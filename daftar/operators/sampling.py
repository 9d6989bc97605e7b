"""Splits, negatives and batches that are the same in every run and on every cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.operators.numbering import by_hash


def hashed(seed: str, *keys: Column | str) -> Column:
    """Pseudo-random whole number below 2^60 from md5(seed|keys)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])), 1, 15), 16, 10).cast("long")


def train_test_split(df: DataFrame, key: str, test: float = 0.2, seed: str = "42") -> DataFrame:
    """df with is_test: exactly ceil(test * n) rows, the first in order of the hash."""
    n = df.count()
    return by_hash(df, [key], seed, "_position").withColumn("is_test", F.col("_position") <= math.ceil(test * n)).drop("_position")


def negatives(rows: DataFrame, key: str, corpus: DataFrame, corpus_key: str, seed: str = "0", epoch: int = 0) -> DataFrame:
    """Each row's key with the key of one corpus row, drawn uniformly with replacement by hash."""
    n = corpus.count()
    if not n:
        return rows.select(F.col(key), F.lit(None).cast("long").alias("negative")).limit(0)
    c = by_hash(corpus.select(corpus_key), [corpus_key], seed, "_position").select(F.col(corpus_key).alias("negative"), (F.col("_position") - 1).alias("_position"))
    return rows.select(key, (hashed(seed, F.lit(epoch), key) % n).alias("_position")).join(c, "_position").select(key, "negative")


def batches(df: DataFrame, key: str, size: int = 32, seed: str = "0", epoch: int = 0) -> DataFrame:
    """df with batch numbers from 1 in shuffled order."""
    return by_hash(df, [key], f"{seed}|{epoch}", "_position").withColumn("batch", F.ceil(F.col("_position") / size)).drop("_position")
