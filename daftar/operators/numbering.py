"""Dense positions over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.functions.text import col
from daftar.session import cut


def by_hash(df: DataFrame, key: list[str], seed: str, name: str = "position") -> DataFrame:
    """df with positions from 1 in order of md5(seed, key): a shuffle that does not depend on the partitions.

    Keys should be unique; rows of equal keys get neighbouring positions in any order.
    """
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    return by_order(df.withColumn("_h", h), ["_h", *key], name).drop("_h")


def by_order(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """df with positions from 1 in the order of ``order``, which should tell all rows apart; nulls come first.

    Rows are divided into ranges of the order (borders from a sample of it, so no value of a leading column makes a
    range large), sorted and numbered within each, and written; the numbers of rows of the ranges, one row a range,
    are all that is summed in one task.
    """
    keys = {f"_o{i}": col(c) for i, c in enumerate(order)}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = df.withColumns(keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys)
    t = cut(t.withColumns({"_range": F.spark_partition_id(), "_here": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = t.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"))
    return t.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_here") + 1).drop("_range", "_here", "_before")


def vector_ids(df: DataFrame, position: str, name: str = "id") -> DataFrame:
    """chunk_{i}, i from 0, of positions from 1."""
    return df.withColumn(name, F.concat(F.lit("chunk_"), (col(position) - 1).cast("string")))
