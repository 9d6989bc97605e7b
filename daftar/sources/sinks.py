"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with header in a directory, white space as it is; one file only where asked (all rows pass one task)."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_texts(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").option("lineSep", "\n").text(path)


def save_adapter(spark: SparkSession, path: str, weight, bias, **params) -> None:
    """Weights as Parquet rows, parameters as JSON."""
    rows = [(i, [float(x) for x in r], float(b)) for i, (r, b) in enumerate(zip(weight, bias))]
    spark.createDataFrame(rows, "i int, w array<double>, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_adapter(spark: SparkSession, path: str):
    """weight (list of rows), bias, parameters."""
    rows = spark.read.parquet(f"{path}/weights").orderBy("i").collect()  # one row per dimension
    return [r.w for r in rows], [r.b for r in rows], json.loads(spark.read.text(f"{path}/params").first()[0])
