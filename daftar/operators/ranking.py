"""Fusing and scoring ranked lists in long form: query_id, list_id, rank, doc."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, doc, score = sum of 1 / (rank + k) with ranks from 0, fused_rank; ties in order of first sight."""
    g = lists.groupBy("query_id", "doc").agg(F.sum(1.0 / (F.col("rank") + k)).alias("score"), F.min(F.struct("list_id", "rank")).alias("_first"))
    g = g.withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "_first")
    return g.withColumn("fused_rank", F.row_number().over(w)).drop("_first")


def unique_union(lists: DataFrame) -> DataFrame:
    """Each document once per query, in order of first sight: query_id, doc, position from 1."""
    g = lists.groupBy("query_id", "doc").agg(F.min(F.struct("list_id", "rank")).alias("_first"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("_first"))).drop("_first")


def retrieval_metrics(retrieved: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row: avg_hit_rate and avg_reciprocal_rank at k; ranks from 1; queries without hit count as 0.

    retrieved: query_id, rank, doc.  truth: query_id, doc (one per query).
    """
    t = truth.select("query_id", F.col("doc").alias("_truth"))
    r = retrieved.where(F.col("rank") <= k)
    hit = t.join(r, (t["query_id"] == r["query_id"]) & (t["_truth"] == r["doc"])).groupBy(t["query_id"]).agg(F.min("rank").alias("_rank"))
    j = t.select("query_id").join(hit, "query_id", "left")
    return j.agg(F.avg(F.when(F.col("_rank").isNull(), 0.0).otherwise(1.0)).alias("avg_hit_rate"), F.avg(F.coalesce(1.0 / F.col("_rank"), F.lit(0.0))).alias("avg_reciprocal_rank"))


def stuff(hits: DataFrame, document: str = "document", separator: str = "\n\n") -> DataFrame:
    """query_id, context: the documents of each query in order of rank, joined."""
    docs = F.sort_array(F.collect_list(F.struct("rank", document)))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(docs, lambda d: d[document]), separator).alias("context"))
