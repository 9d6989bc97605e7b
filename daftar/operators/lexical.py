"""Term weights and lexical retrieval (beyond the dense retrieval above)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.session import cut, small


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: lower-case terms at white space."""
    t = df.select(F.col(key), F.explode(F.split(F.lower(text), r"[ \n\t]+")).alias("term")).where("term <> ''")
    return t.groupBy(key, "term").agg(F.count("*").alias("tf"))


def tf_idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), scaled to length one per document."""
    n = df.where(F.col(text).isNotNull()).count()
    t = terms(df, key, text)
    d = t.groupBy("term").agg(F.count("*").alias("df"))
    w = t.join(d, "term").withColumn("w", F.col("tf") * (F.log((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1.0))
    length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    return w.join(length, key).select(key, "term", (F.col("w") / F.col("_l")).alias("weight"))


def bm25(queries: DataFrame, docs: DataFrame, qid: str, did: str, qtext: str, dtext: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, rank, doc_id, score of the k best documents of each query; ties to the smaller id.

    A document's size is counted in its row, and only the queries' terms are taken out of it: a third of all rows
    with one term makes partial counts, no large task.  The queries' terms are broadcast only after a count.
    """
    words = F.filter(F.split(F.lower(dtext), r"[ \n\t]+"), lambda x: x != "")
    rows = docs.select(F.col(did), words.alias("_w")).withColumn("size", F.size("_w").cast("double")).where("size > 0")
    n, mean = rows.agg(F.count("*"), F.avg("size")).first()
    qt = cut(queries.select(F.col(qid).alias("query_id"), F.explode(F.array_distinct(F.split(F.lower(qtext), r"[ \n\t]+"))).alias("term")).where("term <> ''"))
    asked = qt.select("term").distinct()
    t = rows.select(did, "size", F.explode("_w").alias("term")).join(F.broadcast(asked) if small(asked) else asked, "term", "left_semi")
    w = t.groupBy(did, "size", "term").agg(F.count("*").alias("tf"))
    d = w.groupBy("term").agg(F.count("*").alias("df"))
    w = w.join(d, "term")
    idf = F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = w.withColumn("s", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(float(mean or 1.0)))))
    g = qt.join(w, "term").groupBy("query_id", F.col(did).alias("doc_id")).agg(F.round(F.sum("s"), 6).alias("score"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
