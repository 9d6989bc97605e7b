"""Every query on empty tables, and on tables with nulls in all columns, repeated rows, long texts and extra columns."""

import pytest
from pyspark.sql import functions as F

from daftar.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
TABLES = ["qa_pairs", "chunks", "vectors", "sources", "documents", "eval_items", "mix_targets", "split_limits"]
KEYS = {"qa_pairs": "row_id", "chunks": "chunk_key", "vectors": "vec_id", "documents": "doc_id", "eval_items": "item_id"}
LONG = "كلمة طويلة جداً في نص لا ينتهي. " * 4000 + "x" * 50_000


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dirty")
    for t in TABLES:
        df = spark.read.parquet(f"{D}/{t}.parquet")
        if t in KEYS:
            k = KEYS[t]
            df = df.where(f"{k} <= 60")
            nulls = df.limit(2).select(*[(F.col(k) + 10_000).alias(k) if c == k else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
            again = df.limit(3).withColumn(k, F.col(k) + 20_000)
            text = {"qa_pairs": ["question", "context", "answer"], "chunks": ["page_content"], "documents": ["text"], "eval_items": ["text"]}.get(t, [])
            more = df.limit(1).withColumn(k, F.col(k) + 30_000)
            for c in text:
                more = more.withColumn(c, F.lit(LONG))
            blank = df.limit(1).withColumn(k, F.col(k) + 40_000)
            for c in text:
                blank = blank.withColumn(c, F.lit(""))
            df = df.union(nulls).union(again).union(more).union(blank)
        for extra in ("rows", "key", "n", "fp", "band", "_block", "title2", "h"):
            df = df.withColumn(extra, F.lit("extra"))
        df.coalesce(2).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_dirty(spark, dirty, name):
    df = QUERIES[name](spark, dirty)
    assert len(set(df.columns)) == len(df.columns)
    df.toPandas()


FOUND = {
    "p1_found": ["row_id_a", "row_id_b"], "p2_found": ["vec_id_a", "vec_id_b"], "p3_found": ["row_id", "defect"], "p4_found": ["row_id", "field_name"], "p5_found": ["chunk_key"],
    "p6_found": ["chunk_key", "line_no"], "p7_found": ["table_name", "row_key", "noise"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(FOUND))
def test_found_columns_and_no_repeated_rows(spark, dirty, name):
    df = QUERIES[name](spark, dirty)
    assert df.columns == FOUND[name]
    assert df.count() == df.distinct().count()
    assert all(t in ("bigint", "string", "int") for _, t in df.dtypes)
