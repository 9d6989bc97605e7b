"""Exact nearest neighbours of a stated set of queries, and the vector store on Parquet."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.operators.numbering import by_order, vector_ids
from daftar.operators.providers import Embedder, embed
from daftar.session import cut

#: Bytes of queries that are broadcast at a time, and queries and base rows that are multiplied at a time.
QUERY_BYTES, QUERY_ROWS, BASE_ROWS = 64 << 20, 1024, 4096


def _blocks(queries: DataFrame, qid: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    ids, vecs, size = [], [], 0
    for row in queries.select(qid, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        if size >= QUERY_BYTES:
            yield ids, np.array(vecs, np.float64)
            ids, vecs, size = [], [], 0
        ids.append(row[0])
        vecs.append(row[1])
        size += 8 * len(row[1])
    if ids:
        yield ids, np.array(vecs, np.float64)


class Nearest:
    """The k nearest rows seen so far of each query; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, cosine: bool, exclude_self: bool):
        self.ids, self.q, self.k, self.cosine, self.own = ids, q, k, cosine, exclude_self
        self.square = (q * q).sum(1)
        self.best: list[tuple] = [()] * -(-len(q) // QUERY_ROWS)  # (query, distance, id) of each block of queries

    def add(self, bids: np.ndarray, b: np.ndarray) -> None:
        square = (b * b).sum(1)
        if self.cosine:
            some = square > 0
            bids, b = bids[some], b[some] / np.sqrt(square[some])[:, None]
            square = np.ones(len(b))
        for n in range(len(self.best)):
            rows = slice(n * QUERY_ROWS, (n + 1) * QUERY_ROWS)
            q = self.q[rows]
            d = -(q @ b.T) if self.cosine else self.square[rows, None] + square[None, :] - 2 * (q @ b.T)
            if self.own:
                d[self.ids[rows][:, None] == bids[None, :]] = np.inf
            # the product may be off by its rounding: what is near the k-th best is measured exactly
            slack = 2e-9 + 1e-12 * (self.square[rows, None] + (square.max() if len(b) else 0.0))
            kth = np.full((len(q), 1), np.inf)
            if d.shape[1] > self.k:
                kth = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            if self.best[n]:
                old, size = self.best[n][1], np.bincount(self.best[n][0], minlength=len(q))
                full = np.flatnonzero(size == self.k)
                last = old[np.cumsum(size) - 1]
                kth[full, 0] = np.minimum(kth[full, 0], last[full] - (1.0 if self.cosine else 0.0))
            at, other = np.nonzero((d <= kth + slack) & np.isfinite(d))
            diff = q[at] - b[other]
            exact = 1 - np.einsum("ij,ij->i", q[at], b[other]) if self.cosine else np.einsum("ij,ij->i", diff, diff)
            at, exact, found = [np.concatenate(x) for x in zip((at, np.round(exact, 9), bids[other]), *([self.best[n]] if self.best[n] else []))]
            order = np.lexsort((found, exact, at))
            at, exact, found = at[order], exact[order], found[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at, "left") < self.k
            self.best[n] = (at[keep], exact[keep], found[keep])

    def frame(self) -> pd.DataFrame:
        some = [(n * QUERY_ROWS + x[0], x[1], x[2]) for n, x in enumerate(self.best) if x]
        at, d, found = (np.concatenate(x) for x in zip(*some)) if some else (np.zeros(0, int), np.zeros(0), np.zeros(0, object))
        return pd.DataFrame({"query_id": self.ids[at], "id": found, "distance": d})


def knn_join(queries: DataFrame, base: DataFrame, qid: str, bid: str, qvec: str = "embedding", bvec: str = "embedding", k: int = 10, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k nearest base rows of each query; ties to the smaller id.

    metric: "cosine" (1 - cosine) or "l2" (squared distance).  Distances are rounded to 9 decimals before ranking.
    The queries are a stated set: blocks of at most QUERY_BYTES are broadcast and multiplied with the base, which is
    read once a block and never shuffled; each partition keeps a running list of k rows a query, and only these go
    on.  Ids may be numbers or strings.  Null vectors, and for cosine all-zero ones, have no neighbours and are none;
    so have vectors of another length than the queries'.
    """
    spark = base.sparkSession
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, qid), (base, bid))]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, distance double"
    out = None
    rows = base.select(F.col(bid).alias("id"), F.col(bvec).alias("v")).where("v is not null and id is not null")
    for ids, q in _blocks(queries, qid, qvec):
        if metric == "cosine":
            n = np.linalg.norm(q, axis=1)
            ids, q = [x for x, y in zip(ids, n) if y > 0], q[n > 0] / n[n > 0][:, None]
        shared = spark.sparkContext.broadcast((np.array(ids), q))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            near = Nearest(*shared.value, k, metric == "cosine", exclude_self)
            for pdf in batches:
                pdf = pdf[pdf.v.map(len) == near.q.shape[1]] if len(near.q) else pdf.iloc[:0]
                for i in range(0, len(pdf), BASE_ROWS):
                    p = pdf.iloc[i : i + BASE_ROWS]
                    near.add(p.id.to_numpy().astype(str) if p.id.dtype == object else p.id.to_numpy(), np.stack(p.v.to_numpy()).astype(np.float64))
            yield near.frame()

        part = rows.mapInPandas(best, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {kinds[0]}, rank int, id {kinds[1]}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


class VectorStore:
    """A collection of (id, document, metadata, embedding) on Parquet, with the model and dimension beside it."""

    SCHEMA = "id string, document string, metadata string, embedding array<float>"

    def __init__(self, spark, path: str, model: str, dim: int):
        self.spark, self.path, self.model, self.dim = spark, path.rstrip("/"), model, dim
        known = self._meta()
        if known is None:
            spark.createDataFrame([(json.dumps({"model": model, "dim": dim}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")
        elif known != {"model": model, "dim": dim}:
            raise ValueError(f"the store holds vectors of {known}")

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _meta(self) -> dict | None:
        return json.loads(self.spark.read.text(f"{self.path}/meta").first()[0]) if self._exists("meta") else None

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/data") if self._exists("data") else self.spark.createDataFrame([], self.SCHEMA)

    def add(self, rows: DataFrame) -> None:
        """Add rows whose id is not there yet (of equal new ids one); the existing ones stay."""
        new = rows.select("id", "document", "metadata", F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["id"])
        new = add_if_absent(self.all(), new)
        wrong = new.where(F.size("embedding") != self.dim)
        if wrong.head(1):
            raise ValueError(f"embeddings must have {self.dim} numbers")
        new.write.mode("append").parquet(f"{self.path}/data")

    def get(self, ids: list[str]) -> DataFrame:
        return self.all().where(F.col("id").isin(ids))

    def count(self) -> int:
        return self.all().count()

    def query(self, queries: DataFrame, qid: str, k: int = 10, metric: str = "cosine") -> DataFrame:
        """query_id, rank, distance, id, document, metadata."""
        base = self.all()
        hits = knn_join(queries, base, qid, "id", k=k, metric=metric)
        return hits.join(base.select("id", "document", "metadata"), "id")


class MemoryStore:
    """A named collection kept as a frame of this session; texts are embedded as they are added, numbered from 0."""

    def __init__(self, spark, name: str, embedder: Embedder):
        self.name, self.embedder, self.rows = name, embedder, spark.createDataFrame([], VectorStore.SCHEMA)

    def add_texts(self, texts: DataFrame, text: str, order: list, metadata: str | None = None) -> None:
        """Add a row for each text that is not null, in the order given; ids go on from those before."""
        n = self.count()
        meta = F.col(metadata) if metadata else F.lit(None)
        new = by_order(texts.where(F.col(text).isNotNull()).select(*order, F.col(text).alias("document"), meta.cast("string").alias("metadata")), order, "_p")
        new = vector_ids(new.withColumn("_p", F.col("_p") + n), "_p").select("id", "document", "metadata")
        self.rows = cut(self.rows.unionByName(embed(new, "document", self.embedder)))

    def count(self) -> int:
        return self.rows.count()

    def query(self, queries: DataFrame, qid: str, text: str, k: int = 10) -> DataFrame:
        """query_id, rank, distance, id, document, metadata of the nearest texts."""
        hits = knn_join(embed(queries.select(qid, text), text, self.embedder), self.rows, qid, "id", k=k)
        return hits.join(self.rows.select("id", "document", "metadata"), "id")


def add_if_absent(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new whose key the store does not have."""
    return new.join(store.select(key), key, "left_anti")


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.where(F.col(key).isin(values))
