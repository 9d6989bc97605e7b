"""Problem 2: the k most similar other vectors (cosine) of every vector.

Method: randomly rotated one-bit codes.  Vectors are scaled to length one and assigned to the nearest of about
sqrt(n) / CELLS k-means cells.  A vector's difference from its cell's centre is rotated at random and kept as one bit
a dimension, packed in a word of 64 bits, with correction scalars: the length of the difference over the inner product
of the scaled difference with its code, the product with the centre, and the spread of the estimate.  Codes and
scalars are computed once, stored, and shuffled to the cells.  A query's rotated difference from a cell's centre is
quantised to PLANES bits a dimension; its inner products with the codes of the cell are counted in packed words, one
population count of (code and plane) a plane, and scaled by the scalars.  The error bound of the estimate gives each
base vector a highest possible similarity.  Vectors whose highest lies below the k-th best known are out; the others
are reranked by the exact product.

Which cells a query visits is chosen by measurement, in every run: for about CALIBRATE queries the exact neighbours
are found among all vectors, and the queries visit as many cells as it takes to reach SHARE of these neighbours, either
by the rank of the cell for the query or by how much farther its centre is than the nearest one, whichever visits
fewer.  Where the data have no clusters, that is most cells, and the search is slow rather than wrong.

What is approximate: neighbours in cells that are not visited (1 - SHARE of them, as measured), and those outside
the error bound (EPSILON standard deviations).  The README has the recall measured against brute force.

Fitted on a sample: only the centres, on at most about SAMPLE vectors, those of small hashed id (PER_CELL a cell).
All vectors are indexed and all are queries.  Cells of more than BLOCK vectors are split by hashed id; a query visits
all parts.  Queries of one part are spread over salted groups of about QUERY_BLOCK.  Exact copies of a vector are
searched once and share their representative's list; of a class of copies its k + 1 smallest ids can occur in lists.
With SAMPLE the cells stop growing at 10^9 vectors; beyond, parts of cells grow in number instead.

Not usable: null, NaN or infinite numbers, another dimension than DIM, all zeros; such rows are left out.  Empty
tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.operators.knn import knn_join
from daftar.session import cut

K, DIM = 10, 64
#: Cells are sqrt(n) / CELLS; vectors a cell that the centres are fitted on, and in all.
CELLS, PER_CELL, SAMPLE = 3.0, 100, 100_000
#: Queries whose exact neighbours decide how many cells are visited; share of these neighbours to reach.
CALIBRATE, SHARE = 500, 0.99
BLOCK, QUERY_BLOCK = 4096, 4096
#: Queries at a time; multiples of k that are compared first to get a threshold; bits of a query's numbers.
ROWS, FIRST, PLANES = 64, 4, 4
#: Standard deviations of the bound (the value of the published method); share of pairs from which all are multiplied.
EPSILON, DENSE = 1.9, 0.04


def unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    # scaled first, so that tiny numbers do not vanish when squared
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        empty = size[:, 0] == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        size[empty] = 1
        c = total / size
    return c


def coded(x: np.ndarray, c: np.ndarray, own: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed code of each vector (words of 64 bits) and its scalars: scale, product with its centre, spread."""
    dim, words = x.shape[1], -(-x.shape[1] // 64)
    d = (x - c[own]) @ rot
    length = np.sqrt((d * d).sum(1))
    safe = np.where(length > 0, length, 1)
    bits = np.zeros((len(x), 64 * words), bool)
    bits[:, :dim] = d > 0
    quality = np.where(length > 0, np.abs(d).sum(1) / safe / np.sqrt(dim), 1.0)  # product of the difference with its code
    spread = EPSILON * np.sqrt(np.maximum(0, 1 - quality**2)) / quality / np.sqrt(dim - 1) * length
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.stack([length / quality / np.sqrt(dim), (x * c[own]).sum(1), spread], 1)


class Cell:
    """One-bit codes and correction scalars of the base vectors of a cell, and the vectors for reranking."""

    def __init__(self, base: np.ndarray, ids: np.ndarray, codes: np.ndarray, scalars: np.ndarray, centre: np.ndarray, rot: np.ndarray):
        self.codes, self.scale = np.ascontiguousarray(codes.T), scalars[:, 0].astype(np.float32)
        ones = np.bitwise_count(codes).sum(1)
        # <o, q> = <o - c, q - c> + <o, c> + (the same for all o); the first from the code, scaled, its error in proportion to |q - c|
        self.side = np.stack([scalars[:, 0] * ones, scalars[:, 0], scalars[:, 1], scalars[:, 2]]).astype(np.float32)
        self.base, self.single, self.ids, self.centre, self.rot = base, base.astype(np.float32), ids, centre, rot
        self.order = np.argsort(ids)

    def _products(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each rotated difference: its counts with all codes times its step, its lowest number, the sum of its quantised numbers, its error bound."""
        low = e.min(1)
        step = np.maximum(e.max(1) - low, 1e-12) / ((1 << PLANES) - 1)
        u = np.zeros((len(e), 64 * len(self.codes)), np.uint8)
        u[:, : e.shape[1]] = np.rint((e - low[:, None]) / step[:, None])
        count = np.zeros((len(e), self.codes.shape[1]), np.uint16)
        for j in range(PLANES):
            plane = np.packbits(u >> j & 1, axis=1, bitorder="little").view(np.uint64)
            for w, codes in enumerate(self.codes):
                count += np.bitwise_count(plane[:, w : w + 1] & codes).astype(np.uint16) << j
        total = step * u.sum(1) + low * e.shape[1]
        return count * step[:, None].astype(np.float32), low, total, EPSILON * step * np.sqrt(e.shape[1] / 12)

    def _own(self, qids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.order[np.minimum(np.searchsorted(self.ids, qids, sorter=self.order), len(self.ids) - 1)]
        rows = np.flatnonzero(self.ids[at] == qids)
        return rows, at[rows]

    def search(self, queries: np.ndarray, qids: np.ndarray, floor: np.ndarray, k: int) -> list[tuple]:
        """For each query its best (at most k) base rows, without itself, of similarity floor or more: negated similarities and ids."""
        out = []
        for i in range(0, len(queries), ROWS):
            q, f = queries[i : i + ROWS], floor[i : i + ROWS].copy()
            single = q.astype(np.float32)
            e = (q - self.centre) @ self.rot
            far = np.sqrt((e * e).sum(1, keepdims=True))
            same = (q @ self.centre) - self.centre @ self.centre
            sums, low, total, error = self._products(e)
            about = 2 * sums * self.scale + np.stack([2 * low, -total, np.ones(len(q))], 1).astype(np.float32) @ self.side[:3]
            mine = self._own(qids[i : i + ROWS])
            about[mine] = -np.inf
            new = np.flatnonzero(np.isneginf(f))
            m = min(FIRST * k, len(self.ids))
            if len(new) and len(self.ids) > m:
                # the k-th best of some exact products bounds the k-th best from below
                top = np.argpartition(about[new], -m, axis=1)[:, -m:]
                near = np.einsum("ij,ikj->ik", single[new], self.single[top])
                own = np.full(len(q), -1)
                own[mine[0]] = mine[1]
                near[top == own[new][:, None]] = -np.inf
                f[new] = np.partition(near, -k, axis=1)[:, -k] - 1e-5
            high = about + np.stack([far[:, 0], error], 1).astype(np.float32) @ self.side[[3, 1]]
            if len(new) and len(self.ids) > m:
                high[new[:, None], top] = np.inf  # their products are known, so a query has k of them whatever the bound
            high[mine] = -np.inf
            rows, cols = np.nonzero((high >= (f - same - 1e-5).astype(np.float32)[:, None]) & (high > -np.inf))
            if len(rows) > DENSE * high.size:  # one product for all is cheaper than picking the pairs
                near = (single @ self.single.T)[rows, cols]
            else:
                near = np.einsum("ij,ij->i", single[rows], self.single[cols])
            keep = near >= f[rows] - 1e-5
            rows, cols = rows[keep], cols[keep]
            if len(self.ids) > 4 * k:  # only pairs that the k-th best of the pairs of their query does not rule out
                near = near[keep]
                order = np.lexsort((-near, rows))
                rank = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order], "left")
                at = order[rank == k - 1]
                kth = np.full(len(q), -np.inf, np.float32)
                kth[rows[at]] = near[at]
                keep = near >= kth[rows] - 1e-5
                rows, cols = rows[keep], cols[keep]
            sims = np.round(np.einsum("ij,ij->i", q[rows], self.base[cols]), 12)
            best = np.lexsort((self.ids[cols], -sims, rows))
            rows, cols, sims = rows[best], cols[best], sims[best]
            at = np.searchsorted(rows, np.arange(len(q) + 1))
            out += [(-sims[a : min(b, a + k)], self.ids[cols[a : min(b, a + k)]]) for a, b in zip(at[:-1], at[1:])]
        return out


def _visits(lists: DataFrame, queries: DataFrame, c: np.ndarray, k: int) -> tuple[int | None, float]:
    """How many cells to visit: by rank, or (rank None) all whose centre is at most so much less similar than the nearest.

    From the exact neighbours of some queries among all vectors (their cells, k a query, reach the driver).
    """
    true = knn_join(queries, lists, "vec_id", "vec_id", k=k, exclude_self=True).select(F.col("query_id"), F.col("id").alias("vec_id"))
    true = lists.select("vec_id", "cell").join(F.broadcast(true), "vec_id").select("query_id", "cell").toPandas()
    q = queries.toPandas()
    if not len(true):
        return len(c), 0.0
    s = unit(q.embedding) @ c.T
    place = np.empty(s.shape, np.int64)
    np.put_along_axis(place, np.argsort(-s, axis=1, kind="stable"), np.arange(s.shape[1])[None, :], 1)
    row = true.query_id.map(dict(zip(q.vec_id, range(len(q))))).to_numpy()
    cell = true.cell.to_numpy()
    rank = int(np.sort(place[row, cell])[int(np.ceil(SHARE * len(row))) - 1]) + 1
    gap = float(np.sort(s.max(1)[row] - s[row, cell])[int(np.ceil(SHARE * len(row))) - 1]) + 1e-9
    return (rank, 0.0) if rank <= (s >= s.max(1, keepdims=True) - gap).sum(1).mean() else (None, gap)


def neighbours(vectors: DataFrame, k: int = K, dim: int = DIM) -> DataFrame:
    """vec_id, rank (from 1), neighbour_id, similarity (12 decimals; ties to the smaller id)."""
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.where((F.size("embedding") == dim) & ~bad & F.exists("embedding", lambda x: x != 0)).select("vec_id", F.transform("embedding", lambda x: x.cast("float")).alias("embedding"))
    reps = cut(ok.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, similarity double")
    cells = max(1, round(min(np.sqrt(n) / CELLS, SAMPLE / PER_CELL * 10)))
    rot = rotation(dim)

    def some(rows: int) -> DataFrame:
        """About so many of the vectors, by hashed id."""
        return reps.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(int(min(1.0, rows / n) * (1 << 40)))).select("vec_id", "embedding")

    sample = some(min(SAMPLE, PER_CELL * cells)).toPandas()
    sample = sample if len(sample) else reps.limit(1).select("vec_id", "embedding").toPandas()
    sample = unit(sample.sort_values("vec_id").embedding)
    c = centres(sample, min(cells, len(sample)))
    cells = len(c)
    shared = spark.sparkContext.broadcast((c, rot))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, rot = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), 2048):
                p = pdf.iloc[i : i + 2048]
                x = unit(p.embedding)
                own = np.argmax(x @ c.T, 1)
                codes, scalars = coded(x, c, own, rot)
                yield pd.DataFrame({"vec_id": p.vec_id.to_numpy(), "embedding": p.embedding.to_numpy(), "cell": own.astype(np.int32), "code": list(codes.view(np.int64)), "scalars": list(scalars.astype(np.float32))})

    lists = cut(reps.select("vec_id", "embedding").mapInPandas(code, "vec_id long, embedding array<float>, cell int, code array<long>, scalars array<float>"))
    base_n = {r[0]: r[1] for r in lists.groupBy("cell").count().collect()}  # one number a cell
    held = np.array([base_n.get(j, 0) for j in range(cells)])
    rank, gap = _visits(lists, some(CALIBRATE), c, k)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, _ = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                p = pdf.iloc[i : i + 512]
                s = unit(p.embedding) @ c.T
                order = np.argsort(-s, axis=1, kind="stable")
                s = np.take_along_axis(s, order, 1)
                visits = (s >= s[:, :1] - gap).sum(1) if rank is None else np.full(len(p), min(rank, cells))
                visits = np.maximum(visits, (np.cumsum(held[order], axis=1) <= k).sum(1) + 1)  # more than k vectors at least
                yield pd.DataFrame({"vec_id": p.vec_id.to_numpy(), "embedding": p.embedding.to_numpy(), "near": [x[:v].astype(np.int32) for x, v in zip(order, visits)]})

    at = cut(reps.select("vec_id", "embedding").mapInPandas(near, "vec_id long, embedding array<float>, near array<int>"))
    # one size a cell
    query_n = {r[0]: r[1] for r in at.select(F.explode("near").alias("c")).groupBy("c").count().collect()}
    sizes = spark.createDataFrame([(j, -(-base_n.get(j, 0) // BLOCK), max(1, -(-query_n.get(j, 0) // QUERY_BLOCK))) for j in range(cells)], "cell int, parts int, salts int")
    sizes = F.broadcast(sizes.where("parts > 0"))  # at most SAMPLE / PER_CELL * 10 rows
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int")
    lists = lists.withColumn("h", h)
    base = lists.join(sizes, "cell").select("vec_id", "embedding", "cell", F.pmod("h", "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("double").alias("floor"), "code", "scalars")

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c, rot = shared.value
        b, qs = pdf[pdf["floor"].isna()], pdf[pdf["floor"].notna()]
        if not len(b) or not len(qs):
            return pd.DataFrame({"vec_id": pd.Series(dtype="int64"), "s": pd.Series(dtype=object), "n": pd.Series(dtype=object)})
        cell = Cell(unit(b.embedding), b.vec_id.to_numpy(), np.stack(b.code.to_numpy()).view(np.uint64), np.stack(b.scalars.to_numpy()), c[key[0]], rot)
        found = cell.search(unit(qs.embedding), qs.vec_id.to_numpy(), np.where(qs.floor < -1.5, -np.inf, qs.floor), k)
        some = [(v, x[0], x[1]) for v, x in zip(qs.vec_id, found) if len(x[0])]
        return pd.DataFrame(some, columns=["vec_id", "s", "n"])

    def visit(q: DataFrame) -> DataFrame:
        """Lists of the queries (vec_id, embedding, cell, h, floor) from all parts of their cells."""
        q = q.join(sizes, "cell").select("vec_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod("h", "salts").alias("salt"), "floor", F.lit(None).cast("array<long>").alias("code"), F.lit(None).cast("array<float>").alias("scalars"))
        return base.union(q).groupBy("cell", "part", "salt").applyInPandas(search, "vec_id long, s array<double>, n array<long>")

    def merged(some: DataFrame) -> DataFrame:
        return some.groupBy("vec_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("s", "n")))), 1, k).alias("best"))  # at most probe x parts x k numbers

    # the home cell first: its k-th best is the floor in the others, which leaves little to rerank there
    home = cut(merged(visit(lists.select("vec_id", "embedding", "cell", "h").withColumn("floor", F.lit(-2.0)))))
    floor = home.select("vec_id", F.when(F.size("best") == k, -F.get("best", F.lit(k - 1)).s).otherwise(-2.0).alias("floor"))
    rest = at.select("vec_id", "embedding", F.explode(F.slice("near", 2, cells)).alias("cell"), h.alias("h")).join(floor, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    best = merged(visit(rest).union(home.select("vec_id", "best.s", "best.n")))
    # copies: lists of representatives become lists of rows
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    copied = reps.where("copies > 1").select("embedding", F.col("vec_id").alias("rep"))
    twins = ok.join(copied, "embedding").select("embedding", "rep", "vec_id")
    first = cut(twins.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    long = best.select("vec_id", F.explode_outer("best").alias("b")).select("vec_id", F.col("b.n").alias("n"), F.col("b.s").alias("s"))
    own = reps.select("vec_id", F.col("vec_id").alias("n"), F.lit(-1.0).alias("s"))
    long = long.where("n is not null").union(own).join(first.withColumnRenamed("rep", "n"), "n", "left")
    long = long.select("vec_id", F.explode(F.coalesce("ids", F.array("n"))).alias("n"), "s")
    lists = cut(long.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "n"))), 1, k + 1).alias("best")))
    members = reps.where("copies = 1").select("vec_id", F.col("vec_id").alias("rep")).union(twins.select("vec_id", "rep"))
    out = members.join(lists.withColumnRenamed("vec_id", "rep"), "rep")
    out = out.select("vec_id", F.posexplode(F.slice(F.filter("best", lambda b: b.n != F.col("vec_id")), 1, k)).alias("rank", "b"))
    return out.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("b.n").alias("neighbour_id"), (-F.col("b.s")).alias("similarity"))


def found(vectors: DataFrame) -> DataFrame:
    n = neighbours(vectors)
    return n.select(F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")).distinct()
