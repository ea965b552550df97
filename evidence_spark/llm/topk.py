"""Exact top-k by inner product: an impact-ordered index, processed score at a time.

Rows are dealt into blocks of BLOCK vectors, queries into lots of LOT; every block meets
every lot once, by a cogroup on their two numbers, where the block's index is built once
for the whole lot. A posting's impact is its part's size, quantised to LEVELS levels; the
vectors of one level in one dimension are a posting segment. Segments are processed by
descending impact, each for BATCH queries at a time. What of a vector's length lies in
levels not yet processed bounds what they can still add or take (Cauchy-Schwarz), so every
score is bounded on both sides. A query stops only on proof: when so few vectors may still
reach its k-th lower bound that they are rescored exactly. Ties are among them; each
query's best are kept per block and then over all blocks.

A first pass over one block gives every query its k-th best score there. That bound is
carried into all other blocks, so that their segments of low impact are seldom needed.

Defined cases: a vector that is null, empty or of another length than the rest, or holds
null or non-finite parts, takes no part; ties go to the smaller id, rows without id take
no part; the query's own row is no candidate (nor is any other row of that id); rows of one
id are candidates each on their own, queries of one id are one query if equal; with fewer
than k candidates all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

BLOCK, LOT, LEVELS, BATCH = 4096, 16_384, 16, 64


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per part; null where a part is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(whole, F.lit(False)) & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(1))


class Index:
    """Posting segments of one block of vectors, by descending impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        """longest: the greatest length of a query."""
        order = np.argsort(ids, kind="stable")
        size = np.abs(vectors[order])
        most = lengths(vectors).max() * longest  # of any partial sum
        self.ids = ids[order]
        self.vectors = vectors[order].astype(np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64)  # exact
        level = size // (int(size.max()) // LEVELS + 1)
        square = self.vectors.astype(np.float64) ** 2
        self.levels = []
        for k in range(LEVELS - 1, -1, -1):
            segments = [(d, m, self.vectors[m, d]) for d in range(vectors.shape[1]) if len(m := np.flatnonzero(level[:, d] == k))]
            left = np.sqrt((square * (level < k)).sum(1)) * (1 + 1e-6)  # each vector's length in later levels
            self.levels.append((segments, left))

    def search(self, queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every query the ids and exact scores of its k best but own, of those that reach its bound."""
        n, out = len(self.ids), [None] * len(queries)
        q = queries.astype(self.vectors.dtype)
        length = lengths(queries) * (1 + 1e-6)
        open_, held = np.arange(len(q)), np.zeros((n, len(q)), self.vectors.dtype)
        share, total = 0, self.vectors.size
        for at, (segments, left) in enumerate(self.levels):
            last = at == len(self.levels) - 1
            for d, members, values in segments:
                held[members] += values[:, None] * q[open_, d]
                share += len(members)
            if not last and share < 0.3 * total:
                continue
            spread = (left[:, None] * length[open_]).astype(np.float32 if held.dtype == np.float32 else np.float64)
            least = bounds[open_].astype(np.float64)
            free = np.flatnonzero(np.isneginf(least)) if n > k else []
            if len(free):  # own may be one of the k + 1 best
                least[free] = np.partition((held[:, free] - spread[:, free]).T, n - k - 1)[:, n - k - 1]
            may = held + spread >= least - 1
            done = np.ones(len(open_), bool) if last else may.sum(0) <= max(4 * k, n // 16)
            for j in np.flatnonzero(done):
                i = open_[j]
                keep = np.flatnonzero(may[:, j])
                keep = keep[self.ids[keep] != own[i]]
                scores = (self.vectors[keep] @ q[i]).astype(np.int64)
                best = np.lexsort((self.ids[keep], -scores))[:k]
                out[i] = self.ids[keep][best], scores[best]
            open_, held = open_[~done], held[:, ~done]
            if not len(open_):
                break
        return out


def vectors_of(t: pa.Table, name: str) -> np.ndarray:
    values = t[name].combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1)


def best_in_blocks(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the best of each query in each block. rows (_id, _v, _block, _lot), queries (_id, _v, _bound, _block, _lot)."""

    def search(block: pa.Table, lot: pa.Table) -> pa.Table:
        found, ids = [], lot["_id"].to_numpy()
        if len(block) and len(lot):
            q, bounds = vectors_of(lot, "_v"), lot["_bound"].to_numpy()
            index = Index(block["_id"].to_numpy(), vectors_of(block, "_v"), lengths(q).max())
            for i in range(0, len(q), BATCH):
                found += index.search(q[i : i + BATCH], ids[i : i + BATCH], bounds[i : i + BATCH], k)
        sizes = [len(x) for x, _ in found]
        column = lambda i: pa.array(np.concatenate([f[i] for f in found]) if found else [], pa.int64())
        return pa.table({"query_id": pa.array(np.repeat(ids, sizes) if found else [], pa.int64()), "id": column(0), "score": column(1)})

    return rows.groupBy("_block", "_lot").cogroup(queries.groupBy("_block", "_lot")).applyInArrow(search, "query_id long, id long, score long")


def exact_topk(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank (from 1), id, score: the k largest integer inner products of each query.

    Both frames have an id and an array of longs whose products' sums fit a long.
    """
    spark = rows.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<long>").alias("_v")).filter("_id is not null and _v is not null")
    rows, queries = clean(rows), clean(queries)
    nr, nq = rows.count(), queries.count()
    if not nr or not nq:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    blocks, lots = -(-nr // BLOCK), -(-nq // LOT)
    size = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    dealt = lambda df, n, name: df.filter(F.size("_v") == size).withColumn(name, F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int"))
    each = lambda df, first, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(n - 1))))
    rows, queries = dealt(rows, blocks, "_block"), dealt(queries.dropDuplicates(), lots, "_lot")

    none = queries.withColumn("_bound", F.lit(float("-inf"))).withColumn("_block", F.lit(0))
    found = cut(best_in_blocks(each(rows.filter("_block = 0"), 0, lots, "_lot"), none, k))
    if blocks > 1:
        bounds = found.groupBy(F.col("query_id").alias("_id")).agg(F.min("score").cast("double").alias("_bound"), F.count("*").alias("_n")).filter(F.col("_n") == k).drop("_n")
        known = queries.join(bounds, "_id", "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("-inf"))))
        found = found.union(best_in_blocks(each(rows.filter("_block > 0"), 0, lots, "_lot"), each(known, 1, blocks, "_block"), k))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
