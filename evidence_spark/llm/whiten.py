"""Embedding whitening by MLlib's BlockMatrix.

Vectors become whole numbers (floor(scale * component)). The fit list is each distinct
vector once. Its rows, centred, are indexed into a distributed BlockMatrix; the transpose
times the matrix is the scatter, whose eigenvectors (a local eigh of dimensions x
dimensions) give the whitening matrix, and a BlockMatrix times that matrix projects all
rows. Multiplications split their inner dimension, so that no task gathers a whole matrix:
each adds up the products of some blocks and only dimensions x dimensions sums meet.

Every vector is a key of the fit list, so a vector that many rows share is merged before
the shuffle; rows themselves are indexed by their place and joined on that unique number.
What is indexed is written to the shared folder first, so numbers stay when tasks repeat.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part, nor do those of another length than most (of equally frequent lengths the smallest
counts); components whose eigenvalue is zero (at most 1e-12 of the greatest) can't be
whitened and give no rows, so a single distinct vector gives none at all; repeated rows
are projected each on its own; ids may be null or repeat; a deviation that doesn't fit a
long raises an error; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import scaled
from .common import stored

#: Rows of a block, and of those the blocks that one task multiplies.
BLOCK, SPLIT = 1024, 8
#: An eigenvalue of so small a share of the greatest counts as zero.
ZERO = 1e-12


def indexed(df: DataFrame) -> DataFrame:
    """Adds index: 0, 1, 2, ... over all rows; only counts per partition meet in one place."""
    at = F.monotonically_increasing_id()
    parts = stored(df.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(2**33 - 1)))
    counts = parts.groupBy("_part").count().orderBy("_part").collect()  # a row per partition
    bases, total = [], 0
    for r in counts:
        bases.append((r["_part"], total))
        total += r["count"]
    known = df.sparkSession.createDataFrame(bases, "_part long, _base long")
    return parts.join(F.broadcast(known), "_part").withColumn("index", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def block_matrix(df: DataFrame, vector: Column, dims: int, n: int) -> BlockMatrix:
    """Rows (index, vector: array of double) as a matrix of n rows."""
    rows = df.select("index", array_to_vector(vector).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector"), n, dims).toBlockMatrix(BLOCK, dims)


def times(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    """a x b; a long inner dimension is split over tasks of SPLIT blocks."""
    splits = max(1, -(-a.numColBlocks // SPLIT))
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def local(m: BlockMatrix) -> np.ndarray:
    """A matrix of dimensions x dimensions, on the driver."""
    return np.asarray(m.toLocalMatrix().toArray())


def rows_of(m: BlockMatrix) -> DataFrame:
    """index and vector (array of double) of every row."""
    out = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return out.select("index", vector_to_array("vector").alias("vector"))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, most: int = 4) -> DataFrame:
    """_id, component (from 1), n, deviation, whitened, explained and identity_error of every row kept and each of the most first components."""
    spark = df.sparkSession
    kept = df.select(F.col(id_col).alias("_id"), scaled(F.col(vector_col), scale).alias("_x")).filter("_x is not null")
    shape = f"_id {dict(kept.dtypes)['_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = kept.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], shape)
    dims = common["d"]
    rows = indexed(kept.filter(F.size("_x") == dims))
    fit = indexed(rows.select("_x").distinct())
    sums = {r["pos"]: (r["n"], r["s"]) for r in fit.select(F.posexplode("_x").alias("pos", "x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect()}
    n, total = sums[0][0], [sums[d][1] for d in range(dims)]
    s = F.array(*[F.lit(v).cast("long") for v in total])
    centred = F.transform(F.arrays_zip("_x", s.alias("_s")), lambda p: (p["_x"] * F.lit(n) - p["_s"]).cast("double") / F.lit(float(n)))

    fitted = block_matrix(fit, centred, dims, n)
    variance = local(times(fitted.transpose(), fitted)) / n
    values, vectors = np.linalg.eigh((variance + variance.T) / 2)
    first = [d for d in np.argsort(-values, kind="stable")[:most] if values[d] > ZERO * values.max()]
    if not first:
        return spark.createDataFrame([], shape)
    values, share = values[first], values[first] / np.trace(variance)
    whitening = vectors[:, first] / np.sqrt(values)
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, len(first), whitening.ravel(order="F").tolist()))], 1), dims, len(first))

    white = times(fitted, right)
    error = float(np.abs(local(times(white.transpose(), white)) / n - np.eye(len(first))).max())
    count = rows.count()
    projected = rows_of(times(block_matrix(rows, centred, dims, count), right))
    # Differences are below 2 n max|x|; sums of their squares are exact in decimals.
    apart = F.transform(F.arrays_zip("_x", s.alias("_s")), lambda p: (p["_x"] * F.lit(n) - p["_s"]).cast("decimal(19,0)"))
    deviation = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)")).cast("long")
    out = rows.select("index", "_id", deviation.alias("deviation")).join(projected, "index")
    out = out.select("_id", "deviation", F.posexplode("vector").alias("_c", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(v)) for v in share]), F.col("_c") + 1)
    return out.select("_id", (F.col("_c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))

