"""Shared pieces: cutting lineage, checked broadcasts, distributed ranks and running totals."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word in the contracts' sense: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A lookup side is broadcast up to so many rows (its rows are short); beyond, the join is salted.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on one machine, one of our own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Documents travel to Python so many at a time from now on: a batch of long ones stays small on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(col: Column) -> Column:
    """A join key that is never null and keeps null apart from every string."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col.cast("string")))


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone (52 bits of an MD5)."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def lookup_join(df: DataFrame, small: DataFrame, key: str, by: Sequence[str] | None = None, how: str = "inner", salts: int = 64, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join (inner or left) on a key of which one value may hold much of df.

    small has one row per key. It is broadcast up to that many rows; a larger one is
    repeated per salt and df dealt out by key and salt, a hash of the columns in by (all
    but the key and those that hold maps, if not given).
    """
    by = by or [c for c, kind in df.dtypes if c != key and "map<" not in kind]
    if small.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(small), key, how)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows before this one in the order.

    Rows are dealt out by range; only a row of totals per partition meets in one place.
    """
    spark = df.sparkSession
    parts = cut(df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = parts.join(F.broadcast(bases), "_part")
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_part", *[f"_{k}" for k in sums])


def next_in_order(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds name: value of the row that follows in the order, in the last row that of the first.

    Rows are dealt out by range; only a row per partition meets in one place.
    """
    parts = cut(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    firsts = parts.groupBy("_part").agg(F.min_by(value, F.struct(*order)).alias("_head"))
    everywhere = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = firsts.select("_part", F.coalesce(F.lead("_head").over(W.orderBy("_part")), F.first("_head").over(everywhere)).alias("_after"))
    inside = W.partitionBy("_part").orderBy(*order)
    led = parts.withColumn("_next", F.lead(value).over(inside)).join(F.broadcast(after), "_part")
    return led.withColumn(name, F.coalesce("_next", "_after")).drop("_part", "_next", "_after")


def ranks_in_class(df: DataFrame, cls: str, order: Sequence[Column], name: str, buckets: int) -> DataFrame:
    """Adds name: 0, 1, 2, ... within each class, whatever share of the rows one class holds.

    df has a column _bucket (0 to buckets - 1) that splits every class; counts by class
    and bucket give where each bucket begins.
    """
    w = W.partitionBy(cls, "_bucket")
    counts = df.groupBy(cls, "_bucket").agg(F.count("*").alias("_n"))
    bases = counts.select(
        cls, "_bucket", F.coalesce(F.sum("_n").over(W.partitionBy(cls).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base")
    )
    return (
        df.join(bases, [cls, "_bucket"])
        .withColumn(name, F.col("_base") + F.row_number().over(w.orderBy(*order)) - 1)
        .drop("_base")
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)
