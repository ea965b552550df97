"""Index upkeep: replace, upsert, refresh, delete and verified copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of the keys that come anew are replaced; write the result to a new version path."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_vectors(store: DataFrame, vectors: DataFrame, chunks: DataFrame, doc: str = "doc_id", c: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(new store, refused documents): a document enters only if it has a vector for every chunk."""
    counts = chunks.groupBy(doc).agg(F.count("*").alias("_c")).join(vectors.groupBy(doc).agg(F.count("*").alias("_v")), doc, "full_outer")
    bad = counts.filter(~F.col("_c").eqNullSafe(F.col("_v"))).select(doc)
    good = vectors.join(bad, doc, "left_anti")
    return replace_by_key(store, good, doc), bad


def refresh_metadata(chunks: DataFrame, docs: DataFrame, fields: list[str], doc: str = "doc_id") -> DataFrame:
    """The ledger's fields replace the chunks' copies; a null status reads unknown; chunks without document keep theirs."""
    fresh = docs.select(doc, F.lit(True).alias("_there"), *[(F.coalesce(F.col(f), F.lit("unknown")) if f == "status" else F.col(f)).alias(f"_{f}") for f in fields])
    out = chunks.join(fresh, doc, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col("_there"), F.col(f"_{f}")).otherwise(F.col(f)))
    return out.drop("_there", *[f"_{f}" for f in fields])


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame, doc: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the documents' rows."""
    gone = ids.select(doc).distinct()
    return {name: df.join(gone, doc, "left_anti") for name, df in tables.items()}


def copy_verified(src: DataFrame, path: str) -> tuple[int, int]:
    """A10: writes a copy and returns (rows, differing rows); the second must be 0.

    Both sides are counted by a hash of the whole row, in one pass each, and only hashes and counts meet.
    """
    src.write.mode("errorifexists").parquet(path)
    copy = src.sparkSession.read.parquet(path)
    sign = lambda df, n: df.select(F.sha2(F.concat(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.struct("*").cast("string")), 256).alias("_h"), F.lit(n).alias("_n"))
    counts = sign(src, -1).unionByName(sign(copy, 1)).groupBy("_h").agg(F.sum("_n").alias("_d"), F.count_if(F.col("_n") == 1).alias("_rows"))
    got = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.abs("_d")), F.lit(0)).alias("differing")).first()
    return got["rows"], got["differing"]
