"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of checkpoints, set to spark.checkpoint.dir; where that is unset on one machine, to a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df, computed once and written as a Parquet table in the shared folder: later steps read the columns they need."""
    path = f"{shared(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
