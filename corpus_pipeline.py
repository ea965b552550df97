"""The corpus pipeline: reject toxic text, reject text of no language, keep one of each
group of near copies (five-word shingles, similarity 0.8), mix sources, pack.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but
the last return the columns of documents.

Defined cases: a null or empty text is clean, has no language and is rejected by the second
stage (the whole table, if it has no letters); rows of one id stand each for themselves;
null ids and sources are kept as they are; texts of any length are read whole; repeated
rows are copies of each other, of which one stays; an empty table passes all stages empty;
columns beyond those of documents are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidence_spark.llm import jaccard, language, mixing, packing, toxicity
from evidence_spark.llm.common import small_batches, stored, table
from evidence_spark.llm.queries import toxicity_model


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity_model(spark, docs, sf_dir))


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.keep_known(docs, language.fit(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.keep_first(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_unknown_language),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Model fits and column generation are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
