"""Mixing sources to target weights, in DataFrame operations only.

Words are counted per source; sources in code point order (null last) weigh 1, 2, 3,
repeating. A source's target is its weight's share of all words, held to max_repeat
times its own words, the excess shared again by weight. With rate = target / words, a
document is taken floor(rate) times, and once more if a number hashed from the seed and
its id falls below the fraction.

The common level of the capped shares needs no rounds: for any set of capped sources,
(total - caps inside) / (weights outside) is at most the level, and the sets that hold
the sources of smallest cap / weight reach it, so it is the largest such quotient.

Defined cases: a null or empty text has no words and is taken as often as any other of
its source; a source without words has target 0 and none of its documents are taken; a
null source is a source of its own; equal rows share one decision; texts of any length
are counted whole; an empty table gives
an empty table; columns beyond the three named ones are kept and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lookup_join, running_totals, text_key, uniform

SEED = "mix-1"


def word_count(col) -> F.Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: _key, source_size, target."""
    sizes = docs.select(F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size")).groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = [F.col("_source").asc_nulls_last()]
    ranked = running_totals(sizes, order, {"_rank": F.lit(1)})
    table = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(table, (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_ratio", F.lit(max_repeat) * F.col("source_size") / F.col("_w"))
    filled = running_totals(ranked, [F.col("_ratio"), F.col("_source").asc_nulls_last()], {"_caps": F.lit(max_repeat) * F.col("source_size"), "_ws": F.col("_w")})
    whole = ranked.agg(F.sum("source_size").alias("total"), F.sum("_w").alias("weights")).first()
    quotient = (F.lit(whole["total"]) - F.col("_caps")) / (F.lit(whole["weights"]) - F.col("_ws"))
    level = filled.agg(F.max(quotient)).first()[0]
    return filled.select(
        text_key(F.col("_source")).alias("_key"),
        "source_size",
        F.least(F.lit(float(max_repeat)) * F.col("source_size"), F.lit(level).cast("double") * F.col("_w")).alias("target"),
    )


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = SEED) -> DataFrame:
    """docs as a struct column _row, with size, source_size, target, rate and copies."""
    targets = source_targets(docs, source_col, text_col, weights, max_repeat)
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(id_col).alias("_id"), text_key(F.col(source_col)).alias("_key"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_deal"),
    )
    out = lookup_join(rows, targets, "_key", by=["_deal"]).drop("_deal")
    out = out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    fraction = F.col("rate") - F.floor("rate")
    return out.withColumn("copies", F.floor("rate") + F.when(uniform(seed, F.col("_id")) < fraction, 1).otherwise(0)).drop("_key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, each repeated as often as the mix takes it; the columns of docs."""
    plan = mixing_plan(docs, **options)
    return plan.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")
