"""Measures of retrieval and answer quality, slices, splits and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import number_match, numbers, text_score
from .joins import checked_broadcast


def hit_ranks(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5), wanted: DataFrame | None = None) -> DataFrame:
    """G1: first rank of an acceptable chunk per (case_id, aspect_id), hit@k flags; no hit gives null and false.

    ranked: case_id, aspect_id, chunk_id, rank; gold: case_id, aspect_id, acceptable (array),
    or without it, with the acceptable chunks as rows in wanted (case_id, aspect_id, chunk_id).
    """
    wanted = (gold.select("case_id", "aspect_id", F.explode("acceptable").alias("chunk_id")) if wanted is None else wanted).distinct()
    first = ranked.join(wanted, ["case_id", "aspect_id", "chunk_id"]).groupBy("case_id", "aspect_id").agg(F.min("rank").alias("first_rank"))
    out = gold.select("case_id", "aspect_id").join(first, ["case_id", "aspect_id"], "left")
    return out.select("*", *[F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias(f"hit{k}") for k in ks])


def retrieval_metrics(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5), mrr_at: int = 10) -> DataFrame:
    """Case recall@k (all aspects hit), aspect recall at the last k, reciprocal rank of the best aspect."""
    last = F.col(f"hit{ks[-1]}")
    cases = hits.groupBy("case_id").agg(*[F.bool_and(f"hit{k}").alias(f"hit{k}") for k in ks], F.min("first_rank").alias("best"), F.count_if(last).alias("_hits"), F.count(last).alias("_aspects"))
    rr = F.when(F.col("best") <= mrr_at, 1.0 / F.col("best")).otherwise(0.0)
    return cases.agg(F.count("*").alias("cases"), *[F.round(F.avg(F.col(f"hit{k}").cast("double")), 6).alias(f"recall_at_{k}") for k in ks], F.round(F.avg(rr), 6).alias(f"mrr_at_{mrr_at}"), F.round(F.try_divide(F.sum("_hits"), F.sum("_aspects")), 6).alias(f"aspect_recall_at_{ks[-1]}"))


def rate_by(df: DataFrame, flag: str, dims: list[str]) -> DataFrame:
    """Count and rate overall and by each dimension, as grouping sets."""
    grouped = df.select(*dims, F.col(flag).alias("_flag")).groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims])
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg(F.col("_flag").cast("double")), 6).alias("rate"))


def latency_stats(df: DataFrame, ms: str, keys: list[str], rule: str = "ceil") -> DataFrame:
    """Count, mean, median, p95, max. rule ceil takes position ceil(0.95 n) - 1, rule round position round(0.95 (n - 1))."""
    mid = F.percentile(ms, F.lit(0.5))
    base = [F.count("*").alias("n"), F.round(F.avg(ms), 6).alias("mean"), mid.alias("p50"), F.max(ms).alias("max")]
    if rule == "ceil":
        return df.groupBy(*keys).agg(*base, F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {ms})").alias("p95"))
    # Equal values are counted before they meet, so a key brings its distinct values together only.
    values = df.filter(F.col(ms).isNotNull()).groupBy(*keys, ms).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys).orderBy(ms)
    upto = values.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(W.partitionBy(*keys)))
    p95 = upto.filter(F.col("_to") > F.bround(0.95 * (F.col("_n") - 1))).groupBy(*keys).agg(F.min(ms).alias("p95"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return df.groupBy(*keys).agg(*base).alias("a").join(p95.alias("b"), same, "left").select("a.*", "b.p95")


def score_answers(rows: DataFrame, gold: str = "gold", answer: str = "answer", numeric: Column | None = None) -> DataFrame:
    """Outcome error, empty, refusal, refusal_with_fact, match or mismatch, with score."""
    numeric = F.size(numbers(F.col(gold))) > 0 if numeric is None else numeric
    score = F.when(numeric, F.when(number_match(F.col(gold), F.col(answer)), 1.0).otherwise(0.0)).otherwise(text_score(F.col(gold), F.col(answer)))
    out = rows.withColumn("score", F.round(score, 6))
    refused = F.coalesce(F.col("refused"), F.lit(False))
    outcome = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.trim(F.coalesce(F.col(answer), F.lit(""))) == "", "empty")
        .when(refused & (F.col("score") >= 0.75), "refusal_with_fact")
        .when(refused, "refusal")
        .when(F.col("score") >= F.when(numeric, 1.0).otherwise(0.62), "match")
        .otherwise("mismatch")
    )
    return out.withColumn("outcome", outcome)


def score_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, answered rate, accuracy over all and over answered."""
    ok = F.count_if(F.col("outcome") == "match")
    answered = F.count_if(F.col("outcome").isin("match", "mismatch"))
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), answered.alias("answered"), ok.alias("correct"), F.round(ok / F.count("*"), 6).alias("accuracy"), F.round(F.try_divide(ok, answered), 6).alias("accuracy_answered"))


def option_by_number(answers: DataFrame, options: DataFrame, case: str = "case_id") -> DataFrame:
    """The option whose number is closest to one in the answer (1e-4 relative or 0.02 absolute)."""
    a = answers.select(case, F.explode(numbers(F.col("answer"))).alias("_x"))
    o = options.select(case, "option", F.explode(numbers(F.col("option_text"))).alias("_y"))
    gap = F.abs(F.col("_x") - F.col("_y"))
    near = a.join(o, case).withColumn("_gap", gap).filter(F.col("_gap") <= F.greatest(F.lit(0.02), 1e-4 * F.abs("_y")))
    return near.groupBy(case).agg(F.min_by("option", F.struct("_gap", "option")).alias("option"))


def text_evidence(facts: DataFrame, citations: DataFrame, recall: Column, case: str = "case_id", least: float = 0.65) -> DataFrame:
    """Per case the share of facts whose best citation reaches the least recall."""
    best = facts.join(citations, case, "left").groupBy(case, "fact_id").agg(F.coalesce(F.max(recall), F.lit(0.0)).alias("recall"))
    return best.groupBy(case).agg(F.count("*").alias("facts"), F.round(F.avg((F.col("recall") >= least).cast("double")), 6).alias("covered"))


def set_recall(df: DataFrame, expected: str, got: str) -> DataFrame:
    """Share of expected members that were returned, any hit, and best expected rank."""
    both = F.array_intersect(expected, got)
    return df.withColumn("recall", F.when(F.size(expected) > 0, F.round(F.size(both) / F.size(F.array_distinct(expected)), 6))).withColumn("any_hit", F.arrays_overlap(expected, got))


def split_holdout(cases: DataFrame, strata: list[str], total: int, share: float = 0.2, seed: str = "42", case: str = "case_id") -> DataFrame:
    """A stratified hold-out of exactly total rows, in hash order.

    Each stratum gives its share, rounded half to even, at least one; then rows are taken
    away or added in hash order until the total is met.
    """
    key = F.sha2(F.concat(F.lit(seed + ":"), F.col(case).cast("string")), 256)
    rows = cases.withColumn("_h", key)
    w = W.partitionBy(*strata)
    rows = rows.join(rows.groupBy(*strata).agg(F.count("*").alias("_n")), strata).withColumn("_r", F.row_number().over(w.orderBy("_h", case)))
    chosen = F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share))
    rows = rows.withColumn("_late", ~chosen)
    places = rows.select(case, "_late", "_h").orderBy("_late", F.when(~F.col("_late"), F.col("_h")).desc_nulls_last(), "_h", case).limit(total).select(case, F.lit(True).alias("holdout"))
    return rows.join(checked_broadcast(places), case, "left").withColumn("holdout", F.coalesce("holdout", F.lit(False))).drop("_h", "_n", "_r", "_late")


def make_ood(cases: DataFrame, every: int = 10, limit: int = 30, case: str = "case_id", text: str = "question") -> DataFrame:
    """Every tenth case as an out-of-corpus probe: its years become 2099, or a fictional name is put ahead."""
    picked = cases.filter(F.col(case) % every == 0).orderBy(case).limit(limit)
    year = F.regexp_replace(text, r"(?:19|20)\d{2}", "2099")
    probe = F.when(F.col(text).rlike(r"(?:19|20)\d{2}"), year).otherwise(F.concat(F.lit("虚构指标："), F.col(text)))
    return picked.withColumn("probe", probe)


def failure_crosstab(df: DataFrame, category: str, kind: str, kinds: list[str]) -> DataFrame:
    """Category by question type, counts."""
    return df.groupBy(category).pivot(kind, kinds).count().fillna(0)


def diff_runs(a: DataFrame, b: DataFrame, case: str = "case_id", passed: str = "passed") -> DataFrame:
    """Every case of two runs: regressed, regained, kept, missing_left or missing_right."""
    one, two = a.select(case, F.col(passed).alias("_a")), b.select(case, F.col(passed).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right")
        .when(F.col("_a") & ~F.col("_b"), "regressed").when(~F.col("_a") & F.col("_b"), "regained").otherwise("kept")
    )
    return one.join(two, case, "full_outer").select(case, change.alias("change"))


def run_delta(changes: DataFrame, a: DataFrame, b: DataFrame, passed: str = "passed") -> DataFrame:
    """How many cases changed which way, and the pass rates of both runs and their difference."""
    side = lambda df, n: df.select(F.lit(n).alias("_s"), F.col(passed).alias("_p"), F.lit(None).cast("string").alias("_c"))
    rows = side(a, 0).unionByName(side(b, 1)).unionByName(changes.select(F.lit(2).alias("_s"), F.lit(None).cast("boolean").alias("_p"), F.col("change").alias("_c")))
    rate = lambda n: F.round(F.avg(F.when(F.col("_s") == n, F.col("_p").cast("double"))), 6)
    out = rows.agg(rate(0).alias("rate_left"), rate(1).alias("rate_right"), *[F.count_if(F.col("_c") == k).alias(k) for k in ("regressed", "regained", "kept", "missing_left", "missing_right")])
    return out.withColumn("delta", F.round(F.col("rate_right") - F.col("rate_left"), 6))


def compare_runs(a: DataFrame, b: DataFrame, fields: list[str], case: str = "case_id", ms: str | None = None) -> DataFrame:
    """Per field how many cases differ (nulls equal), of how many both runs have, with the cases each lacks and both mean times."""
    time = lambda side: F.col(ms).cast("double").alias(f"_{side}_ms") if ms else F.lit(None).cast("double").alias(f"_{side}_ms")
    one, two = (df.select(case, F.lit(True).alias(f"_{s}"), time(s), *[F.col(f).alias(f"_{s}_{f}") for f in fields]) for df, s in ((a, "a"), (b, "b")))
    both = one.join(two, case, "full_outer").withColumn("_both", F.col("_a").isNotNull() & F.col("_b").isNotNull())
    counts = both.agg(
        F.count_if("_both").alias("cases"), F.count_if(F.col("_a").isNull()).alias("missing_left"), F.count_if(F.col("_b").isNull()).alias("missing_right"),
        F.round(F.avg("_a_ms"), 6).alias("mean_ms_left"), F.round(F.avg("_b_ms"), 6).alias("mean_ms_right"),
        *[F.count_if(F.col("_both") & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}"))).alias(f) for f in fields],
    )
    return counts.unpivot(["cases", "missing_left", "missing_right", "mean_ms_left", "mean_ms_right"], fields, "field", "differing")
