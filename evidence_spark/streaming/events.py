"""Operational events: aggregation, archives, timings and spans; batch jobs and streaming twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from ..operators.joins import checked_broadcast

KEYS = ["event_key", "target_type", "target_id", "severity"]
#: Fixed value: local dates are those of this zone.
ZONE = "Asia/Shanghai"


def severity(action: Column) -> Column:
    """Failed is an error, source_missing a warning, anything else info."""
    return F.when(action == "failed", "error").when(action == "source_missing", "warning").otherwise("info")


def aggregate_events(events: DataFrame, gap: str = "10 minutes", watermark: str | None = None) -> DataFrame:
    """Rows of equal keys (nulls equal) whose gaps are at most `gap` become one row.

    Works on a batch and, with a watermark, on a stream. Times of first and last event,
    how many, and the latest non-empty detail.
    """
    src = events.withWatermark("ts", watermark) if watermark else events
    detail = F.when(F.trim(F.coalesce("detail", F.lit(""))) != "", F.col("detail"))
    out = src.groupBy(F.session_window("ts", gap).alias("w"), *KEYS).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"), F.max_by(detail, F.when(detail.isNotNull(), F.struct("ts", "event_id"))).alias("detail")
    )
    return out.drop("w")


def aggregate_events_windowed(events: DataFrame, gap_seconds: int = 600) -> DataFrame:
    """J1 with resolved rows: a resolved event closes its session, the next one opens another."""
    w = W.partitionBy(*KEYS).orderBy("ts", "event_id")
    before, resolved = F.lag("ts").over(w), F.coalesce(F.lag("resolved").over(w), F.lit(False))
    apart = before.isNull() | resolved | (F.col("ts").cast("timestamp").cast("double") - before.cast("timestamp").cast("double") > gap_seconds)
    marked = events.withColumn("_s", apart.cast("int")).withColumn("_s", F.sum("_s").over(w))
    detail = F.when(F.trim(F.coalesce("detail", F.lit(""))) != "", F.col("detail"))
    return marked.groupBy(*KEYS, "_s").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"), F.max_by(detail, F.when(detail.isNotNull(), F.struct("ts", "event_id"))).alias("detail")).drop("_s")


def local_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def events_on(events: DataFrame, day: Column, offset: int = 0, limit: int = 50) -> DataFrame:
    """A local day's events, newest first, one page."""
    return events.filter(local_date(F.col("ts")) == day).orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit)


def archive_daily(events: DataFrame, archived: DataFrame, deleted: DataFrame, today: Column) -> DataFrame:
    """Events of days before today that are not archived, without days marked deleted; with archive_date."""
    old = events.withColumn("archive_date", local_date(F.col("ts"))).filter(F.col("archive_date") < today)
    return old.join(archived.select("event_id"), "event_id", "left_anti").join(checked_broadcast(deleted.select("archive_date")), "archive_date", "left_anti")


def list_archives(archive: DataFrame, deleted: DataFrame) -> DataFrame:
    """Events per archived day that is not marked deleted, by severity."""
    kept = archive.join(checked_broadcast(deleted.select("archive_date")), "archive_date", "left_anti")
    return kept.groupBy("archive_date").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def timing_stats(timings: DataFrame, stage: str, ms: str, ts: str, tie: str) -> DataFrame:
    """Per stage count, last, average and largest time; on a stream in update mode."""
    return timings.groupBy(stage).agg(F.count("*").alias("n"), F.max_by(ms, F.struct(ts, tie)).alias("last"), F.round(F.avg(ms), 6).alias("average"), F.max(ms).alias("max"))


def stage_spans(events: DataFrame, key: str, ts: str, tie: str, starts: Column, ends: Column) -> DataFrame:
    """The first start after the last end pairs with the next end; later starts before it do not count."""
    w = W.partitionBy(key).orderBy(ts, tie)
    marked = events.filter(starts | ends).withColumn("_end", ends.cast("int"))
    marked = marked.withColumn("_span", F.coalesce(F.sum("_end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    spans = marked.groupBy(key, "_span").agg(F.min(F.when(F.col("_end") == 0, F.col(ts))).alias("started"), F.max(F.when(F.col("_end") == 1, F.col(ts))).alias("ended"))
    done = spans.filter("started is not null and ended is not null")
    return done.select(key, "started", "ended", F.round(F.col("ended").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double"), 6).alias("seconds"))


def stage_spans_stream(events: DataFrame, key: str, key_type: str, ts: str, kind: str, start: str, end: str, delay: str | None = None, keep: int = 86_400) -> DataFrame:
    """J7 on a stream: the open start is the key's state; a row leaves with each end.

    With a delay, rows wait in the state until the watermark passes them and are taken in the
    order of their times, so a late start that the watermark admits changes its span as in
    the batch job; an open start leaves the state `keep` seconds after its time. Without one
    rows are taken batch by batch, in order within each, and nothing expires.
    """
    rows = events.withWatermark(ts, delay) if delay else events
    rows = rows.select(key, ts, F.col(kind).alias("_kind"), F.unix_micros(ts).alias("_at")).filter(F.col("_kind").isin(start, end))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, times, kinds = state.get if state.exists else (None, [], [])
        waiting = list(zip(times, kinds, strict=True))
        if not state.hasTimedOut:
            new = pd.concat(list(batches)).sort_values("_at", kind="stable")
            waiting += zip(new["_at"].tolist(), new["_kind"].tolist(), strict=True)
        reached = state.getCurrentWatermarkMs() * 1000 if delay else None
        out, later = [], []
        for at, what in sorted(waiting, key=lambda x: x[0]):
            if reached is not None and at >= reached:
                later.append((at, what))
            elif what == start and opened is None:
                opened = at
            elif what == end and opened is not None:
                out.append((k[0], opened, at))
                opened = None
        if delay and opened is not None and opened + keep * 1_000_000 < reached:
            opened = None
        if opened is None and not later:
            if state.exists:
                state.remove()
        else:
            state.update((opened, [x[0] for x in later], [x[1] for x in later]))
            if delay:
                due = min(([later[0][0]] if later else []) + ([opened + keep * 1_000_000] if opened is not None else []))
                state.setTimeoutTimestamp(max(due, reached) // 1000 + 1)
        yield pd.DataFrame(out, columns=[key, "started", "ended"])

    timeout = GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    spans = rows.groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, started long, ended long", "opened long, times array<long>, kinds array<string>", "append", timeout)
    return spans.select(key, F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), ((F.col("ended") - F.col("started")) / 1e6).alias("seconds"))


def running_peaks(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The largest value so far per key."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("peak", F.max(value).over(w))


def latest_n(df: DataFrame, kind: str, order: list[Column], n: int) -> DataFrame:
    """The latest n rows of every kind."""
    return df.withColumn("recent", F.row_number().over(W.partitionBy(kind).orderBy(*order))).filter(F.col("recent") <= n)


def qa_facts(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Answers per local day: all, refused, mean confidence, mean citations."""
    return log.groupBy(local_date(F.col(ts)).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("refused")).alias("refused"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("citations"), 6).alias("citations"))
