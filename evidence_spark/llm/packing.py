"""Packing token pieces into sequences by cutting-stock column generation.

A document of n tokens gives floor(n / capacity) full pieces and a rest. Rests are the
items: their lengths, rounded up to the grain, make a histogram of at most capacity /
grain classes, which is all the driver sees, whatever the data's size. A linear program
over patterns (how many of each class fill one sequence) is solved by the revised
simplex; a knapsack dynamic program over the duals prices new patterns until none
improves the bound by more than TOLERANCE. Whole parts of the solution become sequences,
what is left (fewer sequences than classes) is packed by best fit. Then documents are
ranked within their class, in buckets so that no class meets in one task, and rank and
pattern table give each piece its sequence and place; offsets are summed per sequence.

Defined cases: a null or empty text is the end id alone; equal rows are packed each on
its own; ids may be null; an empty table gives no rows; columns beyond the two named
ones are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, partitions, ranks_in_class
from .tokens import encoder

CAPACITY, GRAIN, TOLERANCE = 1024, 4, 1e-3
END = (0).to_bytes(4, "little")


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """_id, start, length, ids_crc32 and doc_tokens of every piece; with keep_ids its ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        names = ["_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for at, text in enumerate(batch.column(1)):
                raw = model.encode(text.as_py() or "") + END
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    part = raw[4 * s : 4 * (s + capacity)]
                    for col, v in zip(rows, (at, s, len(part) // 4, zlib.crc32(part), n, part), strict=False):
                        col.append(v)
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            cols = [ids, *[pa.array(c, pa.int64()) for c in rows[1:5]], *[pa.array(c, pa.binary()) for c in rows[5:]]]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(run, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def best_pattern(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value that fits: an unbounded knapsack by dynamic programming.

    values[c] is what an item of length c is worth; values[0] is 0, which also stands for
    a place left empty.
    """
    best = np.zeros(room + 1)
    backward = best[::-1]
    for u in range(1, room + 1):
        best[u] = max(best[u - 1], (backward[room + 1 - u :] + values[1 : u + 1]).max())
    pattern, u = np.zeros(room + 1), room
    while u > 0:
        if best[u] == best[u - 1]:
            u -= 1
        else:
            c = 1 + int((backward[room + 1 - u :] + values[1 : u + 1]).argmax())
            pattern[c] += 1
            u -= c
    return float(best[room]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    m = len(a)
    both = np.hstack([a, np.eye(m)])
    for i in range(m):
        j = i + int(np.abs(both[i:, i]).argmax())
        both[[i, j]] = both[[j, i]]
        both[i] /= both[i, i]
        others = both[:, i].copy()
        others[i] = 0
        both -= np.outer(others, both[i])
    return both[:, m:]


def solve(lengths: np.ndarray, demand: np.ndarray, room: int, tolerance: float = TOLERANCE, rounds: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, for fractional use; demand is covered.

    Patterns priced before are tried again before the knapsack is solved for a new one.
    """
    m = len(lengths)
    demand = demand + 1e-5 * np.random.default_rng(0).random(m)  # unequal, so that pivots don't go in circles
    columns = np.diag((room // lengths).astype(float))
    cost = np.ones(m)
    inverse = np.diag(1 / np.diag(columns))
    x = (inverse * demand).sum(1)
    pool = columns.T.copy()
    values = np.zeros(room + 1)
    last = np.inf
    for k in range(rounds):
        if k % 400 == 399:
            if (cost * x).sum() > last * (1 - tolerance / 10):
                break  # what is left to gain is below the tolerance's worth
            last = (cost * x).sum()
        if k % 200 == 199:  # against rounding errors
            inverse = inverted(columns)
            x = np.maximum((inverse * demand).sum(1), 0)
        duals = (cost[:, None] * inverse).sum(0)  # sums, not matrix products: no BLAS threads in the driver
        low = int(duals.argmin())
        price = 1.0
        if duals[low] < -1e-9:  # to serve more of this class than is asked is cheaper
            entering, price = np.zeros(m), 0.0
            entering[low] = -1
        else:
            worth = (pool * duals).sum(1)
            if worth[i := int(worth.argmax())] > 1 + tolerance:
                entering = pool[i]
            else:
                values[lengths] = np.maximum(duals, 0)
                value, pattern = best_pattern(values, room)
                if value <= 1 + tolerance:
                    break
                entering = pattern[lengths]
                pool = np.vstack([pool[-4 * m :], entering])
        step = (inverse * entering).sum(1)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        theta = ratio[out]
        x -= theta * step
        x[out] = theta
        np.maximum(x, 0, out=x)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = entering
        cost[out] = price
    return [(columns[:, i], float(x[i])) for i in range(m) if cost[i] and x[i] > 1e-9]


def best_fit(lengths: np.ndarray, counts: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns for a bounded rest: longest first, each to the fullest sequence that still has room."""
    done: list[np.ndarray] = []
    open_by_room: dict[int, list[np.ndarray]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        size = int(lengths[i])
        for _ in range(int(counts[i])):
            left = min((r for r, p in open_by_room.items() if r >= size and p), default=None)
            if left is None:
                pattern, left = np.zeros(len(lengths)), room
                done.append(pattern)
            else:
                pattern = open_by_room[left].pop()
            pattern[i] += 1
            open_by_room.setdefault(left - size, []).append(pattern)
    return done


def plan_patterns(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(class -> how many in a sequence, number of sequences), covering the histogram."""
    lengths = np.array(sorted(c for c in histogram if c < room), int)
    plan = [({room: 1}, histogram[room])] if histogram.get(room) else []
    if not len(lengths):
        return plan
    demand = np.array([histogram[c] for c in lengths], float)
    left = demand.copy()
    for pattern, uses in solve(lengths, demand, room):
        n, pattern = int(uses + 1e-6), pattern.copy()
        while n and pattern.any():  # where a class runs out, the rest of its pattern goes on without it
            has = pattern > 0
            k = int(min(n, (left[has] // pattern[has]).min()))
            if k:
                plan.append(({int(lengths[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, k))
                left -= pattern * k
                n -= k
            pattern = np.minimum(pattern, left)
    grouped: dict[tuple, int] = {}
    for p in best_fit(lengths, left, room):
        key = tuple((int(lengths[i]), int(p[i])) for i in np.flatnonzero(p))
        grouped[key] = grouped.get(key, 0) + 1
    return plan + [(dict(k), n) for k, n in grouped.items()]


def pattern_slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, per sequence, first sequence, first place) for every class of every pattern."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for pattern, n in plan:
        place = 0
        for c in sorted(pattern, reverse=True):
            k, lo = pattern[c], rank.get(c, 0)
            rows.append((c, lo, lo + k * n, k, first, place))
            rank[c] = lo + k * n
            place += k
        first += n
    return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grain: int = GRAIN, keep_ids: bool = False) -> DataFrame:
    """Every piece with sequence_id, offset and padded (its sequence's stored length).

    A sequence is stored at capacity, or as it is where its length is a power of two.
    """
    spark = docs.sparkSession
    room, buckets = capacity // grain, max(16, partitions(spark))
    cls = F.ceil(F.col("length") / grain).cast("int")
    bucket = F.pmod(F.xxhash64("_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    parts = cut(pieces(docs, path, id_col, text_col, capacity, keep_ids)).withColumns({"_class": cls, "_bucket": bucket})
    histogram = {r["_class"]: r["count"] for r in parts.groupBy("_class").count().collect()}  # at most room rows
    slots = spark.createDataFrame(pattern_slots(plan_patterns(histogram, room)), "_class int, _lo long, _hi long, _per long, _first long, _place long")
    ranked = ranks_in_class(parts, "_class", [F.col("_id"), F.col("start"), F.col("ids_crc32")], "_rank", buckets)
    at = F.col("_rank") - F.col("_lo")
    placed = ranked.join(F.broadcast(slots.hint("broadcast")), (ranked["_class"] == slots["_class"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(slots["_class"])
    placed = placed.withColumn("sequence_id", F.col("_first") + F.floor(at / F.col("_per"))).withColumn("_slot", F.col("_place") + F.pmod(at, F.col("_per")))
    sequence = W.partitionBy("sequence_id")
    before = sequence.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("length").over(sequence)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("_total", total)
    power = F.col("_total").bitwiseAND(F.col("_total") - 1) == 0
    placed = placed.withColumn("padded", F.when(power, F.col("_total")).otherwise(F.lit(capacity)).cast("long"))
    return placed.select("_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded", *["ids"] * keep_ids)
