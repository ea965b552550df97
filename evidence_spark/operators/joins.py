"""Joins that Spark has no operator for, as equi-joins on keys made from the rows, verified after."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .lineage import kept

#: A needle is indexed by the longest run it has of these characters; a shorter one, by all of it.
GRAMS = (4, 8, 16, 32)
#: So many different needles are looked for in each text directly.
FEW = 256
#: So many runs of needles are sent to every task; hashes that a task holds before it hands them on; letters hashed at a time; what hashes of runs grow by.
MOST_WANTED, MOST_HELD, LOT, MULTIPLIER = 100_000, 1 << 20, 1 << 16, np.uint64(0x9E3779B97F4A7C15)


def checked_broadcast(df: DataFrame, rows: int = 100_000, merge: bool = False) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else Spark chooses, or sorts both sides, which costs the driver nothing."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df.hint("merge") if merge else df


#: Rows that a task holds of what is dealt by number.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys, about so many rows to a task: tasks made by size grow with the rows up to that size, these are only more."""
    return df.repartition(max(1, -(-df.count() // (rows or TASK_ROWS))), *keys)


#: Rows of one key that stand in one list, on either side of paired; rows grouped before they are cut into such lists; lists that are sent
#: to every task; copies of a list where they are not sent; pairs that a task makes, if there are lists enough.
LISTED, INNER, GROUPED, MOST_LISTS, DEALS, TASK_PAIRS = 128, 256, 4096, 4096, 32, 4_000_000


def paired(some: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Every pair of rows of equal key, where few keys may have most rows of both sides; rows of a side differ and no key is null.

    The result is as large as it has to be, the work before it is not: rows stand in lists,
    lists of one side are dealt so many to a task and meet those of the other, and only what a
    task hands on is single pairs. They come list by list, so that a file repeats a short run
    of others for each of its rows and a few bits hold a pair.
    """
    sizes = kept(some.groupBy(key).agg(F.count("*").alias("_some")).join(others.groupBy(key).agg(F.count("*").alias("_others")).hint("merge"), key))
    lists = lambda n, size: F.coalesce(F.sum(F.ceil(F.col(n) / size)), F.lit(0))
    keys, pairs, of_some, of_others = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("_some") * F.col("_others")), F.lit(0)), lists("_some", LISTED), lists("_others", INNER)).first()
    tasks = max(1, min(of_some, -(-pairs // TASK_PAIRS)))

    def listed(df: DataFrame, count: str, size: int, name: str) -> DataFrame:
        rows = [c for c in df.columns if c != key]
        near = sizes.select(key, F.ceil(F.col(count) / GROUPED).alias("_groups"))
        grouped = df.join(F.broadcast(near) if keys <= MOST_LISTS else near.hint("merge"), key).withColumn("_group", F.pmod(F.xxhash64(*rows), "_groups"))
        grouped = grouped.groupBy(key, "_group").agg(F.array_sort(F.collect_list(F.struct(*rows))).alias("_rows"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / size).cast("int")), lambda i: F.slice("_rows", i * size + 1, size))
        return grouped.select(key, F.explode(cut).alias(name))

    one, two = listed(some, "_some", LISTED, "_ones"), listed(others, "_others", INNER, "_twos")
    if of_others <= MOST_LISTS:
        met = one.repartition(tasks).join(F.broadcast(two), key)
    else:
        one = one.withColumn("_deal", F.pmod(F.xxhash64("_ones"), F.lit(DEALS)).cast("int")).repartition(tasks, key, "_deal")
        two = two.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))).repartition(tasks, key, "_deal")
        met = one.join(two.hint("merge"), [key, "_deal"])
    # coalesce, which leaves the tasks as they are, ends a step: else a task holds all that a list expands to before it hands on the first pair.
    met = met.select(key, "_ones", "_twos").coalesce(tasks)
    return met.select(key, F.inline("_ones"), "_twos").select(key, *[c for c in some.columns if c != key], F.inline("_twos"))


def run_hashes(df: DataFrame, ident: str, text: str, sizes: list[int], size: str | None = None, only: list[int] | None = None) -> DataFrame:
    """(ident, _g): a hash for every different run of each of the sizes in a row's text, or of the row's own size; with only, of those hashes."""
    wanted = None if only is None else np.array(only, np.int64).view(np.uint64)
    rows = df.select(ident, text, *([size] if size else []))

    def hashes(letters: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of n letters; a longer one is put together from two of half its size."""
        power = lambda k: np.uint64(pow(int(MULTIPLIER), k, 1 << 64))
        out, have = letters, 1
        while have * 2 <= n:
            out, have = out[: max(0, len(out) - have)] * power(have) + out[have:], have * 2
        for i in range(have, n):
            out = out[: max(0, len(letters) - i)] * MULTIPLIER + letters[i:]
        out = out + np.uint64(n * int(power(n)) % (1 << 64))
        return out ^ (out >> np.uint64(29))

    def lots(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes], int | None]]:
        """Texts of a batch with their rows: about LOT letters at a time, or those with a size of their own one by one."""
        at, texts, held = [], [], 0
        for i, t in enumerate(batch.column(1)):
            at.append(i)
            texts.append(t.as_py().encode("utf-32-le"))
            held += len(texts[-1]) // 4
            if held >= LOT or size is not None:
                yield at, texts, None if size is None else batch.column(2)[i].as_py()
                at, texts, held = [], [], 0
        if at:
            yield at, texts, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:  # the first bits of what is wanted turn most runs away
            hint = np.zeros(1 << 20, bool)
            hint[wanted >> np.uint64(44)] = True
        for batch in batches:
            ids, found, held = [], [], 0
            for at, texts, own in lots(batch):
                ends = np.cumsum([len(t) // 4 for t in texts])
                letters = np.frombuffer(b"".join(texts), np.uint32).astype(np.uint64)
                for n in sizes if own is None else [own]:
                    h = hashes(letters, n)
                    place = np.arange(len(h)) if wanted is None else np.flatnonzero(hint[h >> np.uint64(44)])
                    h = h[place]
                    if wanted is not None:
                        some = np.isin(h, wanted)
                        place, h = place[some], h[some]
                    of = np.searchsorted(ends, place, "right")
                    inside = place + n <= ends[of]  # no run goes on into the next text
                    h, of = h[inside], of[inside]
                    order = np.lexsort((h, of))
                    h, of = h[order], of[order]
                    first = np.ones(len(h), bool)
                    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                    ids.append(np.array(at)[of[first]])
                    found.append(h[first])
                    held += len(found[-1])
                if held and (held > MOST_HELD or at[-1] == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(found).view(np.int64))], [ident, "_g"])
                    ids, found, held = [], [], 0

    return rows.mapInArrow(run, f"{ident} {dict(rows.dtypes)[ident]}, _g long")


def contained(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """Every pair of a needle and a text that holds it; needles and texts that are null or needles that are empty meet nothing.

    Up to FEW different needles are tried on each text. Of more, a needle's key is its
    rarest run over all texts, of the longest size in GRAMS that it has (all of it, if it is
    shorter); texts are keyed by their runs of the sizes that needles have. Longer runs stay
    rare as rows grow, so common ones draw few pairs, and no side is met by every row of the
    other. Up to MOST_WANTED runs are sent to the texts, so that others are never handed on.
    Only numbers travel: a hash stands for each text, needle and run; texts join the pairs in
    the end and are looked into, so equal hashes of different strings add pairs to verify,
    never results.
    """
    clash = set(needles.columns) & set(texts.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    n, t = F.col(needle), F.col(text)
    keyed, held = needles.filter(F.char_length(n) > 0), texts.filter(t.isNotNull())
    first = [r[0] for r in keyed.select(n).distinct().limit(FEW + 1).collect()]
    if 0 < len(first) <= FEW:
        met = held.withColumn("_met", F.explode(let(t, lambda whole: F.filter(F.array(*map(F.lit, first)), lambda x: F.contains(whole, x)))))
        return met.join(checked_broadcast(keyed), F.col("_met") == n).drop("_met")
    keyed, held = keyed.withColumn("_nid", F.xxhash64(n)), held.withColumn("_tid", F.xxhash64(t))
    size = F.char_length(n)
    for g in GRAMS:
        size = F.when(F.char_length(n) >= g, g).otherwise(size)
    asked = keyed.select("_nid", size.alias("_size"), n.alias("_n")).distinct()
    sizes = sorted(r["_size"] for r in asked.select("_size").distinct().collect())  # one of GRAMS or less than the first
    each = kept(run_hashes(asked, "_nid", "_n", [], "_size").distinct())
    wanted = [r["_g"] for r in each.select("_g").distinct().limit(MOST_WANTED + 1).collect()]
    if len(wanted) <= MOST_WANTED:
        runs = run_hashes(held, "_tid", text, sizes, only=wanted)
    else:
        runs = run_hashes(held, "_tid", text, sizes).join(each.select("_g").distinct().hint("merge"), "_g", "left_semi")
    runs = kept(runs.distinct())
    often = runs.groupBy("_g").agg(F.count("*").alias("_often"))
    rarest = each.join(often.hint("merge"), "_g", "left").groupBy("_nid").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("o"), F.col("_g").alias("g"))).alias("_r")).filter("_r.o > 0")
    pairs = kept(runs.join(rarest.select("_nid", F.col("_r.g").alias("_g")).hint("merge"), "_g").select("_tid", "_nid").distinct())
    near = checked_broadcast(pairs, merge=True)
    return held.join(near, "_tid").join(checked_broadcast(keyed, merge=True), "_nid").filter(F.contains(t, n)).drop("_tid", "_nid")
