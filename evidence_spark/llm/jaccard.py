"""N-gram Jaccard join by token-combination prefixes, exact, up to connected components.

A document's tokens are its distinct word shingles. Tokens stand in one global order, rare
ones first; frequent token classes are split into groups by hash. A set's prefix is read
in that order with a count of misses: how many of the tokens read a partner lacks at least
if it shares no entry with them. A rare token counts one miss and is indexed alone; n
tokens of a group whose class asks for k-token combinations count n - k + 1 and all their
k-combinations are indexed. Two sets of n and m tokens of which one misses p of the other's
n share at most n - p, so an entry found after p misses reaches partners of at most

    reach = (1 + t) / t * (n - p) - n

tokens, and the prefix ends where that falls below t * n. The first entry that two similar
sets share is the same for both, and within the reach of both. So similar sets always meet,
near copies with more edits than the similarity allows hold entries of their own edits
only, and everyday passages are indexed by combinations.

How often a token occurs is estimated over all documents by a table of counters that grows
with the input up to MOST_COUNTERS (never too low). It steers the order and the classes, so
a poor estimate costs time, not links. The number of groups follows the size of the smaller
set of a pair; a set near the bound of a size class is indexed for both classes.

Documents of equal sets form a class, and classes are joined. An entry of a rare token has
few sets, by the counters, and is brought together as it is; one of frequent tokens (hot)
is dealt out by class and counted in parts. Those that share an entry are split by bands of sizes, so that a group holds the sets of one band (or of two, each
set facing those of the other band). Then rounds: each group's pivot, the set of the most
common tokens, is verified against all that face it, links make components, and what
faces no other component (or nothing within reach) leaves the group, as does the pivot. A
large group of near copies so costs a pair per member and round. What is left after ROUNDS
is decided pair by pair: in small groups by a join, in large ones by blocks of bounded size
that meet two at a time, where only links between components come out.

Defined cases: null, empty and blank texts have no tokens and link with nothing; a text
of fewer words than a shingle is one token; texts of any length are read whole; rows without id link with nothing; rows of
equal id and text share a class; an empty table gives no rows; other columns are not
read. Tokens are held by 64-bit hashes, classes by 128 bits (a second hash stands in where
the first is shared).
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, partitions, stored

#: Token counters: as many as keep tokens per counter near 32, within these bounds.
LEAST_COUNTERS, MOST_COUNTERS, CHUNKS, CELLS = 1 << 20, 1 << 26, 16, 256
#: Below so many tokens every token is indexed alone.
SMALL = 64
ODD = np.uint64(0x9E3779B97F4A7C15)
WORDS_KEPT, CLASSES_KEPT = 100_000, 100_000
#: A side of single numbers is broadcast up to so many rows.
LONGS = 1_000_000
#: Bands of sizes between a size and the smallest that is similar to it.
BANDS = 3
#: Rounds of pivots; members of a group whose pairs are listed; sets and tokens of a block.
ROUNDS, LISTED, BLOCK, BLOCK_TOKENS = 3, 16, 512, 1 << 19
#: Parts in which the sets of an entry of frequent tokens are counted.
PARTS = 64


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def token_set(text: bytes | None, width: int, words: Words) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    parts = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        out = out * ODD + h[i : i + n]
    return np.unique(scramble(out))


def set_class(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def class_of(tokens: np.ndarray, shared: frozenset[int]) -> int:
    """The first hash, or the second where different sets share the first."""
    first, second = set_class(tokens)
    return second if first in shared else first


def cells(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall into each cell: the sum of the smaller counts bounds what two sets share."""
    return np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)


def required(n: int, percent: int) -> int:
    """How many of n tokens a similar set shares at least."""
    return -(-n * percent // 100)


def entries(tokens: np.ndarray, seen: np.ndarray, bounds: tuple[int, ...], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index entries of a set, single tokens and combinations of its prefix, their reach, and whether they are of frequent tokens.

    seen is how often each token occurs.
    """
    n = len(tokens)
    least = required(n, percent)
    reach = lambda misses: (100 + percent) * (n - misses) // percent - n
    need = n - least + 1
    first = np.lexsort((tokens, seen))[:need] if seen.max() < bounds[0] else np.lexsort((tokens, seen))
    tokens, seen = tokens[first], seen[first]
    level = np.searchsorted(bounds, seen, side="right")
    out: dict[int, int] = {}
    hot: set[int] = set()
    for size in {least.bit_length(), n.bit_length()}:
        most = (1 << size) - 1 if size < n.bit_length() else 2 * n  # for the lower size class this is the larger set
        if (1 << size) <= SMALL or not level[:need].any():
            for p, t in enumerate(tokens[:need].tolist()):
                if (r := reach(p)) < least:
                    break
                out[t] = max(out.get(t, 0), min(r, most))
                if level[p]:
                    hot.add(t)
            continue
        groups = (1 << size) // 16
        misses, held = 0, defaultdict(list)
        for t, k in zip(tokens.tolist(), level.tolist(), strict=True):
            if (r := reach(misses)) < least:
                break
            r = min(r, most)
            if k == 0:
                out[t] = max(out.get(t, 0), r)
                misses += 1
                continue
            group = held[k, t % groups]
            for rest in itertools.combinations(group, k):
                e = xxhash.xxh3_64_intdigest(np.array([size, k, *sorted((*rest, t))], np.uint64).tobytes())
                out[e] = max(out.get(e, 0), r)
                hot.add(e)
            if len(group) >= k:
                misses += 1
            group.append(t)
    return np.fromiter(out, np.uint64, len(out)), np.fromiter(out.values(), np.int64, len(out)), np.fromiter((e in hot for e in out), bool, len(out))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def in_parts(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows: what a part is turned into is held at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def read_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, np.ndarray, frozenset[int]]:
    """(_id, n, c) of every document, the counters over all of them, and the first hashes that different sets share."""

    size = (docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0) // 6  # words of some six bytes
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(0, size // 32 - 1).bit_length()))
    shift = np.uint64(65 - counters.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "n", "c", "d", "chunk", "data"]
        words, counts, lot, held = Words(), np.zeros(counters, np.uint32), [], 0

        def flush() -> None:
            at, n = np.unique(np.concatenate(lot) >> shift, return_counts=True)
            counts[at.astype(np.int64)] += n.astype(np.uint32)
            lot.clear()

        for batch in in_parts(batches):
            ns, cs = [], []
            for text in batch.column(1):
                s = token_set(text.as_py(), width, words)
                ns.append(len(s))
                cs.append(set_class(s) if len(s) else (None, None))
                lot.append(s)
                held += len(s)
                if held > 200_000:
                    flush()
                    held = 0
            k = len(ns)
            both = [pa.array([c[i] for c in cs], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *both, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if lot:
            flush()
        if counts.any():
            data = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, CHUNKS)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(CHUNKS, pa.int64())] * 4, pa.array(range(CHUNKS), pa.int32()), pa.array(data, pa.binary())], names)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(counters // CHUNKS, np.uint64)
        for d in pdf["data"]:
            total += np.frombuffer(zlib.decompress(d), np.uint32)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "data": [zlib.compress(total.tobytes(), 1)]})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    both = stored(rows.mapInArrow(run, "_id long, n long, c long, d long, chunk int, data binary"))
    shape = "chunk int, data binary"
    few = 1 + math.isqrt(partitions(docs.sparkSession))
    parts = both.filter("chunk is not null").select("chunk", "data", F.pmod(F.xxhash64("data"), F.lit(few)).alias("lot"))
    parts = parts.groupBy("chunk", "lot").applyInPandas(add, shape).groupBy("chunk").applyInPandas(add, shape)
    counts = np.zeros(counters, np.uint32)
    for r in parts.collect():  # at most MOST_COUNTERS numbers
        counts.reshape(CHUNKS, -1)[r["chunk"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint32)
    rows = both.filter("chunk is null").select("_id", "n", "c", "d")
    shared = frozenset(r["c"] for r in several(rows.filter("c is not null"), "c", "d").collect())  # by chance only: some n^2 / 2^65 of n sets
    return rows.select("_id", "n", F.when(F.col("c").isin(*shared), F.col("d")).otherwise(F.col("c")).alias("c") if shared else "c"), counts, shared


def index_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, counts: np.ndarray, shared: frozenset[int]) -> DataFrame:
    """(entry, c, n, reach, common, hot) of every class; copies that a task meets again soon are indexed once.

    common is how common a set's tokens are: the more a near copy was edited, the less.
    """
    mean = float(counts.mean())
    base = mean + 6 * mean**0.5 + 16
    bounds = (base, 16 * base)
    table = docs.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(65 - len(counts).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = Words(), set()
        for batch in in_parts(batches):
            es, cols = [], []
            for text in batch.column(0):
                s = token_set(text.as_py(), width, words)
                if not len(s) or (c := class_of(s, shared)) in done:
                    continue
                if len(done) >= CLASSES_KEPT:
                    done.clear()
                done.add(c)
                seen = table.value[(s >> shift).astype(np.int64)]
                e, reach, hot = entries(s, seen, bounds, percent)
                es.append(e)
                cols.append((np.full(len(e), c), np.full(len(e), len(s)), reach, np.full(len(e), int(1e6 * np.log2(seen + 1.0).mean())), hot))
            if es:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(es)), *[pa.array(np.concatenate(x)).cast(k) for x, k in zip(zip(*cols, strict=True), kinds, strict=True)]], ["entry", "c", "n", "reach", "common", "hot"])

    texts = docs.filter(F.col(id_col).cast("long").isNotNull()).select(F.col(text_col).cast("binary"))
    return texts.mapInArrow(run, "entry long, c long, n int, reach int, common int, hot boolean")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint where it has few rows; it is a written table."""
    return F.broadcast(df) if df.count() <= rows else df


def lots_of(df: DataFrame) -> int:
    """Partitions of some 50,000 rows for a written table of a few numbers a row."""
    return 1 + df.count() // 50_000


def several(rows: DataFrame, key: str, of: str) -> DataFrame:
    """The keys that hold more than one value."""
    return rows.groupBy(key).agg(F.min(of).alias("lo"), F.max(of).alias("hi")).filter("lo < hi").select(key)


def class_sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, shared: frozenset[int]) -> DataFrame:
    """(c, cells, tokens) of the classes in reps (c, _id), read again from their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = Words(), set()
        for batch in in_parts(batches):
            cs, sets = [], []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = token_set(text.as_py(), width, words)
                if len(s) and class_of(s, shared) == c and c not in done:  # another text may bear the same id
                    cs.append(c)
                    sets.append(s)
            if cs:
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                counts = pa.array([np.minimum(cells(s), 255).astype(np.uint8).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), counts, pa.ListArray.from_arrays(ends, _signed(np.concatenate(sets)))], ["c", "cells", "tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return texts.join(bounded(reps, LONGS), "_id").select("c", "_text").mapInArrow(run, "c long, cells binary, tokens array<long>")


def similar_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def joined(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with a column of both sides. Pairs, two numbers each, go to the sets of b
    (up to LONGS of them); what is found there then meets the few that stand as a."""
    small = pairs.count() <= LONGS
    of_b = sets.select(F.col("c").alias("b"), F.col(column).alias("of_b")).join(F.broadcast(pairs) if small else pairs, "b")
    asked = pairs.select(F.col("a").alias("c")).distinct()
    of_a = sets.select("c", column).join(F.broadcast(asked) if small else asked, "c").select(F.col("c").alias("a"), F.col(column).alias("of_a"))
    return of_b.join(of_a, "a").select("a", "b", "of_a", "of_b")


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their cell counts don't rule out; whole sets travel for these only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 10_000):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CELLS) for i in (2, 3))
            full = (x == 255).any(1) | (y == 255).any(1)
            both, n = np.minimum(x, y).sum(1, dtype=np.int64), x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(full | (both * 100 >= (n - both) * percent)))

    return joined(pairs, sets, "cells").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, lots: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    left = stored(plausible(stored(pairs.coalesce(lots)), sets, percent).coalesce(lots))
    both = joined(left, sets, "tokens").withColumn("_both", F.size(F.array_intersect("of_a", "of_b")))
    union = F.size("of_a") + F.size("of_b") - F.col("_both")
    return both.filter(F.col("_both") * 100 >= union * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(c, comp): the smallest member of every member's component.

    Every round takes the smallest label among a member and its neighbours, then the
    label of that label. Labels are two numbers each and go to the edges (up to LONGS).
    """
    edges = stored(edges.distinct())
    lots = lots_of(edges)
    both = edges.union(edges.select("b", "a")).union(edges.select("a", F.col("a").alias("b"))).union(edges.select(F.col("b").alias("a"), "b"))
    both = stored(both.distinct().coalesce(lots))
    labels = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("comp"))
    labels = stored(labels.coalesce(lots))
    while True:
        known = bounded(labels, LONGS)
        near = both.join(known.select(F.col("c").alias("b"), "comp"), "b").groupBy(F.col("a").alias("c"))
        spread = near.agg(F.min("comp").alias("near"), F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("old"))
        jump = known.select(F.col("c").alias("near"), F.col("comp").alias("further"))
        new = spread.join(jump, "near").select("c", F.least("near", "further").alias("comp"), (F.least("near", "further") != F.col("old")).alias("moved"))
        new = stored(new.coalesce(lots))
        labels = new.select("c", "comp")
        if not new.filter("moved").limit(1).count():
            return labels


def size_band(n: Column, percent: int) -> Column:
    """A number that never falls as the size n grows; BANDS of them between similar sizes."""
    if percent == 100:
        return n.cast("long")
    return F.floor(F.log(n.cast("double")) * F.lit(BANDS / -math.log(percent / 100)))


def shared_entries(index: DataFrame, percent: int) -> DataFrame:
    """The index rows whose entry several classes have, with band, any (bit set of the entry's bands), odd (of those with an odd count) and m (rows)."""
    bit = F.expr("shiftleft(1L, cast(pmod(band, 63) as int))")
    facts = {"lo": F.min("c"), "hi": F.max("c"), "m": F.count("*"), "any": F.bit_or("bit"), "odd": F.bit_xor("bit")}
    part = F.when(F.col("hot"), F.pmod("c", F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    w = W.partitionBy("entry", "part")
    rows = index.withColumn("band", size_band(F.col("n"), percent)).withColumn("bit", bit).withColumn("part", part)
    rows = stored(rows.withColumns({k: f.over(w) for k, f in facts.items()}).filter("hot or lo < hi").drop("part"))
    names = ["entry", "c", "n", "reach", "common", "band", "any", "odd", "m"]
    hot = rows.filter("hot").drop(*facts)
    whole = stored(hot.groupBy("entry").agg(*[f.alias(k) for k, f in facts.items()]).filter("lo < hi").drop("lo", "hi"))
    return rows.filter("not hot").select(*names).unionByName(hot.join(bounded(whole), "entry").select(*names)).distinct()


def grouped(index: DataFrame, percent: int) -> DataFrame:
    """(own, facing, c, n, reach, common, comp): the members of groups, each under its side and the side it faces."""
    held = shared_entries(index, percent).withColumnRenamed("band", "_b")
    least = F.ceil(F.col("n") * percent / 100)
    alone = (F.col("m") == 2) & (F.expr("shiftright(odd, cast(pmod(_b, 63) as int)) & 1") == 1)
    there = lambda o: F.getbit("any", F.pmod(o, F.lit(63)).cast("int")) == 1
    bands = F.sequence(size_band(least, percent), F.greatest(size_band(F.col("reach"), percent), size_band(least, percent)))
    held = held.withColumn("_alone", alone).withColumn("_o", F.explode(F.filter(bands, lambda o: there(o) & ((o != F.col("_b")) | ~F.col("_alone")))))
    side = lambda x: F.xxhash64("entry", F.least("_b", "_o"), F.greatest("_b", "_o"), x)
    own, facing = F.when(F.col("_b") == F.col("_o"), F.lit(0)).otherwise(F.col("_b")), F.when(F.col("_b") == F.col("_o"), F.lit(0)).otherwise(F.col("_o"))
    return held.select(side(own).alias("own"), side(facing).alias("facing"), "c", "n", "reach", "common", F.col("c").alias("comp"))


def open_members(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """The members that still face another component within reach, with the pivot p that they face and whether they are one themselves.

    At first the pivot is the side's set of the most common tokens; later it is that of a component chosen by hash.
    """
    first = F.xxhash64("comp", F.lit(turn)) if turn else F.lit(0).cast("long")
    pivot = F.min(F.struct(first.alias("o"), (-F.col("common")).alias("q"), "c", "n", "reach", "comp")).alias("p")
    sides = stored(members.groupBy("own").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("n_least"), F.max("reach").alias("r_most"), pivot))
    sides = bounded(sides)
    alive = members.join(sides.withColumnRenamed("own", "facing"), "facing")
    alive = alive.filter(((F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))) & (F.col("reach") >= F.col("n_least")) & (F.col("r_most") >= F.col("n")))
    mine = sides.select("own", F.col("p.c").alias("_mine"))
    return alive.join(mine, "own").select("own", "facing", "c", "n", "reach", "common", "comp", "p", (F.col("c") == F.col("_mine")).alias("asked"))


def within(n: Column, reach: Column, m: Column, other: Column, percent: int) -> Column:
    return (n <= other) & (m <= reach) & similar_size(n, m, percent)


def left_pairs(members: DataFrame, counts: DataFrame, percent: int, listed: int) -> DataFrame:
    """The pairs (a, b) of different components that face each other in groups of at most listed members."""
    rows = members.join(counts.filter(F.col("m") <= listed), "gid").select("own", "facing", "c", "n", "reach", "comp")
    one, two = (rows.select(*[F.col(x).alias(f"{x}{i}") for x in rows.columns]) for i in (1, 2))
    met = one.join(two, one["facing1"] == two["own2"])
    fits = within(F.col("n1"), F.col("reach1"), F.col("n2"), F.col("reach2"), percent)
    return met.filter((F.col("c1") < F.col("c2")) & (F.col("comp1") != F.col("comp2")) & fits).select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct()


def links_in_blocks(members: DataFrame, counts: DataFrame, sets: DataFrame, percent: int, listed: int, block: int) -> DataFrame:
    """Links (a, b) between components in groups of more than listed members.

    Members are dealt into blocks by hash and every two blocks of a group meet once. There
    cell counts rule pairs out, the rest is compared as whole sets, and a pair whose ends
    are connected by then is passed over, so at most as many links come out as sets went in.
    Whole sets travel only for the members of such groups (up to LONGS of them).
    """
    rows = members.join(counts.filter(F.col("m") > listed), "gid")
    asked = stored(rows.select("c").distinct())
    whole = sets.select("c", "tokens")
    if asked.count() <= LONGS:
        whole = whole.join(F.broadcast(asked), "c", "left_semi")
    size = F.greatest(F.lit(2), F.least(F.lit(block), F.floor(F.lit(BLOCK_TOKENS) / F.col("most"))))
    rows = rows.withColumn("_n", F.ceil(F.col("m") / size)).withColumn("_k", F.pmod(F.xxhash64("c"), F.col("_n")))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    rows = rows.select("gid", F.least("_k", "_o").alias("x"), F.greatest("_k", "_o").alias("y"), F.col("_k").alias("k"), "own", "facing", "c", "n", "reach", "comp")

    def compare(t: pa.Table) -> pa.Table:
        k, own, facing, c, n, reach, comp = (t[x].to_numpy() for x in ("k", "own", "facing", "c", "n", "reach", "comp"))
        values = t["tokens"].combine_chunks()
        at, flat = values.offsets.to_numpy(), values.values.to_numpy().view(np.uint64)
        tokens = [flat[at[i] : at[i + 1]] for i in range(len(c))]
        table = np.stack([cells(s) for s in tokens]).astype(np.int32)
        labels, root = np.unique(comp, return_inverse=True)
        found: list[tuple[int, int]] = []
        same = t["x"][0].as_py() == t["y"][0].as_py()
        for i in range(len(c)):
            ok = (own == facing[i]) & (root != root[i]) & (n <= reach[i]) & (reach >= n[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
            ok &= c > c[i] if same else k != k[i]
            for j in np.flatnonzero(ok):
                if root[j] == root[i] or (not same and c[j] < c[i]):
                    continue
                bound = np.minimum(table[i], table[j]).sum()
                if bound * 100 < (n[i] + n[j] - bound) * percent:
                    continue
                both = len(np.intersect1d(tokens[i], tokens[j], assume_unique=True))
                if both * 100 >= (n[i] + n[j] - both) * percent:
                    found.append((int(c[i]), int(c[j])))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.join(whole, "c").groupBy("gid", "x", "y").applyInArrow(compare, "a long, b long")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rounds: int = ROUNDS, listed: int = LISTED, block: int = BLOCK) -> DataFrame:
    """_id, n_shingles and component_id (smallest id connected by links) of every document."""
    rows, counts, shared = read_sets(docs, id_col, text_col, width)
    index = index_rows(docs, id_col, text_col, width, percent, counts, shared)
    classes = rows.filter("c is not null and _id is not null").groupBy("c").agg(F.min("_id").alias("_id"), F.count("*").alias("copies"))
    reps = stored(classes)

    members, sets, links, comp = stored(grouped(index, percent)), None, None, None
    for turn in range(rounds + 1):
        if comp is not None:
            members = members.join(bounded(comp.withColumnRenamed("comp", "_new"), LONGS), "c", "left").withColumn("comp", F.coalesce("_new", "comp")).drop("_new")
            members = stored(members.coalesce(lots))
        members = stored(open_members(members, percent, turn))
        lots = lots_of(members)
        if not members.limit(1).count():
            break
        if sets is None:
            wanted = reps.select("c", "_id").join(bounded(stored(members.select("c").distinct()), LONGS), "c")
            sets = stored(class_sets(docs, stored(wanted), id_col, text_col, width, shared))
        if turn < rounds:
            fits = within(F.col("n"), F.col("reach"), F.col("p.n"), F.col("p.reach"), percent)
            pairs = members.filter((F.col("comp") != F.col("p.comp")) & fits).select(F.col("p.c").alias("a"), F.col("c").alias("b")).distinct()
            found = verify(pairs, sets, percent, lots)
            members = members.filter(~F.col("asked")).drop("p", "asked")
        else:
            rest = stored(members.drop("p", "asked").withColumn("gid", F.least("own", "facing")).coalesce(lots))
            sizes = bounded(stored(rest.groupBy("gid").agg(F.count("*").alias("m"), F.max("n").alias("most")).coalesce(lots)))
            found = verify(left_pairs(rest, sizes, percent, listed), sets, percent, lots)
            found = found.union(links_in_blocks(rest, sizes, sets, percent, listed, block))
        found = stored(found.coalesce(lots))
        links = found if links is None else links.union(found)
        comp = components(links)
    if comp is None:
        comp = docs.sparkSession.createDataFrame([], "c long, comp long")
    firsts = comp.join(reps, "c").groupBy("comp").agg(F.min("_id").alias("component_id"))
    linked = comp.join(firsts, "comp").select("c", "component_id")
    copies = reps.filter("copies > 1").join(comp, "c", "left_anti").select("c", F.col("_id").alias("component_id"))
    known = bounded(stored(linked.union(copies)), LONGS)
    own = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return rows.join(known, "c", "left").select("_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: the one of the smallest id, of those without id only where no other has one.

    Every row has a key of its own, so rows of equal id stand or fall by their texts, and
    rows without id belong to the group of their text. Rows without words all stay.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    out = link_components(keyed, key, text_col, width, percent).select(F.col("_id").alias(key), "component_id")
    out = stored(out.join(keyed.select(key, F.struct(F.col(id_col).isNull(), id_col, key).alias("_order")), key))
    firsts = out.groupBy("component_id").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    drop = out.join(bounded(stored(firsts), LONGS), "component_id").filter(F.col(key) != F.col("_first")[key]).select(key)
    return keyed.join(bounded(stored(drop), LONGS), key, "left_anti").select(*docs.columns)
