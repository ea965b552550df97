"""Vector code compression: product codes with integer codebooks, fitted over Hilbert-sorted blocks.

Vectors are cut into equal parts; a codebook for each part position holds ENTRIES entries,
fitted by rounds of nearest-entry assignment and floored means, all in whole numbers.

The parts are sorted by position and by their place on a Hilbert curve (dealt out by
range, equal places by row, so no value gathers in one task) and cut into flat blocks of
BLOCK parts. A block stores the least and greatest component of each dimension (its box)
and the components' sums. In a round the box alone gives each entry's least and greatest
distance; an entry whose least distance is above another's greatest can be nearest to no
part in the block. What is left is the block's shortlist. With one entry the block's sums
are added unread; else a small integer kernel decides for each part. A shortlisted tie is
never dropped, so codes equal those of a search through all entries. Only a codebook's
sums and counts (parts x entries rows) reach the driver in a round; blocks stay in a
written table, so a lost executor repeats its own tasks.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part, nor do those of another length than most (of equally frequent lengths the smallest
counts) and, if that length can't be cut evenly, an error is raised; the first codebooks
come from the rows of smallest id (equal ids: by vector; rows without id last), fewer rows
give fewer entries; ties go to the lower entry; repeated rows are coded each on its own;
null labels count as one label; components so great that squared distances don't fit a
long raise an error; an empty table gives no rows; other columns, whatever
they are called, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup_join, partitions, stored, text_key
from .topk import vectors_of

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts in a block.
BLOCK = 512
#: Squared distances must stay below this to be exact in a long.
LIMIT = 2**62


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) per component; null where a component is null or not finite, or there is none."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(whole, F.lit(False)) & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def hilbert(points: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places of integer points on the Hilbert curve through a cube from low to high, as longs."""
    n, dims = points.shape
    bits = max(1, min(8, 62 // max(dims, 1)))
    shift = max(0, int(high - low).bit_length() - bits)
    x = ((points - low) >> shift).astype(np.int64)[:, : 62 // bits].T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each level
        for i in range(len(x)):
            on = (x[i] & q) != 0
            flip = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(on, q - 1, flip)
            x[i] ^= np.where(on, 0, flip)
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.int64)
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | (axis >> b & 1)
    return place


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entries that may be nearest to a point of the box."""
    near = np.maximum(np.maximum(low - entries, entries - high), 0)
    far = np.maximum(np.abs(entries - low), np.abs(high - entries))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry, ties to the lower, and its squared distance."""
    apart = points[:, None, :] - entries[None, :, :]
    squares = np.einsum("nkd,nkd->nk", apart, apart)
    best = squares.argmin(1)
    return best, squares[np.arange(len(points)), best]


def block_rows(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """The written blocks of rows (_row, _v): part, low, high, total (arrays), rows and points (bytes of longs)."""
    span = rows.agg(F.min(F.array_min("_v")).alias("low"), F.max(F.array_max("_v")).alias("high")).first()
    low, high = span["low"], span["high"]
    width = size // parts
    names = ["part", "place", "_row", "point"]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = vectors_of(pa.Table.from_batches([batch]), "_v")
            for p in range(parts):
                points = np.ascontiguousarray(v[:, p * width : (p + 1) * width])
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), len(v), [None, pa.py_buffer(points)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), pa.array(hilbert(points, low, high)), batch.column(0), raw], names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            row = batch.column(2).to_numpy()
            points = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(-1, width)
            edges = np.unique([*np.flatnonzero(np.diff(part, prepend=-1)), *range(0, len(part), BLOCK), len(part)])
            out: list[list] = [[] for _ in range(6)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x = points[a:b]
                for col, value in zip(out, (int(part[a]), x.min(0), x.max(0), x.sum(0), row[a:b].tobytes(), x.tobytes()), strict=True):
                    col.append(value)
            kinds = [pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["part", "low", "high", "total", "rows", "points"])

    placed = rows.select("_row", "_v").mapInArrow(places, "part int, place long, _row long, point binary")
    spread = placed.repartitionByRange(partitions(rows.sparkSession), "part", "place", "_row").sortWithinPartitions("part", "place", "_row")
    return stored(spread.mapInArrow(blocks, "part int, low array<long>, high array<long>, total array<long>, rows binary, points binary"))


def box(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(batch.column(c)[at].values, np.int64) for c in (1, 2))


def points_of(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    return np.frombuffer(batch.column(5)[at].as_buffer(), np.int64).reshape(-1, width)


def refit(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: the codebooks with each entry replaced by the floored mean of its parts."""
    width = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), len(books[0]), width), np.int64)
        count = np.zeros(total.shape[:2], np.int64)
        for batch in batches:
            for at, p in enumerate(batch.column(0).to_pylist()):
                short = shortlist(*box(batch, at), books[p])
                if len(short) == 1:
                    total[p, short[0]] += np.array(batch.column(3)[at].values, np.int64)
                    count[p, short[0]] += len(batch.column(4)[at].as_buffer()) // 8
                else:
                    x = points_of(batch, at, width)
                    best = short[nearest(x, books[p][short])[0]]
                    np.add.at(total[p], best, x)
                    count[p] += np.bincount(best, minlength=len(count[p]))
        p, k = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(count[p, k]), pa.array(list(total[p, k]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    found = blocks.mapInArrow(sums, "part int, entry int, n long, total array<long>")
    summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"d{d}") for d in range(width)])
    new = [b.copy() for b in books]
    for r in summed.collect():  # parts x entries rows at the most
        new[r["part"]][r["entry"]] = [r[f"d{d}"] // r["n"] for d in range(width)]
    return new


def assigned(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """_row, part, entry and distance of every part."""
    width = books[0].shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, p in enumerate(batch.column(0).to_pylist()):
                short = shortlist(*box(batch, at), books[p])
                best, apart = nearest(points_of(batch, at, width), books[p][short])
                row = np.frombuffer(batch.column(4)[at].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), p, np.int32)), pa.array(short[best].astype(np.int32)), pa.array(apart)], ["_row", "part", "entry", "distance"])

    return blocks.mapInArrow(assign, "_row long, part int, entry int, distance long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place within the part."""
    return hashlib.sha256(",".join(str(c) for book in books for entry in book.tolist() for c in entry).encode()).hexdigest()


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): _id, label, codes (one entry number for each part) and error of every row kept."""
    spark = df.sparkSession
    kept = df.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), scaled(F.col(vector_col), scale).alias("_v")).filter("_v is not null")
    shape = f"_id {dict(kept.dtypes)['_id']}, label {dict(kept.dtypes)['label']}, codes array<int>, error long"
    common = kept.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], shape), []
    size = common["d"]
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    rows = stored(kept.filter(F.size("_v") == size).withColumn("_row", F.monotonically_increasing_id()))
    most = rows.agg(F.max(F.greatest(F.abs(F.array_min("_v")), F.abs(F.array_max("_v"))))).first()[0]
    if size * (2 * most) ** 2 >= LIMIT:
        raise ValueError("distances don't fit a long")
    start = np.array([r["_v"] for r in rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()], np.int64)
    width = size // parts
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    blocks = block_rows(rows, parts, size)
    for _ in range(rounds):
        books = refit(blocks, books)
    codes = assigned(blocks, books).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("part", "entry"))).alias("c"), F.sum("distance").alias("error"))
    out = rows.select("_row", "_id", "label").join(codes, "_row")
    return out.select("_id", "label", F.col("c.entry").alias("codes"), "error"), books


def code_text(codes: Column) -> Column:
    """Entry numbers as two hex digits each, in lower case."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows of a row's label, summed; one label may hold most rows."""
    rows = cut(rows.withColumn("_label", text_key(F.col("label"))))
    sums = rows.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return lookup_join(rows, sums, "_label").drop("_label")
