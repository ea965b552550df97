"""Bottom-k sketches of shingle hashes, in DataFrame operations only.

A text's words are its runs of anything but ASCII white space; every five neighbouring
words are hashed together (a shorter text is one shingle, a text without words has
none). The sketch is the k smallest distinct hashes in ascending order, so sketches of
parts merge into the sketch of the whole, and a sketch of fewer than k hashes is the
whole set and its estimates are exact.

Defined cases: null and empty texts have the empty sketch (the empty string as text);
two empty sketches resemble each other fully, an empty and a filled one not at all;
equal texts have equal sketches, repeated rows one each; texts of any length are read
whole; an empty table gives no rows; no column but the ones named is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, WORD, cut, next_in_order

K = 128
WIDTH = 5
#: Documents of neighbouring ids are brought together in blocks of so many ids (a power of
#: two), those without id in 2^ANON_BITS blocks.
BLOCK, ANON_BITS = 256, 12


def let(col: Column, f: Callable[[Column], Column]) -> Column:
    """f(col), with col computed once."""
    return F.element_at(F.transform(F.array(col), f), 1)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        wide = F.transform(at, lambda i: F.xxhash64(*[h[i + j] for j in range(width)]))
        short = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) >= width, wide).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, shingles)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|."""

    def of(u: Column) -> Column:
        both = F.array_intersect(F.array_intersect(u, a), b)
        return F.when(F.size(u) == 0, 1.0).otherwise(F.size(both) / F.size(u))

    return let(merge(a, b, k), of)


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of A's shingles that B has too."""
    j = resemblance(a, b, k)
    union = distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * union / distinct(a, k)))


def to_text(a: Column) -> Column:
    """The hashes as 16 hex digits each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def from_text(s: Column) -> Column:
    halves = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("long")
    parts = F.regexp_extract_all(s, F.lit("[0-9A-F]{16}"), F.lit(0))
    return F.transform(parts, lambda x: F.shiftleft(halves(x, 1), 32).bitwiseOR(halves(x, 9)))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text and _next_text, the text of the next document by ascending id, after the last the first.

    Null texts count as empty. Rows that share an id follow each other by a hash of the
    text, then by text; rows without id come after all others, in the same order. They are
    brought together in blocks of BLOCK neighbouring ids, those without id in blocks of
    neighbouring hashes; each block also gets the first row of the block after it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.col(id_col).cast("long")
    rows = docs.select(ident.isNull().alias("_anon"), F.coalesce(ident, F.lit(0)).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    rows = rows.withColumn("_block", F.when(F.col("_anon"), F.shiftright("_hash", 64 - ANON_BITS)).otherwise(F.shiftright("_id", BLOCK.bit_length() - 1)))
    heads = rows.groupBy("_anon", "_block").agg(F.min(F.struct("_anon", "_id", "_hash")).alias("_head"))
    heads = next_in_order(heads, ["_anon", "_block"], "_head", "_key").select(F.col("_anon").alias("_to_anon"), F.col("_block").alias("_to_block"), "_key")
    heads = cut(heads)
    if heads.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    extra = rows.withColumn("_key", F.struct("_anon", "_id", "_hash")).join(heads, "_key")
    extra = extra.select(F.col("_to_anon").alias("_anon"), "_id", "_hash", "_text", F.col("_to_block").alias("_block"), F.lit(True).alias("_extra"))
    w = W.partitionBy("_anon", "_block").orderBy("_extra", "_id", "_hash", "_text")
    led = rows.withColumn("_extra", F.lit(False)).unionByName(extra).withColumn("_next_text", F.lead("_text").over(w)).filter(~F.col("_extra"))
    return led.select(F.when(~F.col("_anon"), F.col("_id")).alias("_id"), "_text", "_next_text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of every text, of its edited text (second half replaced by the next text's start) and of the next text."""
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("_text", F.lit(1), (n - half).cast("int")), F.substr("_next_text", F.lit(1), half))
    out = with_next_text(docs, id_col, text_col).select("_id", n.cast("long").alias("n_chars"), "_text", "_next_text", edited.alias("_edited"))
    return out.select(
        "_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        sketch(F.col("_text"), k, width).alias("_sketch"),
        sketch(F.col("_edited"), k, width).alias("_edited_sketch"),
        sketch(F.col("_next_text"), k, width).alias("_next_sketch"),
    )
