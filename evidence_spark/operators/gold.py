"""Gold passages and cells to the chunks that hold them (G16): exactly, nearly, or by coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigram_set, let
from .joins import contained
from .lineage import kept

#: Least share of a passage's bigrams, in any document and in the named one; probes of a passage; least length of a chunk inside a passage.
ANYWHERE, NAMED, WINDOW, PROBES, INSIDE = 0.7, 0.55, 8, 4, 20
#: What passages and chunks are compared without.
SUFFIX, DROPPED = r"\.(?:pdf|docx?|xlsx?|xls|csv|txt|md)$", r"[\s·•、，,。.;；:：()（）\"'“”‘’\-_/\\]+"
#: How gold evidence names a sheet, coordinates and values.
SHEET, COORDINATE, VALUE = r"工作表：\s*([^；;]+)", r"(?<![A-Za-z])([A-Z]{1,3}\d{1,4})(?!\d)", r"(?:原始值|合计|健康险|[A-Za-z一-鿿]+)=(-?[\d,]+(?:\.\d+)?)"
RAW_VALUE, MOST_VALUES = r"原始值：(-?[\d,]+(?:\.\d+)?)", 6


def plain(text: Column) -> Column:
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), "《》", "")
    return F.regexp_replace(F.regexp_replace(out, SUFFIX, ""), DROPPED, "")


def probes(text: Column) -> Column:
    """A plain text's windows: up to four of eight characters, evenly spread from its start; a shorter text is its own."""

    def spread(t: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor((F.char_length(t) - WINDOW) / (PROBES - 1)).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.substr(t, i * step + 1, F.lit(WINDOW)))
        return F.when(F.char_length(t) > WINDOW, F.array_distinct(F.filter(cut, lambda w: F.char_length(w) >= WINDOW // 2))).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))

    return let(text, spread)


def recall(passage: Column, chunk: Column) -> Column:
    """Share of a passage's distinct bigrams that a chunk has; a passage without any gives 0."""
    return let(bigram_set(passage), lambda p: F.when(F.size(p) > 0, F.size(F.filter(p, lambda g: F.contains(chunk, g))) / F.size(p)).otherwise(0.0))


def passage_chunks(passages: DataFrame, chunks: DataFrame, key: str = "aspect_id") -> DataFrame:
    """(key, chunk_id, scope) of the chunks that may stand for each passage.

    passages: key, text, document_id (null: not known); chunks: chunk_id, document_id, text.
    Over all documents a chunk has to hold one of the passage's probes and 0.7 of its
    bigrams. Probes meet chunks by their rarest run of characters, so a common phrase draws
    no pairs of its own. Where no chunk does, the chunks of the named document count that
    hold the passage, stand in it with 20 characters or more, or have 0.55 of its bigrams.
    """
    p = passages.select(key, F.col("document_id").alias("_doc"), plain(F.col("text")).alias("_p")).filter("_p <> ''")
    c = kept(chunks.select("chunk_id", "document_id", plain(F.col("text")).alias("_c")).filter("_c <> ''"))
    asked = p.select(key, "_p", F.explode(probes(F.col("_p"))).alias("_w"))
    met = contained(asked, "_w", c.select("chunk_id", "_c"), "_c")
    anywhere = kept(met.filter(recall(F.col("_p"), F.col("_c")) >= ANYWHERE).select(key, "chunk_id", F.lit("anywhere").alias("scope")).distinct())
    left = p.filter("_doc is not null").join(anywhere.select(key).distinct(), key, "left_anti")
    own = left.join(c, F.col("_doc") == F.col("document_id"))
    held = F.contains("_c", "_p") | (F.contains("_p", "_c") & (F.char_length("_c") >= INSIDE))
    named = own.filter(held | (recall(F.col("_p"), F.col("_c")) >= NAMED)).select(key, "chunk_id", F.lit("named").alias("scope")).distinct()
    return anywhere.unionByName(named)


def cell_chunks(evidence: DataFrame, cells: DataFrame, chunks: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, aspect_id, chunk_id) for each coordinate that gold evidence names, or where it names none, each of its first six values.

    evidence: key, text, document_id; cells: document_id, sheet, coordinate, chunk_id. A
    coordinate is looked up in the named sheet, or else in any sheet of the document; a value
    in the document's chunks. An aspect without a chunk has a row with null.
    """
    text = F.coalesce("text", F.lit(""))
    e = evidence.select(
        key, "document_id", plain(F.regexp_extract(text, SHEET, 1)).alias("_sheet"), F.array_distinct(F.regexp_extract_all(text, F.lit(COORDINATE), F.lit(1))).alias("_at"),
        F.slice(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(VALUE), F.lit(1)), F.regexp_extract_all(text, F.lit(RAW_VALUE), F.lit(1)))), 1, MOST_VALUES).alias("_values"),
    ).filter("document_id is not null")
    at = e.select(key, "document_id", "_sheet", F.explode("_at").alias("_coordinate"))
    have = cells.select("document_id", plain(F.col("sheet")).alias("_in"), F.upper("coordinate").alias("_coordinate"), "chunk_id")
    hits = at.join(have, ["document_id", "_coordinate"], "left").withColumn("_same", (F.col("_sheet") == "") | F.coalesce(F.col("_in") == F.col("_sheet"), F.lit(False)))
    exact = hits.groupBy(key, "_coordinate").agg(F.max("_same").alias("_some"))
    by_place = hits.join(exact, [key, "_coordinate"]).filter("_same or not _some").select(key, F.concat(F.lit("cell:"), "_coordinate").alias("aspect_id"), "chunk_id").distinct()
    values = e.filter(F.size("_at") == 0).select(key, "document_id", F.explode("_values").alias("_v")).withColumn("_v", F.replace("_v", F.lit(","), F.lit("")))
    texts = chunks.select("document_id", "chunk_id", plain(F.col("text")).alias("_c"))
    found = values.join(texts, "document_id").filter((F.col("_v") != "") & F.contains("_c", "_v")).select(key, "_v", "chunk_id")
    by_value = values.select(key, "_v").distinct().join(found, [key, "_v"], "left").select(key, F.concat(F.lit("value:"), "_v").alias("aspect_id"), "chunk_id").distinct()
    return by_place.unionByName(by_value)
