"""Places inside documents and grids: locators, titles, scopes, fills and cell indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import NUMERAL, numeral
from .joins import contained

#: Levels of a locator from coarse to fine, with what marks them.
LEVELS = {"part": "编", "chapter": "章", "section": "节", "article": "条", "paragraph": "款", "item": "项"}


def locate(chunks: DataFrame, path: str = "section_path", title: str = "section_title", text: str = "text") -> DataFrame:
    """The latest number of each level from path, title, then the text's start; key and status.

    A level is 第N编, 章, 节, 条 (also 条之N, kept as article_suffix) or 款, an item （N） at a
    start. resolved with an article, partial with a part, chapter or section, else unresolved.
    """
    marked = rf"第\s*{NUMERAL}\s*[编章节条款项](?:\s*之\s*{NUMERAL})?"
    item = rf"^\s*[（(]\s*({NUMERAL})\s*[）)]"
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.regexp_extract(body, rf"^\s*((?:{marked}\s*)+)", 1)
    rest = F.substr(body, F.char_length(start) + 1)
    steps = F.array_compact(F.concat(F.coalesce(F.col(path), F.array().cast("array<string>")), F.array(F.col(title), F.when(start != "", start), F.when(rest.rlike(item), F.regexp_extract(rest, item, 0)))))
    out = chunks.withColumn("_place", F.array_join(steps, " ")).withColumn("_items", F.filter(F.transform(steps, lambda s: F.regexp_extract(s, item, 1)), lambda s: s != ""))
    for level, mark in LEVELS.items():
        found = F.regexp_extract_all("_place", F.lit(rf"第\s*({NUMERAL})\s*{mark}"), F.lit(1))
        last = F.try_element_at(found, F.lit(-1))
        out = out.withColumn(level, numeral(F.coalesce(last, F.try_element_at("_items", F.lit(-1))) if level == "item" else last))
    suffix = F.try_element_at(F.regexp_extract_all("_place", F.lit(rf"第\s*{NUMERAL}\s*条((?:\s*之\s*{NUMERAL})?)"), F.lit(1)), F.lit(-1))
    out = out.withColumn("article_suffix", numeral(F.nullif(F.regexp_replace(suffix, r"[\s之]", ""), F.lit(""))))
    shown = lambda k: F.concat(F.lit(k + ":"), F.col(k).cast("string"), F.coalesce(F.concat(F.lit("-"), F.col("article_suffix").cast("string")), F.lit("")) if k == "article" else F.lit(""))
    key = F.concat_ws("|", *[F.when(F.col(k).isNotNull(), shown(k)) for k in LEVELS])
    coarse = F.coalesce("part", "chapter", "section").isNotNull()
    status = F.when(F.col("article").isNotNull(), "resolved").when(coarse, "partial").otherwise("unresolved")
    return out.drop("_place", "_items").withColumn("locator_key", key).withColumn("locator_status", status)


def match_structure(pairs: DataFrame, depth: str, mode: str = "ancestor", gold: str = "gold_", got: str = "got_") -> DataFrame:
    """The first level down to depth on which two locators differ; other documents never match.

    ancestor skips levels that only one side has; strict wants the level asked for on both.
    """
    names = list(LEVELS)[: list(LEVELS).index(depth) + 1]
    differs = lambda k: F.col(gold + k).isNotNull() & F.col(got + k).isNotNull() & (F.col(gold + k) != F.col(got + k))
    checks = [F.when(F.col(gold + "doc") != F.col(got + "doc"), "document"), *[F.when(differs(k), k) for k in names]]
    if mode == "strict":
        checks.append(F.when(F.col(gold + depth).isNull() | F.col(got + depth).isNull(), depth))
    first = F.coalesce(*checks)
    return pairs.withColumn("mismatch", first).withColumn("matched", first.isNull())


def fill_row_labels(grid: DataFrame, labels: list[str], keys: list[str], row: str = "row") -> DataFrame:
    """Blank label cells take the value above; the labels of a row joined by ` / `."""
    w = W.partitionBy(*keys).orderBy(row)
    out = grid
    for c in labels:
        out = out.withColumn(c, F.last(F.nullif(F.trim(F.col(c)), F.lit("")), ignorenulls=True).over(w))
    return out.withColumn("row_label", F.concat_ws(" / ", *labels))


def fill_merged(grid: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells inside a merged rectangle (top, left, bottom, right) take its anchor's value; joined per sheet."""
    inside = (F.col("row") >= F.col("top")) & (F.col("row") <= F.col("bottom")) & (F.col("col") >= F.col("left")) & (F.col("col") <= F.col("right"))
    hit = grid.join(ranges, keys).filter(inside).select(*keys, "row", "col", "top", "left")
    anchor = grid.select(*keys, F.col("row").alias("top"), F.col("col").alias("left"), F.col("value").alias("_anchor"))
    filled = hit.join(anchor, [*keys, "top", "left"], "left").select(*keys, "row", "col", "_anchor")
    return grid.join(filled, [*keys, "row", "col"], "left").withColumn("value", F.coalesce("_anchor", "value")).drop("_anchor")


def infer_table_context(grid: DataFrame, keys: list[str], rows: int = 10) -> DataFrame:
    """Unit (单位：x) and period (year, month, quarter) from a sheet's first rows."""
    top = grid.filter(F.col("row") <= rows).withColumn("_t", F.coalesce(F.col("value"), F.lit("")))
    unit = F.nullif(F.regexp_extract("_t", r"单位\s*[:：]\s*([^\s，,；;)）]+)", 1), F.lit(""))
    year = F.nullif(F.regexp_extract("_t", r"((?:19|20)\d{2})\s*年", 1), F.lit("")).cast("int")
    month = F.nullif(F.regexp_extract("_t", r"(\d{1,2})\s*月", 1), F.lit("")).cast("int")
    quarter = F.coalesce(F.nullif(F.regexp_extract("_t", r"([1-4])\s*季度", 1), F.lit("")).cast("int"), numeral(F.nullif(F.regexp_extract("_t", r"第?([一二三四])季度", 1), F.lit(""))))
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), F.struct("row", "col")))
    return top.groupBy(*keys).agg(first(unit).alias("unit"), first(year).alias("year"), first(month).alias("month"), first(quarter).alias("quarter"))


def build_cells(chunks: DataFrame, doc: str = "doc_id", cells: str = "cells") -> DataFrame:
    """One row per cell of a chunk's JSON cell list; 第一季度 and 一季度 read 1季度; a boolean is no number."""
    kind = "array<struct<row:string,column:string,value:string,coordinate:string>>"
    rows = chunks.select(doc, F.explode(F.from_json(F.col(cells), kind)).alias("c")).select(doc, "c.*")
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), "第?一季度", "1季度"), "第?二季度", "2季度"), "第?三季度", "3季度"), "第?四季度", "4季度")
    return rows.withColumn("row_label", norm(F.col("row"))).withColumn("column_label", norm(F.col("column"))).withColumn("numeric_value", F.replace("value", F.lit(","), F.lit("")).try_cast("double")).drop("row", "column")


def embedding_text(labels: dict[str, Column], body: Column) -> Column:
    """Non-empty labels as `name：value` lines ahead of the body."""
    lines = [F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"{k}："), F.trim(v))) for k, v in labels.items()]
    return F.concat_ws("\n", *lines, body)


def resolve_titles(titles: DataFrame, docs: DataFrame, key: str = "title_id") -> DataFrame:
    """A wanted title to one document: equal file name, equal title, else containment with the shortest file name."""
    wanted = titles.select(key, F.lower(F.trim("wanted")).alias("_w"))
    d = docs.select("doc_id", F.lower("filename").alias("_f"), F.lower("title").alias("_t"))
    exact = wanted.join(d, F.col("_w") == F.col("_f")).select(key, "doc_id", F.lit(0).alias("_l"), F.lit(0).alias("_n"))
    equal = wanted.join(d, F.col("_w") == F.col("_t")).select(key, "doc_id", F.lit(1).alias("_l"), F.lit(0).alias("_n"))
    names = d.select("doc_id", F.char_length("_f").alias("_n"), F.explode(F.array("_f", "_t")).alias("_name"))
    held = contained(wanted, "_w", names, "_name").select(key, "doc_id", F.lit(2).alias("_l"), "_n")
    return exact.unionByName(equal).unionByName(held).groupBy(key).agg(F.min_by("doc_id", F.struct("_l", "_n", "doc_id")).alias("doc_id"))


def resolve_scope(filters: DataFrame, docs: DataFrame, q: str = "query_id") -> DataFrame:
    """Per query whether it names documents, and which; named but not found is an empty list, not everything."""
    asked = filters.filter(F.char_length(F.trim("wanted")) > 0)
    a, b = F.lower(F.trim("wanted")), F.lower(F.trim("title"))
    named, wanted = docs.select("doc_id", b.alias("_b")), asked.select(q, a.alias("_a"))
    pairs = contained(wanted, "_a", named, "_b").unionByName(contained(named.filter(F.char_length("_b") >= 4), "_b", wanted, "_a"))
    hits = pairs.groupBy(q).agg(F.array_sort(F.collect_set("doc_id")).alias("_ids"))
    scoped = asked.select(q).distinct().withColumn("scoped", F.lit(True))
    out = filters.select(q).distinct().join(scoped, q, "left").join(hits, q, "left")
    empty = F.array().cast(dict(docs.select(F.array("doc_id").alias("a")).dtypes)["a"])
    return out.select(q, F.coalesce("scoped", F.lit(False)).alias("scoped"), F.coalesce("_ids", empty).alias("doc_ids"))


def in_scope(candidates: DataFrame, scope: DataFrame, q: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Candidates inside their query's scope, before anything is ranked; an unscoped query keeps all."""
    out = candidates.join(scope, q, "left")
    return out.filter(~F.coalesce("scoped", F.lit(False)) | F.array_contains("doc_ids", F.col(doc))).drop("scoped", "doc_ids")


def validate_cells(expected: DataFrame, cells: DataFrame) -> DataFrame:
    """Per expected cell located or not, and whether values agree within half a unit of the last shown digit."""
    have = cells.groupBy("doc_id", "sheet", "coordinate").agg(F.first("value").alias("_v"))
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(38,10)")
    places = F.char_length(F.regexp_extract("expected", r"\.(\d+)$", 1))
    near = F.abs(number(F.col("expected")) - number(F.col("_v"))).cast("double") <= 0.5 * F.pow(F.lit(10.0), -places) + 1e-12
    out = expected.join(have, ["doc_id", "sheet", "coordinate"], "left")
    return out.withColumn("located", F.col("_v").isNotNull()).withColumn("equal", F.coalesce(near, F.col("expected") == F.col("_v"), F.lit(False))).drop("_v")
