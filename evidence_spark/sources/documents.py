"""Readers: text, HTML, CSV, JSON lines and manifests as blocks, cells and documents."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import normalize_value, numeral

MANIFEST_WRAPPERS = ("files", "documents", "records")


def to_blocks(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A1: heading, table and paragraph blocks of a Markdown or plain text, each with the heading before it.

    A line of 1 to 6 # and at most 120 characters is a heading of its own; a line with two
    or more pipe cells belongs to a table; a blank line or another kind closes a block.
    """
    lines = df.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("pos", "line"))
    t = F.trim("line")
    heading = t.rlike(r"^#{1,6}\s+\S") & (F.char_length(t) <= 120)
    table = F.size(F.filter(F.split(t, r"\|"), lambda c: F.trim(c) != "")) >= 2
    kind = F.when(t == "", "blank").when(heading, "heading").when(table & F.contains(t, F.lit("|")), "table").otherwise("paragraph")
    w = W.partitionBy(doc).orderBy("pos")
    marked = lines.withColumn("line", t).withColumn("kind", kind)
    fresh = (F.col("kind") == "heading") | (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit("")))
    marked = marked.withColumn("_b", fresh.cast("int")).withColumn("_b", F.sum("_b").over(w))
    marked = marked.withColumn("section_title", F.last(F.when(F.col("kind") == "heading", F.regexp_replace("line", r"^#+\s*", "")), ignorenulls=True).over(w))
    level = F.when(F.col("kind") == "heading", F.char_length(F.regexp_extract("line", r"^(#+)", 1)))
    marked = marked.withColumn("_level", level).filter("kind <> 'blank'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    blocks = marked.groupBy(doc, "_b", "kind", "section_title").agg(body.alias("text"), F.max("_level").alias("level"), F.min("pos").alias("_pos"))
    text_out = F.when(F.col("kind") == "heading", F.regexp_replace("text", r"^#+\s*", "")).otherwise(F.col("text"))
    return blocks.select(doc, (F.row_number().over(W.partitionBy(doc).orderBy("_pos")) - 1).alias("order_index"), F.col("kind").alias("block_type"), text_out.alias("text"), "level", "section_title")


def read_text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A1 over files, one document per file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return to_blocks(files)


class _Page(HTMLParser):
    """Blocks of one page: headings, paragraphs, list items and pipe tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.title = [], ""
        self.skip, self.tag, self.text = 0, "", []
        self.rows: list | None = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text and self.tag == "title":
            self.title = text
        elif text and self.tag in ("p", "li"):
            self.blocks.append(("paragraph", text, None))
        elif text and self.tag[:1] == "h":
            self.blocks.append(("heading", text, int(self.tag[1])))
        elif self.tag in ("td", "th") and self.rows:
            self.rows[-1].append(text)
        self.tag, self.text = "", []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("p", "li", "title", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
            self.tag = tag
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag == self.tag:
            self.flush()
        elif tag == "table" and self.rows is not None:
            self.flush()
            if any(self.rows):
                self.blocks.append(("table", "\n".join("| " + " | ".join(r) + " |" for r in self.rows if r), None))
            self.rows = None

    def handle_data(self, data):
        if not self.skip and self.tag:
            self.text.append(data)


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A2: blocks of HTML pages; scripts and styles are skipped, the page's title is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ident, text in zip(pdf["_k"], pdf["_h"], strict=True):
                page = _Page()
                page.feed(text or "")
                page.close()
                page.flush()
                head = None
                for i, (kind, body, level) in enumerate(page.blocks):
                    head = body if kind == "heading" else head
                    rows.append((ident, i, kind, body, level, head, page.title))
            yield pd.DataFrame(rows, columns=[key, "order_index", "block_type", "text", "level", "section_title", "title"]).astype({"level": "Int32"})

    src = pages.select(F.col(key).alias("_k"), F.col(html).alias("_h"))
    return src.mapInPandas(run, f"{key} {dict(src.dtypes)['_k']}, order_index int, block_type string, text string, level int, section_title string, title string")


def column_letters(n: Column) -> Column:
    """A, B, ... Z, AA, ... for 1, 2, ... up to three letters."""
    letter = lambda x: F.char(F.lit(65) + x % 26)
    one, two, three = n - 1, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return F.concat(F.when(n > 702, letter(three)).otherwise(F.lit("")), F.when(n > 26, letter(two)).otherwise(F.lit("")), letter(one))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(source_title, row, cells): the non-blank records of CSV files, numbered from 1 in each; quoted commas and line breaks are text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_f"), F.col("value"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["_f"], pdf["value"], strict=True):
                rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text.removeprefix("\ufeff")))]
                rows = [r for r in rows if any(r)]
                yield pd.DataFrame({"source_title": name, "row": range(1, len(rows) + 1), "cells": rows})

    rows = files.mapInPandas(parse, "source_title string, row int, cells array<string>")
    return rows.withColumn("source_title", F.regexp_replace("source_title", r"\.[A-Za-z]+$", ""))


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """A3 over files: the first non-blank row is the header, a blank header becomes 列n, the row label is the first non-empty cell.

    Coordinates count non-blank rows; the unit is the row's value under a header with 单位;
    year, month and quarter are read from the title and the headers.
    """
    rows = csv_rows(spark, path)
    head = rows.filter("row = 1").select("source_title", F.col("cells").alias("_h"))
    body = rows.filter("row > 1").join(head, "source_title")
    headers = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_h"), F.size("cells")) - 1), lambda i: F.coalesce(F.nullif(F.get("_h", i), F.lit("")), F.concat(F.lit("列"), (i + 1).cast("string"))))
    body = body.withColumn("_h", headers)
    label = F.try_element_at(F.filter("cells", lambda c: c != ""), F.lit(1))
    unit = F.try_element_at(F.filter(F.zip_with("_h", "cells", lambda h, c: F.when(F.contains(h, F.lit("单位")) & (c != ""), c)), lambda x: x.isNotNull()), F.lit(1))
    named = F.concat_ws(" ", "source_title", F.array_join("_h", " "))
    number = lambda p: F.nullif(F.regexp_extract(named, p, 1), F.lit(""))
    body = body.select(
        "source_title", "row", label.alias("row_label"), unit.alias("unit"), number(r"(20\d{2})年").cast("int").alias("year"), number(r"(\d{1,2})月").cast("int").alias("month"),
        numeral(number(r"([一二三四1-4])季")).alias("quarter"), "_h", F.posexplode("cells").alias("_c", "value"),
    ).filter("value <> ''")
    coordinate = F.concat(column_letters(F.col("_c") + 1), F.col("row").cast("string"))
    return body.select("source_title", "row_label", F.get("_h", F.col("_c")).alias("column_label"), coordinate.alias("coordinate"), "value", normalize_value(F.col("value")).alias("numeric_value"), "unit", "year", "month", "quarter")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4: (documents, rejected lines): body is the first non-empty of text, content, body; other scalar fields stay as text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("m", F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})).withColumn("_v", F.from_json("value", "map<string,variant>", {"mode": "PERMISSIVE"}))
    body = F.coalesce(*[F.nullif(F.trim(F.col("m")[k]), F.lit("")) for k in ("text", "content", "body")])
    rows = parsed.withColumn("body", body)
    fields = F.map_filter("m", lambda k, v: ~k.isin("text", "content", "body", "title") & v.isNotNull() & ~F.schema_of_variant(F.col("_v")[k]).rlike("^(OBJECT|ARRAY)"))
    good = rows.filter("body is not null").select("file", "body", F.col("m")["title"].alias("section_title"), fields.alias("metadata"))
    reason = F.when(F.col("m").isNull() | (F.size("m") == 0), "not_an_object").otherwise("no_body")
    return good, rows.filter("body is null").select("file", "value", reason.alias("reason"))


def read_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A5: a manifest as CSV, JSON lines or JSON with a files, documents or records list."""
    if kind == "csv":
        return spark.read.csv(path, header=True)
    if kind == "jsonl":
        return spark.read.json(path)
    df = spark.read.json(path, multiLine=True)
    for name in MANIFEST_WRAPPERS:
        if name in df.columns:
            return df.select(F.explode(name).alias("r")).select("r.*")
    return df
