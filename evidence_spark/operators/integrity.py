"""Corpus checks: counts, chunk quality, orphans, reconciliation and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import bigram_set
from .joins import dealt


def check_corpus(docs: DataFrame, chunks: DataFrame, doc: str = "doc_id", name: str = "name", expected: str = "chunk_count") -> DataFrame:
    """H1: findings: duplicate names or ids, documents without chunks, chunk counts that differ from the ledger."""
    have = chunks.groupBy(doc).agg(F.count("*").alias("_have"))
    ledger = docs.select(doc, F.col(expected).alias("_want")).join(have, doc, "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    dup = lambda c, what: docs.groupBy(c).count().filter("count > 1").select(F.lit(what).alias("check"), F.col(c).cast("string").alias("subject"), F.col("count").alias("value"))
    counts = ledger.filter("_have <> _want").select(F.lit("chunk_count").alias("check"), F.col(doc).cast("string").alias("subject"), (F.col("_have") - F.col("_want")).alias("value"))
    empty = ledger.filter("_have = 0").select(F.lit("empty_document").alias("check"), F.col(doc).cast("string").alias("subject"), F.lit(0).cast("long").alias("value"))
    return dup(doc, "duplicate_id").unionByName(dup(name, "duplicate_name")).unionByName(counts).unionByName(empty)


def check_chunks(chunks: DataFrame, doc: str = "doc_id", text: str = "text", short: int = 20) -> DataFrame:
    """H2: per document: chunks, empty ones, replacement and control characters, repeated texts, short ones, and a flag for too many repeats."""
    t = F.coalesce(F.col(text), F.lit(""))
    norm = F.lower(F.regexp_replace(t, r"\s+", ""))
    out = chunks.groupBy(doc).agg(
        F.count("*").alias("chunks"),
        F.count_if(F.trim(t) == "").alias("empty"),
        F.sum(F.regexp_count(t, F.lit("�"))).alias("replacement_chars"),
        F.sum(F.regexp_count(t, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))).alias("control_chars"),
        (F.count("*") - F.count_distinct(F.sha2(norm, 256))).alias("repeated"),
        F.count_if(F.char_length(t) < short).alias("short"),
    )
    return out.withColumn("too_many_repeats", F.col("repeated") > F.greatest(F.lit(2.0), F.col("chunks") / 10))


def index_findings(docs: DataFrame, chunks: DataFrame, version: str, doc: str = "doc_id") -> DataFrame:
    """H1: findings (check, subject, value): states other than indexed with their counts, the ledger's sum of chunks against all chunks, documents without chunks in the ledger, with an index error, or indexed by another version.

    docs: doc, status, chunk_count, index_error, index_version. check_corpus has the rest.
    """
    n = F.coalesce(F.col("chunk_count").cast("long"), F.lit(0))
    states = docs.groupBy(F.coalesce("status", F.lit("none")).alias("subject")).agg(F.count("*").alias("value")).filter("subject <> 'indexed'").select(F.lit("document_status").alias("check"), "subject", "value")
    sums = docs.agg(F.coalesce(F.sum(n), F.lit(0)).alias("want")).join(chunks.agg(F.count("*").alias("have")))  # a row each
    total = sums.filter("want <> have").select(F.lit("chunk_total").alias("check"), F.col("want").cast("string").alias("subject"), F.col("have").alias("value"))
    found = F.array_compact(F.array(
        F.when(n <= 0, F.struct(F.lit("empty_document").alias("check"), n.alias("value"))), F.when(F.coalesce("index_error", F.lit("")) != "", F.struct(F.lit("index_error").alias("check"), n.alias("value"))),
        F.when(F.coalesce("index_version", F.lit("")) != version, F.struct(F.lit("index_version").alias("check"), n.alias("value"))),
    ))
    each = docs.select(F.col(doc).cast("string").alias("subject"), F.explode(found).alias("f")).select("f.check", "subject", "f.value")
    return states.unionByName(total).unionByName(each)


def sheet_findings(docs: DataFrame, chunks: DataFrame, cells: DataFrame, doc: str = "doc_id") -> DataFrame:
    """H4: findings (doc, check, level, value) about the cells of spreadsheets.

    docs: doc, file_type, numeric_cells (of the workbook); chunks: doc, chunk_id, sheet_name,
    table_role, n_cells; cells: doc, chunk_id. blank_spreadsheet_template or
    spreadsheet_no_cells where no row chunk has cells, spreadsheet_cell_count where the cell
    table has more or fewer, spreadsheet_no_sheet_name, spreadsheet_orphan_cells (of no chunk).
    """
    sheets = docs.filter(F.col("file_type").isin("xls", "xlsx")).select(doc, F.coalesce(F.col("numeric_cells").cast("long"), F.lit(0)).alias("_numeric"))
    rows = F.when(F.col("table_role") == "row", F.coalesce(F.col("n_cells").cast("long"), F.lit(0))).otherwise(0)
    want = chunks.groupBy(doc).agg(F.sum(rows).alias("_want"), F.count_if(F.coalesce("sheet_name", F.lit("")) != "").alias("_named"))
    known = chunks.select("chunk_id", F.lit(True).alias("_known")).distinct()
    have = cells.join(known, "chunk_id", "left").groupBy(doc).agg(F.count("*").alias("_have"), F.count_if(F.col("_known").isNull()).alias("_orphans"))
    all_ = sheets.join(want, doc, "left").join(have, doc, "left").fillna(0, ["_want", "_named", "_have", "_orphans"])
    none = F.col("_want") == 0
    finding = lambda ok, name, level, value: F.when(ok, F.struct(F.lit(name).alias("check"), F.lit(level).alias("level"), F.col(value).alias("value")))
    found = F.array_compact(F.array(
        finding(none & (F.col("_numeric") == 0), "blank_spreadsheet_template", "warning", "_numeric"), finding(none & (F.col("_numeric") > 0), "spreadsheet_no_cells", "error", "_numeric"), finding(~none & (F.col("_have") != F.col("_want")), "spreadsheet_cell_count", "error", "_have"),
        finding(F.col("_named") == 0, "spreadsheet_no_sheet_name", "warning", "_named"), finding(F.col("_orphans") > 0, "spreadsheet_orphan_cells", "error", "_orphans"),
    ))
    return all_.select(doc, F.explode(found).alias("f")).select(doc, "f.check", "f.level", "f.value")


#: Least characters of a document, characters from which its share of Chinese ones counts and that share, share of unreadable signs that a PDF's formulas explain.
LEAST_TEXT, JUDGED_TEXT, LEAST_CJK, FORMULA_SIGNS = 20, 200, 0.05, 0.01
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def chunk_findings(docs: DataFrame, chunks: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """H2: findings (doc, check, level, value) about each document's chunks.

    docs: doc, file_type, chunk_count; chunks: doc, text, metadata (JSON, null: none), page_number.
    Errors: chunk_count_mismatch, no_chunks, empty_chunk, replacement_chars,
    chunk_metadata_json (not an object), text_too_short. Warnings: pdf_math_symbol_placeholders
    (replacement signs under a hundredth of a PDF's text), control_chars (chunks that have
    any), low_cjk_ratio (over 200 characters, no spreadsheet), duplicate_chunk_texts (more
    repeats than 2 and a tenth of the chunks), pdf_page_numbers (none).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.trim(F.regexp_replace(t, r"\s+", " "))
    meta = F.coalesce(F.nullif(F.col("metadata"), F.lit("")), F.lit("{}"))
    each = chunks.select(doc, t.alias("_t"), F.sha2(plain, 256).alias("_h"), (plain != "").alias("_full"), (F.try_parse_json(meta).isNotNull() & meta.rlike(r"^\s*\{")).alias("_json"), "page_number")
    stats = each.groupBy(doc).agg(
        F.count("*").alias("chunks"), F.sum(F.char_length("_t")).alias("chars"), F.count_if(~F.col("_full")).alias("empty"), F.sum(F.regexp_count("_t", F.lit("�"))).alias("signs"), F.count_if(F.col("_t").rlike(CONTROL)).alias("control"),
        F.count_if(~F.col("_json")).alias("metadata"), F.sum(F.regexp_count("_t", F.lit("[一-鿿]"))).alias("cjk"), F.count("page_number").alias("pages"), (F.count_if("_full") - F.count_distinct(F.when(F.col("_full"), F.col("_h")))).alias("repeats"),
    )
    n = [c for c in stats.columns if c != doc]
    rows = docs.select(doc, "file_type", F.coalesce(F.col("chunk_count").cast("long"), F.lit(0)).alias("_want")).join(stats, doc, "left").fillna(0, n)
    pdf, excel = F.col("file_type") == "pdf", F.coalesce(F.col("file_type").isin("xls", "xlsx"), F.lit(False))
    formulas = F.coalesce(pdf, F.lit(False)) & (F.col("signs") / F.greatest("chars", F.lit(1)) < FORMULA_SIGNS)
    share = F.col("cjk") / F.greatest("chars", F.lit(1))
    checks = [
        ("chunk_count_mismatch", "error", F.col("chunks") != F.col("_want"), F.col("chunks") - F.col("_want")), ("no_chunks", "error", F.col("chunks") == 0, F.lit(0)), ("empty_chunk", "error", F.col("empty") > 0, F.col("empty")),
        ("pdf_math_symbol_placeholders", "warning", (F.col("signs") > 0) & formulas, F.col("signs")), ("replacement_chars", "error", (F.col("signs") > 0) & ~formulas, F.col("signs")), ("control_chars", "warning", F.col("control") > 0, F.col("control")),
        ("chunk_metadata_json", "error", F.col("metadata") > 0, F.col("metadata")), ("text_too_short", "error", F.col("chars") < LEAST_TEXT, F.col("chars")), ("low_cjk_ratio", "warning", (F.col("chars") > JUDGED_TEXT) & ~excel & (share < LEAST_CJK), F.col("cjk")),
        ("duplicate_chunk_texts", "warning", F.col("repeats") > F.greatest(F.lit(2), F.floor(F.col("chunks") / 10)), F.col("repeats")), ("pdf_page_numbers", "warning", F.coalesce(pdf, F.lit(False)) & (F.col("chunks") > 0) & (F.col("pages") == 0), F.col("chunks")),
    ]
    found = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(name).alias("check"), F.lit(level).alias("level"), value.cast("long").alias("value"))) for name, level, ok, value in checks]))
    return rows.select(doc, F.explode(found).alias("f")).select(doc, "f.check", "f.level", "f.value")


def chunk_distribution(chunks: DataFrame, doc: str, kind: str) -> DataFrame:
    """H3: chunks per document by kind: documents, min, median, p95, max."""
    per = chunks.groupBy(kind, doc).agg(F.count("*").alias("n"))
    return per.groupBy(kind).agg(F.count("*").alias("documents"), F.min("n").alias("min"), F.percentile("n", F.lit(0.5)).alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").alias("p95"), F.max("n").alias("max"))


def check_cells(claimed: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """H4: keys whose claimed cell count (n) differs from the cell table; a missing side counts 0."""
    have = cells.groupBy(key).agg(F.count("*").alias("have"))
    both = claimed.select(key, F.col("n").alias("claimed")).join(have, key, "full_outer")
    return both.select(key, F.coalesce("claimed", F.lit(0)).alias("claimed"), F.coalesce("have", F.lit(0)).alias("have")).filter("claimed <> have")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """H5: rows whose key no parent has."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], version: str) -> DataFrame:
    """H6: keys only in a (missing), only in b (extra), or with another version."""
    one, two = a.select(*keys, F.col(version).alias("_a"), F.lit(1).alias("_ina")), b.select(*keys, F.col(version).alias("_b"), F.lit(1).alias("_inb"))
    both = one.join(two, keys, "full_outer")
    what = F.when(F.col("_inb").isNull(), "missing").when(F.col("_ina").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "version")
    return both.select(*keys, what.alias("finding")).filter("finding is not null")


def diff_baseline(now: DataFrame, before: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """H7: missing and added keys, and one row per changed field."""
    side = lambda df, p: df.select(key, F.struct(*fields).alias(p))
    both = side(now, "_n").join(side(before, "_b"), key, "full_outer")
    kinds = F.array_compact(F.array(
        F.when(F.col("_b").isNull(), "added"), F.when(F.col("_n").isNull(), "missing"),
        *[F.when(F.col("_b").isNotNull() & F.col("_n").isNotNull() & ~F.col(f"_n.{f}").eqNullSafe(F.col(f"_b.{f}")), f"changed_{f}") for f in fields],
    ))
    return both.select(key, F.explode(kinds).alias("change"))


def check_files(ledger: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """H8: missing, not_imported, size or hash findings between a ledger and a file listing (path, size, sha256)."""
    a = ledger.select(key, F.col("size").alias("_s"), F.col("sha256").alias("_h"), F.lit(1).alias("_l"))
    b = files.select(key, F.col("size").alias("_fs"), F.col("sha256").alias("_fh"), F.lit(1).alias("_f"))
    what = F.when(F.col("_f").isNull(), "missing").when(F.col("_l").isNull(), "not_imported").when(F.col("_s") != F.col("_fs"), "size").when(F.col("_h") != F.col("_fh"), "hash")
    return a.join(b, key, "full_outer").select(key, what.alias("finding")).filter("finding is not null")


def metadata_coverage(docs: DataFrame, fields: list[str]) -> DataFrame:
    """H9: per field how many documents have a non-blank value."""
    counts = docs.agg(*[F.count(F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))).alias(f) for f in fields], F.count("*").alias("documents"))
    return counts.unpivot("documents", fields, "field", "filled")


def verify_files(docs: DataFrame, stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """H8: findings (check, filename, expected, actual): the ledger against stored files, and these against the source manifest.

    All three: filename, size, sha256. A document's first failing check counts, in this order:
    original_missing, original_size, original_sha256 (stored file), source_missing,
    source_size_mismatch, source_hash_mismatch (manifest against the stored file's hash);
    then source_not_imported and document_not_in_source for names on one side only.
    """
    side = lambda df, p: df.groupBy("filename").agg(F.max(F.coalesce(F.col("size").cast("long"), F.lit(0))).alias(f"_{p}n"), F.max(F.coalesce("sha256", F.lit(""))).alias(f"_{p}h"), F.lit(True).alias(f"_{p}"))
    rows = docs.select("filename", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("_n"), F.coalesce("sha256", F.lit("")).alias("_h")).join(side(stored, "s"), "filename", "left").join(side(manifest, "m"), "filename", "left")
    text = lambda c: F.col(c).cast("string")
    finding = lambda name, want, have: F.struct(F.lit(name).alias("check"), want.alias("expected"), have.alias("actual"))
    none = F.lit(None).cast("string")
    first = (
        F.when(F.col("_s").isNull(), finding("original_missing", text("_h"), none)).when(F.col("_sn") != F.col("_n"), finding("original_size", text("_n"), text("_sn"))).when(F.col("_sh") != F.col("_h"), finding("original_sha256", text("_h"), text("_sh")))
        .when(F.col("_m").isNull(), finding("source_missing", text("_h"), none)).when(F.col("_mn") != F.col("_n"), finding("source_size_mismatch", text("_mn"), text("_n"))).when(F.col("_mh") != F.col("_sh"), finding("source_hash_mismatch", text("_mh"), text("_sh")))
    )
    found = rows.withColumn("f", first).filter("f is not null").select("f.check", "filename", "f.expected", "f.actual")
    names = lambda a, b, name: a.select("filename").distinct().join(b.select("filename"), "filename", "left_anti").select(F.lit(name).alias("check"), "filename", none.alias("expected"), none.alias("actual"))
    return found.unionByName(names(manifest, docs, "source_not_imported")).unionByName(names(docs, manifest, "document_not_in_source"))


#: Share of bigrams that two chunkings must have of each other, both ways, to differ in boundaries only.
BOUNDARY_COVERAGE = 0.98


def compare_chunkings(old: DataFrame, new: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text", structure: Sequence[str] = ()) -> DataFrame:
    """Per document identical, structure_only (texts and order agree, a structural field does not), order_only (same multiset of texts), boundary_only, or different; with coverage where texts differ.

    Runs of white space are compared as one blank. boundary_only: the two sides' texts, joined in
    lines in order, have 0.98 of each other's distinct bigrams, so sentences moved between
    chunks but none was lost. Only documents whose texts differ are taken apart into bigrams,
    each chunk by itself up to the next one's first character, so no document is joined whole.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    h = F.sha2(plain, 256)
    fields = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in structure]) if structure else F.lit(""), 256)

    def side(df: DataFrame, p: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(pos, h.alias("h"), fields.alias("s"))))
        return df.groupBy(doc).agg(*[
            F.sha2(F.array_join(of, ","), 256).alias(p + name)
            for name, of in (("o", F.transform(rows, lambda x: x["h"])), ("s", F.transform(rows, lambda x: F.concat(x["h"], x["s"]))), ("m", F.array_sort(F.collect_list(h))))
        ])

    both = side(old, "a").join(side(new, "b"), doc, "full_outer")
    kind = (
        F.when(F.col("ao").isNull(), "added").when(F.col("bo").isNull(), "removed").when(F.col("as") == F.col("bs"), "identical").when(F.col("ao") == F.col("bo"), "structure_only")
        .when(F.col("am") == F.col("bm"), "order_only").otherwise("different")
    )
    known = both.select(doc, kind.alias("kind"))
    apart = known.filter("kind = 'different'").select(doc)

    def grams(df: DataFrame, name: str) -> DataFrame:
        rows = df.join(apart, doc, "left_semi").select(doc, pos, plain.alias("_t")).filter("_t <> ''")
        w = W.partitionBy(doc).orderBy(pos, "_t")
        seam = F.concat("_t", F.coalesce(F.concat(F.lit("\n"), F.left(F.lead("_t").over(w), F.lit(1))), F.lit("")))
        return rows.select(doc, seam.alias("_s")).select(doc, F.explode(bigram_set(F.col("_s"))).alias("_g")).distinct().withColumn(name, F.lit(1))

    met = grams(old, "_a").join(grams(new, "_b"), [doc, "_g"], "full_outer").groupBy(doc).agg(F.count("_a").alias("_na"), F.count("_b").alias("_nb"), F.count(F.col("_a") + F.col("_b")).alias("_n"))
    share = lambda n: F.when(F.col(n) == 0, 1.0).otherwise(F.col("_n") / F.col(n))
    cover = met.select(doc, F.least(share("_na"), share("_nb")).alias("coverage"))
    out = known.join(cover, doc, "left")
    # Sides without any bigram cover each other.
    coverage = F.when(F.col("kind") == "different", F.coalesce("coverage", F.lit(1.0)))
    return out.select(doc, F.when(coverage >= BOUNDARY_COVERAGE, "boundary_only").otherwise(F.col("kind")).alias("kind"), F.round(coverage, 6).alias("coverage"))


def audit_metadata(copies: DataFrame, ledger: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per field of a copy that differs from the ledger (nulls equal); copies are dealt by key, so many to a task."""
    both = dealt(copies, key).select("copy_id", key, *[F.col(f).cast("string").alias(f"_c_{f}") for f in fields]).join(ledger.select(key, *[F.col(f).cast("string").alias(f"_l_{f}") for f in fields]), key)
    rows = F.array_compact(F.array(*[F.when(~F.col(f"_c_{f}").eqNullSafe(F.col(f"_l_{f}")), F.lit(f)) for f in fields]))
    return both.select("copy_id", key, F.explode(rows).alias("field"))


def replacement_ratio(text: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit("�")), F.char_length(text))
