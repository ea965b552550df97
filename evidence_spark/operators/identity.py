"""Landing rules and document identity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .joins import contained

#: A source's priority when metadata are merged.
PRIORITIES = {"user": 100, "manifest": 95, "official_url": 90, "document_body": 60, "parser": 50, "filename": 20, "legacy": 10}


@F.pandas_udf(T.StringType())
def nfc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def normalize_filename(col: Column, composed: bool = True) -> Column:
    """Base name across / \\ and :, composed form, trimmed, at most 255 characters, lower case; blank gives null."""
    base = F.trim(F.regexp_extract(col, r"([^/\\:]*)$", 1))
    base = nfc(base) if composed else base
    return F.nullif(F.lower(F.substring(base, 1, 255)), F.lit(""))


def preflight(batch: DataFrame, docs: DataFrame) -> DataFrame:
    """B1: status of each batch row (file_id, name_norm, size, sha256) against the ledger, in order of precedence."""
    twice = F.count("*").over(W.partitionBy("name_norm")) > 1
    marked = batch.withColumn("_twice", twice & F.col("name_norm").isNotNull())
    same = docs.select("size", "sha256").distinct().withColumn("_same", F.lit(True))
    named = docs.select("name_norm").distinct().withColumn("_named", F.lit(True))
    out = marked.join(same, ["size", "sha256"], "left").join(named, "name_norm", "left")
    status = (
        F.when(F.col("name_norm").isNull(), "name_conflict").when(F.col("_twice"), "selection_name_conflict")
        .when(F.col("_same"), "exact_duplicate").when(F.col("_named"), "name_conflict").otherwise("ready")
    )
    return out.select("file_id", status.alias("status"))


def exact_duplicates(docs: DataFrame, doc: str = "doc_id", order: str = "uploaded_at") -> DataFrame:
    """B2: documents of equal size and hash with the keeper of their group; keepers themselves are left out.

    The keeper comes from an aggregate, so a large group is not brought together.
    """
    keeper = docs.groupBy("size", "sha256").agg(F.min_by(doc, F.struct(order, doc)).alias("keeper"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return docs.join(keeper, ["size", "sha256"]).filter(F.col(doc) != F.col("keeper")).select(doc, "keeper")


def match_manifest(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """Manifest rows (row_id, sha256, external_id, name_norm) to documents by the first key with matches; matched, not_found or ambiguous."""
    out = manifest
    for k in ("sha256", "external_id", "name_norm"):
        found = docs.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(f"_n_{k}"), F.min("doc_id").alias(f"_d_{k}"))
        out = out.join(found, k, "left")
    n = F.coalesce(*[F.col(f"_n_{k}") for k in ("sha256", "external_id", "name_norm")])
    d = F.coalesce(*[F.col(f"_d_{k}") for k in ("sha256", "external_id", "name_norm")])
    by = F.coalesce(*[F.when(F.col(f"_n_{k}").isNotNull(), F.lit(k)) for k in ("sha256", "external_id", "name_norm")])
    status = F.when(n.isNull(), "not_found").when(n > 1, "ambiguous").otherwise("matched")
    return out.select("row_id", status.alias("status"), F.when(n == 1, d).alias("doc_id"), by.alias("matched_by"))


def manifest_integrity(matched: DataFrame) -> DataFrame:
    """Valid, or invalid where a stated hash or size differs from the document's."""
    bad = (F.col("sha256") != F.col("doc_sha256")) | (F.col("size") != F.col("doc_size"))
    return matched.withColumn("integrity", F.when(F.coalesce(bad, F.lit(False)), "invalid").otherwise("valid"))


def merge_metadata(observations: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document and field the value of the highest source, later ones at equal priority.

    observations: doc, field, value, source, confidence, seq. An empty value never wins,
    except that a user's empty value clears all before it, and anything later may fill in.
    """
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])[F.col("source")], F.lit(0))
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    cleared = F.max(F.when((F.col("source") == "user") & ~filled, F.col("seq"))).over(W.partitionBy(doc, "field"))
    live = observations.withColumn("_cut", cleared).filter(filled & (F.col("_cut").isNull() | (F.col("seq") > F.col("_cut"))))
    best = F.max_by(F.struct("value", "source", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))).alias("confidence"), "seq"), F.struct(priority, "seq"))
    return live.groupBy(doc, "field").agg(best.alias("b")).select(doc, "field", "b.value", "b.source", "b.confidence", "b.seq")


def normalize_keys(kv: DataFrame, aliases: dict[str, str], key: str = "key", value: str = "value") -> DataFrame:
    """Keys by an alias table (lower case, blanks out), dates as yyyy-mm-dd where they can be read."""
    norm = F.lower(F.regexp_replace(key, r"[\s_\-]+", ""))
    table = F.create_map(*[F.lit(x) for a in aliases.items() for x in a])
    date = F.concat_ws("-", F.regexp_extract(value, r"(\d{4})\D{1,3}(\d{1,2})\D{1,3}(\d{1,2})", 1), F.lpad(F.regexp_extract(value, r"(\d{4})\D{1,3}(\d{1,2})\D{1,3}(\d{1,2})", 2), 2, "0"), F.lpad(F.regexp_extract(value, r"(\d{4})\D{1,3}(\d{1,2})\D{1,3}(\d{1,2})", 3), 2, "0"))
    field = F.coalesce(table[norm], norm)
    return kv.withColumn("field", field).withColumn("normalized", F.when(field.endswith("_date"), F.date_format(date.try_cast("date"), "yyyy-MM-dd")).otherwise(F.trim(value)))


def infer_topic(docs: DataFrame, rules: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The topic of the first rule (rule_order, keyword, topic) whose keyword the text holds."""
    hits = contained(rules, "keyword", docs.select(doc, text), text)
    return hits.groupBy(doc).agg(F.min_by("topic", F.struct("rule_order", "topic")).alias("topic"))


def infer_titles(blocks: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The first meaningful heading among the first eight blocks, else the last specific part of the file name."""
    t = F.trim("text")
    meaningful = (F.char_length(t).between(4, 200)) & ~t.rlike(r"^(附件\s*\d*|第[一二三四五六七八九十百]+[章节条]|[（(]?[一二三四五六七八九十\d]+[)）、.])")
    head = blocks.filter((F.col("block_type") == "heading") & (F.col("order_index") < 8) & meaningful).groupBy(doc).agg(F.min_by(t, "order_index").alias("_head"))
    parts = F.filter(F.split(F.regexp_replace("filename", r"\.[A-Za-z0-9]+$", ""), "_"), lambda p: (F.char_length(p) >= 2) & ~p.rlike(r"^\d+$"))
    return docs.join(head, doc, "left").select(doc, F.coalesce("_head", F.try_element_at(parts, F.lit(-1))).alias("title"))


def resolve_versions(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """What each supersedes value points at, by id or else external id: superseded, self or missing."""
    wanted = docs.filter("supersedes is not null").select(F.col(doc).alias("by_doc"), "supersedes")
    by_id = docs.select(F.col(doc).cast("string").alias("supersedes"), F.col(doc).alias("_a"))
    by_ext = docs.filter("external_id is not null").groupBy(F.col("external_id").alias("supersedes")).agg(F.min(doc).alias("_b"))
    found = wanted.join(by_id, "supersedes", "left").join(by_ext, "supersedes", "left").withColumn("target", F.coalesce("_a", "_b"))
    state = F.when(F.col("target").isNull(), "missing").when(F.col("target") == F.col("by_doc"), "self").otherwise("superseded")
    return found.select("by_doc", "target", state.alias("state"))


def identity_warnings(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Contradictions between dates and status, one row each."""
    checks = F.array_compact(F.array(
        F.when(F.col("expiration_date") < F.col("effective_date"), "error:expires_before_effective"),
        F.when(F.col("publication_date") > F.col("effective_date"), "warning:published_after_effective"),
        F.when((F.col("status") == "current") & F.col("effective_date").isNull(), "warning:current_without_effective"),
        F.when((F.col("status") == "repealed") & F.col("expiration_date").isNull(), "warning:repealed_without_expiry"),
    ))
    return docs.select(doc, F.explode(checks).alias("warning"))


def identity_hash(fields: list[str]) -> Column:
    """SHA-256 over the identity fields in name order; null and empty differ from each other."""
    return F.sha2(F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in sorted(fields)])), 256)


def review_state(docs: DataFrame, fields: list[str], confirmed: str = "confirmed_hash") -> DataFrame:
    """identity_hash and review_state: confirmed while the hash that was confirmed still holds, reset where the identity changed since, else pending."""
    out = docs.withColumn("identity_hash", identity_hash(fields))
    state = F.when(F.col(confirmed).isNull(), "pending").when(F.col(confirmed) == F.col("identity_hash"), "confirmed").otherwise("reset")
    return out.withColumn("review_state", state)


def reject_qa_rows(rows: DataFrame, fields: str = "fields") -> tuple[DataFrame, DataFrame]:
    """(kept, refused): a map with question and any of answer, answer_text, evidence, option_a is refused."""
    keys = F.map_keys(fields)
    leak = F.array_contains(keys, "question") & F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ("answer", "answer_text", "evidence", "option_a")]))
    return rows.filter(~leak), rows.filter(leak)


def lookup_identity(q: DataFrame, docs: DataFrame, q_id: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Documents whose title matches a quoted one best: equal 100, inside 80 + length, containing 60 + length (to 19); ties all kept."""
    a, b = F.lower(F.trim("wanted")), F.lower(F.trim("title"))
    score = F.when(a == b, 100).when(F.contains(b, a), 80 + F.least(F.lit(19), F.char_length(a))).when(F.contains(a, b), 60 + F.least(F.lit(19), F.char_length(b)))
    named, asked = docs.select(doc, "title", b.alias("_b")), q.select(q_id, "wanted", a.alias("_a"))
    pairs = contained(asked, "_a", named, "_b").unionByName(contained(named, "_b", asked, "_a").select(*named.columns, *asked.columns)).distinct()
    found = pairs.withColumn("score", score)
    return found.withColumn("_r", F.rank().over(W.partitionBy(q_id).orderBy(F.desc("score")))).filter("_r = 1").select(q_id, doc, "score")


def ingest_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per extension or parser: processed, outcomes, chunks, and time per document."""
    times = [F.round(F.avg("ms"), 6).alias("avg_ms"), F.percentile("ms", F.lit(0.5)).alias("p50_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"), F.max("ms").alias("max_ms")]
    return records.groupBy(*keys).agg(F.count("*").alias("processed"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "degraded", "failed")], F.sum("chunks").alias("chunks"), *times)


def list_documents(docs: DataFrame, order: str, doc: str, limit: int) -> DataFrame:
    """The newest documents first."""
    return docs.orderBy(F.desc(order), F.desc(doc)).limit(limit)


def reconcile_sources(docs: DataFrame, files: DataFrame, ids: DataFrame, vectors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """source_missing where the file is gone; indexed where chunk ids and vector ids are the same set, else needs_index."""
    digest = lambda df, name: df.groupBy(doc).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("item_id")), ","), 256).alias(name))
    out = docs.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left").join(digest(ids, "_c"), doc, "left").join(digest(vectors, "_v"), doc, "left")
    state = F.when(F.col("_there").isNull(), "source_missing").when(F.col("_c").eqNullSafe(F.col("_v")) & F.col("_c").isNotNull(), "indexed").otherwise("needs_index")
    return out.select(doc, state.alias("state"))
