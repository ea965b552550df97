"""Retrieval over a table of queries: top-k, fusion, filters, ordering and selection.

Every window is keyed by the query, ends with the chunk id, and ranks at most what the
join before it made for that query; row_number <= k lets Spark prune before the shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import NUMERAL, bigram_support, let, numeral, token_count
from .joins import checked_broadcast
from .lineage import kept

#: Weight of each kind of query variant, and of each evidence role.
VARIANT_WEIGHTS = {"semantic": 1.0, "statement": 1.15, "table": 1.2, "keyword": 0.75, "legacy": 0.9, "fallback": 0.85}
ROLE_WEIGHTS = {"direct": 3, "table_evidence": 3, "table_context": 2, "related": 1}
#: Vectors in a block, queries in a lot, and products that a task holds at a time.
VECTOR_BLOCK, QUERY_LOT, PRODUCTS = 16_384, 4_096, 1 << 22


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= k)


def dense_topk(
    queries: DataFrame, vectors: DataFrame, k: int, q: str = "query_id", c: str = "chunk_id", vector: str = "vector", filters: DataFrame | None = None, chunks: DataFrame | None = None, doc: str = "document_id"
) -> DataFrame:
    """The k vectors of greatest inner product for every query; ties (to nine places) go to the smaller id.

    Vectors are dealt into blocks, queries into lots; each block meets each lot once and
    keeps k per query, a window merges what the blocks kept. Null vectors take no part; a
    query meets the vectors of its own length. With filters and chunks (see filtered) a
    block ranks for each query only the chunks that fit its filter.
    """
    blocks, lots = (max(1, -(-df.count() // n)) for df, n in ((vectors, VECTOR_BLOCK), (queries, QUERY_LOT)))
    kind_q, kind_c = dict(queries.dtypes)[q], dict(vectors.dtypes)[c]
    wants, has, fields = [], [], []
    if filters is not None:
        asks, shows, fields = filter_sides(filters, chunks, q, c, doc)
        wants, has = [x for x in asks.columns if x != q], [x for x in shows.columns if x != c]
        queries, vectors = queries.select(q, vector).join(asks, q, "left"), vectors.select(c, vector).join(shows, c, "left")
    deal = lambda df, ident, more, n, name: df.select(F.col(ident).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), *more).filter("_v is not null").withColumn(name, F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int"))
    each = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    matrix = lambda t: t["_v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)

    def fitting(block: pa.Table, wanted: dict) -> np.ndarray:
        mask = np.ones(len(block), bool)
        if wanted.get("_docs") is not None:
            mask &= np.isin(block["_doc"].to_numpy(zero_copy_only=False).astype(object), wanted["_docs"])
        for f in fields:
            if wanted[f"_want_{f}"] is not None:
                mask &= block[f"_has_{f}"].to_numpy(zero_copy_only=False) == wanted[f"_want_{f}"]
        return mask

    def search(block: pa.Table, lot: pa.Table) -> pa.Table:
        at, of, scores = [], [], []
        if len(block) and len(lot):
            block = block.sort_by("_id")
            asked = lot.select(wants).to_pylist() if wants else []
            signs, masks = [repr(x) for x in asked], {}
            sizes, lengths = (np.array([len(v) for v in t["_v"]]) for t in (block, lot))
            for size in np.unique(lengths):
                mine, theirs = np.flatnonzero(lengths == size), np.flatnonzero(sizes == size)
                if not size or not len(theirs):
                    continue
                m, v = matrix(lot.take(mine)), matrix(block.take(theirs))
                step = max(1, PRODUCTS // len(v))
                for i in range(0, len(m), step):
                    s = m[i : i + step] @ v.T
                    shown = s.round(9)
                    for j, row in enumerate(shown):
                        who = mine[i + j]
                        if asked:
                            if signs[who] not in masks:
                                masks[signs[who]] = fitting(block, asked[who])
                            open_ = np.flatnonzero(masks[signs[who]][theirs])
                        else:
                            open_ = None
                        seen = row if open_ is None else row[open_]
                        if not len(seen):
                            continue
                        least = np.partition(seen, max(0, len(seen) - k))[max(0, len(seen) - k)]
                        some = np.flatnonzero(seen >= least)
                        best = some[np.argsort(-seen[some], kind="stable")[:k]]  # rows are in the order of ids
                        best = best if open_ is None else open_[best]
                        at.append(np.full(len(best), who))
                        of.append(theirs[best])
                        scores.append(s[j, best])
        take = lambda t, x: t["_id"].take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return pa.table({q: take(lot, at), c: take(block, of), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

    left, right = each(deal(vectors, c, has, blocks, "_block"), lots, "_lot"), each(deal(queries, q, wants, lots, "_lot"), blocks, "_block")
    found = left.groupBy("_block", "_lot").cogroup(right.groupBy("_block", "_lot")).applyInArrow(search, f"{q} {kind_q}, {c} {kind_c}, score double")
    return top(found, [q], [F.desc(F.round("score", 9)), F.col(c)], k)


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A text's word counts dealt to `dim` places by MD5, of unit length: an encoder without a model."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    places = F.transform(tokens, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim)
    counts = let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(counts, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def embed(df: DataFrame, key: str = "chunk_id", text: str = "text", encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, dim: int = 64, lot: int = 256) -> DataFrame:
    """(key, vector) of every row; a null or blank text is an error of the job.

    encoder is called once per task and gives a function from texts to a matrix, a row each;
    without one, hashed_vector encodes in the JVM.
    """
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    checked = F.when(blank, F.raise_error(F.concat(F.lit("blank text: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col(text))
    if encoder is None:
        return df.select(key, hashed_vector(checked, dim).alias("vector"))
    rows = df.select(key, checked.alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            for i in range(0, b.num_rows, lot):
                part = b.slice(i, lot)
                v = np.asarray(encode(part.column(1).to_pylist()), np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v), pa.list_(pa.float64()))], [key, "vector"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, vector array<double>")


def to_postings(df: DataFrame, key: str, weights: str = "weights") -> DataFrame:
    """(key, token, weight) of a map from tokens to weights; zero, null and non-numeric weights are left out."""
    rows = df.select(key, F.explode(F.col(weights)).alias("token", "_w")).withColumn("weight", F.col("_w").cast("string").try_cast("double"))
    return rows.filter(F.col("weight").isNotNull() & (F.col("weight") != 0) & ~F.isnan("weight")).select(key, "token", "weight")


#: Words of questions that are sent to every task.
ASKED = 100_000
#: Postings of a token beyond which it counts as common; each further tenfold is a class of its own.
COMMON = 10_000
#: Scores closer than this may tie after rounding.
CLOSE = 1e-8


def sparse_topk(q_postings: DataFrame, postings: DataFrame, k: int, q: str = "query_id", c: str = "chunk_id", common: int | None = None, allow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k chunks of greatest dot product on shared tokens for every query.

    Up to ASKED words of questions meet the postings where these lie, in one pass; of
    postings dealt by chunk (see chunking.postings) only k rows of each query and task travel.

    Of more words, or with common given, tokens are read in classes, rare ones first. What a query's remaining tokens can add or
    take is bounded by each token's greatest and least weight. Once k chunks are certain to
    stay above whatever a chunk not met yet could reach, common tokens are no longer joined
    by token: they are looked up by (chunk, token) for the few chunks that may still be among
    the k best. Queries that stay open read the next class, dealt by chunk, so no common
    token meets in one task; after the last class every score is whole. allow keeps the rows
    (query, chunk) that a query may see, before anything is ranked.
    """
    allow = allow or (lambda rows: rows)
    asked = q_postings.select(q, "token", F.col("weight").cast("double").alias("_w"))
    rows = postings.select(c, "token", F.col("weight").cast("double").alias("_v"))
    if common is None and asked.limit(ASKED + 1).count() <= ASKED:
        met = rows.join(F.broadcast(asked), "token").groupBy(q, c).agg(F.sum(F.col("_v") * F.col("_w")).alias("score"))
        return top(allow(met), [q], [F.desc(F.round("score", 9)), F.col(c)], k)
    common = common or COMMON
    rows = kept(rows.join(checked_broadcast(asked.select("token").distinct()), "token", "left_semi"))
    stats = rows.groupBy("token").agg(F.count("*").alias("_df"), F.max("_v").alias("_hi"), F.min("_v").alias("_lo"))
    cls = F.greatest(F.lit(0), F.ceil(F.log10(F.col("_df") / F.lit(float(common))))).cast("int")
    ends = F.array(F.lit(0.0), F.col("_w") * F.col("_hi"), F.col("_w") * F.col("_lo"))
    terms = kept(asked.join(stats, "token").select(q, "token", "_w", cls.alias("_class"), F.array_max(ends).alias("_up"), F.array_min(ends).alias("_down")))
    classes = sorted(r["_class"] for r in terms.select("_class").distinct().collect())  # as many as the data has tenfolds
    salts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held, done, open_ = None, [], None
    for i, k_class in enumerate(classes):
        part = terms.filter(F.col("_class") == k_class)
        part = part.join(open_, q, "left_semi") if open_ is not None else part
        part, side, keys = part.select(q, "token", "_w"), rows, ["token"]
        if k_class:
            part, side, keys = part.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), rows.withColumn("_salt", F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")), ["token", "_salt"]
        met = allow(side.join(part, keys).select(q, c, (F.col("_v") * F.col("_w")).alias("score")))
        held = (met if held is None else held.unionByName(met)).groupBy(q, c).agg(F.sum("score").alias("score"))
        if i == len(classes) - 1:
            break
        held = kept(held)
        rest = terms.filter(F.col("_class") > k_class)
        bounds = rest.groupBy(q).agg(F.sum("_up").alias("_up"), F.sum("_down").alias("_down"))
        best = top(held, [q], [F.desc("score")], k, "_n").groupBy(q).agg(F.min("score").alias("_least"), F.max("_n").alias("_n"))
        state = kept(best.join(bounds, q, "left").select(q, "_n", (F.col("_least") + F.coalesce("_down", F.lit(0.0))).alias("_floor"), F.coalesce("_up", F.lit(0.0)).alias("_up")))
        closed = state.filter((F.col("_n") >= k) & (F.col("_floor") > F.col("_up") + CLOSE))
        final = held.join(closed, q).filter(F.col("score") + F.col("_up") >= F.col("_floor") - CLOSE).select(q, c, "score")
        more = final.select(q, c).join(rest.select(q, "token", "_w"), q).join(rows, [c, "token"]).select(q, c, (F.col("_v") * F.col("_w")).alias("score"))
        done.append(final.unionByName(more).groupBy(q, c).agg(F.sum("score").alias("score")))
        queries = terms.select(q).distinct() if open_ is None else open_
        open_ = kept(queries.join(closed.select(q), q, "left_anti"))
        held = held.join(open_, q, "left_semi")
    if held is None:
        held = rows.limit(0).crossJoin(terms.limit(0).select(q)).select(q, c, F.lit(0.0).alias("score"))
    scored = functools.reduce(DataFrame.unionByName, done, held)
    return top(scored, [q], [F.desc(F.round("score", 9)), F.col(c)], k)


#: Fields of a chunk that a search filters by equality, besides its document.
FILTER_FIELDS = ("article_number", "version_status", "year", "month", "quarter")


def filter_sides(filters: DataFrame, chunks: DataFrame, q: str, c: str, doc: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """What each query wants (_docs, _want_*), what each chunk has (_doc, _has_*), and the fields that both know."""
    fields = [f for f in FILTER_FIELDS if f in filters.columns and f in chunks.columns]
    docs = F.col("document_ids").cast("array<string>") if "document_ids" in filters.columns else F.lit(None).cast("array<string>")
    wants = filters.select(q, docs.alias("_docs"), *[F.nullif(F.col(f).cast("string"), F.lit("")).alias(f"_want_{f}") for f in fields])
    has = chunks.select(c, F.col(doc).cast("string").alias("_doc"), *[F.col(f).cast("string").alias(f"_has_{f}") for f in fields])
    return wants, has, fields


def filtered(filters: DataFrame, chunks: DataFrame, q: str = "query_id", c: str = "chunk_id", doc: str = "document_id") -> Callable[[DataFrame], DataFrame]:
    """Keeps rows (query, chunk) whose chunk fits the query's filters; used inside a search, so that k results stay.

    filters: a row per query with document_ids (null: any; an empty list: none) and equality
    fields (null or empty: any). A query without a row there sees all. chunks: a row per
    chunk; one without is seen by queries without any filter only.
    """
    wants, has, fields = filter_sides(filters, chunks, q, c, doc)

    def keep(rows: DataFrame) -> DataFrame:
        fits = F.col("_docs").isNull() | F.coalesce(F.array_contains("_docs", F.col("_doc")), F.lit(False))
        for f in fields:
            fits = fits & (F.col(f"_want_{f}").isNull() | F.col(f"_has_{f}").eqNullSafe(F.col(f"_want_{f}")))
        return rows.join(checked_broadcast(wants), q, "left").join(has.hint("shuffle_hash"), c, "left").filter(fits).select(*rows.columns)

    return keep


def rrf(lists: DataFrame, k: int = 60, limit: int = 10, q: str = "query_id", c: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of several ranked lists (rows q, c, rank)."""
    fused = lists.groupBy(q, c).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return top(fused, [q], [F.desc(F.round("score", 9)), F.col(c)], limit)


def anchor_boost(title: Column, number: Column, filename: Column, text: Column) -> Column:
    """0.30 if a quoted title is in the file name, else 0.20 if a document number is in name or text."""
    held = lambda a, b: F.coalesce((a != "") & F.contains(b, a), F.lit(False))
    return F.when(held(title, filename), 0.30).when(held(number, filename) | held(number, text), 0.20).otherwise(0.0)


def merge_variants(hits: DataFrame, q: str = "question_id", c: str = "chunk_id") -> DataFrame:
    """Per question and chunk the best score + boost, and all hits ordered by query and rank."""
    return hits.groupBy(q, c).agg(F.max(F.col("score") + F.col("boost")).alias("best"), F.array_sort(F.collect_list(F.struct("query_id", "rank", "score", "boost"))).alias("hits"))


def weighted_rrf(hits: DataFrame, q: str = "question_id", c: str = "chunk_id", constant: int = 60) -> DataFrame:
    """Sum over variants of weight / (60 + rank)."""
    weights = F.create_map(*[F.lit(x) for kv in VARIANT_WEIGHTS.items() for x in kv])
    weight = F.coalesce(weights[F.col("variant")], F.lit(1.0))
    return hits.groupBy(q, c).agg(F.sum(weight / (constant + F.col("rank"))).alias("fused"))


def active_only(candidates: DataFrame, docs: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Candidates of indexed, current documents; ledger columns replace the copies."""
    ok = F.col("indexed") & (F.lit(include_inactive) | ~F.coalesce("status", F.lit("unknown")).isin("repealed", "superseded"))
    return candidates.join(docs.filter(ok), "document_id")


def filter_metadata(candidates: DataFrame, filters: DataFrame, q: str = "query_id", c: str = "chunk_id") -> DataFrame:
    """Candidates that meet all of their query's filters (q, field, mode, wanted) on the map column metadata.

    mode is exact or contains; a query without filters keeps everything.
    """
    asked = filters.groupBy(q).agg(F.collect_list(F.struct("field", "mode", "wanted")).alias("_asked"))  # a query has few filters
    hit = lambda f, v: F.when(f["mode"] == "exact", v == f["wanted"]).otherwise(F.contains(F.lower(v), F.lower(f["wanted"])))
    fits = F.forall("_asked", lambda f: F.coalesce(hit(f, F.try_element_at("metadata", f["field"])), F.lit(False)))
    return candidates.join(checked_broadcast(asked), q, "left").filter(F.coalesce(fits, F.lit(True))).drop("_asked")


#: Which of a candidate's fields answer a filter, and the filters that ask for equality.
FILTERED_FIELDS = {
    "source_title": ("title", "source_title", "filename"), "filename": ("source_filename", "filename"), "external_doc_id": ("external_doc_id",), "issuing_authority": ("issuing_authority",), "publication_date": ("publication_date",),
    "document_number": ("document_number",), "regulatory_topic": ("regulatory_topic",), "business_domain": ("business_domain",), "article_number": ("article_number", "section_number"), "version_status": ("version_status",), "file_type": ("source_format", "file_type"),
}
EQUAL_FIELDS = ("publication_date", "version_status", "external_doc_id", "file_type")
#: Words that titles and questions write differently, replaced in this order.
SAME_WORDS = (("同一个", "同一"), ("怎样", "怎么"), ("如何", "怎么"), ("应该", ""), ("应当", ""), ("怎么", ""), ("什么", ""))


def match_form(text: Column) -> Column:
    """A text for matching names: without white space, underscores, dashes, slashes and edition marks after a year."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s_\-/]+", ""), r"(\d{4}年)版", "$1")
    for old, new in SAME_WORDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def filter_by_fields(candidates: DataFrame, filters: DataFrame, q: str = "query_id", c: str = "chunk_id") -> DataFrame:
    """Candidates that answer all of their query's filters (q, field, wanted) by any of the field's names.

    candidates: q, c, metadata (map), filename, section_number. Dates, states, numbers given
    by the ledger and file types have to be equal, others hold what is wanted, both in match
    form. Unknown fields and blank filters ask for nothing; a field that is null answers none.
    """
    names = F.create_map(*[x for k, v in FILTERED_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = filters.filter(F.col("field").isin(*FILTERED_FIELDS) & (F.coalesce("wanted", F.lit("")) != "")).select(q, "field", match_form(F.col("wanted")).alias("_w"), names[F.col("field")].alias("_names")).distinct()
    of = F.map_concat(F.coalesce(F.map_filter("metadata", lambda k, v: ~k.isin("filename", "section_number")), F.create_map().cast("map<string,string>")), F.create_map(F.lit("filename"), F.col("filename"), F.lit("section_number"), F.col("section_number")))
    needed = asked.groupBy(q).agg(F.collect_list(F.struct("field", "_w", "_names")).alias("_asked"))  # a filter has a dozen fields at most
    rows = candidates.withColumn("_of", of).join(needed, q, "left")
    value = lambda n: F.try_element_at("_of", n)
    fits = lambda f, v: F.when(f["field"].isin(*EQUAL_FIELDS), match_form(v) == f["_w"]).otherwise(F.contains(match_form(v), f["_w"]))
    ok = F.forall("_asked", lambda f: F.exists(f["_names"], lambda n: F.coalesce((value(n) != "") & fits(f, value(n)), F.lit(False))))
    return rows.filter(F.coalesce(ok, F.lit(True))).drop("_of", "_asked")


def limit_with_coverage(candidates: DataFrame, n: int, q: str = "query_id", d: str = "document_id", rank: str = "rank") -> DataFrame:
    """The top row of every document in rank order, then the rest by rank, n in all."""
    first = F.row_number().over(W.partitionBy(q, d).orderBy(rank))
    late = F.col(d).isNull() | (F.col("_first") > 1)
    place = F.row_number().over(W.partitionBy(q).orderBy(late, rank))
    small = F.count("*").over(W.partitionBy(q)) <= n
    order = F.when(F.col("_small"), F.row_number().over(W.partitionBy(q).orderBy(rank))).otherwise(place)
    out = candidates.withColumn("_first", first).withColumn("_small", small).withColumn("selected_rank", order)
    return out.filter(F.col("selected_rank") <= n).drop("_first", "_small")


def order_candidates(candidates: DataFrame, q: str = "query_id", c: str = "chunk_id") -> DataFrame:
    """Rank by fused score, score + boost, preferred type, inferred, statement and fit score."""
    keys = [F.desc("fused"), F.desc(F.col("score") + F.col("boost")), F.desc("preferred"), F.desc("inferred"), F.desc("statement"), F.desc("fit"), F.col(c)]
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy(*keys)))


def rerank(candidates: DataFrame, k: int, question: str = "question", text: str = "text", least: float = 0.30, q: str = "query_id", c: str = "chunk_id", scorer=bigram_support) -> DataFrame:
    """Scores (question, text) pairs and keeps the k best of at least the least score."""
    scored = candidates.withColumn("rerank_score", scorer(F.col(question), F.col(text))).filter(F.col("rerank_score") >= least)
    return top(scored, [q], [F.desc("rerank_score"), F.col(c)], k, "rerank_rank")


def evidence_role(chunk_type: Column, score: Column, coverage: Column, asks_table: Column, compares: Column) -> Column:
    """Direct, table_evidence, table_context or related."""
    table = chunk_type == "table"
    return (
        F.when(~table & (score >= 0.55), "direct")
        .when(table & (asks_table | compares | (coverage >= 0.25)), "table_evidence")
        .when(table, "table_context")
        .when(coverage >= 0.45, "direct")
        .otherwise("related")
    )


def select_final(candidates: DataFrame, n: int = 12, q: str = "query_id", c: str = "chunk_id") -> DataFrame:
    """By role weight, coverage and rerank score, then D19."""
    weights = F.create_map(*[F.lit(x) for kv in ROLE_WEIGHTS.items() for x in kv])
    order = W.partitionBy(q).orderBy(F.desc(F.coalesce(weights[F.col("role")], F.lit(0))), F.desc("coverage"), F.desc("rerank_score"), c)
    return limit_with_coverage(candidates.withColumn("rank", F.row_number().over(order)), n, q)


def diagnostics(candidates: DataFrame, q: str = "query_id") -> DataFrame:
    """Counts and score ranges per query and stage, rounded to four places."""
    ends = [F.round(f(s), 4).alias(f"{n}_{s}") for s in ("score", "rerank_score") for n, f in (("min", F.min), ("max", F.max))]
    return candidates.groupBy(q, "stage").agg(F.count("*").alias("n"), *ends)


def governing_lead(chunks: DataFrame, doc: str, pos: str, modal: Column, back: int = 8) -> DataFrame:
    """For every chunk the nearest of the last `back` chunks that governs it."""
    w = W.partitionBy(doc).orderBy(pos).rowsBetween(-back, -1)
    return chunks.withColumn("lead_pos", F.last(F.when(modal, F.col(pos)), ignorenulls=True).over(w))


#: How a place of the same document is referred to, by kind.
REFERENCES = {"article": rf"第\s*{NUMERAL}\s*条", "page": rf"第\s*{NUMERAL}\s*页", "table": rf"(?:附表|表)\s*{NUMERAL}", "annex": rf"(?:附件|附录)\s*{NUMERAL}", "figure": rf"图\s*{NUMERAL}"}
NEARBY = {"table": "[上下]表", "figure": "[上下]图", "context": "[上下]文"}


def recognize_references(chunks: DataFrame, c: str = "chunk_id", text: str = "text", limit: int = 6) -> DataFrame:
    """References inside the same document in the order of the text: 第X条, 第X页, 表X, 附件X, 图X, and 上表, 下图, 下文; names in 《》 are masked.

    number is null for the latter, direction (previous or next) for the others; a page right
    before a table, figure or annex is given with it. Distinct, at most limit per chunk.
    """
    masked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"《[^》]*》(?:第{NUMERAL}条)?", " ")
    page = REFERENCES["page"]
    placed = "|".join(REFERENCES[k] for k in ("table", "annex", "figure"))
    found = F.regexp_extract_all(masked, F.lit("|".join([f"{page}\\s*(?:{placed})", *NEARBY.values(), *REFERENCES.values()])), F.lit(0))
    rows = chunks.select(c, F.posexplode(F.slice(F.array_distinct(found), 1, limit)).alias("pos", "_m"))
    on_page = F.regexp_extract("_m", f"^({page})\\s*(?:{placed})", 1)
    rows = rows.withColumn("_page", on_page).withColumn("_m", F.when(on_page != "", F.regexp_replace("_m", f"^{page}\\s*", "")).otherwise(F.col("_m")))
    near = F.coalesce(*[F.when(F.col("_m").rlike(f"^{p}$"), F.lit(k)) for k, p in NEARBY.items()])
    kind = F.coalesce(near, *[F.when(F.col("_m").rlike(f"^{p}$"), F.lit(k)) for k, p in REFERENCES.items()])
    digits = lambda m: numeral(F.nullif(F.regexp_extract(m, NUMERAL, 0), F.lit("")))
    way = F.when(near.isNotNull(), F.when(F.startswith("_m", F.lit("上")), "previous").otherwise("next"))
    return rows.select(c, "pos", kind.alias("kind"), digits(F.col("_m")).alias("number"), digits(F.col("_page")).alias("page"), way.alias("direction"))


def dedupe_evidence(evidence: DataFrame, q: str = "query_id") -> DataFrame:
    """Best role per document and evidence id, then the first per document and text; ranks renewed."""
    role = F.desc("role_weight")
    one = evidence.withColumn("_a", F.row_number().over(W.partitionBy(q, "document_id", "evidence_id").orderBy(role, "rank"))).filter("_a = 1")
    norm = F.lower(F.regexp_replace("text", r"\s+", ""))
    two = one.withColumn("_b", F.row_number().over(W.partitionBy(q, "document_id", norm).orderBy("rank"))).filter("_b = 1")
    return two.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy("rank"))).drop("_a", "_b")


def select_evidence(evidence: DataFrame, limit: int = 12, q: str = "query_id", r: str = "requirement_id", c: str = "chunk_id") -> DataFrame:
    """Per requirement scores of at least max(0.45, 0.55 best) or protected rows; round robin, mandatory first."""
    best = F.max("score").over(W.partitionBy(q, r))
    kept = evidence.withColumn("_best", best).filter(F.col("protected") | (F.col("score") >= F.greatest(F.lit(0.45), 0.55 * F.col("_best"))))
    turn = kept.withColumn("_turn", F.row_number().over(W.partitionBy(q, r).orderBy(F.desc("score"), c)))
    order = [F.desc("mandatory"), F.col("_turn"), F.col(r), F.col(c)]
    once = turn.withColumn("_n", F.row_number().over(W.partitionBy(q, c).orderBy(*order))).filter("_n = 1")
    return top(once, [q], order, limit, "pick").drop("_best", "_turn", "_n")


def token_budget(evidence: DataFrame, n: int = 3600, q: str = "query_id", rank: str = "rank", tokens: str = "tokens", exempt: str | None = None) -> DataFrame:
    """In order, every block that still fits; the first always; exempt blocks cost nothing.

    A fold over each query's ordered blocks (an earlier step bounds them), not a running
    sum: a block that does not fit may be followed by one that does.
    """
    free = F.col(exempt) if exempt else F.lit(False)
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.when(free, 0).otherwise(F.col(tokens)).cast("long").alias("n"), free.alias("x"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, b: Column) -> Column:
        fits = b["x"] | (F.size(a["kept"]) == 0) | (a["used"] + b["n"] <= n)
        return F.when(fits, F.struct((a["used"] + b["n"]).alias("used"), F.concat(a["kept"], F.array(b["r"].cast("int"))).alias("kept"))).otherwise(a)

    kept = evidence.groupBy(q).agg(rows.alias("_rows")).select(q, F.explode(F.aggregate("_rows", start, step, lambda a: a["kept"])).alias(rank))
    return evidence.join(kept, [q, rank], "left_semi")


def drop_reasons(recalled: DataFrame, stages: list[tuple[str, DataFrame]], q: str = "query_id", c: str = "chunk_id") -> DataFrame:
    """Recalled rows that did not stay, each with the reason of the first stage it misses."""
    out = recalled.select(q, c)
    for i, (_, kept) in enumerate(stages):
        out = out.join(kept.select(q, c, F.lit(True).alias(f"_{i}")).distinct(), [q, c], "left")
    reason = F.coalesce(*[F.when(F.col(f"_{i}").isNull(), F.lit(name)) for i, (name, _) in enumerate(stages)])
    return out.select(q, c, reason.alias("reason")).filter("reason is not null")


def neighbour_expansion(hits: DataFrame, chunks: DataFrame, doc: str, pos: str, reach: int = 1, q: str = "query_id") -> DataFrame:
    """The chunks up to `reach` places before and behind each hit, without the hits."""
    near = hits.select(q, doc, F.explode(F.array(*[F.col(pos) + d for d in range(-reach, reach + 1) if d])).alias(pos)).distinct()
    near = near.join(hits.select(q, doc, pos), [q, doc, pos], "left_anti")
    return near.join(chunks, [doc, pos])


def inferred_score(candidates: DataFrame, filters: DataFrame, q: str = "query_id", c: str = "chunk_id") -> DataFrame:
    """Matched share of the filters that a candidate has a value for."""
    long = candidates.select(q, c, F.explode("metadata").alias("field", "value")).filter("value is not null")
    hit = F.contains(F.lower("value"), F.lower("wanted"))
    return long.join(filters, [q, "field"]).groupBy(q, c).agg(F.avg(hit.cast("double")).alias("inferred"))


def chunk_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("tokens", token_count(F.col(text)))
