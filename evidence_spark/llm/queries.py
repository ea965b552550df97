"""The thin opN_ queries and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, fingerprints, jaccard, language, lm, mixing, packing, tokens, topk, toxicity, warc, whiten
from .common import small_batches, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL_OP1 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, coalesce(sum(3 * source_size) OVER p, 0) AS caps, coalesce(sum(w) OVER p, 0) AS ws,
        sum(source_size) OVER () AS t, sum(w) OVER () AS tw FROM s
      WINDOW p AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((t - caps)::DOUBLE / (tw - ws)::DOUBLE) AS lev FROM r),
g AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, lev * w) AS target FROM r, l),
j AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM j
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnRenamed("_id", "doc_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    chain = language.fit(docs.filter(~held_out))
    out = language.predict(docs, chain).withColumnRenamed("_id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    read = warc.read_archives(listed, keep_payload=False)
    read = read.withColumn("_checked", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(True)))
    ident = F.when(F.col("record_id") != "null", F.col("record_id").cast("long"))
    return read.filter("_checked").select(ident.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
b AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS f,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(s, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS d FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM b
"""


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    out = topk.exact_topk(rows, rows.filter("vec_id % 50 = 0"))
    return out.withColumnRenamed("id", "vec_id")


SQL_OP5 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.OrdinalModel:
    grades = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.col("toxic").alias("grade"))
    return toxicity.fit(docs, grades)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity_model(spark, docs, sf_dir)).withColumnRenamed("_id", "doc_id")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    target = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("_id"))
    return lm.score(docs, lm.fit(docs, target)).withColumnRenamed("_id", "doc_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.link_components(table(spark, sf_dir, "documents"), width=3, percent=90)
    return out.withColumnRenamed("_id", "doc_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e, n = F.col("_sketch"), F.col("_edited_sketch"), F.col("_next_sketch")
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), "n_chars", "edited_sha256",
        fingerprints.to_text(s).alias("fingerprint"), fingerprints.to_text(e).alias("edited_fingerprint"),
        fingerprints.resemblance(s, e).alias("near_edited"), fingerprints.resemblance(s, n).alias("near_next"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(F.col("_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compress(table(spark, sf_dir, "embeddings"))
    out = codes.with_label_errors(rows.select(F.col("_id").alias("vec_id"), "label", codes.code_text(F.col("codes")).alias("code"), "error"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def _sql_op12() -> str:
    """Seven assignments and six refits of all parts, one common table expression each."""
    apart = "list_sum(list_transform(list_zip(s.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = ["""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
s AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS v FROM e, (SELECT unnest(range(8)) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, v FROM s WHERE r <= 16)"""]  # fmt: skip
    for i in range(7):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, k, d, v FROM (SELECT s.r, s.p, b.k, s.v, {apart} AS d FROM s JOIN b{i} b ON s.p = b.p)
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, k) = 1)""")  # fmt: skip
        if i < 6:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT p, k, list(x ORDER BY j) AS v FROM (SELECT p, k, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
  FROM (SELECT p, k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY p, k, j) GROUP BY p, k),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.k = m.k)""")  # fmt: skip
    return "WITH " + ",\n".join(steps) + """,
c AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY r),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM (SELECT p, k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM b6))
SELECT e.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY e.label))::BIGINT AS label_error, h.codebooks_sha256 FROM e JOIN c ON e.r = c.r, h
"""


SQL_OP12 = _sql_op12()


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("_id", "vec_id")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_warc": op4_warc,
    "op5_topk": op5_topk,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_lm_scores": op8_lm_scores,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_fingerprints": op10_fingerprints,
    "op11_bpe": op11_bpe,
    "op12_codes": op12_codes,
    "op13_whiten": op13_whiten,
}
SQL = {
    "op1_mixing": SQL_OP1,
    "op4_warc": SQL_OP4,
    "op5_topk": SQL_OP5,
    "op12_codes": SQL_OP12,
}
