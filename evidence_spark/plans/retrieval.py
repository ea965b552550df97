"""Queries for chunking, retrieval and evidence selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evaluation, gold, search
from ..operators.joins import checked_broadcast, contained, dealt
from ..operators.lineage import kept
from ..sources import documents as readers
from .tables import table

QUERIES, SQL = {}, {}
#: Chunks that a task scores against all questions.
TASK_CHUNKS = 2_048
UNIT_SQL = r"regexp_extract_all(text, '[一-鿿]|[a-zA-Z0-9_]+|[^\s]')"
WORDS_SQL = r"regexp_extract_all(lower({}), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CHUNKS_SQL = f"""
t AS (SELECT doc_id, {UNIT_SQL} AS u FROM documents),
p AS (SELECT doc_id, (s // 720)::INTEGER AS pos, u[s + 1 : s + CASE WHEN s = 0 THEN 800 ELSE 794 END] AS w FROM t, unnest(range(0, len(u), 720)) AS r(s)),
ch AS (SELECT doc_id, pos, format('{{}}-{{:06d}}', doc_id, pos + 1) AS chunk_id, len(w)::INTEGER AS units,
       CASE WHEN pos > 0 THEN '（承接上文）' ELSE '' END || array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND regexp_full_match(x, '[a-zA-Z0-9_]+') AND regexp_full_match(w[i - 1], '[a-zA-Z0-9_]+') THEN ' ' || x ELSE x END), '') AS piece FROM p)
"""


def chunks_of(docs: DataFrame) -> DataFrame:
    return chunking.link_chunks(chunking.split_windows(docs.select("doc_id", "text")).drop("text"), "doc_id")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(table(spark, d, "documents"))


@query("token_counts_units", f"SELECT doc_id, coalesce(len({UNIT_SQL}), 0)::INTEGER AS tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("chunk_windows", f"""WITH {CHUNKS_SQL} SELECT doc_id, pos, chunk_id, units, md5(piece) AS piece_md5,
  lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")  # fmt: skip
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", "pos", "chunk_id", "units", F.md5("piece").alias("piece_md5"), "prev_id", "next_id")


@query("sentences", r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '(?s).+?(?:[。！？!?；;：:]|$)'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS sentence FROM documents)
SELECT doc_id, count(*) AS sentences, max(length(sentence))::INTEGER AS longest FROM s GROUP BY doc_id""")  # fmt: skip
def sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.split_sentences(table(spark, d, "documents").select("doc_id", "text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.char_length("sentence")).alias("longest"))


@query("packed_sentences")
def packed_sentences(spark: SparkSession, d: str) -> DataFrame:
    units = chunking.split_sentences(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "pos", "sentence")
    packed = chunking.pack_units(units, "doc_id", "pos", "sentence")
    over = chunking.add_overlap(packed, "doc_id")
    return over.select("doc_id", "pos", "units", F.char_length("piece").alias("chars"), F.char_length("overlapped").alias("chars_overlapped"))


@query("html_page_blocks")
def html_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return readers.html_blocks(table(spark, d, "pages"))


@query("text_blocks", r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, trim(line, ' ') AS t FROM l),
m AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^#{1,6}\s+\S') AND length(t) <= 120 THEN 'heading'
  WHEN contains(t, '|') AND len(list_filter(string_split(t, '|'), lambda c: trim(c, ' ') <> '')) >= 2 THEN 'table' ELSE 'paragraph' END AS kind FROM k),
f AS (SELECT *, CASE WHEN kind = 'heading' OR kind <> coalesce(lag(kind) OVER w, '') THEN 1 ELSE 0 END AS b FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, kind AS block_type, sum(b)::BIGINT AS blocks FROM f WHERE kind <> 'blank' GROUP BY ALL""")  # fmt: skip
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return readers.to_blocks(table(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id", "block_type").agg(F.count("*").alias("blocks"))


@query("term_postings", f"""WITH {CHUNKS_SQL}, w AS (SELECT chunk_id, unnest({WORDS_SQL.format('piece')}) AS token FROM ch)
SELECT token, count(DISTINCT chunk_id) AS chunks, round(sum(wt), 6) AS weight FROM (SELECT chunk_id, token, 1 + ln(count(*)) AS wt FROM w GROUP BY ALL) GROUP BY token""")  # fmt: skip
def term_postings(spark: SparkSession, d: str) -> DataFrame:
    """Documents are dealt so many to a task, which cuts them and counts the words of each chunk."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id", rows=TASK_CHUNKS)
    post = chunking.postings(chunks_of(docs), ["doc_id", "chunk_id"], F.col("piece"))
    return post.groupBy("token").agg(F.count("*").alias("chunks"), F.round(F.sum("weight"), 6).alias("weight"))


SPARSE_SQL = f"""{CHUNKS_SQL},
pw AS (SELECT chunk_id, token, 1 + ln(count(*)) AS w FROM (SELECT chunk_id, unnest({WORDS_SQL.format('piece')}) AS token FROM ch) GROUP BY ALL),
qw AS (SELECT item_id AS query_id, token, 1 + ln(count(*)) AS w FROM (SELECT item_id, unnest({WORDS_SQL.format('text')}) AS token FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, sum(pw.w * qw.w) AS score FROM pw JOIN qw USING (token) GROUP BY ALL),
rk AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id))::INTEGER AS rank FROM sc)
"""


def piece_postings(ch: DataFrame, q: DataFrame) -> DataFrame:
    """Postings of written chunks for the words that questions have, so many chunks to a task."""
    return chunking.postings(ch.repartition(max(1, -(-ch.count() // TASK_CHUNKS)), "chunk_id"), "chunk_id", F.col("piece"), only=q)


def sparse_hits(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    ch = kept(chunks(spark, d))
    q = kept(chunking.postings(table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", F.col("text")))
    return search.sparse_topk(q, piece_postings(ch, q), k), ch


@query("sparse_topk", f"WITH {SPARSE_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse_hits(spark, d, 10)[0].withColumn("score", F.round("score", 6))


@query("retrieval_recall", f"""WITH {SPARSE_SQL},
dc AS (SELECT query_id, chunk_id, rank, split_part(chunk_id, '-', 1)::BIGINT AS document_id FROM rk WHERE rank <= 10),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS f, count(*) OVER (PARTITION BY query_id) AS n FROM dc),
sl AS (SELECT *, CASE WHEN n <= 5 THEN row_number() OVER (PARTITION BY query_id ORDER BY rank) ELSE row_number() OVER (PARTITION BY query_id ORDER BY f > 1, rank) END AS sr FROM fr),
gd AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
hr AS (SELECT g.query_id, min(s.sr) AS best FROM (SELECT DISTINCT query_id FROM gd) g LEFT JOIN (SELECT sl.query_id, sl.sr FROM sl JOIN gd ON sl.query_id = gd.query_id AND sl.document_id = gd.doc_id WHERE sl.sr <= 5) s USING (query_id) GROUP BY ALL)
SELECT count(*) AS cases, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3,
  round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN best <= 10 THEN 1.0 / best ELSE 0.0 END), 6) AS mrr_at_10,
  round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END), 6) AS aspect_recall_at_5 FROM hr""")  # fmt: skip
def retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    """Passages as questions over chunk windows: sparse top-k, document coverage, recall against gold found in the corpus."""
    hits, _ = sparse_hits(spark, d, 10)
    document = F.substring_index("chunk_id", "-", 1).cast("long").alias("document_id")  # as link_chunks names chunks
    ranked = search.limit_with_coverage(hits.select("*", document), 5)
    ranked = ranked.select(F.col("query_id").alias("case_id"), F.lit(0).alias("aspect_id"), "chunk_id", F.col("selected_rank").alias("rank"), "document_id")
    found = gold_documents(table(spark, d, "benchmark"), table(spark, d, "documents")).select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("document_id"))
    wanted = ranked.join(found, ["case_id", "document_id"]).select("case_id", "aspect_id", "chunk_id")
    gold = found.select("case_id", F.lit(0).alias("aspect_id")).distinct()
    return evaluation.retrieval_metrics(evaluation.hit_ranks(ranked.drop("document_id"), gold, wanted=wanted))


def shingle_keys(text: F.Column, width: int, skip: int = 0) -> F.Column:
    """Distinct hashes of every `width` neighbouring words; a shorter text has none."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    runs = lambda w: F.transform(F.sequence(F.lit(skip), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    return F.array_distinct(T.let(words, lambda w: F.when(F.size(w) >= width + skip, runs(w)).otherwise(F.array().cast("array<bigint>"))))


def gold_documents(items: DataFrame, docs: DataFrame, probe: int = 5) -> DataFrame:
    """(item_id, doc_id) where a document holds the passage; probed by five words, then verified.

    The first word may be glued to what stands before it and the last to what follows, so the
    probe is the passage's rarest run of words inside; passages of fewer words are looked for
    by their rarest run of characters.
    """
    cut = items.select("item_id", F.col("text").alias("passage"), F.regexp_replace("text", r"[^\x20\x09-\x0D]+$", "").alias("_inner"))
    keys = cut.select("item_id", F.explode(shingle_keys(F.col("_inner"), probe, 1)).alias("_p"))
    held = kept(docs.select("doc_id", F.explode(shingle_keys(F.col("text"), probe)).alias("_p")).join(checked_broadcast(keys.select("_p").distinct()), "_p", "left_semi"))
    often = held.groupBy("_p").agg(F.count("*").alias("_n"))
    rarest = keys.join(often, "_p", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_p")).alias("r"))
    probes = held.join(rarest.filter("r.n > 0").select("item_id", F.col("r._p").alias("_p")), "_p").select("doc_id", "item_id")
    passages = cut.select("item_id", "passage")
    long = probes.join(docs.select("doc_id", "text"), "doc_id").join(passages, "item_id").filter(F.contains("text", "passage")).select("item_id", "doc_id")
    short = passages.join(keys.select("item_id").distinct(), "item_id", "left_anti")
    return long.unionByName(contained(short, "passage", docs.select("doc_id", "text"), "text").select("item_id", "doc_id"))


@query("gold_documents", "SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_documents_query(spark: SparkSession, d: str) -> DataFrame:
    return gold_documents(table(spark, d, "benchmark"), table(spark, d, "documents")).distinct()


PLAIN_SQL = r"""regexp_replace(regexp_replace(translate(lower(coalesce({}, '')), '《》', ''), '\.(?:pdf|docx?|xlsx?|xls|csv|txt|md)$', '', 'g'), '[\s·•、，,。.;；:：()（）"''“”‘’\-_/\\]+', '', 'g')"""


def altered(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"\S+$", "gone")


@query("near_passages", f"""WITH p AS (SELECT item_id AS aspect_id, item_id AS doc, {PLAIN_SQL.format(r"regexp_replace(text, '[^ \t\n\r\f\v]+$', 'gone')")} AS p FROM benchmark),
c AS (SELECT doc_id, {PLAIN_SQL.format('text')} AS c FROM documents),
w AS (SELECT *, CASE WHEN length(p) > 8 THEN list_transform(range(4), lambda i: substr(p, i * greatest(1, (length(p) - 8) // 3) + 1, 8)) ELSE [p] END AS w, list_distinct(list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) AS g FROM p WHERE p <> ''),
m AS (SELECT aspect_id, doc_id, c, g FROM w JOIN c ON c.c <> '' AND (contains(c, w[1]) OR contains(c, w[2]) OR contains(c, w[3]) OR contains(c, w[4]))),
a AS (SELECT aspect_id, doc_id FROM m WHERE len(list_intersect(g, list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))))) >= 0.7 * len(g) AND len(g) > 0),
n AS (SELECT aspect_id, doc_id FROM w JOIN c ON c.doc_id = w.doc AND c.c <> '' WHERE aspect_id NOT IN (SELECT aspect_id FROM a) AND (contains(c, p) OR contains(p, c) AND length(c) >= 20
  OR len(g) > 0 AND len(list_intersect(g, list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))))) >= 0.55 * len(g)))
SELECT aspect_id, doc_id AS chunk_id, 'anywhere' AS scope FROM a UNION ALL SELECT aspect_id, doc_id, 'named' FROM n""")  # fmt: skip
def near_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose last word was changed, over all documents; the document of a passage's own number is the named one."""
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("aspect_id"), F.col("item_id").alias("document_id"), altered(F.col("text")).alias("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text")
    return gold.passage_chunks(passages, docs)


@query("gold_cells", """WITH r AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey % 2 AS s, l_orderkey % 3 AS kind FROM lineitem),
e AS (SELECT DISTINCT o, kind, o % 7 + 1 AS want FROM r),
h AS (SELECT e.o, e.want, bool_or(s = 0) AS some FROM e JOIN r ON e.o = r.o AND r.n = e.want WHERE e.kind > 0 GROUP BY ALL)
SELECT DISTINCT e.o AS case_id, 'cell:A' || e.want AS aspect_id, r.o || '-' || r.n || '-' || r.s AS chunk_id FROM e LEFT JOIN h ON h.o = e.o LEFT JOIN r ON r.o = e.o AND r.n = e.want AND (r.s = 0 OR NOT h.some) WHERE e.kind > 0
UNION ALL SELECT DISTINCT e.o, 'value:7' || e.want, r.o || '-' || r.n || '-' || r.s FROM e LEFT JOIN r ON r.o = e.o AND contains('7' || r.n || '亿', '7' || e.want) WHERE e.kind = 0""")  # fmt: skip
def gold_cells(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, lines as cells of two sheets; two orders of three name a cell, the third a value."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(o.alias("document_id"), n.alias("n"), (F.col("l_partkey") % 2).alias("s")).distinct()
    rows = rows.withColumn("chunk_id", F.concat_ws("-", F.col("document_id").cast("string"), F.col("n").cast("string"), F.col("s").cast("string")))
    cells = rows.select("document_id", F.concat(F.lit("Sheet "), F.col("s").cast("string")).alias("sheet"), F.concat(F.lit("A"), F.col("n").cast("string")).alias("coordinate"), "chunk_id")
    want = (o % 7 + 1).cast("string")
    text = F.when(o % 3 > 0, F.concat(F.lit("工作表：Sheet 0；A"), want)).otherwise(F.concat(F.lit("合计=7"), want))
    asked = table(spark, d, "lineitem").select(o.alias("case_id"), o.alias("document_id"), text.alias("text")).distinct()
    return gold.cell_chunks(asked, cells, rows.select("document_id", "chunk_id", F.concat(F.lit("7"), F.col("n").cast("string"), F.lit("亿")).alias("text")))


@query("filtered_search", f"""WITH {SPARSE_SQL}, m AS (SELECT DISTINCT chunk_id, ch.doc_id, 2020 + ch.doc_id % 3 AS year, lang FROM ch JOIN documents USING (doc_id)),
f AS (SELECT query_id, chunk_id, score FROM sc JOIN m USING (chunk_id) WHERE (query_id % 4 = 3 OR year = 2020 + query_id % 3) AND (query_id % 2 = 1 OR lang = 'en') AND (query_id % 5 > 0 OR doc_id IN (query_id, query_id + 1, query_id * 2)))
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id))::INTEGER AS rank FROM f) WHERE rank <= 10""")  # fmt: skip
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Passages as questions, each held to a year, every second to a language, every fifth to three documents."""
    ch = kept(chunks(spark, d))
    i = F.col("item_id")
    asked = table(spark, d, "benchmark")
    filters = asked.select(
        i.alias("query_id"), F.when(i % 5 == 0, F.array(i.cast("string"), (i + 1).cast("string"), (i * 2).cast("string"))).alias("document_ids"), F.when(i % 4 != 3, 2020 + i % 3).alias("year"), F.when(i % 2 == 0, "en").alias("version_status"),
    )
    about = ch.select("chunk_id", "doc_id").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    about = about.select("chunk_id", F.col("doc_id").alias("document_id"), (2020 + F.col("doc_id") % 3).alias("year"), F.col("lang").alias("version_status")).dropDuplicates(["chunk_id"])
    q = kept(chunking.postings(asked.withColumnRenamed("item_id", "query_id"), "query_id", F.col("text")))
    out = search.sparse_topk(q, piece_postings(ch, q), 10, allow=search.filtered(filters, about))
    return out.withColumn("score", F.round("score", 6))


DENSE_SQL = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ds AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label AS document_id, list_dot_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0),
dk AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id))::INTEGER AS rank FROM ds)
"""


def dense_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return search.dense_topk(v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), v, k)


@query("dense_topk", f"WITH {DENSE_SQL} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM dk WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense_hits(spark, d, 10).withColumn("score", F.round("score", 5))


@query("cosine_neighbours", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("document_coverage", f"""WITH {DENSE_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS f FROM dk WHERE rank <= 40)
SELECT query_id, chunk_id, document_id, selected_rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY f > 1, rank))::INTEGER AS selected_rank FROM c) WHERE selected_rank <= 12""")  # fmt: skip
def document_coverage(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"))
    out = search.limit_with_coverage(dense_hits(spark, d, 40).join(labels, "chunk_id"), 12)
    return out.select("query_id", "chunk_id", "document_id", "selected_rank")


@query("rrf_fusion", f"""WITH {DENSE_SQL}, n AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY abs(query_id - chunk_id), chunk_id))::INTEGER AS rank FROM ds),
f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM dk WHERE rank <= 20 UNION ALL SELECT * FROM n WHERE rank <= 20) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id))::INTEGER AS rank FROM f) WHERE rank <= 10""")  # fmt: skip
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    near = ids.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"))
    around = near.withColumn("chunk_id", F.explode(F.sequence(F.col("query_id") - 20, F.col("query_id") + 20))).join(ids, "chunk_id")
    around = search.top(around, ["query_id"], [F.abs(F.col("query_id") - F.col("chunk_id")), F.col("chunk_id")], 20)
    lists = dense_hits(spark, d, 20).select("query_id", "chunk_id", "rank").unionByName(around.select("query_id", "chunk_id", "rank"))
    return search.rrf(lists).withColumn("score", F.round("score", 9))


LINES_SQL = """l AS (SELECT l_suppkey AS question_id, l_partkey AS chunk_id, l_linenumber AS query_id, max(l_extendedprice) AS score, max(l_discount) AS boost FROM lineitem GROUP BY ALL),
h AS (SELECT *, (row_number() OVER (PARTITION BY question_id, query_id ORDER BY score DESC, chunk_id))::INTEGER AS rank,
  CASE query_id WHEN 1 THEN 'semantic' WHEN 2 THEN 'statement' WHEN 3 THEN 'table' WHEN 4 THEN 'keyword' WHEN 5 THEN 'legacy' ELSE 'fallback' END AS variant FROM l)"""


def variant_hits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as search hits: supplier asks, line number is the query variant, part is the chunk."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("question_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("query_id")).agg(F.max("l_extendedprice").alias("score"), F.max("l_discount").alias("boost"))
    names = F.array(*[F.lit(v) for v in ("semantic", "statement", "table", "keyword", "legacy")])
    rows = rows.withColumn("variant", F.coalesce(F.try_element_at(names, F.col("query_id")), F.lit("fallback")))
    return search.top(rows, ["question_id", "query_id"], [F.desc("score"), F.col("chunk_id")], 2**31 - 1)


@query("merge_variants", f"WITH {LINES_SQL} SELECT question_id, chunk_id, max(score + boost) AS best, count(*) AS hits, min(rank) AS best_rank FROM h GROUP BY ALL")
def merge_variants(spark: SparkSession, d: str) -> DataFrame:
    out = search.merge_variants(variant_hits(spark, d))
    return out.select("question_id", "chunk_id", "best", F.size("hits").cast("long").alias("hits"), F.array_min(F.transform("hits", lambda h: h["rank"])).alias("best_rank"))


@query("weighted_rrf", f"""WITH {LINES_SQL} SELECT question_id, chunk_id, round(sum(CASE variant WHEN 'semantic' THEN 1.0 WHEN 'statement' THEN 1.15 WHEN 'table' THEN 1.2 WHEN 'keyword' THEN 0.75 WHEN 'legacy' THEN 0.9 ELSE 0.85 END::DOUBLE / (60 + rank)), 9) AS fused FROM h GROUP BY ALL""")
def weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    return search.weighted_rrf(variant_hits(spark, d)).withColumn("fused", F.round("fused", 9))


@query("active_candidates", """SELECT d.doc_id AS document_id, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0""")
def active_candidates(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("indexed"), F.when(F.col("toxic") == 1, "repealed").otherwise("current").alias("status"))
    return search.active_only(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source"), ledger).select("document_id", "source")


@query("metadata_filters", """WITH q AS (SELECT s.s_suppkey AS query_id, n.n_name, 'ECONOMY' AS typ FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)
SELECT DISTINCT q.query_id, l.l_partkey AS chunk_id FROM q JOIN lineitem l ON l.l_suppkey = q.query_id JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_type = q.typ AND contains(lower(p.p_name), 'ring')""")  # fmt: skip
def metadata_filters(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.create_map(F.lit("type"), "p_type", F.lit("name"), "p_name").alias("metadata"))
    cand = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("chunk_id")).distinct().join(part, "chunk_id")
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"))
    rules = F.array(F.struct(F.lit("type").alias("field"), F.lit("exact").alias("mode"), F.lit("ECONOMY").alias("wanted")), F.struct(F.lit("name").alias("field"), F.lit("contains").alias("mode"), F.lit("ring").alias("wanted")))
    filters = q.select("query_id", F.explode(rules).alias("r")).select("query_id", "r.*")
    return search.filter_metadata(cand, filters).select("query_id", "chunk_id")


@query("select_evidence", """WITH e AS (SELECT l_suppkey AS query_id, l_linenumber AS requirement_id, l_partkey AS chunk_id, max(l_discount) * 10 AS score, max(l_quantity) >= 50 AS protected, l_linenumber <= 3 AS mandatory FROM lineitem GROUP BY ALL),
k AS (SELECT *, max(score) OVER (PARTITION BY query_id, requirement_id) AS best FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, requirement_id ORDER BY score DESC, chunk_id) AS turn FROM k WHERE protected OR score >= greatest(0.45, 0.55 * best)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY mandatory DESC, turn, requirement_id) AS n FROM t)
SELECT query_id, requirement_id, chunk_id, pick FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY mandatory DESC, turn, requirement_id, chunk_id))::INTEGER AS pick FROM o WHERE n = 1) WHERE pick <= 12""")  # fmt: skip
def select_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_linenumber").alias("requirement_id"), F.col("l_partkey").alias("chunk_id")).agg((F.max("l_discount") * 10).alias("score"), (F.max("l_quantity") >= 50).alias("protected"))
    return search.select_evidence(e.withColumn("mandatory", F.col("requirement_id") <= 3)).select("query_id", "requirement_id", "chunk_id", "pick")


@query("token_budget", f"""WITH RECURSIVE {SPARSE_SQL}, r AS MATERIALIZED (SELECT query_id, chunk_id, rank, units AS tokens FROM rk JOIN ch USING (chunk_id) WHERE rank <= 12),
f AS (SELECT query_id, rank, tokens::BIGINT AS used, true AS kept FROM r WHERE rank = 1
  UNION ALL SELECT r.query_id, r.rank, CASE WHEN f.used + r.tokens <= 3600 THEN f.used + r.tokens ELSE f.used END, f.used + r.tokens <= 3600 FROM f JOIN r ON r.query_id = f.query_id AND r.rank = f.rank + 1)
SELECT r.query_id, r.chunk_id, r.rank, r.tokens FROM r JOIN f ON f.query_id = r.query_id AND f.rank = r.rank AND f.kept""")  # fmt: skip
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    hits, ch = sparse_hits(spark, d, 12)
    rows = hits.join(ch.select("chunk_id", F.col("units").alias("tokens")), "chunk_id")
    return search.token_budget(rows).select("query_id", "chunk_id", "rank", "tokens")


@query("neighbour_expansion", f"""WITH {SPARSE_SQL}, h AS (SELECT query_id, split_part(chunk_id, '-', 1)::BIGINT AS doc_id, split_part(chunk_id, '-', 2)::INTEGER - 1 AS pos FROM rk WHERE rank <= 3),
n AS (SELECT DISTINCT query_id, doc_id, pos + o AS pos FROM h, (VALUES (-1), (1)) v(o))
SELECT n.query_id, ch.chunk_id FROM n JOIN ch ON n.doc_id = ch.doc_id AND n.pos = ch.pos WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = n.query_id AND h.doc_id = n.doc_id AND h.pos = n.pos)""")  # fmt: skip
def neighbour_expansion(spark: SparkSession, d: str) -> DataFrame:
    hits, ch = sparse_hits(spark, d, 3)
    placed = kept(hits.join(ch.select("chunk_id", "doc_id", "pos"), "chunk_id"))
    return search.neighbour_expansion(placed, ch.select("doc_id", "pos", "chunk_id"), "doc_id", "pos").select("query_id", "chunk_id")


@query("evidence_roles", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE WHEN l_returnflag <> 'A' AND l_discount * 10 >= 0.55 THEN 'direct' WHEN l_returnflag = 'A' AND (l_tax * 10 >= 0.25) THEN 'table_evidence' WHEN l_returnflag = 'A' THEN 'table_context'
  WHEN l_tax * 10 >= 0.45 THEN 'direct' ELSE 'related' END AS role FROM lineitem""")  # fmt: skip
def evidence_roles(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "table").otherwise("text")
    role = search.evidence_role(kind, F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(False), F.lit(False))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", role.alias("role"))


@query("governing_lead", """SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS lead_pos FROM conversations""")
def governing_lead(spark: SparkSession, d: str) -> DataFrame:
    return search.governing_lead(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "lead_pos")


@query("drop_reasons", f"""WITH {DENSE_SQL}, r AS (SELECT * FROM dk WHERE rank <= 20)
SELECT query_id, chunk_id, CASE WHEN document_id % 2 = 1 THEN 'metadata_conflict' WHEN rank > 12 THEN 'rerank_budget' ELSE 'candidate_limit' END AS reason FROM r WHERE document_id % 2 = 1 OR rank > 6""")  # fmt: skip
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"))
    r = dense_hits(spark, d, 20).join(labels, "chunk_id")
    return search.drop_reasons(r, [("metadata_conflict", r.filter("document_id % 2 = 0")), ("rerank_budget", r.filter("rank <= 12")), ("candidate_limit", r.filter("rank <= 6"))])


@query("retrieval_diagnostics", """WITH c AS (SELECT l_suppkey AS query_id, l_returnflag AS stage, l_discount AS score, l_tax AS rerank_score FROM lineitem)
SELECT query_id, stage, count(*) AS n, round(min(score), 4) AS min_score, round(max(score), 4) AS max_score, round(min(rerank_score), 4) AS min_rerank_score, round(max(rerank_score), 4) AS max_rerank_score FROM c GROUP BY ALL""")  # fmt: skip
def retrieval_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return search.diagnostics(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_returnflag").alias("stage"), F.col("l_discount").alias("score"), F.col("l_tax").alias("rerank_score")))


NORM_SQL = r"""regexp_replace(regexp_replace(lower({}), '\[\d+\]', '', 'g'), '[\s\x0B·•、，,。.;；:：()（）"''“”‘’\-_/《》]+', '', 'g')"""


@query("answer_text_scores", f"""WITH p AS (SELECT a.conv_id, a.turn, {NORM_SQL.format('a.text')} AS g, {NORM_SQL.format('b.text')} AS a FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
s AS (SELECT *, list_distinct([g[i:i+1] for i in range(1, length(g))]) AS gg, list_distinct([a[i:i+1] for i in range(1, length(a))]) AS ga FROM p),
b AS (SELECT *, len(list_intersect(gg, ga))::DOUBLE AS both_n FROM s)
SELECT conv_id, turn, round(CASE WHEN g = '' OR a = '' THEN 0.0 WHEN contains(a, g) OR (contains(g, a) AND length(a) >= greatest(8, length(g) // 3)) THEN 1.0
  WHEN len(gg) = 0 THEN 0.0 ELSE 0.7::DOUBLE * both_n / len(gg) + 0.3::DOUBLE * both_n / greatest(len(ga), 1) END, 6) AS score FROM b""")  # fmt: skip
def answer_text_scores(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.text_score(F.col("text"), F.col("answer")), 6).alias("score"))


@query("anchor_coverage", r"""WITH w AS (SELECT item_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark), v AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS k FROM w, unnest(range(1, len(w) - 3)) AS r(i)), y AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM v, unnest(range(1, len(w) - 3)) AS r(i)),
j AS (SELECT DISTINCT item_id, doc_id FROM x JOIN y USING (k)),
p AS (SELECT item_id, doc_id, regexp_replace(w.text, '\s+', '', 'g') AS a, regexp_replace(v.text, '\s+', '', 'g') AS t FROM j JOIN w USING (item_id) JOIN v USING (doc_id)),
s AS (SELECT *, list_distinct([a[i:i+1] for i in range(1, length(a))]) AS ga, list_distinct([t[i:i+1] for i in range(1, length(t))]) AS gt FROM p)
SELECT item_id, doc_id, round(CASE WHEN a = '' OR t = '' THEN 0.0 WHEN contains(t, a) THEN 1.0 ELSE len(list_intersect(ga, gt))::DOUBLE / greatest(len(ga), 1) END, 6) AS coverage FROM s""")
def anchor_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a passage and a document that share five neighbouring words."""
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text")
    keys = lambda df, c: df.select(c, F.explode(shingle_keys(F.col("text"), 5)).alias("_p"))
    pairs = keys(docs, "doc_id").join(keys(items, "item_id"), "_p").select("item_id", "doc_id").distinct()
    both = pairs.join(items.select("item_id", F.col("text").alias("anchor")), "item_id").join(docs, "doc_id")
    return both.select("item_id", "doc_id", F.round(T.anchor_coverage(F.col("anchor"), F.col("text")), 6).alias("coverage"))


SUPPORT_SQL = r"""lower(regexp_replace({}, '[\s"''“”‘’=：:；;，,。()（）]+', '', 'g'))"""


@query("phrase_support", f"""WITH {SPARSE_SQL}, ps AS (SELECT rk.query_id, rk.chunk_id, {SUPPORT_SQL.format('b.text')} AS e, {SUPPORT_SQL.format('piece')} AS a FROM rk JOIN ch USING (chunk_id) JOIN benchmark b ON item_id = query_id WHERE rank <= 10),
sv AS (SELECT query_id, chunk_id, CASE WHEN length(e) = 0 THEN 0 WHEN contains(a, e) THEN 1 WHEN length(e) = 1 THEN 0 ELSE len(list_filter([e[i:i + 1] for i in range(1, length(e))], lambda g: contains(a, g)))::DOUBLE / (length(e) - 1) END AS v FROM ps),
rr AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY v DESC, chunk_id))::INTEGER AS rerank_rank FROM sv WHERE v >= 0.30)
SELECT query_id, chunk_id, round(v, 6)::DOUBLE AS support, rerank_rank FROM rr WHERE rerank_rank <= 5""")  # fmt: skip
def phrase_support(spark: SparkSession, d: str) -> DataFrame:
    """D20/D25 over the sparse hits: bigram support of the passage in each chunk, at least 0.30, five per passage."""
    hits, ch = sparse_hits(spark, d, 10)
    pairs = hits.drop("rank").join(ch.select("chunk_id", F.col("piece").alias("text")), "chunk_id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    return search.rerank(pairs, 5).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("support"), "rerank_rank")
