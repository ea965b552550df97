"""Queries for single rules: text, order, identity, grid and locator operators over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evaluation, evidence, identity, integrity, search, structure
from ..operators import tables as tb
from ..operators.joins import dealt
from ..sources import indexes
from .tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rowset(names: list[str], *rows: tuple) -> F.Column:
    """An array of structs of the given field names."""
    cell = lambda v: v if isinstance(v, F.Column) else F.lit(v)
    return F.array(*[F.struct(*[cell(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns with a number of their own."""
    return table(spark, d, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))


TURNS = "c AS (SELECT *, conv_id * 1000 + turn AS k FROM conversations)"

# ---- order, boost and selection (D9, D15, D18, D22, D39) ----


@query("anchor_boosts", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN p_name <> '' AND contains(p_name || ' ' || p_type, split_part(p_name, ' ', 1)) AND l_linenumber % 2 = 0 THEN 0.3
  WHEN contains(p_type, 'ECO') OR contains(p_name, 'ECO') THEN 0.2 ELSE 0.0 END::DOUBLE AS boost FROM lineitem JOIN part ON l_partkey = p_partkey""")  # fmt: skip
def anchor_boosts(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    title = F.when(F.col("l_linenumber") % 2 == 0, F.substring_index("p_name", " ", 1)).otherwise("")
    boost = search.anchor_boost(title, F.lit("ECO"), F.concat_ws(" ", "p_name", F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).otherwise(F.col("p_type"))), F.col("p_name"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", boost.cast("double").alias("boost"))


@query("inferred_scores", """WITH c AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS chunk_id FROM lineitem), m AS (SELECT query_id, chunk_id, p.* FROM c JOIN part p ON chunk_id = p_partkey),
h AS (SELECT query_id, chunk_id, unnest([contains(lower(p_type), 'o'), contains(lower(p_name), CASE WHEN query_id % 2 = 0 THEN 'red' ELSE 'ring' END)]) AS hit FROM m)
SELECT query_id, chunk_id, avg(hit::INTEGER)::DOUBLE AS inferred FROM h GROUP BY ALL""")  # fmt: skip
def inferred_scores(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.create_map(F.lit("type"), "p_type", F.lit("name"), "p_name").alias("metadata"))
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"))
    cand = dealt(lines, "chunk_id").distinct().join(part, "chunk_id")
    wanted = F.array(F.struct(F.lit("type").alias("field"), F.lit("O").alias("wanted")), F.struct(F.lit("name").alias("field"), F.when(F.col("s_suppkey") % 2 == 0, "red").otherwise("RING").alias("wanted")))
    filters = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.explode(wanted).alias("r")).select("query_id", "r.*")
    return search.inferred_score(cand, filters)


LINES = "l AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_partkey AS document_id, round(l_extendedprice / 100, 0) AS fused, l_discount AS score, l_tax AS boost, l_quantity % 2 AS preferred, l_linenumber AS inferred, l_quantity AS statement, l_extendedprice AS fit FROM lineitem)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("query_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("chunk_id"), c("l_partkey").alias("document_id"), F.round(c("l_extendedprice") / 100, 0).alias("fused"), c("l_discount").alias("score"), c("l_tax").alias("boost"), (c("l_quantity") % 2).alias("preferred"), c("l_linenumber").alias("inferred"), c("l_quantity").alias("statement"), c("l_extendedprice").alias("fit"))


@query("candidate_order", f"WITH {LINES} SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, score + boost DESC, preferred DESC, inferred DESC, statement DESC, fit DESC, chunk_id))::INTEGER AS rank FROM l")
def candidate_order(spark: SparkSession, d: str) -> DataFrame:
    return search.order_candidates(lines(spark, d)).select("query_id", "chunk_id", "rank")


@query("final_selection", f"""WITH {LINES}, r AS (SELECT query_id, chunk_id, document_id, CASE inferred % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS w, score AS coverage, boost AS rr FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, coverage DESC, rr DESC, chunk_id) AS rank FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS f, count(*) OVER (PARTITION BY query_id) AS n FROM o),
s AS (SELECT query_id, chunk_id, (CASE WHEN n <= 12 THEN row_number() OVER (PARTITION BY query_id ORDER BY rank) ELSE row_number() OVER (PARTITION BY query_id ORDER BY f > 1, rank) END)::INTEGER AS selected_rank FROM f) SELECT * FROM s WHERE selected_rank <= 12""")  # fmt: skip
def final_selection(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(x) for x in ("table_evidence", "table_context", "related", "other")]), F.col("inferred") % 4 + 1)
    c = lines(spark, d).select("query_id", "chunk_id", "document_id", role.alias("role"), F.col("score").alias("coverage"), F.col("boost").alias("rerank_score"))
    return search.select_final(c).select("query_id", "chunk_id", "selected_rank")


@query("evidence_dedup", """WITH e AS (SELECT l_suppkey AS query_id, l_partkey AS document_id, l_linenumber AS evidence_id, l_orderkey * 10 + l_linenumber AS id, (l_quantity % 3)::INTEGER AS rw, l_returnflag || '  ' || l_linestatus AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rank FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, evidence_id ORDER BY rw DESC, rank) AS a FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, regexp_replace(t, '\\s+', '', 'g') ORDER BY rank) AS b FROM a WHERE a = 1)
SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INTEGER AS rank FROM b WHERE b = 1""")  # fmt: skip
def evidence_dedup(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    rank = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("document_id"), F.col("l_linenumber").alias("evidence_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") % 3).cast("int").alias("role_weight"), F.concat_ws("  ", "l_returnflag", "l_linestatus").alias("text"), rank.alias("rank"))
    return search.dedupe_evidence(e).select("query_id", "id", "rank")


# ---- text rules (D16, D17, D23, D25, D43, C20, C4) ----


@query("question_terms", f"""WITH {TURNS}, p AS (SELECT k, regexp_extract_all(regexp_replace(text, '《[^》]*》', ' ', 'g'), '[一-鿿A-Za-z0-9_]{{2,}}') AS w, regexp_extract_all(text, '[“"‘'']([^”"’'']{{2,40}})[”"’'']', 1) AS q FROM c),
t AS (SELECT k, list_concat(q, flatten(list_transform(w, lambda x: CASE WHEN length(x) <= 18 THEN [x] ELSE [x[i:i + 3] for i in range(1, length(x) - 2)] END))) AS t FROM p)
SELECT k, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:32], '|') AS terms FROM t""")  # fmt: skip
def question_terms(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("k", F.array_join(T.question_terms(F.col("text")), "|").alias("terms"))


@query("term_coverage", f"""WITH {TURNS}, p AS (SELECT a.k, regexp_extract_all(regexp_replace(a.text, '[“"‘''”’]', ' ', 'g'), '[A-Za-z0-9_]{{2,18}}') AS w, b.text AS t FROM c a JOIN c b ON b.k = a.k + 1),
u AS (SELECT k, list_filter(w, lambda x, i: list_position(w, x) = i)[1:32] AS w, t FROM p) SELECT k, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: contains(t, x))) / len(w), 6) ELSE 0.0 END AS coverage FROM u""")  # fmt: skip
def term_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = F.regexp_extract_all(F.regexp_replace("text", "[“\"‘'”’]", " "), F.lit("[A-Za-z0-9_]{2,18}"), F.lit(0))
    a = turns(spark, d).select("k", F.slice(F.array_distinct(w), 1, 32).alias("w"))
    b = turns(spark, d).select((F.col("k") - 1).alias("k"), F.col("text").alias("t"))
    return a.join(b, "k").select("k", F.round(T.term_coverage(F.col("w"), F.col("t")), 6).alias("coverage"))


@query("excerpts", r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(trim(text, ' '), '(?s).+?(?:[。！？!?；;]|$)') AS s FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, text, s, list_transform(s, lambda x, i: list_sum(list_transform(s[1:i], lambda y: length(y)))) AS upto FROM s),
k AS (SELECT doc_id, text, array_to_string(list_filter(s, lambda x, i: upto[i] <= 300), '') AS kept FROM n)
SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text WHEN kept = '' THEN text[1:300] ELSE trim(kept, ' ') END) AS excerpt_md5 FROM k""")  # fmt: skip
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(T.excerpt(F.col("text"), 300)).alias("excerpt_md5"))


@query("contents_pages", r"""SELECT doc_id, len(regexp_extract_all(t, '[.．…·]{3,}\s*\d+')) >= 5 OR (len(regexp_extract_all(t, '[.．…·]{3,}\s*\d+')) >= 2 AND doc_id % 3 = 0) AS is_toc
FROM (SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN regexp_replace(text, '([a-z]) ', '\1.... 12 ', 'g') ELSE regexp_replace(text, '([a-z]) ', '\1.... 12 ') END AS t FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    t = F.when(k % 5 < 3, F.regexp_replace("text", "([a-z]) ", "$1.... 12 ")).otherwise(F.regexp_replace("text", "(?s)^(.*?[a-z]) ", "$1.... 12 "))
    title = F.when(k % 3 == 0, F.lit("目录")).otherwise(F.col("source"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.coalesce(chunking.is_toc(t, title), F.lit(False)).alias("is_toc"))


@query("normal_values", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN round(l_extendedprice, 2) WHEN 1 THEN round(l_tax * 100, 0) / 100 WHEN 2 THEN NULL ELSE l_quantity END::DOUBLE AS value FROM lineitem""")
def normal_values(spark: SparkSession, d: str) -> DataFrame:
    n, p = F.col("l_linenumber") % 4, F.col("l_extendedprice")
    shown = F.when(n == 0, F.format_number(p, 2)).when(n == 1, F.concat(F.round(F.col("l_tax") * 100, 0).cast("int").cast("string"), F.lit("%"))).when(n == 2, F.lit("—")).otherwise(F.col("l_quantity").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.normalize_value(shown).alias("value"))


# ---- labels and numerals (C3, C14, C15, C16, D33) ----

CN = "['零','一','二','三','四','五','六','七','八','九']"
CN_SQL = f"(CASE WHEN n >= 1000 THEN {CN}[n // 1000 + 1] || '千' ELSE '' END || CASE WHEN n % 1000 >= 100 THEN {CN}[n % 1000 // 100 + 1] || '百' WHEN n >= 1000 AND n % 1000 > 0 THEN '零' ELSE '' END || CASE WHEN n % 100 >= 10 THEN {CN}[n % 100 // 10 + 1] || '十' WHEN n >= 100 AND n % 1000 >= 100 AND n % 100 > 0 THEN '零' ELSE '' END || CASE WHEN n % 10 > 0 THEN {CN}[n % 10 + 1] ELSE '' END)"


def chinese(n: F.Column) -> F.Column:
    """1 to 9999 in Chinese numerals, in DataFrame functions (the operators read them back)."""
    digit = lambda x: F.element_at(F.array(*[F.lit(c) for c in "零一二三四五六七八九"]), x.cast("int") + 1)
    thousands = F.when(n >= 1000, F.concat(digit(F.floor(n / 1000)), F.lit("千"))).otherwise("")
    hundreds = F.when(n % 1000 >= 100, F.concat(digit(F.floor(n % 1000 / 100)), F.lit("百"))).when((n >= 1000) & (n % 1000 > 0), "零").otherwise("")
    tens = F.when(n % 100 >= 10, F.concat(digit(F.floor(n % 100 / 10)), F.lit("十"))).when((n >= 100) & (n % 1000 >= 100) & (n % 100 > 0), "零").otherwise("")
    return F.concat(thousands, hundreds, tens, F.when(n % 10 > 0, digit(n % 10)).otherwise(""))


@query("numerals", "SELECT doc_id, (doc_id * 7 % 9999 + 1)::INTEGER AS number FROM documents")
def numerals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") * 7 % 9999 + 1
    return table(spark, d, "documents").select("doc_id", T.numeral(chinese(n)).alias("number"))


@query("article_parts", """SELECT doc_id, u.i::INTEGER AS part_no, CASE WHEN u.i > 0 THEN (doc_id % 1500 + u.i)::INTEGER END AS number FROM documents, unnest([0, 1, 2]) AS u(i) WHERE text IS NOT NULL AND trim(text) <> ''""")
def article_parts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with two articles put behind them are cut into preface and articles."""
    k = F.col("doc_id") % 1500
    label = lambda i: F.concat(F.lit("\n  第"), chinese(k + i), F.lit("条"), F.lit("之二" if i == 2 else ""), F.lit(" 本条\n"))
    t = F.concat(F.col("text"), label(1), label(2))
    rows = table(spark, d, "documents").filter("text is not null and trim(text) <> ''").select("doc_id", t.alias("text"))
    return chunking.split_articles(rows).select("doc_id", "part_no", F.col("article").alias("number"))


@query("clause_index", "SELECT doc_id, unnest(list_distinct([doc_id % 999 + 1, doc_id % 97 + 1]))::INTEGER AS clause_number FROM documents")
def clause_index(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(F.lit(" 第"), (k % 999 + 1).cast("string"), F.lit("条 "), F.coalesce("text", F.lit("")))
    title = F.concat(F.lit("见第"), (k % 97 + 1).cast("string"), F.lit("条"))
    return chunking.extract_clauses(table(spark, d, "documents").select("doc_id", text.alias("text"), title.alias("section_title")), "doc_id").select("doc_id", "clause_number")


@query("locators", """SELECT doc_id, 'chapter:' || (doc_id % 30 + 1) || CASE WHEN doc_id % 3 > 0 THEN '|article:' || (doc_id % 2000 + 1) || CASE WHEN doc_id % 3 = 2 THEN '-2' ELSE '' END ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '|item:' || (doc_id % 9 + 1) ELSE '' END AS locator_key,
  CASE WHEN doc_id % 3 > 0 THEN 'resolved' ELSE 'partial' END AS locator_status FROM documents""")  # fmt: skip
def locators(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.array(F.concat(F.lit("第"), chinese(k % 30 + 1), F.lit("章 总则")))
    title = F.when(k % 3 > 0, F.concat(F.lit("第"), chinese(k % 2000 + 1), F.lit("条"), F.when(k % 3 == 2, F.lit("之二")).otherwise("")))
    text = F.concat(F.when(k % 4 == 0, F.concat(F.lit("（"), chinese(k % 9 + 1), F.lit("）"))).otherwise(""), F.lit("根据第五条"), F.coalesce("source", F.lit("")))
    return structure.locate(table(spark, d, "documents").select("doc_id", path.alias("section_path"), title.alias("section_title"), text.alias("text"))).select("doc_id", "locator_key", "locator_status")


@query("locator_matches", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 50 AS gd, l_suppkey % 50 AS od, l_linenumber % 3 AS ga, l_quantity % 3 AS oa, l_quantity % 2 AS gp FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN gd % 2 <> od % 2 THEN 'document' WHEN ga > 0 AND oa > 0 AND ga <> oa THEN 'article' WHEN gp > 0 AND gp <> 1 THEN 'paragraph' END AS mismatch FROM p""")  # fmt: skip
def locator_matches(spark: SparkSession, d: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("int")
    some = lambda x: F.when(x > 0, x.cast("int"))
    side = lambda p, doc, article, paragraph: [(doc % 50 % 2).alias(f"{p}doc"), none.alias(f"{p}part"), none.alias(f"{p}chapter"), none.alias(f"{p}section"), some(article).alias(f"{p}article"), some(paragraph).alias(f"{p}paragraph"), none.alias(f"{p}item")]
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *side("gold_", c("l_partkey"), c("l_linenumber") % 3, c("l_quantity") % 2), *side("got_", c("l_suppkey"), c("l_quantity") % 3, F.lit(1)))
    return structure.match_structure(rows, "paragraph").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "mismatch")


@query("references_in_text", """SELECT doc_id, u.i::INTEGER AS pos, ['annex', 'article', 'table', 'page', 'table'][u.i + 1] AS kind, [doc_id % 5 + 1, doc_id % 900 + 1, doc_id % 7 + 1, doc_id % 80 + 1, NULL][u.i + 1]::INTEGER AS number, CASE WHEN u.i = 4 THEN 'next' END AS direction FROM documents, unnest([0, 1, 2, 3, 4]) AS u(i)""")
def references_in_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    s = lambda n: (k % n + 1).cast("string")
    text = F.concat(F.lit("依据《办法》第三条，见附件"), s(5), F.lit("、第"), s(900), F.lit("条、表"), s(7), F.lit("和第"), s(80), F.lit("页，以及下表"))
    return search.recognize_references(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id").select("doc_id", "pos", "kind", "number", "direction")


# ---- identity (B3, B5, B7, B8, B9, B12, B13, B14) ----


@query("file_names", """SELECT doc_id, nullif(lower(trim('Report_' || source || '_' || doc_id || '.PDF ')[1:255]), '') AS name FROM documents""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("C:\\tmp/x\\ Report_"), F.coalesce("source", F.lit("")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".PDF "))
    return table(spark, d, "documents").filter("source is not null").select("doc_id", identity.normalize_filename(raw).alias("name"))


@query("manifest_integrity", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_custkey % 7 = 0 THEN 'invalid' ELSE 'valid' END AS integrity FROM orders""")
def manifest_integrity(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = table(spark, d, "orders").select("o_orderkey", F.sha2(k.cast("string"), 256).alias("sha256"), c.alias("size"), F.sha2((k + (k % 5 == 0).cast("int")).cast("string"), 256).alias("doc_sha256"), (c + (c % 7 == 0).cast("int")).alias("doc_size"))
    return identity.manifest_integrity(m).select("o_orderkey", "integrity")


@query("metadata_keys", """SELECT o_orderkey, u.i AS n, ['effective_date', 'issuer', 'doctype'][u.i] AS field, CASE u.i WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN o_orderpriority ELSE o_orderstatus END AS normalized FROM orders, unnest([1, 2, 3]) AS u(i)""")
def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    date = F.date_format("o_orderdate", "yyyy年M月d日")
    kv = rowset(["n", "key", "value"], (1, "Effective Date", date), (2, "issued-by", F.concat(F.lit(" "), "o_orderpriority")), (3, "Doc_Type", F.col("o_orderstatus")))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(kv).alias("r")).select("o_orderkey", "r.*")
    return identity.normalize_keys(rows, {"effectivedate": "effective_date", "issuedby": "issuer"}).select("o_orderkey", "n", "field", "normalized")


TOPICS = "r AS (SELECT row_number() OVER (ORDER BY w) AS o, w AS keyword, 'topic ' || length(w) AS topic FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS w FROM benchmark))"


@query("inferred_topics", f"WITH {TOPICS}, h AS (SELECT doc_id, o, topic FROM documents JOIN r ON contains(text, keyword)) SELECT doc_id, arg_min(topic, o) AS topic FROM h GROUP BY doc_id")
def inferred_topics(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("keyword")).distinct()
    return identity.infer_topic(table(spark, d, "documents"), words.select(F.col("keyword").alias("rule_order"), "keyword", F.concat(F.lit("topic "), F.char_length("keyword").cast("string")).alias("topic")))


@query("inferred_titles", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Rules of ' || source ELSE source || ' report' END AS title FROM documents WHERE source IS NOT NULL""")
def inferred_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source is not null").select("doc_id", "source", F.concat(F.lit("12_"), F.col("source"), F.lit(" report_7.docx")).alias("filename"))
    heads = rowset(["order_index", "block_type", "text"], (0, "heading", "第一章 总则"), (2, "heading", F.concat(F.lit("Rules of "), "source")), (9, "heading", "Too late a heading"))
    blocks = docs.select("doc_id", F.explode(F.when(F.col("doc_id") % 3 == 0, heads).otherwise(F.slice(heads, 3, 1))).alias("r")).select("doc_id", "r.*")
    return identity.infer_titles(blocks, docs)


@query("identity_hashes", """SELECT n_nationkey, count(DISTINCT c_mktsegment) AS identities FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def identity_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.withColumn("h", identity.identity_hash(["n_name", "c_mktsegment"])).groupBy("n_nationkey").agg(F.count_distinct("h").alias("identities"))


@query("review_states", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'reset' END AS state FROM customer""")
def review_states(spark: SparkSession, d: str) -> DataFrame:
    """A third of the customers was never confirmed, a third holds, a third moved to another segment since."""
    c, k = table(spark, d, "customer"), F.col("c_custkey") % 3
    fields = ["c_name", "c_mktsegment"]
    before = c.withColumn("c_mktsegment", F.when(k == 2, F.concat("c_mktsegment", F.lit("?"))).otherwise(F.col("c_mktsegment"))).select("c_custkey", F.when(k > 0, identity.identity_hash(fields)).alias("confirmed_hash"))
    return identity.review_state(c.join(before, "c_custkey"), fields).select("c_custkey", F.col("review_state").alias("state"))


@query("title_term_hits", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (contains(p_name || ' ' || p_type, 'red')::INTEGER + contains(p_name || ' ' || p_type, 'ring')::INTEGER + contains(p_name || ' ' || p_type, 'ECO')::INTEGER)::INTEGER AS hits FROM lineitem JOIN part ON l_partkey = p_partkey""")
def title_term_hits(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    terms = F.array(F.lit("red"), F.lit("ring"), F.lit("ECO"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.title_hits(terms, F.col("p_name"), F.col("p_type")).alias("hits"))


@query("qa_rows_refused", "SELECT conv_id, turn, turn % 3 = 1 AS refused FROM conversations")
def qa_rows_refused(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("turn") % 3
    m = F.when(n == 1, F.create_map(F.lit("question"), "text", F.lit("answer_text"), "role")).when(n == 2, F.create_map(F.lit("question"), "text")).otherwise(F.create_map(F.lit("answer"), "text"))
    kept, refused = identity.reject_qa_rows(table(spark, d, "conversations").withColumn("fields", m))
    return kept.select("conv_id", "turn", F.lit(False).alias("refused")).unionByName(refused.select("conv_id", "turn", F.lit(True).alias("refused")))


@query("source_states", """WITH i AS (SELECT o_custkey AS doc_id, list(o_orderkey ORDER BY o_orderkey) AS a, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 11 <> 0) AS b FROM orders GROUP BY ALL)
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 10 = 0 THEN 'source_missing' WHEN a IS NOT NULL AND a IS NOT DISTINCT FROM b THEN 'indexed' ELSE 'needs_index' END AS state FROM customer LEFT JOIN i ON c_custkey = doc_id""")  # fmt: skip
def source_states(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("/f/"), F.col("c_custkey").cast("string")).alias("path"))
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("item_id"))
    return identity.reconcile_sources(docs, docs.filter("doc_id % 10 <> 0").select("path"), ids, ids.filter("item_id % 11 <> 0"))


@query("file_findings", """WITH f AS (SELECT o_orderkey AS k, o_orderkey % 13 = 0 AS gone, o_orderkey % 17 = 0 AS s, o_orderkey % 19 = 0 AS h, o_orderkey % 23 = 0 AS extra FROM orders)
SELECT 'f' || k AS path, CASE WHEN extra THEN 'not_imported' WHEN gone THEN 'missing' WHEN s THEN 'size' ELSE 'hash' END AS finding FROM f WHERE (extra AND NOT gone) OR (NOT extra AND (gone OR s OR h))""")  # fmt: skip
def file_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("f"), k.cast("string")).alias("path"), F.col("o_custkey").alias("size"), F.sha2(k.cast("string"), 256).alias("sha256"))
    files = rows.filter("k % 13 <> 0").withColumn("size", F.col("size") + (F.col("k") % 17 == 0).cast("int")).withColumn("sha256", F.when(F.col("k") % 19 == 0, "x").otherwise(F.col("sha256")))
    return integrity.check_files(rows.filter("k % 23 <> 0"), files)


@query("guarded_upsert", "SELECT o_custkey AS doc_id, count(*) AS vectors FROM orders GROUP BY ALL HAVING NOT bool_or(o_orderkey % 50 = 0)")
def guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_id"))
    vectors = chunks.filter("chunk_id % 50 <> 0").withColumn("v", F.lit(1))
    store, _ = indexes.upsert_vectors(vectors.limit(0), vectors, chunks)
    return store.groupBy("doc_id").agg(F.count("*").alias("vectors"))


# ---- tables and grids (C10, C18, C19, C21, C22, F3, F5, F22, G12, G24) ----


@query("row_sentences", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '客户为' || o_custkey || '时，状态为' || o_orderstatus ELSE '客户=' || o_custkey || '；状态=' || o_orderstatus || '；级别=' || o_orderpriority END AS sentence FROM orders""")
def row_sentences(spark: SparkSession, d: str) -> DataFrame:
    two = F.col("o_orderkey") % 2 == 0
    heads, cells = F.array(*[F.lit(x) for x in ("客户", "状态", "级别")]), F.array(F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    cut = lambda a: F.when(two, F.slice(a, 1, 2)).otherwise(a)
    rows = table(spark, d, "orders").select(F.lit("t").alias("t"), "o_orderkey", cut(heads).alias("h"), cut(cells).alias("c"))
    return chunking.table_chunks(rows, "t", "o_orderkey", "h", "c").select("o_orderkey", "sentence")


@query("table_summaries", "SELECT n_name AS t, '表格摘要：' || n_name || '；数据行数：' || count(*) || '；列：name、balance' AS summary FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def table_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return chunking.table_summary(c.select(F.col("n_name").alias("t"), F.array(F.lit("name"), F.lit("balance")).alias("h")), "t", "t", "h")


@query("filled_labels", """WITH g AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS b FROM lineitem GROUP BY ALL), f AS (SELECT *, max(CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS a FROM g)
SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL THEN b ELSE a || ' / ' || b END AS row_label FROM f""")  # fmt: skip
def filled_labels(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("b"))
    g = g.withColumn("a", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_linenumber").cast("string")).otherwise(" "))
    return structure.fill_row_labels(g, ["a", "b"], ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "row_label")


@query("merged_cells", """WITH g AS (SELECT l_orderkey AS sheet, l_linenumber AS r, u.c AS c, l_linenumber || ':' || u.c AS v FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), unnest([1, 2, 3]) AS u(c))
SELECT sheet, r AS "row", c AS col, CASE WHEN r BETWEEN 1 AND 2 AND c BETWEEN 1 AND 2 THEN '1:1' ELSE v END AS value FROM g WHERE sheet IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""")  # fmt: skip
def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()  # noqa: E741
    g = l.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("col")).withColumn("value", F.concat_ws(":", F.col("row").cast("string"), F.col("col").cast("string")))
    some = l.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("sheet"))
    ranges = some.select("sheet", F.lit(1).alias("top"), F.lit(1).alias("left"), F.lit(2).alias("bottom"), F.lit(2).alias("right"))
    return structure.fill_merged(g.join(some, "sheet"), ranges, ["sheet"]).select("sheet", "row", "col", "value")


@query("table_contexts", """SELECT n_name AS sheet, '亿元' AS unit, (2000 + n_nationkey)::INTEGER AS year, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 12 + 1 END::INTEGER AS month, (n_nationkey % 4 + 1)::INTEGER AS quarter FROM nation""")
def table_contexts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    quarter = F.element_at(F.array(*[F.lit(x) for x in "一二三四"]), (k % 4 + 1).cast("int"))
    title = F.concat((k + 2000).cast("string"), F.lit("年"), F.when(k % 2 == 0, F.concat((k % 12 + 1).cast("string"), F.lit("月"))).otherwise(""), F.lit("第"), quarter, F.lit("季度统计表"))
    g = rowset(["row", "col", "value"], (1, 1, title), (2, 3, "单位：亿元"), (12, 1, "单位：万元 1999年"))
    return structure.infer_table_context(table(spark, d, "nation").select(F.col("n_name").alias("sheet"), F.explode(g).alias("r")).select("sheet", "r.*"), ["sheet"])


@query("cell_index", """SELECT o_orderkey AS doc_id, u.i AS n, 'A' || u.i AS coordinate, ['合计', o_orderpriority][u.i] AS row_label, (quarter(o_orderdate)) || '季度' AS column_label, CASE WHEN u.i = 1 THEN o_custkey::DOUBLE END AS numeric_value FROM orders, unnest([1, 2]) AS u(i)""")
def cell_index(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("第"), F.element_at(F.array(*[F.lit(x) for x in "一二三四"]), F.quarter("o_orderdate")), F.lit("季度"))
    row = lambda label, col, value, at: F.struct(label.alias("row"), col.alias("column"), value.alias("value"), F.lit(at).alias("coordinate"))
    cells = F.to_json(F.array(row(F.lit(" 合计"), q, F.format_number(F.col("o_custkey"), 0), "A1"), row(F.col("o_orderpriority"), q, F.lit("true"), "A2")))
    out = structure.build_cells(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), cells.alias("cells")))
    return out.select("doc_id", F.substring("coordinate", 2, 1).cast("int").alias("n"), "coordinate", "row_label", "column_label", "numeric_value")


@query("required_labels", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name || ' ' || p_type || ' ' || l_returnflag), 'ing') AND (contains(lower(p_name || ' ' || p_type || ' ' || l_returnflag), 'econx') OR contains(lower(p_name || ' ' || p_type || ' ' || l_returnflag), 'eco'))""")
def required_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p_name").alias("row_label"), F.col("p_type").alias("column_label"), F.col("l_returnflag").alias("source_title"), F.array(F.lit("ING"), F.lit("econx")).alias("required"))
    return tb.require_labels(c).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("unique_cells", """WITH r AS (SELECT l_suppkey AS question_id, l_partkey AS source_title, l_linenumber AS coordinate, l_extendedprice AS numeric_value, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_linenumber ORDER BY l_quantity DESC, l_orderkey) AS n FROM lineitem WHERE l_returnflag <> 'R') SELECT question_id, source_title, coordinate, numeric_value FROM r WHERE n = 1""")
def unique_cells(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("question_id"), F.col("l_partkey").alias("source_title"), F.col("l_linenumber").alias("coordinate"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("numeric_value"), F.col("l_quantity").alias("score"), F.col("l_orderkey").alias("row_label"))
    return tb.unique_numeric(c, ["question_id"]).select("question_id", "source_title", "coordinate", "numeric_value")


@query("formula_lines", r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'r = a + ' || turn ELSE text END AS t FROM conversations), f AS (SELECT * FROM t WHERE trim(t, ' ') <> ''),
n AS (SELECT conv_id, turn, t, lag(turn) OVER w AS b, lead(turn) OVER w AS a FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, b AS before_turn, a AS after_turn FROM n WHERE length(t) BETWEEN 3 AND 240 AND regexp_matches(t, '[+\-*/×÷^=]') AND regexp_matches(t, '\p{L}') AND regexp_matches(t, '[\d=]')""")  # fmt: skip
def formula_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("r = a + "), F.col("turn").cast("string"))).otherwise(F.col("text"))
    plain = table(spark, d, "conversations").select("conv_id", "turn", t.alias("t"))
    turn_of = plain.select("conv_id", F.col("turn").alias("at"), "t")
    found = tb.find_formulas(plain, "conv_id", "turn", "t")
    filled = turn_of.filter(F.trim("t") != "")
    from pyspark.sql.window import Window as W

    w = W.partitionBy("conv_id").orderBy("at")
    near = filled.select("conv_id", F.col("at").alias("turn"), F.lag("at").over(w).alias("before_turn"), F.lead("at").over(w).alias("after_turn"), F.lag("t").over(w).alias("_b"), F.lead("t").over(w).alias("_a"))
    both = found.join(near, ["conv_id", "turn"]).filter(F.col("before").eqNullSafe(F.col("_b")) & F.col("after").eqNullSafe(F.col("_a")))
    return both.select("conv_id", "turn", "before_turn", "after_turn")


@query("text_facts", """WITH f AS (SELECT l_suppkey AS case_id, l_linenumber AS fact_id, max(l_discount) * 10 AS r FROM lineitem GROUP BY ALL) SELECT case_id, count(*) AS facts, round(avg(CASE WHEN r >= 0.65 THEN 1.0 ELSE 0.0 END), 6) AS covered FROM f GROUP BY ALL""")
def text_facts(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    facts = l.select(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("fact_id")).distinct()
    cites = l.groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("of")).agg(F.max("l_discount").alias("x"))
    return evaluation.text_evidence(facts, cites, F.when(F.col("of") == F.col("fact_id"), F.col("x") * 10).otherwise(0.0))


@query("expected_cells", """SELECT o_orderkey AS doc_id, o_orderkey % 4 <> 3 AS located, o_orderkey % 4 < 2 AS equal FROM orders""")
def expected_cells(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("o_orderkey"), F.round(F.col("o_totalprice"), 2).cast("decimal(18,2)")
    cells = table(spark, d, "orders").filter(k % 4 != 3).select(k.alias("doc_id"), F.lit("s").alias("sheet"), F.lit("B2").alias("coordinate"), v.cast("string").alias("value"))
    shown = F.when(k % 4 == 0, F.format_number(v, 2)).when(k % 4 == 1, F.round(v, 1).cast("decimal(18,1)").cast("string")).otherwise((v + 3).cast("string"))
    want = table(spark, d, "orders").select(k.alias("doc_id"), F.lit("s").alias("sheet"), F.lit("B2").alias("coordinate"), shown.alias("expected"))
    return structure.validate_cells(want, cells).select("doc_id", "located", "equal")


@query("heading_paths", """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 1 WHEN turn % 4 = 1 THEN 2 END AS level FROM conversations), h AS (SELECT *, max(CASE WHEN level = 1 THEN turn END) OVER w AS a, max(CASE WHEN level = 2 THEN turn END) OVER w AS b FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, array_to_string(list_filter([a, CASE WHEN b > coalesce(a, -1) THEN b END], lambda x: x IS NOT NULL), '>') AS path FROM h""")  # fmt: skip
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("turn") % 4
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(n == 0, 1).when(n == 1, 2).alias("level"), F.col("turn").cast("string").alias("title"))
    return chunking.heading_paths(rows, "conv_id", "turn").select("conv_id", "turn", F.array_join("path", ">").alias("path"))


@query("section_numbers", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (doc_id % 9 + 1) || '.2.' || (doc_id % 5) WHEN 1 THEN '第二十条之三' END AS section_number, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 9 + 1) || '.2' END AS parent_number FROM documents""")
def section_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    title = F.when(k % 3 == 0, F.concat((k % 9 + 1).cast("string"), F.lit(".2."), (k % 5).cast("string"), F.lit(" Scope"))).when(k % 3 == 1, F.lit(" 第二十条之三 要求")).otherwise(F.lit("2024report"))
    return chunking.section_numbers(table(spark, d, "documents").select("doc_id", title.alias("section_title"))).select("doc_id", "section_number", "parent_number")


@query("embedding_texts", """SELECT doc_id, md5(CASE WHEN source IS NULL THEN '' ELSE '来源：' || source || chr(10) END || CASE WHEN lang IS NULL THEN '' ELSE '语言：' || lang || chr(10) END || coalesce(text, '')) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    t = structure.embedding_text({"来源": F.col("source"), "语言": F.col("lang"), "页": F.lit(" ")}, F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(t).alias("text_md5"))


@query("definitions", """SELECT doc_id, u.k AS kind, u.t AS term_norm FROM (SELECT doc_id, ['所称', '简称', '是指'] AS ks, ['a' || doc_id, 'b' || doc_id, 'c' || doc_id] AS ts FROM documents), unnest([{'k': ks[1], 't': ts[1]}, {'k': ks[2], 't': ts[2]}, {'k': ks[3], 't': ts[3]}]) AS x(u)""")
def definitions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    t = F.concat(F.lit("本办法所称A"), k, F.lit("，指银行。以下简称“B"), k, F.lit("”。上述C"), k, F.lit("是指公司。所称A"), k, F.lit("，指银行。"))
    return chunking.extract_definitions(table(spark, d, "documents").select("doc_id", t.alias("text")), "doc_id").select("doc_id", "kind", "term_norm")


# ---- scopes, options and triage of questions ----


@query("scope_of_queries", """WITH d AS (SELECT n_nationkey AS doc_id, lower(n_name || ' trade report') AS t FROM nation),
q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN ' ' || lower(n_name) || ' ' WHEN 1 THEN 'the ' || lower(n_name) || ' trade report of this year' WHEN 2 THEN 'atlantis' ELSE '' END AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey),
h AS (SELECT query_id, list(doc_id ORDER BY doc_id) AS ids FROM q JOIN d ON trim(w) <> '' AND (contains(t, trim(w)) OR contains(trim(w), t)) GROUP BY ALL)
SELECT q.query_id, trim(w) <> '' AS scoped, array_to_string(coalesce(ids, []), ',') AS doc_ids FROM q LEFT JOIN h USING (query_id)""")  # fmt: skip
def scope_of_queries(spark: SparkSession, d: str) -> DataFrame:
    n, s = table(spark, d, "nation"), F.col("s_suppkey")
    wanted = F.when(s % 4 == 0, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).when(s % 4 == 1, F.concat(F.lit("the "), F.lower("n_name"), F.lit(" trade report of this year"))).when(s % 4 == 2, "atlantis").otherwise("")
    filters = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(s.alias("query_id"), wanted.alias("wanted"))
    docs = n.select(F.col("n_nationkey").alias("doc_id"), F.concat("n_name", F.lit(" trade report")).alias("title"))
    return structure.resolve_scope(filters, docs).select("query_id", "scoped", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@query("question_options", """SELECT s_suppkey AS question_id, stem, pos, label, option FROM (SELECT s_suppkey, 'Which of these is true?' AS stem, unnest([0, 1, 2])::INTEGER AS pos, unnest(['A', 'B', 'C']) AS label,
  unnest(['in ' || n_name, s_nationkey::VARCHAR || ' of 25', 'neither']) AS option FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 > 0)""")  # fmt: skip
def question_options(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as questions in two notations; every third has a single label, which is no option."""
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n, k = F.col("n_name"), F.col("s_nationkey").cast("string")
    dots = F.concat(F.lit("Which of these is true? A. in "), n, F.lit(" B. "), k, F.lit(" of 25 C. neither"))
    marks = F.concat(F.lit("Which of these is true?\n(A) in "), n, F.lit("\n(B) "), k, F.lit(" of 25\n(C) neither"))
    q = rows.select(s.alias("question_id"), F.when(s % 3 == 1, dots).when(s % 3 == 2, marks).otherwise(F.concat(F.lit("Is A. in "), n)).alias("question"))
    return evidence.extract_options(q).select("question_id", "stem", "pos", "label", "option")


@query("question_triage", """SELECT c_custkey AS question_id, CASE c_custkey % 5 WHEN 0 THEN 'prediction' WHEN 1 THEN 'advice' WHEN 2 THEN 'out_of_corpus' ELSE 'none' END AS triage FROM customer""")
def question_triage(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    said = F.element_at(F.array(*map(F.lit, ("未来利率会怎样", "我应该买这只基金吗", "今天天气如何", "《投资建议与预测》第三条怎么规定", "“预测”一词出现在哪里"))), (c % 5 + 1).cast("int"))
    return table(spark, d, "customer").select(c.alias("question_id"), evidence.triage(F.concat("c_mktsegment", F.lit(" "), said)).alias("triage"))
