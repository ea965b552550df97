"""Queries for evidence support, contract checks and evaluation, over conversations, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, contract, grids, scoring, search, support
from ..operators import tables as tb
from .rules import rowset, turns
from .tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NORM = r"""lower(regexp_replace({}, '[\s"''“”‘’=：:；;，,。()（）]+', '', 'g'))"""
TURNS = "c AS (SELECT *, conv_id * 1000 + turn AS k FROM conversations)"
#: Share of a phrase's bigrams in a text, 1 if it is contained; p and t are normal forms.
RECALL = "CASE WHEN contains({t}, {p}) THEN 1.0 ELSE len(list_filter([{p}[i:i + 1] for i in range(1, length({p}))], lambda g: contains({t}, g))) / (length({p}) - 1) END::DOUBLE"


def words(text: F.Column) -> F.Column:
    return F.split(F.trim(text), " +")


def chunk_rows(spark: SparkSession, d: str, text: F.Column) -> DataFrame:
    """Turns as chunks of their conversation."""
    return turns(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("k").alias("chunk_id"), F.col("turn").alias("pos"), F.lit(None).cast("string").alias("section_title"), text.alias("text"))


# ---- sections and pieces (C2, C7, C8) ----


@query("section_groups", r"""WITH t AS (SELECT conv_id, turn, turn // 5 AS g, turn % 5 AS m, text FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''),
a AS (SELECT conv_id, g, min(turn) AS first_turn, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS x, bool_or(m > 0) AS body, bool_or(m IN (1, 2)) AS para FROM t WHERE m < 3 GROUP BY ALL),
b AS (SELECT *, len(regexp_extract_all(x, '[一-鿿]|[a-zA-Z0-9_]+|[^\s]')) <= 120 AND EXISTS (SELECT 1 FROM t WHERE t.conv_id = a.conv_id AND t.g = a.g AND t.m = 3) AS caption FROM a WHERE body)
SELECT conv_id, first_turn::BIGINT AS group_index, 'paragraph' AS block_type, md5(x) AS text_md5 FROM b WHERE NOT caption
UNION ALL SELECT t.conv_id, t.turn, 'table', md5(CASE WHEN b.caption THEN b.x || chr(10) || chr(10) ELSE '' END || '表格：' || chr(10) || t.text) FROM t LEFT JOIN b ON t.conv_id = b.conv_id AND t.g = b.g WHERE t.m = 3
UNION ALL SELECT conv_id, turn, 'paragraph', md5(text) FROM t WHERE m = 4""")  # fmt: skip
def section_groups(spark: SparkSession, d: str) -> DataFrame:
    """Turns as blocks that repeat heading, two paragraphs, table, paragraph."""
    m = F.col("turn") % 5
    kind = F.when(m == 0, "heading").when(m == 3, "table").otherwise("paragraph")
    blocks = table(spark, d, "conversations").filter("text is not null and trim(text) <> ''").select("conv_id", F.col("turn").alias("order_index"), kind.alias("block_type"), "text", F.lit(None).cast("string").alias("section_title"))
    return chunking.group_blocks(blocks, "conv_id").select("conv_id", "group_index", "block_type", F.md5("text").alias("text_md5"))


UNITS = r"[一-鿿]|[a-zA-Z0-9_]+|[^\s]"
PACK = r"""s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s).+?(?:[。！？!?；;：:]|$)'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i AS pos, l[i] AS t, len(regexp_extract_all(l[i], '[一-鿿]|[a-zA-Z0-9_]+|[^\s]')) AS n, regexp_matches(l[i], '^[a-zA-Z0-9_]') AS h, regexp_matches(l[i], '[a-zA-Z0-9_]$') AS e FROM s, unnest(range(1, len(l) + 1)) AS r(i)),
f AS (SELECT doc_id, pos, 0 AS piece, n AS held, e FROM u WHERE pos = 1
  UNION ALL SELECT u.doc_id, u.pos, CASE WHEN f.held > 800 OR f.held + u.n - (f.e AND u.h)::INTEGER > 800 THEN f.piece + 1 ELSE f.piece END, CASE WHEN f.held > 800 OR f.held + u.n - (f.e AND u.h)::INTEGER > 800 THEN u.n ELSE f.held + u.n - (f.e AND u.h)::INTEGER END, u.e
  FROM f JOIN u ON u.doc_id = f.doc_id AND u.pos = f.pos + 1),
p AS (SELECT f.doc_id, f.piece, regexp_extract_all(string_agg(u.t, '' ORDER BY u.pos), '[一-鿿]|[a-zA-Z0-9_]+|[^\s]') AS w FROM f JOIN u ON f.doc_id = u.doc_id AND f.pos = u.pos GROUP BY ALL),
x AS (SELECT doc_id, piece, 0 AS ofs, len(w) AS units FROM p WHERE len(w) BETWEEN 1 AND 800
  UNION ALL SELECT doc_id, piece, a, least(len(w) - a, CASE WHEN a = 0 THEN 800 ELSE 794 END) FROM p, unnest(range(0, len(w), 720)) AS r(a) WHERE len(w) > 800)"""


@query("packed_units", f"WITH RECURSIVE {PACK} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY piece, ofs) - 1)::INTEGER AS pos, units::INTEGER AS units FROM x")
def packed_units(spark: SparkSession, d: str) -> DataFrame:
    units = chunking.split_sentences(table(spark, d, "documents").filter("text is not null").select("doc_id", "text")).select("doc_id", "pos", "sentence")
    return chunking.pack_units(units, "doc_id", "pos", "sentence").select("doc_id", "pos", "units")


@query("semantic_pieces", r"""WITH RECURSIVE u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, len(regexp_extract_all(coalesce(text, ''), '[一-鿿]|[a-zA-Z0-9_]+|[^\s]')) AS n, turn % 4 = 3 AS turned FROM conversations),
v AS (SELECT *, pos > 1 AND turned IS DISTINCT FROM lag(turned) OVER (PARTITION BY conv_id ORDER BY pos) AS far FROM u),
f AS (SELECT conv_id, pos, 0 AS piece, n AS held FROM v WHERE pos = 1 UNION ALL
  SELECT v.conv_id, v.pos, f.piece + (held >= 512 OR far OR held + v.n > 800)::INTEGER, CASE WHEN held >= 512 OR far OR held + v.n > 800 THEN v.n ELSE held + v.n END FROM f JOIN v ON v.conv_id = f.conv_id AND v.pos = f.pos + 1)
SELECT f.conv_id, piece AS pos, sum(v.n)::BIGINT AS units, count(*) AS paragraphs FROM f JOIN v ON f.conv_id = v.conv_id AND f.pos = v.pos GROUP BY ALL""")  # fmt: skip
def semantic_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Turns as paragraphs; every fourth points elsewhere."""
    v = F.when(F.col("turn") % 4 == 3, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.2)))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), v.alias("v"))
    return chunking.semantic_pieces(rows, "conv_id", "turn", "text", "v").select("conv_id", "pos", "units", "paragraphs")


# ---- support inside documents (D27-D30, D34, D35, D38, D46, D49) ----


@query("lexical_phrases", rf"""WITH {TURNS}, t AS (SELECT k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM c),
w AS (SELECT k, t, list_filter(list_transform(regexp_split_to_array(t, '\s+'), lambda x: trim(x, ' ，,：:')), lambda x: length({NORM.format('x')}) BETWEEN 2 AND 20) AS w FROM t),
p AS (SELECT k, list_concat(
  list_filter(flatten([[array_to_string(w[i:i + n - 1], '') for i in range(1, len(w) - n + 2)] for n in [4, 3, 2]]), lambda x: length({NORM.format('x')}) BETWEEN 6 AND 60),
  list_filter(w, lambda x: length({NORM.format('x')}) BETWEEN 6 AND 40),
  list_filter(list_transform(regexp_split_to_array(t, '[；;。？?]'), lambda x: trim(x, ' ，,：:')), lambda x: length({NORM.format('x')}) BETWEEN 6 AND 120)) AS p FROM w)
SELECT k, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i)[1:12], '|') AS phrases FROM p""")  # fmt: skip
def lexical_phrases(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("k", F.array_join(support.lexical_phrases(F.array("text")), "|").alias("phrases"))


SPOKEN = f"""{TURNS}, ph AS (SELECT conv_id AS question_id, n AS phrase_no, array_to_string(string_split_regex(trim(text), ' +')[a:b], ' ') AS phrase FROM c, (VALUES (0, 1, 6), (1, 4, 9), (2, 2, 40)) v(n, a, b) WHERE turn = 0),
pn AS (SELECT *, {NORM.format('phrase')} AS p FROM ph WHERE length({NORM.format('phrase')}) >= 6), tn AS (SELECT conv_id AS doc_id, turn AS pos, k AS chunk_id, {NORM.format('text')} AS t FROM c)"""


def spoken_phrases(spark: SparkSession, d: str) -> DataFrame:
    w = words(F.col("text"))
    part = lambda a, b: F.array_join(F.slice(w, a, b - a + 1), " ")
    rows = rowset(["phrase_no", "phrase"], (0, part(1, 6)), (1, part(4, 9)), (2, part(2, 40)))
    return table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("question_id"), F.explode(rows).alias("r")).select("question_id", "r.*", F.array().cast("array<string>").alias("figures"))


@query("phrase_evidence", f"""WITH {SPOKEN}, j AS (SELECT question_id, phrase_no, p, phrase, tn.doc_id, pos, chunk_id, contains(t, p) AS x, {RECALL.format(t='t', p='p')} AS r FROM pn JOIN tn ON tn.doc_id IN (question_id, question_id + 1)),
q AS (SELECT *, round(r + CASE WHEN x THEN 0.35 ELSE 0 END, 6) AS s FROM j WHERE x OR r >= 0.72),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id, phrase_no ORDER BY s DESC, doc_id, pos) AS n FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY phrase_no) AS m FROM b WHERE n = 1)
SELECT question_id, chunk_id, phrase, s AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY s DESC, length(p) DESC, phrase_no))::INTEGER AS rank FROM o WHERE m = 1) WHERE rank <= 6""")  # fmt: skip
def phrase_evidence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id").distinct()
    scope = c.select(F.col("conv_id").alias("question_id"), F.explode(F.array(F.col("conv_id"), F.col("conv_id") + 1)).alias("doc_id"))
    return support.phrase_support(spoken_phrases(spark, d), chunk_rows(spark, d, F.col("text")), scope).select("question_id", "chunk_id", "phrase", "score", "rank")


@query("definition_evidence", f"""WITH {TURNS}, q AS (SELECT DISTINCT conv_id AS question_id, conv_id % 3 AS m, 'term' || conv_id % 7 AS w FROM c),
t AS (SELECT *, CASE WHEN turn % 4 = 1 THEN 'term' || conv_id % 7 END AS w, lead(k) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM c),
i AS (SELECT question_id, w, m = 0 AND EXISTS (SELECT 1 FROM t o WHERE o.conv_id = question_id AND o.w = q.w) AS inside FROM q),
h AS (SELECT question_id, k, i.w, nxt, CASE WHEN inside THEN CASE WHEN question_id = conv_id THEN 'scope' END WHEN question_id % 7 < 4 THEN 'dictionary' ELSE 'corpus' END AS s FROM i JOIN t ON t.w = i.w),
f AS (SELECT * FROM h WHERE s IS NOT NULL)
SELECT question_id, k AS chunk_id, w AS term, s AS source, 1.5::DOUBLE AS score FROM f UNION ALL
SELECT DISTINCT question_id, nxt, w, 'successor', 1.4::DOUBLE FROM f WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f o WHERE o.question_id = f.question_id AND o.k = f.nxt)""")  # fmt: skip
def definition_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth turn defines a term; a third of the questions have a scope, a third a dictionary, the rest the corpus."""
    term = F.concat(F.lit("term"), (F.col("conv_id") % 7).cast("string"))
    defines = F.col("turn") % 4 == 1
    chunks = chunk_rows(spark, d, F.when(defines, F.concat(term, F.lit("是指"), F.col("text"))).otherwise(F.col("text")))
    q = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.concat(F.lit("“"), term, F.lit("”是如何定义的")).alias("question")).distinct()
    scope = q.filter("question_id % 3 = 0").select("question_id", F.col("question_id").alias("doc_id"))
    known = turns(spark, d).filter(defines & (F.col("conv_id") % 7 < 4)).select(term.alias("term_norm"), F.col("k").alias("chunk_id"))
    return support.definition_support(q, chunks, scope, known)


@query("list_continuations", f"""WITH {TURNS}, ph AS (SELECT conv_id AS question_id, {NORM.format("array_to_string(string_split_regex(trim(text), ' +')[1:6], ' ')")} AS p, array_to_string(string_split_regex(trim(text), ' +')[1:6], ' ') AS phrase FROM c WHERE turn = 2),
n AS (SELECT question_id, k, phrase, contains(t, p) AS x, {RECALL.format(t='t', p='p')} AS r FROM (SELECT question_id, phrase, p, k, {NORM.format('text')} AS t FROM ph JOIN c ON conv_id = question_id AND turn BETWEEN 1 AND 4 WHERE length(p) >= 6) WHERE EXISTS (SELECT 1 FROM c o WHERE o.conv_id = question_id AND o.turn = 0))
SELECT question_id, k AS chunk_id, phrase AS by, round(r + CASE WHEN x THEN 0.35 ELSE 0 END, 6) AS score FROM n WHERE x OR r >= 0.72""")  # fmt: skip
def list_continuations(spark: SparkSession, d: str) -> DataFrame:
    """Opening turns announce conditions; a phrase of the third turn is looked for behind them."""
    chunks = chunk_rows(spark, d, F.when(F.col("turn") == 0, F.concat(F.col("text"), F.lit("，应当同时满足以下条件："))).otherwise(F.col("text")))
    c = table(spark, d, "conversations")
    anchors = c.filter("turn = 0").select(F.col("conv_id").alias("question_id"), (F.col("conv_id") * 1000).alias("chunk_id"))
    phrases = c.filter("turn = 2").select(F.col("conv_id").alias("question_id"), F.array_join(F.slice(words(F.col("text")), 1, 6), " ").alias("phrase"))
    terms = phrases.select("question_id", F.lit("").alias("term"))
    return support.continue_list(anchors, chunks, phrases, terms).select("question_id", "chunk_id", "by", "score")


@query("table_units", """WITH r AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), c AS (SELECT o, count(*) AS rows_, bool_or(n = 1) AS hit FROM r GROUP BY o)
SELECT o AS question_id, 'scope' AS part, o * 100 AS chunk_id FROM c WHERE hit AND o % 3 > 0 UNION ALL SELECT o, 'summary', o * 100 + 1 FROM c WHERE hit
UNION ALL SELECT o, 'row', o * 100 + 1 + n FROM r JOIN c USING (o) WHERE hit AND (n = 1 OR (o % 2 = 0 AND rows_ BETWEEN 2 AND 8))""")  # fmt: skip
def table_units(spark: SparkSession, d: str) -> DataFrame:
    """An order is a document: a paragraph (a row of another table for every third), a summary, its lines."""
    o = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select(o.alias("doc_id"), F.col("l_linenumber").alias("n")).distinct()
    mine = F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    head = rowset(["n", "table_id", "table_role"], (-1, F.when(F.col("doc_id") % 3 == 0, "other"), F.when(F.col("doc_id") % 3 == 0, "row")), (0, mine, "summary"))
    heads = rows.select("doc_id").distinct().select("doc_id", F.explode(head).alias("r")).select("doc_id", "r.*")
    chunks = rows.select("doc_id", "n", mine.alias("table_id"), F.lit("row").alias("table_role")).unionByName(heads)
    chunks = chunks.select("doc_id", (F.col("doc_id") * 100 + F.col("n") + 1).alias("chunk_id"), F.col("n").alias("pos"), "table_id", "table_role")
    hits = rows.filter("n = 1").select(F.col("doc_id").alias("question_id"), (F.col("doc_id") * 100 + 2).alias("chunk_id"), (F.col("doc_id") % 2 == 0).alias("siblings"))
    return support.table_unit(hits, chunks).select("question_id", "part", "chunk_id")


@query("lead_items", f"""WITH {TURNS}, i AS (SELECT conv_id, turn, k, turn > 0 AND turn % 5 <> 4 AS item FROM c) SELECT a.conv_id AS question_id, b.k AS chunk_id, (b.turn - a.turn)::INTEGER AS step FROM i a JOIN i b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 1 AND a.turn + 3 AND b.item
WHERE a.turn % 5 = 4 OR a.turn = 0 AND NOT EXISTS (SELECT 1 FROM i x WHERE x.conv_id = a.conv_id AND x.turn > a.turn AND x.turn <= b.turn AND NOT x.item)""".replace("WHERE a.turn % 5 = 4 OR a.turn = 0 AND NOT", "WHERE (a.turn % 5 = 4 OR a.turn = 0) AND NOT"))  # fmt: skip
def lead_items(spark: SparkSession, d: str) -> DataFrame:
    """Turns 0, 4, 9, ... end in an open list, the others are items."""
    lead = (F.col("turn") % 5 == 4) | (F.col("turn") == 0)
    chunks = chunk_rows(spark, d, F.when(lead, F.concat(F.lit("范围包括："), F.lit(""))).otherwise(F.concat(F.lit("（一）"), F.col("text"))))
    sel = turns(spark, d).filter(lead).select(F.col("conv_id").alias("question_id"), F.col("k").alias("chunk_id"))
    return support.lead_continuation(sel, chunks).select("question_id", "chunk_id", "step")


@query("recovery_gate", """WITH m AS (SELECT s_suppkey AS aspect_id, s_suppkey % 5 = 0 AS def, coalesce(bool_or(l_quantity = 50 AND CASE WHEN s_suppkey % 5 = 0 THEN l_linenumber = 7 ELSE l_returnflag = 'R' AND l_discount * 10 >= 0.75 AND (s_suppkey % 2 = 1 OR l_partkey % 2 = 0) END), false) AS fine FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT aspect_id, CASE WHEN def THEN 'definition' ELSE 'phrases' END AS pass FROM m WHERE NOT fine""")  # fmt: skip
def recovery_gate(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    aspects = table(spark, d, "supplier").select(s.alias("aspect_id"), F.when(s % 5 == 0, "define").otherwise("explain").alias("intent"), F.array(F.lit("资本(a)")).alias("targets"))
    l = table(spark, d, "lineitem")  # noqa: E741
    text = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") == 50), "资本(a)，是指").otherwise("资本(a)")
    score = F.when((F.col("l_discount") * 10 >= 0.75) & (F.col("l_quantity") == 50), 0.6).otherwise(0.2)
    matches = l.select(F.col("l_suppkey").alias("aspect_id"), F.col("l_partkey").alias("doc_id"), text.alias("text"), F.when(F.col("l_returnflag") == "R", "direct").otherwise("related").alias("role"), score.alias("rerank_score"))
    scope = matches.filter("aspect_id % 2 = 0 and doc_id % 2 = 0").select("aspect_id", "doc_id").unionByName(aspects.filter("aspect_id % 2 = 0").select("aspect_id", F.lit(-2).cast("long").alias("doc_id")))
    return support.needs_recovery(aspects, matches, scope)


@query("document_references", """SELECT DISTINCT p_partkey AS from_id, CASE WHEN a % 5 < 4 THEN a * 10 + p_partkey % 3 + 1 ELSE a * 10 END AS chunk_id FROM (SELECT p_partkey, unnest([p_partkey % 50 + 1, p_partkey % 7 + 1]) AS a FROM part) WHERE a IN (SELECT p_partkey FROM part) AND (a % 5 < 4 OR p_partkey % 3 = 0)""")
def document_references(spark: SparkSession, d: str) -> DataFrame:
    """Parts cite two documents each; four documents of five have a clause index, the fifth one heading."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    cite = lambda a: F.concat(F.lit("《办法"), a.cast("string"), F.lit("号》第"), (k % 3 + 1).cast("string"), F.lit("条"))
    own = part.select(k.alias("doc_id"), (k * 10).alias("chunk_id"), F.when(k % 5 == 4, "第1条").alias("section_title"), F.lit("").alias("text"))
    citing = part.select(F.lit(-1).cast("long").alias("doc_id"), k.alias("chunk_id"), F.lit(None).cast("string").alias("section_title"), F.concat(F.lit("按"), cite(k % 50 + 1), F.lit("和"), cite(k % 7 + 1)).alias("text"))
    docs = part.select(k.alias("doc_id"), F.concat(F.lit("f"), k.cast("string")).alias("filename"), F.concat(F.lit("办法"), k.cast("string"), F.lit("号")).alias("title"))
    clauses = part.filter(k % 5 < 4).select(k.alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("clause_number")).withColumn("chunk_id", F.col("doc_id") * 10 + F.col("clause_number"))
    shifted = own.withColumn("chunk_id", F.col("chunk_id").cast("long")).unionByName(citing.withColumn("chunk_id", F.col("chunk_id").cast("long")))
    return support.cross_references(shifted, docs, clauses.withColumn("chunk_id", F.col("chunk_id").cast("long"))).filter("from_id < 1000000000").select("from_id", "chunk_id")


@query("object_references", """WITH r AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), m AS (SELECT o, max(n) AS top FROM r GROUP BY o)
SELECT a.o * 100 + a.n AS chunk_id, b.o * 100 + 50 + b.n AS target_id FROM r a JOIN r b ON a.o = b.o AND CASE WHEN a.n % 2 = 0 THEN b.n = a.n + 1 ELSE b.n = (SELECT min(x.n) FROM r x WHERE x.o = a.o AND x.n >= a.n) END""")  # fmt: skip
def object_references(spark: SparkSession, d: str) -> DataFrame:
    """Lines refer to tables: even ones to the table of the next number, odd ones to the next table below."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).distinct()
    even = F.col("n") % 2 == 0
    refs = r.select("doc_id", (F.col("doc_id") * 100 + F.col("n")).alias("chunk_id"), (F.col("n") * 10).alias("pos"), F.lit(0).alias("ref_no"), F.lit("table").alias("kind"), F.when(even, F.col("n") + 1).alias("number"), F.when(~even, "next").alias("direction"))
    objects = r.select("doc_id", F.lit("table").alias("kind"), F.col("n").alias("number"), F.col("n").cast("string").alias("identity"), (F.col("doc_id") * 100 + 50 + F.col("n")).alias("chunk_id"), (F.col("n") * 10 + 5).alias("chunk_pos"))
    return support.resolve_references(refs, objects).select("chunk_id", "target_id")


# ---- evidence contract (E2, E4, E5) ----

NAMED = """n AS (SELECT l_orderkey AS question_id, l_linenumber AS ln, min(l_partkey) AS part FROM lineitem GROUP BY ALL), e AS (SELECT n.*, p_name FROM n JOIN part ON part = p_partkey), q AS (SELECT question_id, min(ln) AS f FROM n GROUP BY ALL),
r AS (SELECT e.question_id, e.p_name AS wanted FROM e JOIN q ON e.question_id = q.question_id AND ln = f)"""


def named_evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(evidence, first names): an order's lines as evidence named after their parts; the first line's name is asked for."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("chunk_id")).agg(F.min("l_partkey").alias("doc_id"))
    e = n.join(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id")
    first = e.groupBy("question_id").agg(F.min_by("p_name", "chunk_id").alias("wanted"))
    return e, first


@query("source_matches", f"""WITH {NAMED} SELECT e.question_id, ln AS chunk_id, replace(lower(e.p_name), ' ', '') LIKE '%' || replace(lower(wanted), ' ', '') || '%' AND CASE WHEN e.question_id % 2 = 0 THEN part % 2 = 0 ELSE part % 4 + 1 = 2 END AS source_ok FROM e JOIN r USING (question_id)""")
def source_matches(spark: SparkSession, d: str) -> DataFrame:
    """A title with a year's edition (even orders) or a quarter (odd ones)."""
    e, first = named_evidence(spark, d)
    even = F.col("doc_id") % 2 == 0
    ev = e.select("question_id", "chunk_id", "doc_id", F.concat(F.lit("12_"), "p_name", F.lit("（"), F.when(even, "2023年").otherwise("2022年"), F.lit("）.pdf")).alias("filename"), F.lit(None).cast("string").alias("source_title"), F.lit("pdf").alias("file_type"), F.lit(None).cast("string").alias("version_status"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("month"), (F.col("doc_id") % 4 + 1).cast("int").alias("quarter"))
    qualifier = F.when(F.col("question_id") % 2 == 0, "（２０２３年版）").otherwise("(二季度)")
    req = first.select("question_id", F.lit("r").alias("requirement_id"), F.array(F.concat(F.lit("《"), F.upper("wanted"), F.lit("》"), qualifier)).alias("source_titles"))
    return contract.source_matches(req, ev).select("question_id", "chunk_id", "source_ok")


@query("requirement_bindings", f"""WITH {NAMED}, t AS (SELECT e.question_id, ln AS chunk_id, replace(lower(wanted), ' ', '') AS w, replace(lower(e.p_name || ' ' || e.p_name), ' ', '') AS t FROM e JOIN r USING (question_id) WHERE ln % 4 <> 0),
g AS (SELECT *, list_distinct([w[i:i + 2] for i in range(1, length(w) - 1)]) AS g FROM t)
SELECT question_id, chunk_id FROM g WHERE length(w) >= 8 AND (contains(t, w) OR len(list_filter(g, lambda x: contains(t, x))) >= greatest(2, len(g) // 3))""")  # fmt: skip
def requirement_bindings(spark: SparkSession, d: str) -> DataFrame:
    e, first = named_evidence(spark, d)
    none = F.array().cast("array<string>")
    ev = e.select("question_id", "chunk_id", F.concat_ws(" ", "p_name", "p_name").alias("text"), F.lit(None).cast("string").alias("section_title"), F.lit("").alias("identity"), F.when(F.col("chunk_id") % 4 == 0, F.array(F.lit("r"))).otherwise(none).alias("tags"))
    req = first.select("question_id", F.lit("r").alias("requirement_id"), F.lit(None).cast("string").alias("question"), F.lit("explain").alias("intent"), F.array("wanted").alias("target_terms"), none.alias("attribute_terms"))
    fits = e.select("question_id", F.lit("r").alias("requirement_id"), "chunk_id", F.lit(True).alias("source_ok"))
    return contract.bind_requirements(ev, req, fits).select("question_id", "chunk_id")


FACETS = """k AS (SELECT o_orderkey AS question_id, o_orderkey % 5 AS m, o_custkey % 2 = 0 AS good, o_custkey % 7 = 0 AS bare FROM orders),
s AS (SELECT *, CASE WHEN bare THEN 'unbound' WHEN good OR m = 4 THEN 'covered' WHEN m = 1 THEN 'missing' ELSE 'missing' END AS status FROM k)"""


def facet_reports(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    question = F.when(k == 0, "上限为5%").when(k == 1, "适用前提").when(k == 2, "列出清单").when(k == 3, "含义").otherwise("说明")
    good = F.when(k == 0, "不超过5.0%").when(k == 1, "但是").when(k == 2, "（一）甲；（二）乙").when(k == 3, "甲是指乙").otherwise("x")
    o = table(spark, d, "orders")
    none = F.array().cast("array<string>")
    req = o.select(F.col("o_orderkey").alias("question_id"), F.lit("r").alias("requirement_id"), (F.col("o_orderkey") % 3 > 0).alias("mandatory"), question.alias("question"), F.lit("explain").alias("intent"), none.alias("source_titles"), none.alias("target_terms"), F.lit(False).alias("needs_table"))
    bound = o.filter(c % 7 != 0).select(F.col("o_orderkey").alias("question_id"), F.lit("r").alias("requirement_id"), F.lit(1).alias("chunk_id"), F.when(c % 2 == 0, good).otherwise("无").alias("text"), F.lit(None).cast("string").alias("section_title"), F.lit("s").alias("source"), F.lit(False).alias("is_table"))
    return contract.facets(req, bound)


@query("facet_status", f"WITH {FACETS} SELECT question_id, status FROM s")
def facet_status(spark: SparkSession, d: str) -> DataFrame:
    return facet_reports(spark, d).select("question_id", "status")


@query("set_status", f"WITH {FACETS} SELECT question_id, CASE WHEN status = 'unbound' OR (question_id % 3 > 0 AND status = 'missing') THEN 'insufficient' ELSE 'sufficient' END AS status FROM s")
def set_status(spark: SparkSession, d: str) -> DataFrame:
    return contract.set_status(facet_reports(spark, d)).select("question_id", "status")


# ---- evaluation (G4, G6, G9, G11, G14, G15, G17, G20) ----

CASES = """k AS (SELECT o_orderkey AS case_id, o_orderpriority AS slice, o_totalprice AS v, o_orderkey % 9 = 0 AS err, o_orderkey % 8 = 0 AS ref, o_orderkey % 11 = 0 AS blank FROM orders), a AS (SELECT *, NOT err AND NOT ref AND NOT blank AS answered FROM k),
c AS (SELECT l_orderkey AS case_id, count(*) AS n, bool_or(l_linenumber = 2) AS st, bool_or(l_linenumber >= 2) AS br, bool_or(l_linenumber = 3) AS src, bool_or(l_linenumber = 4) AS val FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL)"""


def cited_cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    o = table(spark, d, "orders")
    cases = o.select(k.alias("case_id"), F.col("o_orderpriority").alias("slice"), F.when(k % 11 != 0, price).otherwise(" ").alias("answer"), (k % 8 == 0).alias("refused"), F.when(k % 9 == 0, "timeout").alias("error"), price.alias("gold"), F.concat(F.lit("Report "), k.cast("string"), F.lit("x")).alias("gold_title"), F.lit(None).cast("string").alias("gold_evidence"))
    n = F.col("l_linenumber")
    l = table(spark, d, "lineitem").filter(n < 6).join(o.select(k.alias("l_orderkey"), price.alias("price")), "l_orderkey")  # noqa: E741
    cites = l.select(F.col("l_orderkey").alias("case_id"), F.lit("f").alias("filename"), F.when(n == 3, F.concat(F.lit("《report "), F.col("l_orderkey").cast("string"), F.lit("X》"))).alias("source_title"), F.when(n == 4, F.concat(F.lit("为"), F.col("price"), F.lit("元"))).otherwise("无").alias("excerpt"), F.when(n >= 3, "总则").when(n == 2, "第三条").alias("section_title"), F.lit(None).cast("string").alias("structure_status"), F.lit(False).alias("is_cell"), F.lit(None).cast("int").alias("page"))
    return cases, cites.withColumn("source_title", F.regexp_replace("source_title", "[《》]", ""))


def _share(flag: str) -> str:
    return f"round(count_if(answered AND coalesce({flag}, false)) / nullif(count_if(answered), 0), 4)"


@query("citation_metrics", f"WITH {CASES} SELECT slice, count(*) AS total, count_if(answered)::BIGINT AS answered, {_share('n > 0')} AS cited_rate, {_share('st')} AS structured_rate, {_share('br')} AS broad_rate, {_share('src')} AS gold_source_rate, {_share('val')} AS gold_value_rate FROM a LEFT JOIN c USING (case_id) GROUP BY slice")
def citation_metrics(spark: SparkSession, d: str) -> DataFrame:
    cases, cites = cited_cases(spark, d)
    rows = scoring.citation_rows(cases, cites).join(cases.select("case_id", "slice"), "case_id")
    return scoring.citation_metrics(rows, ["slice"])


@query("evidence_set_report", """WITH q AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS n FROM lineitem), p AS (SELECT case_id, n, n > 1 AS doc, n = 2 OR n = 4 AS ex, n = 2 OR n = 4 OR n = 3 AS pre, n = 4 AS art FROM q),
g AS (SELECT case_id, count(*) AS required, round(avg(doc::INTEGER), 4) AS document_rate, round(avg(ex::INTEGER), 4) AS exact_rate, round(avg(pre::INTEGER), 4) AS prefix_rate, round(avg(art::INTEGER), 4) AS article_rate, count_if(n > 1) AS citations, CASE WHEN count_if(n > 1) > 0 THEN round(count_if(n = 4) / count_if(n > 1), 4) END AS sc FROM p GROUP BY ALL),
j AS (SELECT o_orderkey AS case_id, o_orderkey % 9 = 0 AS err, CASE WHEN o_orderkey % 2 = 0 THEN 'sufficient' WHEN o_orderkey % 3 = 0 THEN 'partial' END AS s, g.* FROM orders LEFT JOIN g ON o_orderkey = g.case_id)
SELECT count(*) AS "rows", count_if(NOT err)::BIGINT AS completed, count_if(err)::BIGINT AS errors, count_if(NOT err AND required IS NULL)::BIGINT AS without_gold, round(avg(document_rate) FILTER (NOT err), 4) AS document_rate, round(avg(exact_rate) FILTER (NOT err), 4) AS exact_rate, round(avg(prefix_rate) FILTER (NOT err), 4) AS prefix_rate, round(avg(article_rate) FILTER (NOT err), 4) AS article_rate,
  round(avg(sc) FILTER (NOT err), 4) AS structure_coverage, round(avg(coalesce(citations, 0)) FILTER (NOT err), 4) AS mean_citations, count_if(NOT err AND s = 'sufficient')::BIGINT AS sufficient, count_if(NOT err AND s = 'partial')::BIGINT AS partial, 0::BIGINT AS insufficient, count_if(NOT err AND s IS NULL)::BIGINT AS unrecorded FROM j""")  # fmt: skip
def evidence_set_report(spark: SparkSession, d: str) -> DataFrame:
    n, key = F.col("n"), F.concat_ws("k", F.col("case_id").cast("string"), F.col("n").cast("string"))
    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n")).distinct()
    start = F.concat(F.lit("the licensed institution shall report each item numbered "), F.rpad(key, 12, "z"))
    required = q.select("case_id", F.concat(F.lit("7_source "), key, F.lit(".pdf")).alias("path"), F.concat(start, F.lit(" within the period that is set")).alias("evidence"))
    excerpt = F.when((n == 2) | (n == 4), F.concat(F.upper(start), F.lit(", within the period that is set!".replace("!", "。")))).when(n == 3, F.concat(start, F.lit(" without a period"))).otherwise("无")
    cites = q.filter("n > 1").select("case_id", F.concat(F.lit("source-"), key, F.lit(".pdf")).alias("filename"), F.lit(None).cast("string").alias("source_title"), excerpt.alias("excerpt"), F.lit(None).cast("string").alias("section_title"), F.when(n == 4, "resolved").alias("structure_status"))
    k = F.col("o_orderkey")
    cases = table(spark, d, "orders").select(k.alias("case_id"), F.when(k % 9 == 0, "x").alias("error"), F.when(k % 2 == 0, "sufficient").when(k % 3 == 0, "partial").alias("sufficiency"))
    return scoring.evidence_sets(cases, scoring.evidence_rows(required, cites))


@query("manifest_scores", """WITH l AS (SELECT DISTINCT l_suppkey AS case_id, l_linenumber AS aspect_id, l_partkey AS chunk_id, l_orderkey FROM lineitem), w AS (SELECT DISTINCT case_id, aspect_id, chunk_id FROM l WHERE aspect_id < 6 AND l_orderkey % 3 = 0), u AS (SELECT DISTINCT case_id, chunk_id FROM w),
b AS (SELECT case_id, count(*) AS aspects, count_if(has) AS ev FROM (SELECT case_id, aspect_id, bool_or(aspect_id < 6 AND l_orderkey % 3 = 0) AS has FROM l GROUP BY ALL) GROUP BY ALL),
f AS (SELECT DISTINCT case_id, chunk_id FROM l WHERE l_orderkey % 20 = 0), c AS (SELECT DISTINCT case_id, chunk_id FROM l WHERE l_orderkey % 30 = 0), r AS (SELECT case_id, chunk_id, min(l_orderkey) AS rank FROM l WHERE l_orderkey % 10 = 0 GROUP BY ALL),
h AS (SELECT w.case_id, count(DISTINCT w.aspect_id) FILTER (f.chunk_id IS NOT NULL) AS fin, count(DISTINCT w.aspect_id) FILTER (c.chunk_id IS NOT NULL) AS cit, count(DISTINCT w.aspect_id) FILTER (r.chunk_id IS NOT NULL) AS rer FROM w LEFT JOIN f USING (case_id, chunk_id) LEFT JOIN c USING (case_id, chunk_id) LEFT JOIN r USING (case_id, chunk_id) GROUP BY w.case_id),
a AS (SELECT c.case_id, count(*) AS n, count(u.chunk_id) AS ok FROM c LEFT JOIN u USING (case_id, chunk_id) GROUP BY c.case_id), k AS (SELECT r.case_id, min(rank) AS best FROM r JOIN u USING (case_id, chunk_id) GROUP BY r.case_id)
SELECT b.case_id, aspects, ev AS evaluable, CASE WHEN ev > 0 THEN round(coalesce(fin, 0) / ev, 6) END AS final_recall, CASE WHEN ev > 0 AND EXISTS (SELECT 1 FROM r WHERE r.case_id = b.case_id) THEN round(coalesce(rer, 0) / ev, 6) END AS rerank_retention, CASE WHEN ev > 0 THEN round(coalesce(cit, 0) / ev, 6) END AS citation_completeness,
  CASE WHEN ev > 0 THEN round(ok / n, 6) END AS citation_accuracy, best AS best_rank FROM b LEFT JOIN h USING (case_id) LEFT JOIN a USING (case_id) LEFT JOIN k USING (case_id)""")  # fmt: skip
def manifest_scores(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("aspect_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("o"))  # noqa: E741
    fits = (F.col("aspect_id") < 6) & (F.col("o") % 3 == 0)
    aspects = l.groupBy("case_id", "aspect_id").agg(F.collect_set(F.when(fits, F.col("chunk_id"))).alias("acceptable"))
    pick = lambda n: l.filter(F.col("o") % n == 0).select("case_id", "chunk_id").distinct()
    reranked = l.filter("o % 10 = 0").groupBy("case_id", "chunk_id").agg(F.min("o").alias("rank"))
    return scoring.manifest_scores(aspects, pick(20), pick(30), reranked)


@query("run_summary", """WITH k AS (SELECT o_orderpriority AS p, o_orderstatus AS s, o_orderkey % 9 = 0 AS err, o_orderkey % 3 > 0 AS ok, o_orderkey % 4 = 0 AS src, o_orderkey % 10 = 0 AS ood, o_orderkey % 20 = 0 AS ref, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 > 0 END AS gr, o_orderkey % 13 = 0 AS ent, o_orderkey % 6 AS cit, o_custkey AS ms FROM orders)
SELECT p, s, count(*) AS cases, count_if(NOT err)::BIGINT AS completed, count_if(err)::BIGINT AS errors, round(avg(ok::INTEGER) FILTER (NOT err), 6) AS accuracy, round(avg(src::INTEGER) FILTER (NOT err AND NOT ood), 6) AS source_hit_rate, round(avg(gr::INTEGER) FILTER (NOT err), 6) AS grounding_pass_rate, round(avg(ent::INTEGER) FILTER (NOT err AND gr IS NOT NULL), 6) AS entity_error_rate,
  round(avg(ref::INTEGER) FILTER (NOT err AND ood), 6) AS ood_refusal_rate, round(avg((cit > 0)::INTEGER) FILTER (NOT err AND NOT ood), 6) AS citation_rate, round(avg(ms) FILTER (NOT err), 2) AS avg_ms, round(quantile_cont(ms, 0.5) FILTER (NOT err), 2) AS p50_ms, max(ms) FILTER (NOT err) AS max_ms FROM k GROUP BY GROUPING SETS ((p), (s), ())""")  # fmt: skip
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.when(k % 9 == 0, "x").alias("error"), (k % 3 > 0).alias("correct"), (k % 4 == 0).alias("source_hit"), (k % 10 == 0).alias("expected_refusal"),
        (k % 20 == 0).alias("refused"), F.when(k % 5 > 0, k % 7 > 0).alias("grounded"), (k % 13 == 0).alias("entity_error"), (k % 6).alias("citations"), F.col("o_custkey").alias("elapsed_ms"),
    )
    return scoring.run_summary(r, ["p", "s"])


@query("gold_files", """SELECT p_partkey AS ref_id, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 400 + 1 WHEN 1 THEN p_partkey ELSE p_partkey END AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'prefix' WHEN 1 THEN 'exact' ELSE 'containment' END AS method FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 400 + 1 <= (SELECT count(*) FROM part)""")
def gold_files(spark: SparkSession, d: str) -> DataFrame:
    """References by number, by equal title, and by part of a title."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    name = F.concat(F.lit("Rule no "), F.lpad(k.cast("string"), 7, "0"), F.lit(" of parts"))
    docs = part.select(k.alias("doc_id"), F.concat(F.when(k <= 400, F.concat(k.cast("string"), F.lit("_"))).otherwise(""), name, F.lit(".pdf")).alias("filename"), name.alias("title"))
    wanted = F.when(k % 3 == 1, F.lower(name)).when(k % 3 == 2, F.concat(F.lit("no "), F.lpad(k.cast("string"), 7, "0"), F.lit(" of part")))
    evidence = F.when(k % 3 == 0, F.concat(F.lit("a/"), (k % 400 + 1).cast("string"), F.lit("_any name.xlsx；x")))
    refs = part.select(k.alias("ref_id"), F.coalesce(evidence, F.lit("")).alias("evidence"), F.coalesce(wanted, F.lit("")).alias("source_title"))
    return scoring.resolve_gold_docs(refs, docs)


@query("entity_errors", """WITH k AS (SELECT o_orderkey, o_orderkey % 9 > 0 AS answered, o_orderkey % 2 = 0 AS passed, o_orderkey % 5 = 0 AS num, o_orderkey % 7 = 0 AS per, o_orderkey % 11 = 0 AS tit FROM orders), b AS (SELECT * FROM k WHERE answered AND NOT passed AND (num OR per OR tit))
SELECT (SELECT count(*) * 2 FROM k WHERE answered)::BIGINT AS facts_total, count(*) AS error_facts, count_if(num)::BIGINT AS number_conflicts, count_if(per)::BIGINT AS period_conflicts, count_if(tit)::BIGINT AS title_conflicts, round(count(*) / (SELECT count(*) * 2 FROM k WHERE answered), 4) AS error_rate FROM b""")  # fmt: skip
def entity_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda num, per, tit: F.concat(F.lit("《"), tit, F.lit("》中"), per, F.lit("季度余额为"), num, F.lit("亿元"))
    gold = text(F.lit("8123.5"), F.lit("一"), F.lit("资本办法"))
    said = text(F.when(k % 5 == 0, "77001").otherwise("8,130"), F.when(k % 7 == 0, "三").otherwise("一"), F.when(k % 11 == 0, "其他办法").otherwise("资本办法"))
    o = table(spark, d, "orders")
    cases = o.select(k.alias("case_id"), said.alias("answer"), F.lit(False).alias("refused"), F.when(k % 9 == 0, "x").alias("error"), (k % 2 == 0).alias("passed"), F.lit(2).alias("facts_total"))
    return scoring.entity_error_rate(cases, o.select(k.alias("case_id"), gold.alias("conclusion")))


@query("inferred_options", """SELECT o_orderkey AS case_id, CASE o_orderkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' END AS option, CASE o_orderkey % 4 WHEN 0 THEN 'letter' WHEN 1 THEN 'number' ELSE 'containment' END AS rule FROM orders WHERE o_orderkey % 4 < 3""")
def inferred_options(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.col("o_custkey") * 10
    answer = F.when(k % 4 == 0, "答案为 b。理由[1]").when(k % 4 == 1, F.concat(F.lit("约为"), F.format_number(v + 2, 2), F.lit("，见[99]"))).when(k % 4 == 2, "应为 Chart-D 与补充").otherwise("无法判断")
    o = table(spark, d, "orders")
    numeric = rowset(["option", "option_text"], ("A", v.cast("string")), ("B", (v + 1).cast("string")), ("C", F.format_number(v + 2, 0)), ("D", (v + 3).cast("string")))
    named = rowset(["option", "option_text"], ("A", "ch"), ("B", "art"), ("C", "none of these"), ("D", "Chart D"))
    options = o.select(k.alias("case_id"), F.explode(F.when(k % 4 == 2, named).otherwise(numeric)).alias("r")).select("case_id", "r.*")
    return scoring.infer_option(o.select(k.alias("case_id"), answer.alias("answer")), options)


@query("answer_flags", """SELECT o_orderkey AS case_id, o_orderkey % 3 = 0 AS wrong_option, o_orderkey % 5 = 0 AS supported, (o_orderkey % 2 <> 0 AND o_orderkey % 5 = 0) OR (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) AS needs_review FROM orders""")
def answer_flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    other = "another option that is worded at length"
    rows = o.select(k.alias("case_id"), F.lit("the gold option that is worded at length").alias("gold"), F.when(k % 3 == 0, f"it is: {other.upper()}").otherwise("none").alias("answer"), F.when(k % 2 == 0, "match").otherwise("mismatch").alias("outcome"))
    options = o.select(k.alias("case_id"), F.explode(F.array(F.lit(other), F.lit("short"))).alias("option_text"))
    cites = o.select(k.alias("case_id"), F.when(k % 5 == 0, "see The Gold Option (that is worded at length)").otherwise("other").alias("excerpt"))
    return scoring.answer_flags(rows, options, cites).select("case_id", "wrong_option", "supported", "needs_review")


# ---- encoders, postings, statements, outlines, layouts, sources (D1, D2, D32, D50, C17, F20) ----


@query("hashed_embeddings", r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM benchmark), p AS (SELECT item_id, ('0x' || md5(w)[1:8])::BIGINT % 64 AS place, count(*)::DOUBLE AS n FROM w GROUP BY ALL)
SELECT item_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 9) AS value FROM p""")
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = search.embed(table(spark, d, "benchmark"), "item_id")
    return v.select("item_id", F.posexplode("vector").alias("p", "x")).filter("x > 0").select("item_id", F.col("p").cast("long").alias("place"), F.round("x", 9).alias("value"))


@query("weight_postings", """SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_partkey AS part, l_suppkey AS supp, u.t AS token, u.w AS weight FROM lineitem, unnest([{'t': 'tax', 'w': l_tax}, {'t': 'discount', 'w': l_discount}, {'t': 'quantity', 'w': l_quantity::DOUBLE}]) AS x(u) WHERE u.w <> 0""")
def weight_postings(spark: SparkSession, d: str) -> DataFrame:
    names = ("tax", "discount", "quantity")
    m = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"l_{n}").cast("double").cast("string"))], F.lit("flag"), F.lit("heavy"), F.lit("none"), F.lit(None).cast("string"))
    rows = table(spark, d, "lineitem").select(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).alias("k"), m.alias("weights"))
    return search.to_postings(rows, "k").select("k.*", "token", "weight")


@query("statement_evidence", f"""WITH {TURNS}, s AS (SELECT conv_id AS question_id, array_to_string(string_split_regex(trim(text), ' +')[a:b], ' ') AS statement FROM c, (VALUES (1, 9), (3, 12)) v(a, b) WHERE turn = 0),
u AS (SELECT DISTINCT question_id, unnest(list_concat([statement], list_filter(list_transform(string_split_regex(statement, '[；;，,]'), lambda x: trim(x, ' ')), lambda x: length({NORM.format('x')}) >= 4))) AS statement FROM s WHERE trim(statement) <> ''),
j AS (SELECT question_id, statement, k AS chunk_id, turn AS pos, {NORM.format('statement')} AS p, {NORM.format('text')} AS t FROM u JOIN c ON conv_id = question_id),
r AS (SELECT *, round({RECALL.format(t='t', p='p')}, 6) AS score FROM j WHERE length(p) > 1),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id, statement ORDER BY score DESC, pos) AS n FROM r WHERE score >= 0.45),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY score DESC, length(statement) DESC, statement) AS m FROM b WHERE n = 1)
SELECT question_id, 'support' AS role, rank, chunk_id, statement, score FROM (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, length(statement) DESC, statement, chunk_id))::INTEGER AS rank FROM o WHERE m = 1) WHERE rank <= 10""")  # fmt: skip
def statement_evidence(spark: SparkSession, d: str) -> DataFrame:
    w = words(F.col("text"))
    part = lambda a, b: F.array_join(F.slice(w, a, b - a + 1), " ")
    first = table(spark, d, "conversations").filter("turn = 0")
    s = first.select(F.col("conv_id").alias("question_id"), F.explode(support.statements_of(F.array(part(1, 9), part(3, 12)))).alias("statement"))
    scope = first.select(F.col("conv_id").alias("question_id"), F.col("conv_id").alias("doc_id"))
    return support.statement_support(s, chunk_rows(spark, d, F.col("text")), scope)


@query("section_outlines", """WITH r AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), g AS (SELECT o, min(n) AS f, count(*) AS c, string_agg('（' || ['一','二','三','四','五','六','七'][n] || '）item ' || n, '|' ORDER BY n) AS s FROM r GROUP BY o)
SELECT o AS question_id, o * 10 + f AS chunk_id, CASE WHEN c >= 2 THEN s ELSE '' END AS outline FROM g WHERE o % 3 = 0""")
def section_outlines(spark: SparkSession, d: str) -> DataFrame:
    """An order is a document of one part, its lines are the part's chunks; every third order is asked for."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).distinct()
    mark = F.element_at(F.array(*[F.lit(x) for x in "一二三四五六七"]), F.col("pos"))
    text = F.concat(F.lit("\n （"), mark, F.lit("）item  "), F.col("pos").cast("string"), F.lit("\nbody"))
    chunks = r.select("doc_id", (F.col("doc_id") * 10 + F.col("pos")).alias("chunk_id"), "pos", F.array(F.lit("总则"), F.lit("风险管理部分")).alias("section_path"), text.alias("text"))
    asked = r.select("doc_id").distinct().select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, "风险管理部分包括哪些").otherwise("风险管理部分").alias("question"))
    out = support.section_outline(asked, chunks, asked.select("question_id", F.col("question_id").alias("doc_id")))
    return out.select("question_id", "chunk_id", F.array_join("outline", "|").alias("outline"))


@query("grid_layouts", """WITH g AS (SELECT n_name AS sheet, n_nationkey AS k, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT sheet, (3 + k % 2)::INTEGER AS first_row, 2 AS first_col, (7 + k % 2)::INTEGER AS data_row, '年度 / 名称|2024 / 余额|2024 / 段' AS headers, '1,3' AS label_cols FROM g""")
def grid_layouts(spark: SparkSession, d: str) -> DataFrame:
    """A nation's customers as a sheet: title, unit, two header rows, then a row per customer."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    top = (F.col("n_nationkey") % 2 + 3).cast("int")
    from pyspark.sql.window import Window as W

    at = (F.row_number().over(W.partitionBy("n_name").orderBy("c_custkey")) + top + 3).cast("int")
    c = c.withColumn("at", at)
    at = F.col("at")
    body = c.select(F.col("n_name").alias("sheet"), F.explode(rowset(["row", "col", "value"], (at, 2, F.col("c_name")), (at, 3, F.format_number("c_acctbal", 2)), (at, 4, F.col("c_mktsegment")))).alias("r")).select("sheet", "r.*")
    head = rowset(["row", "col", "value"], (top - 2, 1, " "), (top, 2, "统计表"), (top + 1, 4, "单位：元"), (top + 2, 2, "年度"), (top + 2, 3, "2024 "), (top + 2, 4, "2024 "), (top + 3, 2, "名称"), (top + 3, 3, "余额"), (top + 3, 4, "段"))
    heads = c.select(F.col("n_name").alias("sheet"), "n_nationkey").distinct().select("sheet", F.explode(head).alias("r")).select("sheet", "r.*")
    out = grids.infer_layout(body.unionByName(heads), ["sheet"])
    return out.select("sheet", "first_row", "first_col", "data_row", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("label_cols", lambda x: x.cast("string")), ",").alias("label_cols"))


@query("question_sources", """SELECT n_nationkey * 100 + m AS question_id, lower('Orders of ' || n_name) || '2024年' || m || '月' AS source_title FROM nation n, unnest([1, 2, 11]) AS u(m) WHERE m < 11 AND (SELECT count(*) FROM nation o WHERE contains(n.n_name, o.n_name)) = 1""")
def question_sources(spark: SparkSession, d: str) -> DataFrame:
    """Titles by nation and month; a question that holds two titles has none, as has month 11."""
    n = table(spark, d, "nation")
    month = lambda *ms: F.explode(F.array(*[F.lit(m) for m in ms]))
    titles = n.select("n_name", month(1, 2, 12).alias("m")).select(F.lower(F.concat(F.lit("7_Orders of "), "n_name", F.lit("2024年"), F.col("m").cast("string"), F.lit("月.xlsx"))).alias("source_title"))
    q = n.select("n_nationkey", "n_name", month(1, 2, 11).alias("m")).select((F.col("n_nationkey") * 100 + F.col("m")).alias("question_id"), F.concat(F.lit("2024年"), F.col("m").cast("string"), F.lit("月《Orders of "), "n_name", F.lit("》情况？")).alias("question"))
    none = F.lit(None).cast("int")
    return tb.match_source(q.select("question_id", "question", none.alias("year"), none.alias("month"), none.alias("quarter")), titles)
