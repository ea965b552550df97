"""Queries for evaluation, integrity, identity, tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as ev
from ..operators import identity, integrity, metadata
from ..operators import tables as tb
from ..sources import indexes
from ..streaming import events as evs
from .tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- evaluation: orders as cases, two runs told apart by price and status ----


@query("rates_by_slice", """SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")  # fmt: skip
def rates_by_slice(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") > 250000).alias("passed"))
    return ev.rate_by(o, "passed", ["status", "priority"])


LAT = "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean, quantile_cont(o_totalprice, 0.5) AS p50, max(o_totalprice) AS max, {} AS p95 FROM {} GROUP BY o_orderpriority"


@query("latency_stats", LAT.format("quantile_disc(o_totalprice, 0.95)", "orders"))
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return ev.latency_stats(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


@query("latency_stats_rounded", LAT.format("max(CASE WHEN r = round_even(0.95 * (c - 1), 0) THEN o_totalprice END)", "(SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders)"))
def latency_stats_rounded(spark: SparkSession, d: str) -> DataFrame:
    return ev.latency_stats(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"], "round")


#: A half cent is one of the shortest decimal form, rounded up, as F.round does; round() of a double scales it in binary first.
ANSWERS_SQL = """a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, 'total ' || l_extendedprice::DECIMAL(18,2)::VARCHAR || ' units' AS gold,
  CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 6 THEN NULL ELSE 'about ' || (l_extendedprice * (1 + l_discount / 50))::VARCHAR::DECIMAL(38,15)::DECIMAL(18,2)::VARCHAR END AS answer,
  l_returnflag = 'R' AS refused, CASE WHEN l_linenumber = 5 THEN 'timeout' END AS error FROM lineitem),
s AS (SELECT *, CASE WHEN answer IS NOT NULL AND len(list_filter(list_transform(regexp_extract_all(answer, '[-+]?\\d+(?:,\\d{3})*(?:\\.\\d+)?'), lambda x: x::DOUBLE),
  lambda x: abs(l_extendedprice::DECIMAL(18,2)::DOUBLE - x) <= greatest(0.01, abs(l_extendedprice::DECIMAL(18,2)::DOUBLE) * 0.001::DOUBLE))) > 0 THEN 1.0 ELSE 0.0 END AS score FROM a),
o AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN trim(coalesce(answer, '')) = '' THEN 'empty' WHEN refused AND score >= 0.75 THEN 'refusal_with_fact' WHEN refused THEN 'refusal' WHEN score >= 1 THEN 'match' ELSE 'mismatch' END AS outcome FROM s)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    l = table(spark, d, "lineitem")  # noqa: E741
    near = F.concat(F.lit("about "), money(F.round(F.col("l_extendedprice") * (1 + F.col("l_discount") / 50), 2)))
    n = F.col("l_linenumber")
    return l.select("*", F.concat(F.lit("total "), money(F.col("l_extendedprice")), F.lit(" units")).alias("gold"), F.when(n == 7, "").when(n == 6, None).otherwise(near).alias("answer"), (F.col("l_returnflag") == "R").alias("refused"), F.when(n == 5, "timeout").alias("error"))


@query("score_answers", f"WITH {ANSWERS_SQL} SELECT l_linenumber, outcome, count(*) AS n, sum(score) AS score FROM o GROUP BY ALL".replace("\\\\", "\\"))
def score_answers(spark: SparkSession, d: str) -> DataFrame:
    return ev.score_answers(answers(spark, d)).groupBy("l_linenumber", "outcome").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("score_summary", f"""WITH {ANSWERS_SQL} SELECT l_linestatus, count(*) AS n, count_if(outcome IN ('match', 'mismatch'))::BIGINT AS answered, count_if(outcome = 'match')::BIGINT AS correct,
round(count_if(outcome = 'match') / count(*), 6) AS accuracy, round(count_if(outcome = 'match') / nullif(count_if(outcome IN ('match', 'mismatch')), 0), 6) AS accuracy_answered
FROM o GROUP BY l_linestatus""".replace("\\\\", "\\").replace("l_quantity, 'total", "l_quantity, l_linestatus, 'total"))  # fmt: skip
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.score_summary(ev.score_answers(answers(spark, d)), ["l_linestatus"])


@query("option_by_number", """WITH p AS (SELECT o_orderkey AS case_id, floor(o_totalprice) AS x FROM orders), o AS (SELECT l_orderkey AS case_id, l_linenumber AS option, max(floor(l_extendedprice)) AS y FROM lineitem GROUP BY ALL),
g AS (SELECT case_id, option, abs(x - y) AS gap, y FROM p JOIN o USING (case_id) WHERE abs(x - y) <= greatest(0.02, 1e-4 * y) OR false)
SELECT case_id, arg_min(option, (gap, option)) AS option FROM g GROUP BY case_id""")  # fmt: skip
def option_by_number(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.floor("o_totalprice").cast("string").alias("answer"))
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("option")).agg(F.max(F.floor("l_extendedprice")).cast("string").alias("option_text"))
    return ev.option_by_number(a, o)


@query("set_recall", """WITH e AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS e, list(DISTINCT l_partkey) FILTER (l_discount >= 0.05) AS g FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN len(e) > 0 THEN round(len(list_intersect(e, coalesce(g, []))) / len(e), 6) END AS recall, coalesce(list_has_any(e, g), false) AS any_hit FROM e""")  # fmt: skip
def set_recall(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("e"), F.collect_set(F.when(F.col("l_discount") >= 0.05, F.col("l_partkey"))).alias("g"))
    return ev.set_recall(e, "e", "g").select("l_orderkey", "recall", "any_hit")


@query("holdout_split", """WITH h AS (SELECT c_custkey, c_mktsegment, sha256('42:' || c_custkey) AS k FROM customer),
r AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY k, c_custkey) AS r FROM h),
l AS (SELECT *, NOT r <= greatest(1, round_even(n * 0.2, 0)) AS late FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY late, CASE WHEN NOT late THEN k END DESC NULLS LAST, k, c_custkey) AS p FROM l) SELECT c_custkey, p <= 60 AS holdout FROM o""")  # fmt: skip
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return ev.split_holdout(table(spark, d, "customer"), ["c_mktsegment"], 60, case="c_custkey").select("c_custkey", "holdout")


@query("ood_probes", r"""SELECT p_partkey AS case_id, CASE WHEN regexp_matches(q, '(?:19|20)\d{2}') THEN regexp_replace(q, '(?:19|20)\d{2}', '2099', 'g') ELSE '虚构指标：' || q END AS probe
FROM (SELECT p_partkey, p_name || ' ' || p_partkey AS q FROM part WHERE p_partkey % 10 = 0 ORDER BY p_partkey LIMIT 30)""")  # fmt: skip
def ood_probes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("question"))
    return ev.make_ood(q).select("case_id", "probe")


@query("failure_crosstab", """SELECT l_returnflag, count_if(l_linestatus = 'F')::BIGINT AS F, count_if(l_linestatus = 'O')::BIGINT AS O FROM lineitem GROUP BY ALL""")
def failure_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return ev.failure_crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


RUNS_SQL = "a AS (SELECT o_orderkey AS case_id, o_totalprice > 200000 AS passed, o_orderstatus AS s, o_orderpriority AS p, o_custkey::DOUBLE AS ms FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS case_id, o_totalprice > 250000 OR o_orderkey % 5 = 0 AS passed, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s, o_orderpriority AS p, (o_custkey * 2)::DOUBLE AS ms FROM orders WHERE o_orderkey % 11 <> 0)"


def runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    a = o.filter(k % 7 != 0).select(k.alias("case_id"), (F.col("o_totalprice") > 200000).alias("passed"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_custkey").cast("double").alias("ms"))
    b = o.filter(k % 11 != 0).select(k.alias("case_id"), ((F.col("o_totalprice") > 250000) | (k % 5 == 0)).alias("passed"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("s"), F.col("o_orderpriority").alias("p"), (F.col("o_custkey") * 2).cast("double").alias("ms"))
    return a, b


@query("diff_runs", f"""WITH {RUNS_SQL} SELECT case_id, CASE WHEN a.passed IS NULL THEN 'missing_left' WHEN b.passed IS NULL THEN 'missing_right' WHEN a.passed AND NOT b.passed THEN 'regressed' WHEN NOT a.passed AND b.passed THEN 'regained' ELSE 'kept' END AS change FROM a FULL JOIN b USING (case_id)""")
def diff_runs(spark: SparkSession, d: str) -> DataFrame:
    return ev.diff_runs(*runs(spark, d))


@query("run_delta", f"""WITH {RUNS_SQL}, j AS (SELECT a.passed AS x, b.passed AS y FROM a FULL JOIN b USING (case_id)), r AS (SELECT (SELECT round(avg(passed::INTEGER), 6) FROM a) AS l, (SELECT round(avg(passed::INTEGER), 6) FROM b) AS r)
SELECT l AS rate_left, r AS rate_right, count_if(x AND NOT y)::BIGINT AS regressed, count_if(NOT x AND y)::BIGINT AS regained, count_if(x = y)::BIGINT AS kept, count_if(x IS NULL)::BIGINT AS missing_left, count_if(y IS NULL)::BIGINT AS missing_right, round(r - l, 6) AS delta FROM j, r GROUP BY l, r""")
def run_delta(spark: SparkSession, d: str) -> DataFrame:
    a, b = runs(spark, d)
    return ev.run_delta(ev.diff_runs(a, b), a, b)


@query("compare_runs", f"""WITH {RUNS_SQL}, j AS (SELECT a.case_id IS NOT NULL AND b.case_id IS NOT NULL AS both_, a.case_id IS NULL AS ml, b.case_id IS NULL AS mr, a.ms AS ams, b.ms AS bms, a.passed IS DISTINCT FROM b.passed AS x, a.s IS DISTINCT FROM b.s AS y, a.p IS DISTINCT FROM b.p AS z FROM a FULL JOIN b ON a.case_id = b.case_id),
g AS (SELECT count_if(both_)::BIGINT AS cases, count_if(ml)::BIGINT AS missing_left, count_if(mr)::BIGINT AS missing_right, round(avg(ams), 6) AS mean_ms_left, round(avg(bms), 6) AS mean_ms_right, [count_if(both_ AND x), count_if(both_ AND y), count_if(both_ AND z)] AS n FROM j)
SELECT cases, missing_left, missing_right, mean_ms_left, mean_ms_right, ['passed', 's', 'p'][i] AS field, n[i]::BIGINT AS differing FROM g, unnest([1, 2, 3]) AS u(i)""")  # fmt: skip
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    return ev.compare_runs(*runs(spark, d), ["passed", "s", "p"], ms="ms")


# ---- integrity: documents as chunks of their source, orders and line items as ledger and rows ----


@query("chunk_quality", r"""SELECT source, count(*) AS chunks, count_if(trim(coalesce(text, ''), ' ') = '')::BIGINT AS empty, sum(len(regexp_extract_all(coalesce(text, ''), '\x{FFFD}')))::BIGINT AS replacement_chars,
sum(len(regexp_extract_all(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]')))::BIGINT AS control_chars, count(*) - count(DISTINCT regexp_replace(lower(text), '[\s\x0B]+', '', 'g')) AS repeated, count_if(length(coalesce(text, '')) < 20)::BIGINT AS short,
count(*) - count(DISTINCT regexp_replace(lower(text), '[\s\x0B]+', '', 'g')) > greatest(2.0, count(*) / 10) AS too_many_repeats FROM documents GROUP BY source""")  # fmt: skip
def chunk_quality(spark: SparkSession, d: str) -> DataFrame:
    return integrity.check_chunks(table(spark, d, "documents"), "source")


@query("chunk_distribution", """SELECT c_mktsegment, count(*) AS documents, min(n) AS min, quantile_cont(n, 0.5) AS median, quantile_disc(n, 0.95)::DOUBLE AS p95, max(n) AS max
FROM (SELECT c_mktsegment, c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY ALL""")  # fmt: skip
def chunk_distribution(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return integrity.chunk_distribution(o, "c_custkey", "c_mktsegment")


@query("corpus_checks", """WITH have AS (SELECT l_orderkey AS doc_id, count(*) AS h FROM lineitem GROUP BY ALL), led AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS w, coalesce(h, 0) AS h FROM orders LEFT JOIN have ON o_orderkey = doc_id)
SELECT 'duplicate_name' AS "check", (o_custkey % 1000)::VARCHAR AS subject, count(*) AS value FROM orders GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'chunk_count', doc_id::VARCHAR, h - w FROM led WHERE h <> w UNION ALL SELECT 'empty_document', doc_id::VARCHAR, 0 FROM led WHERE h = 0""")  # fmt: skip
def corpus_checks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 1000).alias("name"), (F.col("o_orderkey") % 5).alias("chunk_count"))
    return integrity.check_corpus(docs, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


@query("cell_reconcile", """WITH c AS (SELECT o_orderkey AS k, 1 + o_orderkey % 6 AS n FROM orders), h AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT k, coalesce(c.n, 0) AS claimed, coalesce(h.n, 0) AS have FROM c FULL JOIN h USING (k) WHERE coalesce(c.n, 0) <> coalesce(h.n, 0)""")  # fmt: skip
def cell_reconcile(spark: SparkSession, d: str) -> DataFrame:
    claimed = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 6).alias("n"))
    return integrity.check_cells(claimed, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("orphan_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"))
    return integrity.orphans(table(spark, d, "lineitem"), parents, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("vector_reconcile", """WITH a AS (SELECT vec_id, label % 3 AS v FROM embeddings WHERE vec_id % 9 <> 0), b AS (SELECT vec_id, label % 4 AS v FROM embeddings WHERE vec_id % 10 <> 0)
SELECT vec_id, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'extra' ELSE 'version' END AS finding FROM a FULL JOIN b USING (vec_id) WHERE a.v IS DISTINCT FROM b.v""")  # fmt: skip
def vector_reconcile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return integrity.reconcile(e.filter("vec_id % 9 <> 0").select("vec_id", (F.col("label") % 3).alias("v")), e.filter("vec_id % 10 <> 0").select("vec_id", (F.col("label") % 4).alias("v")), ["vec_id"], "v")


@query("baseline_diff", f"""WITH {RUNS_SQL} SELECT case_id, unnest(list_filter([CASE WHEN b.case_id IS NULL THEN 'added' END, CASE WHEN a.case_id IS NULL THEN 'missing' END,
  CASE WHEN a.case_id IS NOT NULL AND b.case_id IS NOT NULL AND a.passed IS DISTINCT FROM b.passed THEN 'changed_passed' END, CASE WHEN a.case_id IS NOT NULL AND b.case_id IS NOT NULL AND a.s IS DISTINCT FROM b.s THEN 'changed_s' END], lambda x: x IS NOT NULL)) AS change
FROM a FULL JOIN b USING (case_id)""")  # fmt: skip
def baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = runs(spark, d)
    return integrity.diff_baseline(a, b, "case_id", ["passed", "s"])


@query("metadata_coverage", """WITH c AS (SELECT count(*) AS documents, count(nullif(trim(lang), '')) AS lang, count(nullif(trim(source), '')) AS source, count(nullif(trim(CASE WHEN quality = 1 THEN 'x' END), '')) AS q FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT documents, 'lang' AS field, lang AS filled FROM c UNION ALL SELECT documents, 'source', source FROM c UNION ALL SELECT documents, 'checked', q FROM c""")  # fmt: skip
def metadata_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("checked", F.when(F.col("quality") == 1, "x"))
    return integrity.metadata_coverage(docs, ["lang", "source", "checked"])


@query("chunking_compare", r"""WITH c AS (SELECT conv_id, turn, role, text, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS x, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prv FROM conversations),
n0 AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN -turn ELSE turn END AS p, CASE WHEN conv_id % 7 = 3 AND turn = 0 THEN 'x' ELSE role END AS role,
  CASE WHEN conv_id % 5 = 0 THEN x || '!' WHEN conv_id % 5 = 1 THEN coalesce(right(regexp_replace(prv, '\s+', '', 'g'), 1), '') || CASE WHEN nxt IS NULL THEN x ELSE left(x, length(x) - 1) END ELSE x END AS x FROM c),
o AS (SELECT conv_id, list(x ORDER BY turn) AS o, list(x ORDER BY x) AS m, list(role ORDER BY turn) AS s, string_agg(x, chr(10) ORDER BY turn) FILTER (x <> '') AS j FROM c GROUP BY ALL),
n AS (SELECT conv_id, list(x ORDER BY p) AS o, list(x ORDER BY x) AS m, list(role ORDER BY p) AS s, string_agg(x, chr(10) ORDER BY p) FILTER (x <> '') AS j FROM n0 GROUP BY ALL),
k AS (SELECT conv_id, CASE WHEN o.o = n.o AND o.s = n.s THEN 'identical' WHEN o.o = n.o THEN 'structure_only' WHEN o.m = n.m THEN 'order_only' ELSE 'different' END AS kind,
  list_distinct(list_transform(range(1, length(o.j)), lambda i: substr(o.j, i, 2))) AS a, list_distinct(list_transform(range(1, length(n.j)), lambda i: substr(n.j, i, 2))) AS b FROM o JOIN n USING (conv_id)),
g AS (SELECT conv_id, kind, CASE WHEN kind = 'different' THEN least(len(list_intersect(a, b))::DOUBLE / len(a), len(list_intersect(a, b))::DOUBLE / len(b)) END AS v FROM k)
SELECT conv_id, CASE WHEN v >= 0.98 THEN 'boundary_only' ELSE kind END AS kind, round(v, 6) AS coverage FROM g""")  # fmt: skip
def chunking_compare(spark: SparkSession, d: str) -> DataFrame:
    """A third of the conversations runs backwards, a fifth has marks added, a fifth passes each turn's last letter on to the next."""
    from pyspark.sql.window import Window as W

    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    w = W.partitionBy("conv_id").orderBy("turn")
    i, x = F.col("conv_id"), T.squeeze(F.col("text"))
    c = c.withColumn("x", x).withColumn("before", F.lag("x").over(w)).withColumn("last", F.lead("text").over(w).isNull())
    moved = F.concat(F.coalesce(F.right("before", F.lit(1)), F.lit("")), F.when(F.col("last"), F.col("x")).otherwise(F.left("x", F.char_length("x") - 1)))
    text = F.when(i % 5 == 0, F.concat("x", F.lit("!"))).when(i % 5 == 1, moved).otherwise(F.col("x"))
    new = c.select("conv_id", F.when(i % 3 == 0, -F.col("turn")).otherwise(F.col("turn")).alias("turn"), F.when((i % 7 == 3) & (F.col("turn") == 0), "x").otherwise(F.col("role")).alias("role"), text.alias("text"))
    return integrity.compare_chunkings(c.withColumn("text", F.col("x")), new, "conv_id", "turn", "text", ["role"])


@query("metadata_audit", """SELECT l_linenumber AS copy_id, l_orderkey, f AS field, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey, (VALUES ('status'), ('month')) v(f)
WHERE (f = 'status' AND l_linestatus IS DISTINCT FROM o_orderstatus) OR (f = 'month' AND month(l_shipdate) IS DISTINCT FROM month(o_orderdate)) GROUP BY ALL""")  # fmt: skip
def metadata_audit(spark: SparkSession, d: str) -> DataFrame:
    copies = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("copy_id"), "l_orderkey", F.col("l_linestatus").alias("status"), F.month("l_shipdate").alias("month"))
    ledger = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"), F.month("o_orderdate").alias("month"))
    return integrity.audit_metadata(copies, ledger, "l_orderkey", ["status", "month"]).groupBy("copy_id", "l_orderkey", "field").agg(F.count("*").alias("n"))


# ---- identity ----


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.concat(F.col("source"), F.lit("_"), (F.col("doc_id") % 400).cast("string")).alias("name_norm"), (F.col("doc_id") % 97).alias("uploaded_at"))


FILES_SQL = "f AS (SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256, source || '_' || (doc_id % 400) AS name_norm, doc_id % 97 AS uploaded_at FROM documents)"


@query("exact_duplicates", f"""WITH {FILES_SQL}, k AS (SELECT size, sha256, arg_min(doc_id, (uploaded_at, doc_id)) AS keeper, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, keeper FROM f JOIN k USING (size, sha256) WHERE doc_id <> keeper""")  # fmt: skip
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return identity.exact_duplicates(files(spark, d))


@query("upload_preflight", f"""WITH {FILES_SQL}, b AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE name_norm END AS name_norm, size, sha256 FROM f WHERE doc_id % 2 = 0), s AS (SELECT * FROM f WHERE doc_id % 2 = 1)
SELECT file_id, CASE WHEN name_norm IS NULL THEN 'name_conflict' WHEN count(*) OVER (PARTITION BY name_norm) > 1 THEN 'selection_name_conflict'
 WHEN EXISTS (SELECT 1 FROM s WHERE s.size = b.size AND s.sha256 = b.sha256) THEN 'exact_duplicate' WHEN name_norm IN (SELECT name_norm FROM s) THEN 'name_conflict' ELSE 'ready' END AS status FROM b""")  # fmt: skip
def upload_preflight(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    batch = f.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 50 != 0, F.col("name_norm")).alias("name_norm"), "size", "sha256")
    return identity.preflight(batch, f.filter("doc_id % 2 = 1"))


@query("manifest_match", f"""WITH {FILES_SQL}, m AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN sha256 END AS sha256, CASE WHEN doc_id % 3 = 1 THEN 'ext-' || (doc_id % 700) END AS external_id, name_norm FROM f),
s AS (SELECT *, 'ext-' || doc_id AS external_id FROM f), x AS (SELECT m.row_id, a.n AS na, a.d AS da, b.n AS nb, b.d AS db, c.n AS nc, c.d AS dc FROM m
 LEFT JOIN (SELECT sha256, count(*) AS n, min(doc_id) AS d FROM s GROUP BY ALL) a ON a.sha256 = m.sha256 LEFT JOIN (SELECT external_id, count(*) AS n, min(doc_id) AS d FROM s GROUP BY ALL) b ON b.external_id = m.external_id
 LEFT JOIN (SELECT name_norm, count(*) AS n, min(doc_id) AS d FROM s GROUP BY ALL) c ON c.name_norm = m.name_norm)
SELECT row_id, CASE WHEN coalesce(na, nb, nc) IS NULL THEN 'not_found' WHEN coalesce(na, nb, nc) > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN coalesce(na, nb, nc) = 1 THEN coalesce(da, db, dc) END AS doc_id,
 CASE WHEN na IS NOT NULL THEN 'sha256' WHEN nb IS NOT NULL THEN 'external_id' WHEN nc IS NOT NULL THEN 'name_norm' END AS matched_by FROM x""")  # fmt: skip
def manifest_match(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    k = F.col("doc_id")
    m = f.select(k.alias("row_id"), F.when(k % 3 == 0, F.col("sha256")).alias("sha256"), F.when(k % 3 == 1, F.concat(F.lit("ext-"), (k % 700).cast("string"))).alias("external_id"), "name_norm")
    return identity.match_manifest(m, f.withColumn("external_id", F.concat(F.lit("ext-"), k.cast("string"))))


@query("metadata_merge", """WITH o AS (SELECT user_id AS doc_id, event_type AS field, CASE WHEN event_id % 13 = 0 THEN '' ELSE value::VARCHAR END AS value, event_id AS seq, ['user', 'manifest', 'parser', 'filename', 'legacy'][event_id % 5 + 1] AS source, [100, 95, 50, 20, 10][event_id % 5 + 1] AS pr, value / 50 AS confidence FROM events),
c AS (SELECT *, max(CASE WHEN source = 'user' AND value = '' THEN seq END) OVER (PARTITION BY doc_id, field) AS cut FROM o),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY pr DESC, seq DESC) AS r FROM c WHERE value <> '' AND (cut IS NULL OR seq > cut))
SELECT doc_id, field, value::DOUBLE AS value, source, least(1.0, greatest(0.0, confidence)) AS confidence, seq FROM l WHERE r = 1""")  # fmt: skip
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    source = F.element_at(F.array(*[F.lit(s) for s in ("user", "manifest", "parser", "filename", "legacy")]), (k % 5 + 1).cast("int"))
    o = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"), F.when(k % 13 == 0, "").otherwise(F.col("value").cast("string")).alias("value"), source.alias("source"), (F.col("value") / 50).alias("confidence"), k.alias("seq"))
    return identity.merge_metadata(o).withColumn("value", F.col("value").cast("double"))


@query("version_supersession", """WITH d AS (SELECT o_orderkey AS doc_id, 'x' || (o_orderkey // 2) AS external_id, CASE WHEN o_orderkey % 10 = 0 THEN (o_orderkey + o_custkey % 3)::VARCHAR WHEN o_orderkey % 10 = 1 THEN 'x' || o_custkey WHEN o_orderkey % 10 = 2 THEN 'none' END AS s FROM orders),
e AS (SELECT external_id, min(doc_id) AS m FROM d GROUP BY ALL), r AS (SELECT d.doc_id AS by_doc, coalesce(i.doc_id, e.m) AS target FROM d LEFT JOIN d i ON i.doc_id::VARCHAR = d.s LEFT JOIN e ON e.external_id = d.s WHERE d.s IS NOT NULL)
SELECT by_doc, target, CASE WHEN target IS NULL THEN 'missing' WHEN target = by_doc THEN 'self' ELSE 'superseded' END AS state FROM r""")  # fmt: skip
def version_supersession(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = F.when(k % 10 == 0, (k + c % 3).cast("string")).when(k % 10 == 1, F.concat(F.lit("x"), c.cast("string"))).when(k % 10 == 2, "none")
    return identity.resolve_versions(table(spark, d, "orders").select(k.alias("doc_id"), F.concat(F.lit("x"), F.floor(k / 2).cast("string")).alias("external_id"), s.alias("supersedes")))


@query("identity_warnings", """WITH d AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(o_orderdate) AS p, CASE WHEN l_linenumber <> 3 THEN min(l_shipdate) END AS e, CASE WHEN l_linenumber <> 4 THEN min(o_orderdate) + INTERVAL 100 DAY END AS x, CASE WHEN min(l_linestatus) = 'F' THEN 'repealed' ELSE 'current' END AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber)
SELECT w AS warning, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN x < e THEN 'error:expires_before_effective' END, CASE WHEN p > e THEN 'warning:published_after_effective' END, CASE WHEN s = 'current' AND e IS NULL THEN 'warning:current_without_effective' END, CASE WHEN s = 'repealed' AND x IS NULL THEN 'warning:repealed_without_expiry' END], lambda v: v IS NOT NULL)) AS w FROM d) GROUP BY w""")  # fmt: skip
def identity_warnings(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"))
    g = j.agg(F.min("o_orderdate").alias("publication_date"), F.min("l_shipdate").alias("_e"), F.min("l_linestatus").alias("_s"))
    g = g.withColumn("effective_date", F.when(F.col("n") != 3, F.col("_e"))).withColumn("expiration_date", F.when(F.col("n") != 4, F.col("publication_date") + F.expr("INTERVAL 100 DAY"))).withColumn("status", F.when(F.col("_s") == "F", "repealed").otherwise("current"))
    return identity.identity_warnings(g).groupBy("warning").agg(F.count("*").alias("n"))


@query("identity_lookup", """WITH s AS (SELECT DISTINCT p_name AS title FROM part), q AS (SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN upper(split_part(p_name, ' ', 1)) WHEN 1 THEN 'the ' || p_name || ' of steel' WHEN 2 THEN p_name ELSE p_name || '#' || p_partkey END AS w FROM part),
m AS (SELECT query_id, title AS doc_id, CASE WHEN lower(w) = lower(title) THEN 100 WHEN contains(lower(title), lower(w)) THEN 80 + least(19, length(w)) WHEN contains(lower(w), lower(title)) THEN 60 + least(19, length(title)) END::INTEGER AS score FROM q, s)
SELECT query_id, doc_id, score FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM m WHERE score IS NOT NULL) WHERE r = 1""")  # fmt: skip
def identity_lookup(spark: SparkSession, d: str) -> DataFrame:
    part, k = table(spark, d, "part"), F.col("p_partkey") % 4
    titles = part.select(F.col("p_name").alias("title")).distinct().withColumn("doc_id", F.col("title"))
    n = F.col("p_name")
    w = F.when(k == 0, F.upper(F.substring_index(n, " ", 1))).when(k == 1, F.concat(F.lit("the "), n, F.lit(" of steel"))).when(k == 2, n).otherwise(F.concat_ws("#", n, "p_partkey"))
    return identity.lookup_identity(part.select(F.col("p_partkey").alias("query_id"), w.alias("wanted")), titles)


@query("ingest_summary", """SELECT event_type, count(*) AS processed, count_if(event_id % 3 = 0)::BIGINT AS success, count_if(event_id % 3 = 1)::BIGINT AS degraded, count_if(event_id % 3 = 2)::BIGINT AS failed, sum(user_id) ::BIGINT AS chunks, round(avg(value), 6) AS avg_ms, quantile_cont(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms FROM events GROUP BY ALL""")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    r = table(spark, d, "events").select("event_type", F.when(k % 3 == 0, "success").when(k % 3 == 1, "degraded").otherwise("failed").alias("outcome"), F.col("user_id").alias("chunks"), F.col("value").alias("ms"))
    return identity.ingest_summary(r, ["event_type"])


@query("document_listing", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def document_listing(spark: SparkSession, d: str) -> DataFrame:
    return identity.list_documents(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_orderdate")


@query("replace_index_rows", """WITH n AS (SELECT * FROM embeddings WHERE vec_id % 10 = 0) SELECT vec_id, label AS version FROM embeddings WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id, label + 100 FROM n""")
def replace_index_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("version"))
    return indexes.replace_by_key(e, e.filter("vec_id % 10 = 0").withColumn("version", F.col("version") + 100), "vec_id")


@query("refresh_metadata", """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE -1 END AS quality, CASE WHEN l.doc_id IS NULL THEN 'old' WHEN l.toxic = 1 THEN 'toxic' ELSE 'unknown' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def refresh_metadata(spark: SparkSession, d: str) -> DataFrame:
    ch = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit("old").alias("status"))
    ledger = table(spark, d, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, "toxic").alias("status"))
    return indexes.refresh_metadata(ch, ledger, ["quality", "status"])


@query("delete_documents", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    return indexes.delete_documents({"documents": table(spark, d, "documents")}, table(spark, d, "labels").filter("toxic = 1"))["documents"].select("doc_id")


# ---- table questions: order totals by nation, priority and quarter as cells ----


CELLS_SQL = """w AS (SELECT n_name, o_orderpriority, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, count(*) AS orders, sum(round(o_totalprice * 100)::BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
c AS (SELECT 'Orders of ' || n_name AS source_title, o_orderpriority AS row_label, y AS year, q AS quarter, 'count' AS unit, unnest(['orders', 'cents']) AS column_label, unnest([orders, cents]) AS v FROM w)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = j.groupBy("n_name", "o_orderpriority", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return tb.wide_to_cells(w, F.concat(F.lit("Orders of "), F.col("n_name")), ["o_orderpriority"], ["orders", "cents"], F.lit("count"), F.col("y"), F.col("q"))


@query("table_cells", f"WITH {CELLS_SQL} SELECT source_title, row_label, column_label, year, quarter, v::VARCHAR AS value, v::DOUBLE AS numeric_value, row_label || '!' || column_label AS coordinate FROM c")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).drop("unit")


def questions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").withColumn("y", F.explode(F.array(F.lit(1996), F.lit(1997), F.lit(1890))))
    return n.select((k * 10 + F.col("y") % 10).cast("long").alias("question_id"), F.lower("n_name").alias("asked_source"), F.col("y").alias("asked_year"), F.when(k % 2 == 0, 1).alias("asked_quarter"), F.lit("1-URGENT").alias("asked_row"), F.lit("orders").alias("asked_column"))


QUESTIONS_SQL = "qs AS (SELECT (n_nationkey * 10 + y % 10)::BIGINT AS question_id, lower(n_name) AS asked_source, y AS asked_year, CASE WHEN n_nationkey % 2 = 0 THEN 1 END AS asked_quarter, '1-URGENT' AS asked_row, 'orders' AS asked_column FROM nation, (VALUES (1996), (1997), (1890)) v(y))"
CAND_SQL = f"""{CELLS_SQL}, {QUESTIONS_SQL}, k AS (SELECT qs.*, c.*, row_label || '!' || column_label AS coordinate,
 0.25 + CASE WHEN lower(asked_row) = lower(row_label) THEN 7 WHEN contains(lower(row_label), lower(asked_row)) THEN 5 ELSE 0 END + CASE WHEN lower(asked_column) = lower(column_label) THEN 7 WHEN contains(lower(column_label), lower(asked_column)) THEN 5 ELSE 0 END AS score
 FROM qs JOIN c ON contains(lower(source_title), asked_source) AND asked_year = year AND (asked_quarter IS NULL OR asked_quarter = quarter))"""


TIED_SQL = f"""{CAND_SQL}, t AS (SELECT *, year * 10000 + quarter AS period, max(score) OVER (PARTITION BY question_id) AS best FROM k),
g AS (SELECT question_id, count(DISTINCT v) AS n, count(*) AS c, count(DISTINCT period) AS p, arg_min(v, (source_title, coordinate)) AS v0, arg_min(coordinate, (source_title, coordinate)) AS c0, arg_max(v, period) AS v1, arg_max(coordinate, period) AS c1,
  arg_max(source_title, period) AS s1, arg_max(quarter, period) AS q1 FROM t WHERE best - score < 0.0001 AND score >= 5 GROUP BY ALL)"""


@query("table_lookup", f"""WITH {TIED_SQL}, r AS (SELECT qs.question_id, g.*, CASE WHEN n IS NULL THEN 'period_not_found' WHEN n = 1 OR p = c THEN 'valid_cell' ELSE 'ambiguous_candidates' END AS status FROM qs LEFT JOIN g ON qs.question_id = g.question_id)
SELECT question_id, status, CASE WHEN status = 'valid_cell' THEN CASE WHEN n = 1 THEN v0 ELSE v1 END::VARCHAR END AS value, CASE WHEN status = 'valid_cell' THEN CASE WHEN n = 1 THEN c0 ELSE c1 END END AS coordinate,
  CASE WHEN status = 'valid_cell' THEN CASE WHEN n > 1 THEN 'latest_period' WHEN c > 1 THEN 'equal_values' END END AS assumption,
  CASE status WHEN 'period_not_found' THEN 'no cell has the asked year, month or quarter' WHEN 'ambiguous_candidates' THEN 'several candidates of one score differ in value' END AS reason FROM r""")  # fmt: skip
def table_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    return tb.table_lookup(tb.score_cells(tb.cell_candidates(q, cells(spark, d))), q)


@query("tied_cells_latest", f"WITH {TIED_SQL} SELECT question_id, s1 AS source_title, q1 AS quarter, v1::VARCHAR AS value, 'latest_period' AS tie_rule FROM g WHERE p = c")
def tied_cells_latest(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    s = tb.score_cells(tb.cell_candidates(questions(spark, d), cells(spark, d)))
    tied = s.withColumn("_b", F.max("score").over(W.partitionBy("question_id"))).filter((F.col("_b") - F.col("score") < tb.TIE) & (F.col("score") >= 5)).drop("_b")
    return tb.resolve_ties(tied).select("question_id", "source_title", "quarter", "value", "tie_rule")


@query("table_calculations", f"""WITH {CELLS_SQL}, o AS (SELECT source_title, year, quarter, max(v) FILTER (row_label = '1-URGENT') AS a, max(v) FILTER (row_label = '5-LOW') AS b FROM c WHERE column_label = 'cents' GROUP BY ALL)
SELECT source_title || '/' || year || '/' || quarter || '/' || op AS question_id, op AS operation, CASE WHEN a IS NULL OR b IS NULL THEN 'missing_operands' WHEN op = 'ratio' AND b = 0 THEN 'zero_denominator' ELSE 'valid_calculation' END AS status,
 CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE op WHEN 'difference' THEN (a - b)::DOUBLE WHEN 'sum' THEN (a + b)::DOUBLE ELSE a::DOUBLE / b::DOUBLE END END AS result FROM o, (VALUES ('difference'), ('sum'), ('ratio')) v(op)""")  # fmt: skip
def table_calculations(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).filter("column_label = 'cents'")
    q = c.select("source_title", "year", "quarter").distinct().withColumn("operation", F.explode(F.array(F.lit("difference"), F.lit("sum"), F.lit("ratio"))))
    q = q.withColumn("question_id", F.concat_ws("/", "source_title", F.col("year").cast("string"), F.col("quarter").cast("string"), "operation"))
    pick = lambda r: F.struct(F.lit(r).alias("row"), F.lit("cents").alias("column"))
    q = q.withColumn("selectors", F.array(pick("1-URGENT"), pick("5-LOW")))
    scored = c.join(q.select("question_id", "source_title", "year", "quarter"), ["source_title", "year", "quarter"]).withColumn("score", F.lit(1.0))
    return tb.calculate(q, tb.operands(q, scored))


@query("table_extremes", f"WITH {CELLS_SQL} SELECT source_title, year, arg_max(row_label, (v, row_label)) AS max_row, max(v)::DOUBLE AS max_value, arg_min(row_label, (v, row_label)) AS min_row, min(v)::DOUBLE AS min_value FROM c WHERE column_label = 'cents' GROUP BY ALL")
def table_extremes(spark: SparkSession, d: str) -> DataFrame:
    return tb.table_extreme(cells(spark, d).filter("column_label = 'cents'"), ["source_title", "year"])


@query("reconcile_totals", f"""WITH {CELLS_SQL}, s AS (SELECT source_title, year, quarter, sum(v) FILTER (row_label <> '5-LOW')::DOUBLE AS added, max(v) FILTER (row_label = '5-LOW')::DOUBLE AS reported FROM c WHERE column_label = 'orders' GROUP BY ALL)
SELECT source_title, year, quarter, reported, added, abs(reported - added) <= 1e-6 AS agrees FROM s""")  # fmt: skip
def reconcile_totals(spark: SparkSession, d: str) -> DataFrame:
    return tb.reconcile_total(cells(spark, d).filter("column_label = 'orders'"), ["source_title", "year", "quarter"], "5-LOW")


@query("label_vocabulary", f"WITH {CELLS_SQL}, p AS (SELECT DISTINCT trim(regexp_replace(unnest(list_concat(string_split_regex(row_label, '\\s*/\\s*'), string_split_regex(column_label, '\\s*/\\s*'))), '^\\s*(?:其中[：:]?|[（(]?\\d+[)）.、])\\s*', '')) AS term FROM c) SELECT term FROM p WHERE length(term) BETWEEN 2 AND 80")
def label_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return tb.label_vocabulary(cells(spark, d))


@query("indicator_match", """WITH q AS (SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations), v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS term FROM benchmark),
h AS (SELECT question_id, question, term FROM q JOIN v ON contains(lower(question), term)) SELECT question_id, term, instr(lower(question), term)::INTEGER AS position FROM h
WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.question_id = h.question_id AND length(o.term) > length(h.term) AND contains(o.term, h.term))""")  # fmt: skip
def indicator_match(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    v = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("term")).distinct()
    return tb.match_indicators(q, v)


@query("derived_metric", """WITH p AS (SELECT l_suppkey AS k, l_returnflag AS f, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), w AS (SELECT k, count(*) AS n, max(v) FILTER (f = 'A') AS a, max(v) FILTER (f = 'N') AS b, max(v) FILTER (f = 'R') AS c FROM p GROUP BY k)
SELECT k, CASE WHEN n < 3 THEN 'missing' ELSE 'bound' END AS status, CASE WHEN n = 3 THEN round((a + b) / c, 6) END AS result FROM w""")  # fmt: skip
def derived_metric(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("name")).agg(F.sum("l_quantity").alias("value")).withColumn("unit", F.lit("piece"))
    return tb.derive_metric(p, "k", ["A", "N", "R"], "round(try_divide(A + N, R), 6)")


@query("display_values", "SELECT o_orderkey, round(o_totalprice::DECIMAL(38,10), 1)::DECIMAL(38,1)::VARCHAR AS shown FROM orders")
def display_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", tb.display_value(F.col("o_totalprice"), F.lit(1)).alias("shown"))


@query("numeric_values", r"SELECT conv_id, turn, list_sum(list_transform(regexp_extract_all(text, '[-+]?\d+(?:,\d{3})*(?:\.\d+)?'), lambda x: replace(x, ',', '')::DOUBLE)) AS total FROM conversations")
def numeric_values(spark: SparkSession, d: str) -> DataFrame:
    total = T.let(T.numbers(F.col("text")), lambda n: F.when(F.size(n) > 0, F.aggregate(n, F.lit(0.0), lambda a, x: a + x)))
    return table(spark, d, "conversations").select("conv_id", "turn", total.alias("total"))


# ---- events ----


def audit(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    action = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "source_missing").otherwise("ok")
    return e.select("event_id", "ts", F.col("event_type").alias("event_key"), F.lit("user").alias("target_type"), F.when(F.col("user_id") % 10 != 0, F.col("user_id") % 5).alias("target_id"), evs.severity(action).alias("severity"), F.when(k % 4 != 0, F.col("props")).otherwise("").alias("detail"), (k % 20 == 0).alias("resolved"))


AUDIT_SQL = "a AS (SELECT event_id, ts, event_type AS event_key, 'user' AS target_type, CASE WHEN user_id % 10 <> 0 THEN user_id % 5 END AS target_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity, CASE WHEN event_id % 4 <> 0 THEN props ELSE '' END AS detail, event_id % 20 = 0 AS resolved FROM events)"
SESSION_SQL = f"""WITH {AUDIT_SQL}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL {{}} OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 600000000 THEN 1 ELSE 0 END AS s FROM a WINDOW w AS (PARTITION BY event_key, target_type, target_id, severity ORDER BY ts, event_id)),
h AS (SELECT *, sum(s) OVER (PARTITION BY event_key, target_type, target_id, severity ORDER BY ts, event_id) AS n FROM g)
SELECT event_key, target_type, target_id, severity, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrences, arg_max(detail, (ts, event_id)) FILTER (detail <> '') AS detail FROM h GROUP BY event_key, target_type, target_id, severity, n"""


@query("event_sessions", SESSION_SQL.format(""))
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return evs.aggregate_events(audit(spark, d))


@query("event_sessions_resolved", SESSION_SQL.format("OR coalesce(lag(resolved) OVER w, false)"))
def event_sessions_resolved(spark: SparkSession, d: str) -> DataFrame:
    return evs.aggregate_events_windowed(audit(spark, d))


@query("events_of_day", f"WITH {AUDIT_SQL} SELECT event_id, ts, severity FROM a WHERE (ts + INTERVAL 8 HOUR)::DATE = DATE '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10")
def events_of_day(spark: SparkSession, d: str) -> DataFrame:
    return evs.events_on(audit(spark, d), F.lit("2024-01-15").cast("date"), 10).select("event_id", "ts", "severity")


@query("daily_archive", f"""WITH {AUDIT_SQL}, o AS (SELECT *, (ts + INTERVAL 8 HOUR)::DATE AS archive_date FROM a) SELECT archive_date, count(*) AS n, count_if(severity = 'error')::BIGINT AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM o
WHERE archive_date < DATE '2024-01-20' AND event_id % 10 <> 0 AND archive_date <> DATE '2024-01-05' GROUP BY ALL""")  # fmt: skip
def daily_archive(spark: SparkSession, d: str) -> DataFrame:
    a = audit(spark, d)
    deleted = spark.sql("SELECT DATE '2024-01-05' AS archive_date")
    kept = evs.archive_daily(a, a.filter("event_id % 10 = 0"), deleted, F.lit("2024-01-20").cast("date"))
    return evs.list_archives(kept, deleted)


@query("stage_timings", "SELECT event_type, count(*) AS n, arg_max(value, (ts, event_id)) AS last, round(avg(value), 6) AS average, max(value) AS max FROM events GROUP BY ALL")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    return evs.timing_stats(table(spark, d, "events"), "event_type", "value", "ts", "event_id")


@query("stage_spans", """WITH m AS (SELECT user_id, ts, event_id, (event_type = 'purchase')::INTEGER AS e FROM events WHERE event_type IN ('view', 'purchase')),
s AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sp FROM m),
g AS (SELECT user_id, sp, min(ts) FILTER (e = 0) AS started, max(ts) FILTER (e = 1) AS ended FROM s GROUP BY ALL)
SELECT user_id, started, ended, round((epoch_us(ended) - epoch_us(started)) / 1000000.0, 6)::DOUBLE AS seconds FROM g WHERE started IS NOT NULL AND ended IS NOT NULL""")  # fmt: skip
def stage_spans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return evs.stage_spans(e, "user_id", "ts", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")


@query("running_peaks", "SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events")
def running_peaks(spark: SparkSession, d: str) -> DataFrame:
    return evs.running_peaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "peak")


@query("latest_per_kind", "SELECT event_id, event_type, recent FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC))::INTEGER AS recent FROM events) WHERE recent <= 50")
def latest_per_kind(spark: SparkSession, d: str) -> DataFrame:
    return evs.latest_n(table(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type", "recent")


@query("answer_log_facts", "SELECT (ts + INTERVAL 8 HOUR)::DATE AS day, count(*) AS n, count_if(event_type = 'error')::BIGINT AS refused, round(avg(value / 100), 6) AS confidence, round(avg(user_id % 5), 6) AS citations FROM events GROUP BY ALL")
def answer_log_facts(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("ts", (F.col("event_type") == "error").alias("refused"), (F.col("value") / 100).alias("confidence"), (F.col("user_id") % 5).alias("citations"))
    return evs.qa_facts(log)


@query("verified_files", """WITH d AS (SELECT 'file' || p_partkey AS f, p_partkey AS k, p_size::BIGINT AS n, md5(p_partkey::VARCHAR) AS h FROM part),
s AS (SELECT f, CASE WHEN k % 7 = 1 THEN n + 1 ELSE n END AS n, CASE WHEN k % 7 = 2 THEN 'x' ELSE h END AS h FROM d WHERE k % 7 <> 0),
m AS (SELECT f, CASE WHEN k % 11 = 1 THEN n + 2 ELSE n END AS n, CASE WHEN k % 11 = 2 THEN 'y' ELSE h END AS h FROM d WHERE k % 11 <> 0 UNION ALL SELECT 'only' || s_suppkey, 1, 'z' FROM supplier),
j AS (SELECT d.*, s.n AS sn, s.h AS sh, m.n AS mn, m.h AS mh FROM d LEFT JOIN s USING (f) LEFT JOIN m USING (f))
SELECT CASE WHEN sn IS NULL THEN 'original_missing' WHEN sn <> n THEN 'original_size' WHEN sh <> h THEN 'original_sha256' WHEN mn IS NULL THEN 'source_missing' WHEN mn <> n THEN 'source_size_mismatch' ELSE 'source_hash_mismatch' END AS "check", f AS filename,
  CASE WHEN sn IS NULL THEN h WHEN sn <> n THEN n::VARCHAR WHEN sh <> h THEN h WHEN mn IS NULL THEN h WHEN mn <> n THEN mn::VARCHAR ELSE mh END AS expected, CASE WHEN sn IS NULL THEN NULL WHEN sn <> n THEN sn::VARCHAR WHEN sh <> h THEN sh WHEN mn IS NULL THEN NULL WHEN mn <> n THEN n::VARCHAR ELSE sh END AS actual
FROM j WHERE sn IS NULL OR sn <> n OR sh <> h OR mn IS NULL OR mn <> n OR mh <> sh
UNION ALL SELECT 'source_not_imported', f, NULL, NULL FROM m WHERE f NOT IN (SELECT f FROM d) UNION ALL SELECT 'document_not_in_source', f, NULL, NULL FROM d WHERE f NOT IN (SELECT f FROM m)""")  # fmt: skip
def verified_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files; stored copies and the manifest lack some and differ in size or hash for others."""
    k = F.col("p_partkey")
    ledger = table(spark, d, "part").select(k, F.concat(F.lit("file"), k.cast("string")).alias("filename"), F.col("p_size").cast("long").alias("size"), F.md5(k.cast("string")).alias("sha256"))
    bent = lambda mod, more, other: ledger.filter(k % mod != 0).select("filename", F.when(k % mod == 1, F.col("size") + more).otherwise(F.col("size")).alias("size"), F.when(k % mod == 2, other).otherwise(F.col("sha256")).alias("sha256"))
    only = table(spark, d, "supplier").select(F.concat(F.lit("only"), F.col("s_suppkey").cast("string")).alias("filename"), F.lit(1).cast("long").alias("size"), F.lit("z").alias("sha256"))
    return integrity.verify_files(ledger.drop("p_partkey"), bent(7, 1, "x"), bent(11, 2, "y").unionByName(only))


@query("inferred_metadata", """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate::DATE + INTERVAL 20 YEAR AS day FROM orders)
SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 3 = 0 THEN '财政部' WHEN o_custkey % 3 = 1 THEN o_orderpriority || '部门' END AS issuing_authority, '财会〔' || year(day) || '〕' || o_custkey % 1000 || '号' AS document_number,
  CASE WHEN o_custkey % 3 < 2 THEN strftime(day, '%Y-%m-%d') END AS publication_date, CASE WHEN o_custkey % 2 = 0 THEN strftime(day, '%Y-%m-%d') END AS effective_date, NULL::VARCHAR AS expiration_date,
  CASE WHEN o_custkey % 2 = 0 THEN '信贷管理' END AS regulatory_topic, CASE WHEN o_custkey % 2 = 0 THEN '信贷业务' END AS business_domain FROM o""")  # fmt: skip
def inferred_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Orders as notices: their authority labelled, named or absent, their dates written out."""
    c, day = F.col("o_custkey"), F.add_months(F.to_date("o_orderdate"), 240)
    written = F.date_format(day, "yyyy年M月d日")
    head = F.concat(F.when(c % 3 == 1, F.concat(F.lit("发文机关："), F.col("o_orderpriority"), F.lit("部门\n"))).when(c % 3 == 0, "由财政部印发\n").otherwise(""), F.lit("《通知》（财会〔"), F.year(day).cast("string"), F.lit("〕"), (c % 1000).cast("string"), F.lit("号）"))
    text = F.concat(head, F.lit("\n"), F.when(c % 3 < 2, F.concat(F.lit("发布日期："), written)).otherwise(F.concat(F.lit("日期 "), written)), F.when(c % 2 == 0, F.concat(F.lit("\n贷款办法自"), written, F.lit("起施行"))).otherwise(""))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("a.pdf").alias("filename"), text.alias("text"), F.array(head).alias("head"))
    return metadata.infer_metadata(docs)


@query("normalized_fields", """SELECT c_custkey AS doc_id, ['publication_date', 'version_status', 'source_url', 'expiration_date'][(c_custkey % 4 + 1)::INTEGER] AS field,
  CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 28 < 27 THEN printf('2024-02-%02d', c_custkey % 28 + 1) ELSE '2024-02-28' END WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN 'current' END WHEN 2 THEN CASE WHEN c_custkey % 8 = 2 THEN 'https://host/' || c_custkey END END AS normalized,
  CASE c_custkey % 4 WHEN 1 THEN CASE WHEN c_custkey % 8 <> 1 THEN 'version_status' END WHEN 2 THEN CASE WHEN c_custkey % 8 <> 2 THEN 'url' END WHEN 3 THEN 'date' END AS error FROM customer""")  # fmt: skip
def normalized_fields(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    key = F.element_at(F.array(*map(F.lit, ("发布日期", "status", "url", "invalid_date"))), (c % 4 + 1).cast("int"))
    value = (
        F.when(c % 4 == 0, F.concat(F.lit("2024年2月"), (c % 28 + 1).cast("string"), F.lit("日"))).when(c % 4 == 1, F.when(c % 8 == 1, "现行").otherwise("lost"))
        .when(c % 4 == 2, F.concat(F.when(c % 8 == 2, "https://host/").otherwise("file://host/"), c.cast("string"))).otherwise("2024-02-31")
    )
    rows = table(spark, d, "customer").select(c.alias("doc_id"), key.alias("key"), value.alias("value"))
    return metadata.normalize_metadata(rows).select("doc_id", "field", "normalized", "error")


@query("chunk_findings", r"""WITH c AS (SELECT conv_id AS doc_id, CASE WHEN turn % 6 = 5 THEN ' ' WHEN conv_id % 4 = 1 THEN text || '�' WHEN conv_id % 4 = 2 AND turn = 0 THEN chr(7) || text WHEN conv_id % 4 = 3 THEN 'same' ELSE text END AS t,
  turn = 1 AND conv_id % 3 = 0 AS bad, turn FROM conversations),
d AS (SELECT DISTINCT conv_id AS doc_id, ['pdf', 'docx', 'xlsx'][(conv_id % 3 + 1)::INTEGER] AS kind, conv_id % 5 + 2 AS want FROM conversations UNION ALL SELECT -s_suppkey, 'pdf', 0 FROM supplier),
s AS (SELECT doc_id, count(*) AS n, sum(length(t)) AS chars, count(*) FILTER (trim(t) = '') AS empty, sum(length(t) - length(replace(t, '�', ''))) AS signs, count(*) FILTER (contains(t, chr(7))) AS control, count(*) FILTER (bad) AS meta,
  count(*) FILTER (trim(t) <> '') - count(DISTINCT CASE WHEN trim(t) <> '' THEN trim(regexp_replace(t, '\s+', ' ', 'g')) END) AS repeats FROM c GROUP BY ALL),
j AS (SELECT d.*, coalesce(n, 0) AS n, coalesce(chars, 0) AS chars, coalesce(empty, 0) AS empty, coalesce(signs, 0) AS signs, coalesce(control, 0) AS control, coalesce(meta, 0) AS meta, coalesce(repeats, 0) AS repeats FROM d LEFT JOIN s USING (doc_id)),
f AS (SELECT doc_id, 'chunk_count_mismatch' AS "check", 'error' AS level, n - want AS value FROM j WHERE n <> want UNION ALL SELECT doc_id, 'no_chunks', 'error', 0 FROM j WHERE n = 0 UNION ALL SELECT doc_id, 'empty_chunk', 'error', empty FROM j WHERE empty > 0
  UNION ALL SELECT doc_id, CASE WHEN kind = 'pdf' AND signs::DOUBLE / chars < 0.01::DOUBLE THEN 'pdf_math_symbol_placeholders' ELSE 'replacement_chars' END, CASE WHEN kind = 'pdf' AND signs::DOUBLE / chars < 0.01::DOUBLE THEN 'warning' ELSE 'error' END, signs FROM j WHERE signs > 0
  UNION ALL SELECT doc_id, 'control_chars', 'warning', control FROM j WHERE control > 0 UNION ALL SELECT doc_id, 'chunk_metadata_json', 'error', meta FROM j WHERE meta > 0 UNION ALL SELECT doc_id, 'text_too_short', 'error', chars FROM j WHERE chars < 20
  UNION ALL SELECT doc_id, 'low_cjk_ratio', 'warning', 0 FROM j WHERE chars > 200 AND kind <> 'xlsx' UNION ALL SELECT doc_id, 'duplicate_chunk_texts', 'warning', repeats FROM j WHERE repeats > greatest(2, n // 10) UNION ALL SELECT doc_id, 'pdf_page_numbers', 'warning', n FROM j WHERE kind = 'pdf' AND n > 0)
SELECT doc_id, "check", level, value::BIGINT AS value FROM f""")  # fmt: skip
def chunk_findings(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents of which one in four each has unreadable signs, control signs or repeats; suppliers as documents without chunks."""
    i, t = F.col("conv_id"), F.col("turn")
    text = F.when(t % 6 == 5, " ").when(i % 4 == 1, F.concat("text", F.lit("�"))).when((i % 4 == 2) & (t == 0), F.concat(F.lit("\x07"), "text")).when(i % 4 == 3, "same").otherwise(F.col("text"))
    c = table(spark, d, "conversations")
    chunks = c.select(i.alias("doc_id"), text.alias("text"), F.when((t == 1) & (i % 3 == 0), "[1]").when(t == 2, None).otherwise('{"a": 1}').alias("metadata"), F.when(i % 3 == 1, t).alias("page_number"))
    kinds = F.element_at(F.array(F.lit("pdf"), F.lit("docx"), F.lit("xlsx")), (i % 3 + 1).cast("int"))
    docs = c.select(i.alias("doc_id"), kinds.alias("file_type"), (i % 5 + 2).alias("chunk_count")).distinct()
    none = table(spark, d, "supplier").select((-F.col("s_suppkey")).alias("doc_id"), F.lit("pdf").alias("file_type"), F.lit(0).cast("long").alias("chunk_count"))
    return integrity.chunk_findings(docs.unionByName(none), chunks)


@query("index_findings", """WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'indexed' ELSE o_orderstatus END AS status, o_custkey % 7 AS n, CASE WHEN o_custkey % 11 = 0 THEN 'timeout' END AS e, CASE WHEN o_custkey % 13 = 0 THEN 'v1' ELSE 'v2' END AS v FROM orders)
SELECT 'document_status' AS "check", status AS subject, count(*) AS value FROM d WHERE status <> 'indexed' GROUP BY ALL UNION ALL SELECT 'chunk_total', w::VARCHAR, h FROM (SELECT coalesce(sum(n), 0)::BIGINT AS w, (SELECT count(*) FROM lineitem) AS h FROM d) WHERE w <> h
UNION ALL SELECT 'empty_document', k::VARCHAR, n FROM d WHERE n = 0 UNION ALL SELECT 'index_error', k::VARCHAR, n FROM d WHERE e IS NOT NULL UNION ALL SELECT 'index_version', k::VARCHAR, n FROM d WHERE v <> 'v2'""")  # fmt: skip
def index_findings(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    docs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "indexed").otherwise(F.col("o_orderstatus")).alias("status"), (c % 7).alias("chunk_count"), F.when(c % 11 == 0, "timeout").alias("index_error"), F.when(c % 13 == 0, "v1").otherwise("v2").alias("index_version")
    )
    return integrity.index_findings(docs, table(spark, d, "lineitem"), "v2")


@query("sheet_findings", """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_orderkey % 5 > 0 THEN 'S' END AS name, CASE WHEN l_linenumber > 2 THEN 'row' ELSE 'summary' END AS role FROM lineitem),
d AS (SELECT o_orderkey AS k, o_custkey % 3 AS numeric FROM orders WHERE o_orderkey % 3 > 0),
w AS (SELECT k, sum(CASE WHEN role = 'row' THEN 1 ELSE 0 END)::BIGINT AS want, count(name) AS named FROM c GROUP BY ALL),
h AS (SELECT k, count(*) AS have, count(*) FILTER (p % 50 = 1) AS orphans FROM c WHERE role = 'row' AND p % 50 <> 0 GROUP BY ALL),
j AS (SELECT d.*, coalesce(want, 0) AS want, coalesce(named, 0) AS named, coalesce(have, 0) AS have, coalesce(orphans, 0) AS orphans FROM d LEFT JOIN w USING (k) LEFT JOIN h USING (k))
SELECT k AS doc_id, CASE WHEN numeric = 0 THEN 'blank_spreadsheet_template' ELSE 'spreadsheet_no_cells' END AS "check", CASE WHEN numeric = 0 THEN 'warning' ELSE 'error' END AS level, numeric::BIGINT AS value FROM j WHERE want = 0
UNION ALL SELECT k, 'spreadsheet_cell_count', 'error', have FROM j WHERE want > 0 AND have <> want UNION ALL SELECT k, 'spreadsheet_no_sheet_name', 'warning', 0 FROM j WHERE named = 0 UNION ALL SELECT k, 'spreadsheet_orphan_cells', 'error', orphans FROM j WHERE orphans > 0""")  # fmt: skip
def sheet_findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as workbooks, of which every third is no spreadsheet; their lines as chunks and cells, some of them missing or of no chunk."""
    o, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    place = F.concat_ws("-", o.cast("string"), n.cast("string"), p.cast("string"))
    rows = table(spark, d, "lineitem")
    chunks = rows.select(o.alias("doc_id"), place.alias("chunk_id"), F.when(o % 5 > 0, "S").alias("sheet_name"), F.when(n > 2, "row").otherwise("summary").alias("table_role"), F.lit(1).alias("n_cells"))
    cells = rows.filter((n > 2) & (p % 50 != 0)).select(o.alias("doc_id"), F.when(p % 50 == 1, "none").otherwise(place).alias("chunk_id"))
    k = F.col("o_orderkey")
    docs = table(spark, d, "orders").select(k.alias("doc_id"), F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "xls").otherwise("xlsx").alias("file_type"), (F.col("o_custkey") % 3).alias("numeric_cells"))
    return integrity.sheet_findings(docs, chunks, cells)
