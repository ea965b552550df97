"""Queries for the evidence contract, over orders as questions and line items as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as ev
from .tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("requirements", """WITH a AS (SELECT o_orderkey AS question_id, o_custkey % 4 AS aspect_id, CASE WHEN o_orderstatus = 'F' THEN 'table' ELSE 'text' END AS kind, o_orderpriority < '3' AS mandatory, CASE WHEN o_orderkey % 3 = 0 THEN ['x'] ELSE ['x', 'y'] END AS s FROM orders)
SELECT question_id, aspect_id::VARCHAR AS requirement_id, kind, mandatory, NULL::VARCHAR AS selector FROM a
UNION ALL SELECT question_id, aspect_id || '-' || p, 'operand', mandatory, s[p] FROM a, unnest(range(1, len(s) + 1)) AS r(p) WHERE kind = 'table' AND len(s) >= 2""")  # fmt: skip
def requirements(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = table(spark, d, "orders").select(k.alias("question_id"), (F.col("o_custkey") % 4).alias("aspect_id"), F.when(F.col("o_orderstatus") == "F", "table").otherwise("text").alias("kind"), (F.col("o_orderpriority") < "3").alias("mandatory"), F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("selectors"))
    return ev.requirements(a)


@query("evidence_bundle", """WITH r AS (SELECT o_orderkey AS question_id, n AS requirement_id, n <= 2 AS mandatory FROM orders, (VALUES (1), (2), (3)) v(n)),
d AS (SELECT l_orderkey AS question_id, l_linenumber AS requirement_id, l_returnflag <> 'R' AS ok, l_discount >= 0.05 AS sel FROM lineitem),
g AS (SELECT question_id, requirement_id, count_if(ok AND sel)::BIGINT AS selected, count_if(NOT ok)::BIGINT AS filtered, count_if(ok AND NOT sel)::BIGINT AS passed_over FROM d GROUP BY ALL),
j AS (SELECT question_id, requirement_id, mandatory, coalesce(selected, 0) AS selected, coalesce(filtered, 0) AS filtered, coalesce(passed_over, 0) AS passed_over FROM r LEFT JOIN g USING (question_id, requirement_id))
SELECT *, CASE WHEN selected > 0 THEN 'covered' WHEN passed_over > 0 THEN 'not_selected' WHEN filtered > 0 THEN 'filtered' ELSE 'missing' END AS state FROM j""")  # fmt: skip
def evidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("requirement_id")).withColumn("mandatory", F.col("requirement_id") <= 2)
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("requirement_id"), F.col("l_partkey").alias("chunk_id"), (F.col("l_returnflag") != "R").alias("source_ok"), (F.col("l_discount") >= 0.05).alias("selected"))  # noqa: E741
    return ev.evidence_bundle(r, l)


@query("sufficiency", """WITH f AS (SELECT l_orderkey AS question_id, l_linenumber AS requirement_id, CASE l_returnflag WHEN 'A' THEN 'source' WHEN 'N' THEN 'condition' ELSE 'numeric' END AS facet, CASE WHEN l_discount < 0.02 THEN 'missing' WHEN l_discount < 0.05 THEN 'partial' ELSE 'covered' END AS status FROM lineitem),
p AS (SELECT question_id, requirement_id, bool_or(facet IN ('source', 'numeric') AND status = 'missing') AS bad, bool_or(status <> 'covered') AS part FROM f GROUP BY ALL),
q AS (SELECT question_id, count(*) AS requirements, count_if(bad)::BIGINT AS failed, count_if(part AND NOT bad)::BIGINT AS partial FROM p GROUP BY ALL)
SELECT *, CASE WHEN failed = requirements THEN 'insufficient' WHEN failed > 0 OR partial > 0 THEN 'partial' ELSE 'sufficient' END AS status FROM q""")  # fmt: skip
def sufficiency(spark: SparkSession, d: str) -> DataFrame:
    flag, x = F.col("l_returnflag"), F.col("l_discount")
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("requirement_id"), F.when(flag == "A", "source").when(flag == "N", "condition").otherwise("numeric").alias("facet"), F.when(x < 0.02, "missing").when(x < 0.05, "partial").otherwise("covered").alias("status"))
    return ev.sufficiency(f)


@query("traced_evidence", r"""WITH e AS (SELECT conv_id AS question_id, turn AS rank, conv_id || '-' || turn AS chunk_id, CASE WHEN turn % 3 = 1 THEN 'no such words' ELSE substr(text, 5, 40) END AS excerpt, CASE WHEN turn % 4 = 1 THEN 'calculation' ELSE 'text' END AS kind FROM conversations),
t AS (SELECT conv_id || '-' || turn AS chunk_id, regexp_replace(text, '[\s\x0B]+', '', 'g') AS t FROM conversations WHERE turn % 5 <> 4),
k AS (SELECT e.* FROM e JOIN t USING (chunk_id) WHERE kind = 'calculation' OR coalesce(contains(t, regexp_replace(excerpt, '[\s\x0B]+', '', 'g')) OR contains(regexp_replace(excerpt, '[\s\x0B]+', '', 'g'), t), false))
SELECT question_id, chunk_id, excerpt, kind, (row_number() OVER (PARTITION BY question_id ORDER BY rank, chunk_id))::INTEGER AS rank FROM k""")  # fmt: skip
def traced_evidence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("chunk_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    t = F.col("turn")
    e = c.select(F.col("conv_id").alias("question_id"), t.alias("rank"), "chunk_id", F.when(t % 3 == 1, "no such words").otherwise(F.substring("text", 5, 40)).alias("excerpt"), F.when(t % 4 == 1, "calculation").otherwise("text").alias("kind"))
    return ev.trace_evidence(e, c.filter(t % 5 != 4))


@query("compact_citations", r"""WITH a AS (SELECT o_orderkey AS question_id, o_orderkey % 6 + 1 AS x, o_custkey % 6 + 1 AS y FROM orders), k AS (SELECT l_orderkey AS question_id, list(DISTINCT l_linenumber) AS known FROM lineitem GROUP BY ALL),
m AS (SELECT a.*, list_sort(list_distinct(list_filter([x, y]::INTEGER[], lambda v: list_contains(coalesce(known, []), v)))) AS kept FROM a LEFT JOIN k USING (question_id))
SELECT question_id, 'see [' || coalesce(list_position(kept, x::INTEGER), x) || '] and [' || coalesce(list_position(kept, y::INTEGER), y) || '].' AS answer, kept FROM m""")  # fmt: skip
def compact_citations(spark: SparkSession, d: str) -> DataFrame:
    x, y = ((F.col(c) % 6 + 1).cast("string") for c in ("o_orderkey", "o_custkey"))
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("see ["), x, F.lit("] and ["), y, F.lit("].")).alias("answer"))
    return ev.compact_citations(a, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("evidence_no")))


@query("citation_checks", """WITH a AS (SELECT o_orderkey AS question_id, list_distinct([o_orderkey % 6 + 1, o_custkey % 6 + 1]::INTEGER[]) AS i FROM orders), k AS (SELECT l_orderkey AS question_id, list(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY ALL),
c AS (SELECT l_orderkey AS question_id, list(DISTINCT l_linenumber + 1) FILTER (l_returnflag = 'A') AS c, count_if(l_returnflag <> 'A')::BIGINT AS u FROM lineitem GROUP BY ALL)
SELECT question_id, list_sort(list_filter(i, lambda v: NOT list_contains(coalesce(k, []), v))) AS inline_unknown, list_sort(list_filter(coalesce(c, []), lambda v: NOT list_contains(coalesce(k, []), v))) AS claimed_unknown,
 list_sort(list_filter(coalesce(c, []), lambda v: NOT list_contains(i, v))) AS claimed_not_inline, coalesce(u, 0) AS uncited_claims FROM a LEFT JOIN k USING (question_id) LEFT JOIN c USING (question_id)""")  # fmt: skip
def citation_checks(spark: SparkSession, d: str) -> DataFrame:
    x, y = ((F.col(c) % 6 + 1).cast("string") for c in ("o_orderkey", "o_custkey"))
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("see ["), x, F.lit("] and ["), y, F.lit("].")).alias("answer"))
    l = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "question_id")  # noqa: E741
    claims = l.select("question_id", F.when(F.col("l_returnflag") == "A", F.array(F.col("l_linenumber") + 1)).otherwise(F.array().cast("array<int>")).alias("cited"))
    return ev.citation_checks(a, claims, l.select("question_id", F.col("l_linenumber").alias("evidence_no")))


@query("answer_coverage", """WITH e AS (SELECT l_orderkey AS question_id, list_sort(list(DISTINCT l_linenumber)) AS e, list(DISTINCT l_linenumber) FILTER (l_returnflag <> 'R') AS g, max(l_discount * 12) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY ALL),
m AS (SELECT *, list_sort(list_filter(e, lambda v: NOT list_contains(coalesce(g, []), v))) AS missing FROM e)
SELECT question_id, len(e)::INTEGER AS expected, (len(e) - len(missing))::INTEGER AS covered, missing, len(missing) = 0 AS complete, least(0.95, greatest(0.0, coalesce(b, 0.0))) AS confidence FROM m""")  # fmt: skip
def answer_coverage(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("aspect_id"), (F.col("l_discount") * 12).alias("score"), "l_returnflag")  # noqa: E741
    return ev.answer_coverage(l, l.filter("l_returnflag <> 'R'"))


@query("source_groups", """SELECT l_suppkey AS question_id, l_returnflag AS source_title, count(*) AS claims, count_if(l_discount > 0.03)::BIGINT AS supported, CASE WHEN count_if(l_discount > 0.03) = count(*) THEN 'covered' WHEN count_if(l_discount > 0.03) > 0 THEN 'partial' ELSE 'missing' END AS status FROM lineitem GROUP BY ALL""")
def source_groups(spark: SparkSession, d: str) -> DataFrame:
    return ev.source_groups(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("question_id"), F.col("l_returnflag").alias("source_title"), (F.col("l_discount") > 0.03).alias("supported")))


@query("unsupported_numbers", """WITH c AS (SELECT l_orderkey, l_linenumber, 'is ' || round(max(l_extendedprice) * CASE WHEN max(l_discount) > 0.05 THEN 1.01 ELSE 1 END, 1)::DECIMAL(18,1)::VARCHAR AS claim, list(l_extendedprice::DECIMAL(18,2)::DOUBLE) AS have FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, substr(claim, 4) AS number FROM c WHERE len(list_filter(have, lambda h: abs(h - substr(claim, 4)::DOUBLE) <= 0.05 + 1e-9)) = 0""")  # fmt: skip
def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    l, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]  # noqa: E741
    value = F.round(F.max("l_extendedprice") * F.when(F.max("l_discount") > 0.05, 1.01).otherwise(1), 1)
    claims = l.groupBy(*keys).agg(F.concat(F.lit("is "), value.cast("decimal(18,1)").cast("string")).alias("claim"))
    cited = l.select(*keys, F.concat(F.lit("total "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("text"))
    return ev.unsupported_numbers(claims, cited, keys)


DECISIONS_SQL = """r AS (SELECT o_orderkey AS question_id, unnest(['a', 'b', 'c']) AS requirement_id FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 'a' FROM orders WHERE o_orderkey % 3 = 0),
l AS (SELECT DISTINCT l_orderkey AS question_id, l_partkey::VARCHAR AS chunk_id, bool_or(l_linenumber <= 2) OVER (PARTITION BY l_orderkey, l_partkey) AS chosen, l_partkey % 4 AS t, l_suppkey % 5 = 0 AS other FROM lineitem),
g AS (SELECT question_id, chunk_id, any_value(chosen) AS chosen, any_value(t) AS t, bool_or(other) AS other FROM l GROUP BY ALL),
m AS (SELECT r.question_id, r.requirement_id, chunk_id, CASE WHEN other AND r.requirement_id = 'a' THEN 'filtered' WHEN chosen THEN 'selected' ELSE 'not_selected' END AS stage FROM r JOIN g ON r.question_id = g.question_id
  AND (r.question_id % 3 = 0 OR r.requirement_id = ['a', 'b', 'a', 'none'][(t + 1)::INTEGER])),
d AS (SELECT * FROM m UNION ALL SELECT question_id, requirement_id, '', 'missing' FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.question_id = r.question_id AND m.requirement_id = r.requirement_id))"""


def decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as questions of three requirements (every third of one), their parts as candidates, tagged by number; suppliers by fives are another source for the first."""
    o = F.col("o_orderkey")
    reqs = table(spark, d, "orders").select(o.alias("question_id"), F.explode(F.when(o % 3 > 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))).alias("requirement_id"))
    tags = F.element_at(F.array(F.array(F.lit("a")), F.array(F.lit("b")), F.array(F.lit("a")), F.array(F.lit("none"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").cast("string").alias("chunk_id"), tags.alias("tags"), (F.col("l_linenumber") <= 2).alias("selected"), (F.col("l_suppkey") % 5 == 0).alias("other"))
    conflict = rows.filter("other").select("question_id", F.lit("a").alias("requirement_id"), "chunk_id")
    return reqs, ev.evidence_decisions(reqs, rows.drop("other"), conflict)


@query("evidence_decisions", f"""WITH {DECISIONS_SQL} SELECT question_id, requirement_id, chunk_id, stage,
  CASE stage WHEN 'filtered' THEN 'explicit_source_conflict' WHEN 'selected' THEN 'source_and_requirement_match' WHEN 'missing' THEN 'not_recalled' ELSE 'context_budget' END AS reason FROM d""")  # fmt: skip
def evidence_decisions(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d)[1]


@query("missing_requirements", f"""WITH {DECISIONS_SQL}, c AS (SELECT question_id, requirement_id, list(DISTINCT chunk_id) AS ids, bool_or(chunk_id::BIGINT % 10 = 0) AS cut FROM d WHERE stage = 'selected' GROUP BY ALL)
SELECT r.question_id, r.requirement_id, r.requirement_id <> 'c' AS mandatory, coalesce(array_to_string(list_sort(ids), ','), '') AS covered_by, coalesce(cut, true) AS missing FROM r LEFT JOIN c USING (question_id, requirement_id)""")  # fmt: skip
def missing_requirements(spark: SparkSession, d: str) -> DataFrame:
    reqs, made = decisions(spark, d)
    cut = made.filter("chunk_id <> '' and cast(chunk_id as bigint) % 10 = 0").select("question_id", "chunk_id")
    out = ev.missing_requirements(reqs.withColumn("mandatory", F.col("requirement_id") != "c"), made, cut)
    return out.withColumn("covered_by", F.array_join("covered_by", ","))
