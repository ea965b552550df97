"""Queries over spreadsheets in three layouts: order counts by nation, year, quarter and market segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spreadsheets as sp
from .tables import table

QUERIES, SQL = {}, {}

#: Every third nation's table is transposed, has its quarters in the headers, or in an index column.
SHEETS_SQL = """w AS (SELECT n_nationkey % 3 AS kind, n_nationkey AS n, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, c_mktsegment AS seg, count(*) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
a AS (SELECT c_custkey AS question_id, n_nationkey % 3 AS kind, n_nationkey AS n, (1991 + c_custkey % 8)::INTEGER AS y, (c_custkey % 4 + 1)::INTEGER AS q, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def title() -> Column:
    return F.concat("n_name", F.lit("订单数量分机构类情况表（季度）"))


def sheets(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = j.groupBy("n_nationkey", "n_name", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("v"))
    kind, word = F.col("n_nationkey") % 3, F.concat(F.substring(F.lit(sp.DIGITS), F.col("q"), F.lit(1)), F.lit("季度"))
    return w.select(
        F.col("n_nationkey").cast("string").alias("document_id"), title().alias("source_title"), F.lit("Sheet1").alias("sheet_name"),
        F.when(kind == 0, F.concat(word, F.lit(" / 订单数量"))).otherwise(F.col("seg")).alias("row_label"), F.when(kind == 0, F.col("seg")).when(kind == 1, word).otherwise("订单数量").alias("column_label"),
        F.concat_ws("/", F.col("y").cast("string"), F.col("q").cast("string"), "seg").alias("coordinate"), F.lit(None).cast("int").alias("sheet_row"), F.lit(None).cast("int").alias("sheet_column"),
        F.col("v").cast("string").alias("value"), F.col("v").cast("double").alias("numeric_value"), F.lit("单").alias("unit"), F.col("y").alias("year"), F.lit(None).cast("int").alias("month"), F.when(kind == 2, F.col("q")).alias("quarter"),
    )


def askers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("question_id"), (F.col("n_nationkey") % 3).alias("kind"), title().alias("asked_source"), (F.lit(1991) + F.col("c_custkey") % 8).cast("int").alias("y"),
        (F.col("c_custkey") % 4 + 1).cast("int").alias("q"), F.col("c_mktsegment").alias("asked_row"), F.lit("订单数量").alias("asked_indicator"),
    )


@query("sheet_lookups", f"""WITH {SHEETS_SQL},
r AS (SELECT question_id, a.kind, w.v, a.y || '/' || a.q || '/' || a.seg AS place, EXISTS (SELECT 1 FROM w x WHERE x.n = a.n AND x.y = a.y) AS has_year, EXISTS (SELECT 1 FROM w x WHERE x.n = a.n AND x.y = a.y AND x.q = a.q) AS has_quarter
  FROM a LEFT JOIN w ON a.n = w.n AND a.y = w.y AND a.q = w.q AND a.seg = w.seg)
SELECT question_id, CASE WHEN v IS NOT NULL THEN 'valid_cell' WHEN CASE WHEN kind = 0 THEN has_year ELSE has_quarter END THEN 'indicator_not_found' ELSE 'period_not_found' END AS status,
  v::VARCHAR AS value, CASE WHEN v IS NOT NULL THEN place END AS coordinate, CASE WHEN kind = 0 AND has_year THEN 'transposed' ELSE 'plain' END AS layout FROM r""")  # fmt: skip
def sheet_lookups(spark: SparkSession, d: str) -> DataFrame:
    asked = askers(spark, d).withColumnsRenamed({"y": "asked_year", "q": "asked_quarter"}).drop("kind")
    return sp.lookup_answers(asked, sheets(spark, d)).select("question_id", "status", "value", "coordinate", "layout")


@query("sheet_calculations", f"""WITH {SHEETS_SQL},
r AS (SELECT question_id, a.kind, o.v AS v1, p.v AS v2, a.y || '/1/' || a.seg AS at1, a.y || '/' || (a.q % 3 + 2) || '/' || a.seg AS at2 FROM a
  LEFT JOIN w o ON a.n = o.n AND a.y = o.y AND o.q = 1 AND a.seg = o.seg LEFT JOIN w p ON a.n = p.n AND a.y = p.y AND p.q = a.q % 3 + 2 AND a.seg = p.seg)
SELECT question_id, CASE WHEN v1 IS NULL OR v2 IS NULL THEN 'missing_operands' ELSE 'valid_calculation' END AS status,
  CASE WHEN question_id % 3 = 0 THEN v1 - v2 WHEN question_id % 3 = 1 THEN v2 - v1 ELSE v1 + v2 END::DOUBLE AS result,
  CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN CASE WHEN kind = 0 THEN 'transposed' ELSE 'plain' END END AS layout, CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN at1 || ' ' || at2 END AS cells FROM r""")  # fmt: skip
def sheet_calculations(spark: SparkSession, d: str) -> DataFrame:
    a = askers(spark, d)
    row = F.when(F.col("kind") == 0, F.lit("订单数量")).otherwise(F.col("asked_row"))
    one = lambda quarter: F.struct(
        F.lit(None).cast("string").alias("label"), row.alias("row_label"), F.lit(None).cast("string").alias("column_label"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("source_title"),
        F.col("y").alias("year"), F.lit(None).cast("int").alias("month"), quarter.cast("int").alias("quarter"), (F.col("question_id") % 3 == 1).alias("ordered_transition"),
    )
    asked = a.withColumn("selectors", F.array(one(F.lit(1)), one(F.col("q") % 3 + 2))).withColumn("operation", F.when(F.col("question_id") % 3 == 2, "sum").otherwise("difference"))
    out = sp.calculation_answers(asked.drop("kind", "y", "q"), sheets(spark, d))
    return out.select("question_id", "status", "result", "layout", F.when(F.col("status") == "valid_calculation", F.array_join("coordinates", " ")).alias("cells"))
