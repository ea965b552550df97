"""Queries over what answers are written from: orders as documents, their lines as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import context as cx
from ..operators import graph, grounding
from ..operators.lineage import written
from .tables import table

QUERIES, SQL = {}, {}

#: A line returned is an item of a list, one accepted leads a list, others are plain; untaxed ones aren't indexed.
ORDER = ["l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]
LINES_SQL = f"""l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS place FROM lineitem),
c AS (SELECT l_orderkey, place, l_orderkey || '-' || place AS chunk_id, l_returnflag AS flag, l_tax > 0 AS indexed, l_extendedprice AS price FROM l)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def lines(spark: SparkSession, d: str) -> DataFrame:
    flag, mode = F.col("l_returnflag"), F.col("l_linestatus")
    text = F.when(flag == "R", F.concat(F.lit("（一）"), mode)).when(flag == "A", F.concat(mode, F.lit("包括："))).otherwise(mode)
    at = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*[F.col(c).asc_nulls_last() for c in ORDER]))
    return table(spark, d, "lineitem").withColumn("pos", at).select(
        "l_orderkey", "pos", flag.alias("flag"), F.col("l_orderkey").cast("string").alias("document_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("pos").cast("string")).alias("chunk_id"),
        text.alias("text"), F.col("l_quantity").cast("int").alias("token_count"), (F.col("l_tax") > 0).alias("indexed"), F.col("l_extendedprice").alias("price"),
    )


@query("source_units", f"""WITH {LINES_SQL},
a AS (SELECT a.l_orderkey, a.chunk_id, a.place, coalesce(n.flag = 'R', false) AS listed, (SELECT min(g.place) FROM c g WHERE g.l_orderkey = a.l_orderkey AND g.place > a.place AND g.place <= a.place + 10 AND NOT g.indexed) AS gap, coalesce(b.flag = 'R', false) AS beyond
  FROM c a LEFT JOIN c b ON b.l_orderkey = a.l_orderkey AND b.place = a.place + 11 LEFT JOIN c n ON n.l_orderkey = a.l_orderkey AND n.place = a.place + 1 WHERE a.flag = 'A')
SELECT a.l_orderkey AS question_id, a.chunk_id AS anchor_id, c.chunk_id, c.place::INTEGER AS place, a.listed AND (a.gap IS NOT NULL OR a.beyond) AS unit_incomplete
FROM a JOIN c ON c.l_orderkey = a.l_orderkey AND (c.place = a.place OR a.listed AND c.place > a.place AND c.place < coalesce(a.gap, a.place + 11))""")  # fmt: skip
def source_units(spark: SparkSession, d: str) -> DataFrame:
    return units_of(lines(spark, d))


def units_of(c: DataFrame) -> DataFrame:
    return cx.source_units(c.filter("flag = 'A'").select(F.col("l_orderkey").alias("question_id"), "chunk_id"), c.drop("l_orderkey", "flag", "price"))


@query("unit_budget")
def unit_budget(spark: SparkSession, d: str) -> DataFrame:
    """Of each order the units of its list leads, in 100 tokens; every second line brings a requirement of its own."""
    c = written(lines(spark, d))
    anchors = c.filter("flag = 'A'").select(F.col("l_orderkey").alias("question_id"), "chunk_id", F.col("pos").alias("rank"), F.array(F.when(F.col("pos") % 2 == 0, F.col("pos").cast("string")).otherwise("all")).alias("tags"))
    return cx.unit_budget(units_of(c), anchors, c.select("chunk_id", "token_count", "text"), most=5, tokens=100)


@query("reserve_clauses", f"""WITH {LINES_SQL},
b AS (SELECT l_orderkey, arg_min(chunk_id, (-price, place, chunk_id)) AS best FROM c WHERE flag = 'A' GROUP BY ALL),
s AS (SELECT l_orderkey, chunk_id, place AS rank, flag = 'R' AS atomic, flag = 'A' AS answers FROM c WHERE place <= 3),
g AS (SELECT l_orderkey, count(*) AS n, bool_or(answers) AS covered, max(rank) FILTER (NOT atomic) AS gives FROM s GROUP BY ALL),
t AS (SELECT g.*, best, NOT covered AND best IS NOT NULL AND (n < 3 OR gives IS NOT NULL) AS turns FROM g LEFT JOIN b USING (l_orderkey)),
o AS (SELECT l_orderkey, chunk_id, rank, false AS reserved FROM s JOIN t USING (l_orderkey) WHERE NOT (turns AND n >= 3 AND rank = gives) UNION ALL SELECT l_orderkey, best, 0, true FROM t WHERE turns)
SELECT l_orderkey AS question_id, chunk_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY rank))::INTEGER AS rank, reserved FROM o""")  # fmt: skip
def reserve_clauses(spark: SparkSession, d: str) -> DataFrame:
    c = lines(spark, d).withColumnRenamed("l_orderkey", "question_id")
    selected = c.filter("pos <= 3").select("question_id", "chunk_id", F.col("pos").alias("rank"), (F.col("flag") == "R").alias("atomic"))
    asks = c.select("question_id").distinct().select("question_id", F.lit("r").alias("requirement_id"), F.lit(1).alias("pos"))
    found = c.filter("flag = 'A'").select("question_id", F.lit("r").alias("requirement_id"), "chunk_id", F.col("price").alias("score"), F.col("pos").alias("rank"))
    return cx.reserve_clauses(selected, asks, found, most=3)


@query("neighbour_graph", f"""WITH {LINES_SQL}, h AS (SELECT * FROM c WHERE place % 4 = 1),
e AS (SELECT h.l_orderkey, h.place AS hit, h.chunk_id AS anchor_id, c.chunk_id, CASE WHEN c.place = h.place THEN NULL WHEN c.place < h.place THEN 'previous_chunk' ELSE 'next_chunk' END AS reason, CASE WHEN c.place = h.place THEN 0 WHEN c.place < h.place THEN 1 ELSE 2 END AS o
  FROM h JOIN c ON c.l_orderkey = h.l_orderkey AND (c.place = h.place OR abs(c.place - h.place) = 1 AND c.flag = 'R'))
SELECT l_orderkey AS question_id, chunk_id, reason, anchor_id, pick FROM (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY hit, o))::INTEGER AS pick FROM e) WHERE pick <= 36""")  # fmt: skip
def neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth line of an order is a hit; lines returned are what the question is about."""
    c = lines(spark, d)
    chunks = c.select("document_id", "pos", "chunk_id", F.lit(None).cast("string").alias("section_title"), F.when(F.col("flag") == "R", "退货记录").otherwise("其他记录").alias("text"))
    hits = c.filter("pos % 4 = 1").select(F.col("l_orderkey").alias("question_id"), F.lit("“退货记录”").alias("question"), "chunk_id", F.col("pos").alias("rank"))
    none = c.limit(0).select("chunk_id", F.col("chunk_id").alias("to_id"), F.lit("clause").alias("kind"), F.lit(0).alias("turn"))
    return graph.expand_graph(hits, chunks, none)


@query("claim_entities", """WITH g AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice)::DECIMAL(18,2) AS p, max(l_discount)::DECIMAL(4,2) AS r, max(l_tax) > 0.05 AS late, max(year(l_shipdate)) + 20 AS y FROM lineitem GROUP BY ALL),
e AS (SELECT *, (round(p::DOUBLE * CASE WHEN r > 0.05 THEN 1.01 ELSE 1 END, 1))::DECIMAL(18,1)::VARCHAR AS said, (r * 100)::INTEGER::VARCHAR AS pct, (y + CASE WHEN late THEN 1 ELSE 0 END)::VARCHAR AS own FROM g),
k AS (SELECT *, own || '年金额' || p || '率' || r AS ev, [own::DOUBLE, p::DOUBLE, r::DOUBLE] AS have FROM e)
SELECT l_orderkey, l_linenumber, y || '年' AS entity, 'date' AS kind FROM k WHERE late
UNION ALL SELECT l_orderkey, l_linenumber, said, 'number' FROM k WHERE NOT contains(ev, said) AND len(list_filter(have, lambda h: abs(said::DOUBLE - h) <= 0.5::DOUBLE * 0.1::DOUBLE + 1e-9::DOUBLE)) = 0
UNION ALL SELECT l_orderkey, l_linenumber, pct || '%', 'number' FROM k WHERE len(list_filter(have, lambda h: pct::DOUBLE = h OR pct::DOUBLE = h * 100::DOUBLE)) = 0""")  # fmt: skip
def claim_entities(spark: SparkSession, d: str) -> DataFrame:
    """A claim per order line: its year, its price to one place (a hundredth too much if much discounted), its discount in percent."""
    keys = ["l_orderkey", "l_linenumber"]
    g = table(spark, d, "lineitem").groupBy(*keys).agg(
        F.max("l_extendedprice").cast("decimal(18,2)").alias("p"), F.max("l_discount").cast("decimal(4,2)").alias("r"), (F.max("l_tax") > 0.05).alias("late"), (F.max(F.year("l_shipdate")) + 20).alias("y")
    )
    said = F.round(F.col("p").cast("double") * F.when(F.col("r") > 0.05, 1.01).otherwise(1.0), 1).cast("decimal(18,1)").cast("string")
    claim = F.concat(F.lit("于"), F.col("y").cast("string"), F.lit("年发生"), said, F.lit("元，比例"), (F.col("r") * 100).cast("int").cast("string"), F.lit("%"))
    own = F.concat((F.col("y") + F.when(F.col("late"), 1).otherwise(0)).cast("string"), F.lit("年，金额"), F.col("p").cast("string"), F.lit("，率"), F.col("r").cast("string"))
    return grounding.unsupported_entities(g.select(*keys, claim.alias("claim")), g.select(*keys, own.alias("text")), keys)
