"""Layout of spreadsheet grids: where data begin, column headers, and which columns label rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import normalize_value

#: What a note of the unit holds, and how a level of a header is joined to the next.
UNIT_NOTE, JOINT = r"单位\s*[:：]", " / "
#: How many rows above the data may hold headers; columns that may label rows; data rows looked at for that.
HEADERS, LABELS, SAMPLE = 3, 3, 8


def infer_layout(grid: DataFrame, keys: list[str]) -> DataFrame:
    """C17: one row per sheet: first_row, first_col, data_row (null without data), header_rows, headers (array by column) and label_cols.

    grid: keys, row, col, value. Empty edges are trimmed. Data begin at the first row but the
    top one with a number, a text and, in one of the HEADERS rows above, two texts. Headers
    join the distinct values of those rows that hold two values and no unit; a column
    without any reads 列n. Columns among the first LABELS that hold only texts in the first
    SAMPLE data rows label rows; without such a column the first does. Columns are counted
    from the trimmed edge.
    """
    text = F.trim(F.coalesce("value", F.lit("")))
    cells = grid.select(*keys, "row", "col", text.alias("v"), normalize_value(text).isNotNull().alias("num")).filter("v <> ''")
    edges = cells.groupBy(*keys).agg(F.min("row").alias("first_row"), F.min("col").alias("first_col"), F.max("col").alias("_last"))
    unit = F.col("v").rlike(UNIT_NOTE)
    rows = cells.groupBy(*keys, "row").agg(F.count("*").alias("n"), F.count_if("num").alias("numbers"), F.count_if(~F.col("num")).alias("texts"), F.bool_or(unit).alias("unit"))
    above = W.partitionBy(*keys).orderBy("row").rangeBetween(-HEADERS, -1)
    rows = rows.withColumn("above", F.max("texts").over(above)).join(edges, keys)
    begins = (F.col("row") > F.col("first_row")) & (F.col("n") >= 2) & (F.col("numbers") >= 1) & (F.col("texts") >= 1) & (F.col("above") >= 2)
    start = rows.groupBy(*keys).agg(F.min(F.when(begins, F.col("row"))).alias("data_row"))
    near = rows.join(start, keys).filter(F.col("row").between(F.greatest(F.col("first_row"), F.col("data_row") - HEADERS), F.col("data_row") - 1))
    heads = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when((F.col("n") >= 2) & ~F.col("unit"), F.col("row")))).alias("_h"))
    sheets = edges.join(start, keys).join(heads, keys, "left")
    one = F.when(F.col("data_row").isNotNull(), F.array(F.greatest(F.col("data_row") - 1, F.col("first_row"))))
    sheets = sheets.withColumn("header_rows", F.when(F.size("_h") > 0, F.col("_h")).otherwise(one)).drop("_h")
    sheets = sheets.withColumn("header_rows", F.coalesce("header_rows", F.array().cast(dict(sheets.dtypes)["header_rows"])))
    titled = cells.join(sheets.select(*keys, "header_rows"), keys).filter(F.array_contains("header_rows", F.col("row")) & ~unit)
    names = titled.groupBy(*keys, "col").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda x: x["v"])), JOINT).alias("name"))
    named = names.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col", "name"))).alias("_names"))
    sample = cells.join(sheets.select(*keys, "data_row", "first_col"), keys).filter(F.col("row").between(F.col("data_row"), F.col("data_row") + SAMPLE - 1) & (F.col("col") - F.col("first_col") < LABELS))
    words = sample.groupBy(*keys, (F.col("col") - F.col("first_col") + 1).alias("at")).agg(F.bool_and(~F.col("num")).alias("only")).filter("only")
    labels = words.groupBy(*keys).agg(F.array_sort(F.collect_list("at")).alias("label_cols"))
    out = sheets.join(named, keys, "left").join(labels, keys, "left")
    headers = F.transform(F.sequence(F.col("first_col"), F.col("_last")), lambda c: F.coalesce(F.try_element_at("_names", c), F.concat(F.lit("列"), (c - F.col("first_col") + 1).cast("string"))))
    first = F.array(F.lit(1)).cast(dict(labels.dtypes)["label_cols"])
    return out.select(*keys, "first_row", "first_col", "data_row", "header_rows", headers.alias("headers"), F.coalesce("label_cols", first).alias("label_cols"))
