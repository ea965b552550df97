"""Table questions over cells: filter, score, look up, calculate, compare, report a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import anchor_coverage, bigram_set, squeeze
from .joins import contained
from .lineage import kept

#: Fixed value: scores this close count as a tie.
TIE = 0.0001
MONEY = "decimal(38,10)"


def wide_to_cells(df: DataFrame, source: Column, labels: list[str], values: list[str], unit: Column, year: Column | None = None, quarter: Column | None = None) -> DataFrame:
    """A3: one row per cell of a wide table: row label, column label, coordinate-like key, value as text and number."""
    row = F.concat_ws(" / ", *labels)
    base = df.select(source.alias("source_title"), row.alias("row_label"), (year if year is not None else F.lit(None).cast("int")).alias("year"), (quarter if quarter is not None else F.lit(None).cast("int")).alias("quarter"), unit.alias("unit"), *[F.col(v).cast("string").alias(v) for v in values])
    cells = base.unpivot(["source_title", "row_label", "year", "quarter", "unit"], values, "column_label", "value")
    return cells.withColumn("coordinate", F.concat_ws("!", "row_label", "column_label")).withColumn("numeric_value", F.col("value").try_cast("double"))


def cell_candidates(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """cells of each question's source (equal, or holding the asked title) whose year and quarter fit; an unset constraint fits all.

    Titles are matched on the distinct titles, then joined to the cells by equality.
    """
    titles = cells.select("source_title", F.lower("source_title").alias("_t")).distinct()
    wanted = questions.select("question_id", F.lower("asked_source").alias("_asked"))
    held = contained(wanted, "_asked", titles, "_t").select("question_id", "source_title")
    out = cells.join(held, "source_title").join(questions, "question_id")
    fits = lambda want, have: F.col(want).isNull() | F.col(have).eqNullSafe(F.col(want))
    return kept(out.filter(fits("asked_year", "year") & fits("asked_quarter", "quarter")))


def require_labels(candidates: DataFrame, terms: str = "required") -> DataFrame:
    """all required terms inside row, column and title text; a term of five or more also by its first three characters."""
    text = F.lower(F.concat_ws(" ", "row_label", "column_label", "source_title"))
    ok = lambda t: F.contains(text, F.lower(t)) | ((F.char_length(t) >= 5) & F.contains(text, F.lower(F.substring(t, 1, 3))))
    return candidates.filter(F.forall(F.coalesce(F.col(terms), F.array().cast("array<string>")), ok))


def score_cells(candidates: DataFrame) -> DataFrame:
    """0.25 for a number; row 5 (+2 if equal), column 5 (+2 if equal) where the label holds the asked one."""
    part = lambda asked, label: F.when(F.col(asked).isNull(), 0.0).when(F.lower(asked) == F.lower(label), 7.0).when(F.contains(F.lower(label), F.lower(asked)), 5.0).otherwise(0.0)
    return candidates.withColumn("score", F.when(F.col("numeric_value").isNotNull(), 0.25).otherwise(0.0) + part("asked_row", "row_label") + part("asked_column", "column_label"))


def unique_numeric(cells: DataFrame, keys: list[str]) -> DataFrame:
    """numeric cells once per question, source and coordinate."""
    w = W.partitionBy(*keys, "source_title", "coordinate").orderBy(F.desc("score"), "row_label")
    return cells.filter("numeric_value is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: Why a lookup has no single answer.
REASONS = {
    "period_not_found": "no cell has the asked year, month or quarter",
    "sheet_not_found": "the asked sheet is not among the candidates",
    "source_not_found": "the asked source is not among the tables",
    "no_candidates": "no candidate cell",
    "indicator_not_found": "no candidate holds the asked row or column",
    "empty_value": "the best candidates hold no number",
    "ambiguous_candidates": "several candidates of one score differ in value",
}


def table_lookup(scored: DataFrame, questions: DataFrame | None = None, least: float = 5.0) -> DataFrame:
    """exactly one row per question: status, value, coordinate, assumption and reason.

    Without questions, those that have candidates are answered.

    The best numeric cell answers; of cells within TIE of it, equal values (to six digits)
    answer together, others by resolve_ties, else ambiguous_candidates. A question without
    candidates says which of its filters found nothing: period, sheet, source, in this order.
    """
    questions = scored.select("question_id").distinct() if questions is None else questions
    for c in ("asked_year", "asked_month", "asked_quarter", "asked_sheet", "asked_source"):
        questions = questions if c in questions.columns else questions.withColumn(c, F.lit(None).cast("string"))
    any_ = scored.groupBy("question_id").agg(F.count("*").alias("_cells"), F.max(F.col("score") - F.when(F.col("numeric_value").isNotNull(), 0.25).otherwise(0.0)).alias("_label"))
    numeric = scored.filter(F.col("numeric_value").isNotNull())
    best = numeric.groupBy("question_id").agg(F.max("score").alias("_best"))
    tied = numeric.join(best, "question_id").filter((F.col("_best") - F.col("score") < TIE) & (F.col("score") >= least)).drop("_best")
    order = F.struct("source_title", "coordinate")
    values = F.count_distinct(F.round("numeric_value", 6))
    got = tied.groupBy("question_id").agg(values.alias("_values"), F.count("*").alias("_tied"), F.min_by(F.struct("value", "coordinate"), order).alias("_first"))
    split = tied.join(got.filter("_values > 1").select("question_id"), "question_id", "left_semi")
    chosen = resolve_ties(split).select("question_id", F.struct("value", "coordinate").alias("_chosen"), F.col("tie_rule").alias("_rule"))
    out = questions.join(any_, "question_id", "left").join(best, "question_id", "left").join(got, "question_id", "left").join(chosen, "question_id", "left")
    asked = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()
    missing = F.when(asked("asked_year", "asked_month", "asked_quarter"), "period_not_found").when(asked("asked_sheet"), "sheet_not_found").when(asked("asked_source"), "source_not_found").otherwise("no_candidates")
    status = (
        F.when(F.col("_cells").isNull(), missing).when(F.col("_label") < least, "indicator_not_found").when(F.col("_best").isNull() | F.col("_values").isNull(), "empty_value")
        .when((F.col("_values") == 1) | F.col("_chosen").isNotNull(), "valid_cell").otherwise("ambiguous_candidates")
    )
    out = out.withColumn("status", status).withColumn("_cell", F.when(F.col("status") == "valid_cell", F.when(F.col("_values") == 1, F.col("_first")).otherwise(F.col("_chosen"))))
    assumption = F.when(F.col("status") == "valid_cell", F.when(F.col("_values") > 1, F.col("_rule")).when(F.col("_tied") > 1, "equal_values"))
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("status")]
    return out.select("question_id", "status", F.col("_cell.value").alias("value"), F.col("_cell.coordinate").alias("coordinate"), assumption.alias("assumption"), reason.alias("reason"))


def resolve_ties(tied: DataFrame) -> DataFrame:
    """one of each question's tied cells, by the first rule that names exactly one, with tie_rule; none gives no row.

    first_block: all in one table and under one row label, the smallest row (of those with a
    column sheet_row; others by coordinate). latest_period: all in one table and under one
    row label, all periods differ and are of one kind (year, month or quarter), the latest. question_wording: twice the question's bigrams
    in the row label and once those in the column label, if one cell leads.
    """
    for c, kind in (("month", "int"), ("sheet_row", "int"), ("question", "string")):
        tied = tied if c in tied.columns else tied.withColumn(c, F.lit(None).cast(kind))
    w = W.partitionBy("question_id")
    year, month, quarter = (F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("year", "month", "quarter"))
    kind = F.when(month > 0, "month").when(quarter > 0, "quarter").when(year > 0, "year").otherwise("none")
    period = year * 10_000 + month * 100 + quarter
    asked = F.coalesce("question", F.lit(""))
    wording = 2 * anchor_coverage(F.col("row_label"), asked) * F.size(bigram_set(squeeze(F.col("row_label")))) + anchor_coverage(F.col("column_label"), asked) * F.size(bigram_set(squeeze(F.col("column_label"))))
    rows = tied.withColumn("_kind", kind).withColumn("_period", period).withColumn("_words", F.round(wording, 6))
    facts = rows.groupBy("question_id").agg(
        F.count("*").alias("_n"), F.count_distinct("source_title").alias("_sources"), F.count_distinct("row_label").alias("_labels"), F.min("sheet_row").alias("_top"), F.count_distinct("sheet_row").alias("_rows"),
        F.count_distinct("_period").alias("_periods"), F.count_distinct("_kind").alias("_kinds"), F.max("_kind").alias("_one"), F.max("_period").alias("_latest"), F.max("_words").alias("_lead"),
    )
    rows = rows.join(facts, "question_id")
    leads = F.sum((F.col("_words") == F.col("_lead")).cast("int")).over(w)
    first = (F.col("_sources") == 1) & (F.col("_labels") == 1) & (F.col("_rows") == F.col("_n")) & (F.col("sheet_row") == F.col("_top"))
    latest = (F.col("_sources") == 1) & (F.col("_labels") == 1) & (F.col("_periods") == F.col("_n")) & (F.col("_kinds") == 1) & (F.col("_one") != "none") & (F.col("_period") == F.col("_latest"))
    words = (F.col("_lead") > 0) & (F.col("_words") == F.col("_lead")) & (leads == 1)
    rule = F.when(first, F.lit(0)).when(latest, 1).when(words, 2)
    picked = rows.withColumn("_rule", rule).filter("_rule is not null").withColumn("_r", F.row_number().over(w.orderBy("_rule", "source_title", "coordinate"))).filter("_r = 1")
    name = F.element_at(F.array(*[F.lit(x) for x in ("first_block", "latest_period", "question_wording")]), F.col("_rule") + 1)
    return picked.select(*tied.columns, name.alias("tie_rule"))


def operands(questions: DataFrame, scored: DataFrame) -> DataFrame:
    """F8: per question and selector (pos, asked_row, asked_column) the best cell, its displayed value as an exact decimal."""
    selectors = questions.select("question_id", F.posexplode("selectors").alias("pos", "s")).select("question_id", "pos", F.col("s.row").alias("_row"), F.col("s.column").alias("_column"))
    match = scored.join(selectors, "question_id").filter((F.lower("row_label") == F.lower("_row")) & (F.lower("column_label") == F.lower("_column")))
    one = match.withColumn("_n", F.row_number().over(W.partitionBy("question_id", "pos").orderBy(F.desc("score"), "source_title", "coordinate"))).filter("_n = 1")
    return one.select("question_id", "pos", "source_title", "unit", F.col("value").try_cast(MONEY).alias("operand"))


def calculate(questions: DataFrame, ops: DataFrame) -> DataFrame:
    """Difference (first less the rest), sum, ratio of two; guards for missing operands, mixed units or sources, zero."""
    v = F.col("operand")
    agg = ops.groupBy("question_id").agg(
        F.count("*").alias("n"), F.count_distinct(F.nullif("unit", F.lit(""))).alias("units"), F.count_distinct("source_title").alias("sources"),
        F.sum(F.when(F.col("pos") == 0, v).otherwise(-v)).alias("difference"), F.sum(v).alias("sum"),
        F.max(F.when(F.col("pos") == 0, v)).alias("first"), F.max(F.when(F.col("pos") == 1, v)).alias("second"),
    )
    out = questions.select("question_id", "operation", F.size("selectors").alias("asked")).join(agg, "question_id", "left")
    op = F.col("operation")
    status = (
        F.when(F.coalesce("n", F.lit(0)) < F.col("asked"), "missing_operands").when(F.col("units") > 1, "mixed_units")
        .when((op == "ratio") & (F.col("n") != 2), "missing_operands").when((op == "ratio") & (F.col("second") == 0), "zero_denominator")
        .when((op == "ratio") & (F.col("sources") > 1), "different_sources").otherwise("valid_calculation")
    )
    value = F.when(op == "difference", F.col("difference").cast("double")).when(op == "sum", F.col("sum").cast("double")).when(op == "ratio", F.try_divide(F.col("first").cast("double"), F.col("second").cast("double")))
    return out.withColumn("status", status).select("question_id", "operation", "status", F.when(F.col("status") == "valid_calculation", value).alias("result"))


def display_value(value: Column, places: Column) -> Column:
    """half-up rounding to 0-10 places; the scale of a round is a literal, so one branch each."""
    out = F.lit(None).cast("string")
    for p in range(10, -1, -1):
        out = F.when(places == p, F.round(value.cast(MONEY), p).cast(f"decimal(38,{p})").cast("string")).otherwise(out)
    return out


def table_extreme(scored: DataFrame, keys: list[str]) -> DataFrame:
    """smallest and largest cell per group with their labels; mixed units give none."""
    got = scored.groupBy(*keys).agg(F.count_distinct("unit").alias("units"), F.max_by("row_label", F.struct("numeric_value", "row_label")).alias("max_row"), F.max("numeric_value").alias("max_value"), F.min_by("row_label", F.struct("numeric_value", "row_label")).alias("min_row"), F.min("numeric_value").alias("min_value"))
    return got.filter("units <= 1").drop("units")


def reconcile_total(cells: DataFrame, keys: list[str], total_label: str) -> DataFrame:
    """F16: reported total against the sum of the other rows, equal within 1e-6."""
    is_total = F.col("row_label") == total_label
    got = cells.groupBy(*keys).agg(F.max(F.when(is_total, F.col("numeric_value"))).alias("reported"), F.sum(F.when(~is_total, F.col("value").try_cast(MONEY))).cast("double").alias("added"))
    return got.withColumn("agrees", F.abs(F.col("reported") - F.col("added")) <= 1e-6)


def match_indicators(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """vocabulary terms inside a question, without those inside a longer hit, by position."""
    terms, asked = vocabulary.select("term", F.lower("term").alias("_t")), questions.select("question_id", "question", F.lower("question").alias("_q"))
    hits = contained(terms, "_t", asked, "_q").select("question_id", "question", "term")
    lists = hits.groupBy("question_id", "question").agg(F.collect_set("term").alias("_terms"))
    kept = F.filter("_terms", lambda t: ~F.exists("_terms", lambda o: (F.char_length(o) > F.char_length(t)) & F.contains(F.lower(o), F.lower(t))))
    rows = lists.select("question_id", "question", F.explode(kept).alias("term"))
    return rows.select("question_id", "term", F.expr("locate(lower(term), lower(question))").alias("position"))


#: What a table's title is compared without.
TITLE_NOISE, TITLE_FILLER = r"^\d+_|20\d{2}年|\d{1,2}月|[一二三四1-4]季度|\.(?:xlsx?|csv)$", r"情况|公司经营|[《》\s]"


def match_source(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """the one table whose title fits a question's period and is contained in it without serial number, period and filler; others give no row.

    questions: question_id, question, year, month, quarter (null: any; with all null, a single
    year and month named in the question); titles: source_title.
    """
    plain = lambda t: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), TITLE_NOISE, ""), TITLE_FILLER, "")
    said = F.regexp_extract_all("question", F.lit(r"(20\d{2})年\d{1,2}月"), F.lit(1)), F.regexp_extract_all("question", F.lit(r"(\d{1,2})月"), F.lit(1))
    unset = F.coalesce("year", "month", "quarter").isNull() & (F.size(F.array_distinct(said[0])) == 1) & (F.size(F.array_distinct(said[1])) == 1)
    q = questions.select("question_id", plain(F.col("question")).alias("_q"), F.when(unset, said[0][0].cast("int")).otherwise(F.col("year")).alias("_y"), F.when(unset, said[1][0].cast("int")).otherwise(F.col("month")).alias("_m"), F.col("quarter").alias("_k"))
    t = titles.select("source_title", plain(F.col("source_title")).alias("_t")).distinct()
    held = contained(t, "_t", q, "_q")
    has = lambda n, before, after: n.isNull() | (F.regexp_count("source_title", F.concat(F.lit(before), n.cast("string"), F.lit(after))) > 0)
    fits = held.filter(has(F.col("_y"), "", "年") & has(F.col("_m"), r"(?<!\d)", "月") & has(F.col("_k"), "", "季度"))
    one = fits.groupBy("question_id").agg(F.count_distinct("source_title").alias("_n"), F.min("source_title").alias("_s")).filter("_n = 1")
    return one.select("question_id", F.regexp_replace("_s", r"^\d+_|\.(?:xlsx?|csv)$", "").alias("source_title"))


def label_vocabulary(cells: DataFrame) -> DataFrame:
    """Distinct parts of row and column labels, numbering stripped, 2 to 80 characters."""
    parts = F.explode(F.concat(F.split("row_label", r"\s*/\s*"), F.split("column_label", r"\s*/\s*")))
    term = F.trim(F.regexp_replace("part", r"^\s*(?:其中[：:]?|[（(]?\d+[)）.、])\s*", ""))
    return cells.select(parts.alias("part")).select(term.alias("term")).filter(F.char_length("term").between(2, 80)).distinct()


def derive_metric(long: DataFrame, key: str, names: list[str], expression: str) -> DataFrame:
    """a formula over named values: bound, or missing / ambiguous / unit_conflict; zero division gives null."""
    known = long.filter(F.col("name").isin(*names))
    state = known.groupBy(key).agg(F.count_distinct("name").alias("_names"), F.count("*").alias("_rows"), F.count_distinct("unit").alias("_units"))
    wide = known.groupBy(key).pivot("name", names).agg(F.max("value"))
    status = F.when(F.col("_names") < len(names), "missing").when(F.col("_rows") > len(names), "ambiguous").when(F.col("_units") > 1, "unit_conflict").otherwise("bound")
    return state.join(wide, key).withColumn("status", status).select(key, "status", F.when(F.col("status") == "bound", F.expr(expression)).alias("result"))


def find_formulas(lines: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """lines of 3 to 240 characters with an operator, a letter and a digit or =, with the nearest non-empty lines around."""
    w = W.partitionBy(doc).orderBy(pos)
    filled = lines.filter(F.trim(text) != "").withColumn("before", F.lag(text).over(w)).withColumn("after", F.lead(text).over(w))
    t = F.col(text)
    return filled.filter(F.char_length(t).between(3, 240) & t.rlike(r"[+\-*/×÷^=]") & t.rlike(r"\p{L}") & t.rlike(r"[\d=]"))
