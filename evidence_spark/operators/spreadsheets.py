"""Questions over spreadsheet cells whose periods stand in an index column, a column header or a row label.

Cells: document_id, source_title, sheet_name, row_label, column_label, coordinate, sheet_row,
sheet_column, value, numeric_value, unit, year, month, quarter; status, version_status,
filename and the ledger's fields if there are any. Questions: question_id, question, operation
(null or none: a lookup), selectors, and what they ask for in columns asked_*; absent columns
count as null. Cells that a question may see are written once; each step is an aggregate
per question and selector, so no step gathers a question's cells in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .joins import contained
from .lineage import kept, written
from .tables import MONEY, REASONS, table_lookup

#: Fields of the document ledger that filter by equality.
LEDGER = ("external_doc_id", "issuing_authority", "publication_date", "document_number", "regulatory_topic", "business_domain", "version_status")
#: Documents that can be read, and versions that only an explicit question sees.
READABLE, RETIRED = ("indexed", "table_indexed"), ("repealed", "superseded")
#: A row label that begins with a period, and a period in a column header.
PERIOD_ROW = r"^\s*(20\d{2}年)?\s*(?:(\d{1,2})月|第?([一二三四1-4])季度)\s*[/|｜]\s*(.+?)\s*$"
PERIOD_HEADER = r"(?:第?([一二三四1-4])季度|(\d{1,2})月)"
#: Labels that name no column or scope of their own.
GENERIC_SCOPES = ("本年累计", "截至当期", "本年累计截至当期", "年季度", "季度", "月度", "年月度")
GENERIC_COLUMNS = ("", "项目", "名称", "项目名称", "指标", "指标名称", "地区", "合计", "总计", "本年累计", "截至当期", "本年累计截至当期")
#: Endings that a question may add to a row's name, words of an institution, names of the whole country.
MEASURES = ("投资", "余额", "收入", "支出", "金额", "发生额", "总额", "净额", "总量")
INSTITUTION, NATIONWIDE = r"(?:公司|银行|机构|合计)$", ("全国", "全国合计")
#: A row that is a share of something, and an asked label that means one.
SHARE_ROW, SHARE_ASKED = r"占.{0,14}(?:比例|比重)$|占比$", r"(?:比例|比重|占比)$"
DIGITS = "一二三四"
ASKED = ("source", "sheet", "year", "month", "quarter", "row", "column", "indicator", "metric", "scope", "context", *LEDGER)
PLAIN = ("source", "sheet", "row", "column", "indicator", "metric", "scope", "context")
SELECTOR = "array<struct<label:string,row_label:string,column_label:string,scope:string,source_title:string,year:int,month:int,quarter:int,ordered_transition:boolean>>"


# ---- labels ----


def plain_label(text: Column) -> Column:
    """A label for comparison: lower case, half-width brackets, no white space, slashes or dashes, quarters by number."""
    out = F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), "（）：／", "():/")
    out = F.regexp_replace(out, r"[\s/\\\-_—–]+", "")
    for i, digit in enumerate(DIGITS, 1):
        out = F.regexp_replace(out, f"第?{digit}季度", f"{i}季度")
    return out


def label_words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"[\s、，,]+"), lambda w: w != "")


def words_covered(row: Column, words: Column) -> Column:
    """All words stand in the row; a word's base without a measure's ending must end a word there."""

    def covered(row: Column, word: Column) -> Column:
        ok = (word == "") | F.contains(row, word)
        for m in MEASURES:
            base = F.left(word, F.char_length(word) - len(m))
            ends = word.endswith(m) & (F.char_length(word) > len(m) + 1)
            ok = ok | (ends & F.regexp_like(row, F.concat(F.lit("\\Q"), base, F.lit("\\E(?![一-鿿A-Za-z0-9])"))))
        return ok

    return let(F.struct(row.alias("r"), F.transform(words, plain_label).alias("w")), lambda s: F.forall(s["w"], lambda w: covered(s["r"], w)))


def period_number(digit: Column) -> Column:
    return F.when(F.locate("一", digit) > 0, 1).when(F.locate("二", digit) > 0, 2).when(F.locate("三", digit) > 0, 3).when(F.locate("四", digit) > 0, 4).otherwise(digit.try_cast("int"))


def header_period(label: Column) -> Column:
    """struct(quarter, month) of a column header; both null where it has no period."""
    quarter = F.regexp_extract(F.coalesce(label, F.lit("")), PERIOD_HEADER, 1)
    month = F.regexp_extract(F.coalesce(label, F.lit("")), PERIOD_HEADER, 2).try_cast("int")
    return F.struct(F.when(quarter != "", period_number(quarter)).alias("quarter"), F.when((quarter == "") & month.between(1, 12), month).alias("month"))


def row_period(label: Column) -> Column:
    """struct(year, month, quarter, metric) of a row label that begins with a period, else null."""
    got = lambda i: F.regexp_extract(F.coalesce(label, F.lit("")), PERIOD_ROW, i)
    year = F.regexp_extract(got(1), r"20\d{2}", 0).try_cast("int")
    return F.when(got(4) != "", F.struct(year.alias("year"), got(2).try_cast("int").alias("month"), F.when(got(3) != "", period_number(got(3))).alias("quarter"), got(4).alias("metric")))


def column_leaf(label: Column) -> Column:
    return plain_label(F.element_at(F.split(F.coalesce(label, F.lit("")), " / "), -1))


def title_variants(title: Column) -> Column:
    """an asked title (a plain label) and the forms under which a table may be filed."""
    more = lambda rows, f: let(rows, lambda r: F.array_distinct(F.concat(r, F.transform(r, f))))
    swap = lambda a, b: lambda t: F.replace(t, F.lit(a), F.lit(b))
    out = F.array(title)
    out = more(out, lambda t: F.regexp_replace(t, r"^\d{1,4}(?:\s*[_\-－—]\s*|(?=20\d{2}年))", ""))
    out = more(out, lambda t: F.regexp_replace(t, r"^20\d{2}年(?:\d{1,2}月|第?[一二三四1-4]季度)?", ""))
    for short, long in (("财产险", "财产保险"), ("人身险", "人身保险")):
        out = more(more(out, swap(short, long)), swap(long, short))
    out = more(more(out, lambda t: F.regexp_replace(t, r"(\d{4})年0([1-9])月", "$1年$2月")), lambda t: F.regexp_replace(t, r"(\d{4})年([1-9])月", "$1年0$2月"))
    out = more(out, lambda t: F.when(F.contains(t, F.lit("情况表")), F.replace(t, F.lit("情况表"), F.lit("表"))).otherwise(F.regexp_replace(t, "表$", "情况表")))
    return F.filter(more(out, lambda t: F.regexp_replace(t, r"\(季度\)$", "")), lambda t: t != "")


# ---- F1 to F4: what a question may see, and how well it fits ----


def with_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with the columns that it lacks, as nulls."""
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items() if c not in df.columns])


def prepared(questions: DataFrame) -> DataFrame:
    numbers = {"asked_year", "asked_month", "asked_quarter"}
    out = with_columns(questions, {"question": "string", "operation": "string", "selectors": SELECTOR} | {f"asked_{c}": "int" if f"asked_{c}" in numbers else "string" for c in ASKED})
    out = out.withColumn("selectors", F.coalesce(F.col("selectors"), F.array().cast(SELECTOR)))
    return out.select("*", *[plain_label(F.col(f"asked_{c}")).alias(f"_a_{c}") for c in PLAIN])


def visible_cells(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """each question's cells by source, sheet, ledger fields and year; neither month nor quarter is looked at.

    The asked title, in one of its forms, stands in the table's. Questions whose selectors
    name two sources or more are held by these alone. A question without any source sees the
    tables in which the longest of its labels stands (of labels of five characters or more the
    first three count, as in require_terms); one without labels sees none. Cells are written
    once with their plain labels: what makes them is read once, and no label is made anew for
    each row that a cell is counted from.
    """
    text = dict.fromkeys(("document_id", "sheet_name", "coordinate", "unit", "status", "filename", *LEDGER), "string") | dict.fromkeys(("sheet_row", "sheet_column", "year", "month", "quarter"), "int")
    cells = with_columns(cells, text)
    cells = cells.filter(F.coalesce(F.col("status").isin(*READABLE), F.lit(True)))
    plain = {"_source": F.coalesce("source_title", "filename"), "_r": F.col("row_label"), "_c": F.col("column_label"), "_sheet": F.col("sheet_name")}
    cells = written(cells.select("*", *[plain_label(c).alias(k) for k, c in plain.items()], column_leaf(F.col("column_label")).alias("_leaf")))
    q = prepared(questions)
    named = F.array_distinct(F.filter(F.transform("selectors", lambda s: plain_label(s["source_title"])), lambda t: t != ""))
    own = F.col("_a_source")
    sources = F.when(F.size(named) >= 2, named).when(own != "", F.array(own)).otherwise(named)
    labels = F.concat(F.array(*[F.col(f"_a_{c}") for c in ("indicator", "row", "column", "metric")]), F.transform("selectors", lambda s: plain_label(F.coalesce(s["label"], s["row_label"]))))
    longest = F.element_at(F.array_sort(labels, lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1)
    by_title = q.filter(F.size(sources) > 0).select("question_id", F.explode(F.array_distinct(F.flatten(F.transform(sources, title_variants)))).alias("_asked"))
    by_label = q.filter(F.size(sources) == 0).select("question_id", F.when(F.char_length(longest) >= 5, F.left(longest, F.lit(3))).otherwise(longest).alias("_asked"))
    titles = cells.select("_source").distinct()
    texts = cells.select("_source", plain_label(F.concat_ws(" ", "row_label", "column_label", "source_title")).alias("_text")).distinct()
    seen = contained(by_title, "_asked", titles.withColumn("_text", F.col("_source")), "_text").select("question_id", "_source")
    seen = seen.union(contained(by_label, "_asked", texts, "_text").select("question_id", "_source")).distinct()
    out = cells.join(seen, "_source").join(q, "question_id")
    same = lambda asked, have: F.col(asked).isNull() | (F.col(asked).cast("string") == "") | F.col(have).eqNullSafe(F.col(asked))
    fits = F.col("asked_year").isNull() | F.col("year").eqNullSafe(F.col("asked_year"))
    for c in LEDGER:
        fits = fits & same(f"asked_{c}", c)
    retired = F.coalesce(F.col("version_status").isin(*RETIRED), F.lit(False)) & ~F.coalesce(F.col("asked_version_status").isin(*RETIRED), F.lit(False))
    return out.filter(fits & ~retired & F.contains("_sheet", "_a_sheet"))


def in_period(visible: DataFrame) -> DataFrame:
    """cells of the asked month and quarter, by the index column or, where that is null, the column header, which then fills it."""
    head = header_period(F.col("column_label"))
    out = visible.withColumn("_head", head)
    for c in ("month", "quarter"):
        have = F.coalesce(F.col(c), F.col(f"_head.{c}"))
        out = out.filter(F.col(f"asked_{c}").isNull() | have.eqNullSafe(F.col(f"asked_{c}"))).withColumn(c, have)
    return out.drop("_head")


def required_terms(row: str = "asked_row") -> Column:
    """the labels a lookup's cell must show: indicator, each word of the row, column and metric, then those of selectors; generic ones are none."""
    words = F.transform(label_words(F.col(row)), plain_label)
    terms = F.concat(F.array("_a_indicator"), words, F.array("_a_column", "_a_metric"), F.flatten(F.transform("selectors", lambda s: F.array(*[plain_label(s[c]) for c in ("label", "row_label", "column_label")]))))
    return F.array_distinct(F.filter(terms, lambda t: (t != "") & ~t.isin(*GENERIC_SCOPES)))


def term_shown(term: Column, text: Column) -> Column:
    """A term stands in the text; one that is a period by its value; one of five characters or more by its first three."""
    period = header_period(term)
    quarter = F.concat(F.lit("["), F.substring(F.lit(DIGITS), period["quarter"], F.lit(1)), period["quarter"].cast("string"), F.lit("]\\s*季度"))
    timed = F.when(period["quarter"].isNotNull(), F.regexp_like(text, quarter)).when(period["month"].isNotNull(), F.regexp_like(text, F.concat(period["month"].cast("string"), F.lit("\\s*月"))))
    return F.contains(text, term) | F.coalesce(timed, (F.char_length(term) >= 5) & F.contains(text, F.left(term, F.lit(3))))


def require_terms(visible: DataFrame, terms: Column) -> DataFrame:
    text = plain_label(F.concat_ws(" ", "row_label", "column_label", "source_title", "filename"))
    return visible.filter(F.forall(terms, lambda t: term_shown(t, text)))


def overlap(question: Column, text: Column) -> Column:
    """Share of the question's words in the text; of a longer Chinese clause half its share of bigrams."""
    squeezed = F.lower(F.regexp_replace(text, r"\s+", ""))
    terms = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"[一-鿿]{2,}|[A-Za-z0-9_]{2,}"), F.lit(0))

    def hit(term: Column) -> Column:
        t = F.lower(term)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))
        part = F.size(F.filter(grams, lambda g: F.contains(squeezed, g))) / F.size(grams) * 0.5
        return F.when(F.contains(squeezed, t), 1.0).when(t.rlike(r"^[一-鿿]{3,}$"), part).otherwise(0.0)

    total = F.aggregate(F.transform(terms, hit), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(terms) > 0, total / F.size(terms)).otherwise(0.0)


def score(visible: DataFrame) -> DataFrame:
    """number 0.25; row 5 with 2 for equality and 2 for its last part, or 1 for a single word; column 5; indicator and metric 4; scope 3; family 4 or 3; context 2; word overlap."""
    row, column, source, asked = F.col("_r"), F.col("_c"), F.col("_source"), {c: F.col(f"_a_{c}") for c in PLAIN}
    leaf = plain_label(F.element_at(F.split(F.coalesce("column_label", F.lit("")), r"\s*/\s*|[|｜>]"), -1))
    locator = plain_label(F.concat_ws(" ", "asked_row", "asked_indicator", "asked_metric", "asked_scope"))
    share = row.rlike(SHARE_ROW) & ~locator.rlike(SHARE_ASKED)
    words = F.transform(label_words(F.col("asked_row")), plain_label)
    tail = plain_label(F.element_at(F.split(F.coalesce("row_label", F.lit("")), "/"), -1))
    equal = F.when(row == asked["row"], 2.0).otherwise(0.0) + F.when(F.array_contains(words, tail), 2.0).otherwise(0.0)
    part = F.when(share | (F.size(words) == 0), 0.0).when(words_covered(row, label_words(F.col("asked_row"))), 5.0 + equal).when(F.exists(words, lambda w: F.contains(row, w)), 1.0).otherwise(0.0)
    # A question without a row asks for any: each cell has the row's share, as with all words covered.
    total = F.when(F.col("numeric_value").isNotNull(), 0.25).otherwise(0.0) + F.when(F.size(words) == 0, 5.0).otherwise(part)
    total = total + F.when((asked["column"] != "") & F.contains(leaf, asked["column"]), 5.0).otherwise(0.0)
    for c in ("indicator", "metric"):
        inside = F.contains(row, asked[c]) | F.contains(F.concat(row, column), asked[c])
        total = total + F.when(asked[c] == "", 0.0).when(inside, F.when(row == asked[c], 6.0).otherwise(4.0)).when(F.contains(source, asked[c]) & ~share, 2.5).otherwise(0.0)
    total = total + F.when((asked["scope"] != "") & F.contains(F.concat(row, column), asked["scope"]) & ~share, 3.0).otherwise(0.0)
    family = F.when(F.contains(source, asked["scope"]), 4.0).when((F.char_length(asked["scope"]) >= 4) & F.contains(source, F.left(asked["scope"], F.lit(3))), 3.0).otherwise(0.0)
    total = total + F.when(asked["scope"] == "", 0.0).otherwise(family)
    total = total + F.when((asked["context"] != "") & (F.contains(row, asked["context"]) | F.contains(source, asked["context"])), 2.0).otherwise(0.0)
    return visible.withColumn("score", total + overlap(F.col("question"), F.concat(row, column)))


# ---- F17: tables whose rows begin with the period ----


def transposed_cells(visible: DataFrame) -> DataFrame:
    """Numeric cells whose row label begins with a period, as _turned."""
    return visible.withColumn("_turned", row_period(F.col("row_label"))).filter("_turned is not null and numeric_value is not null")


def turned_fits(year: Column, month: Column, quarter: Column, metric: Column, institution: Column) -> Column:
    """The row's period and metric and the column's institution are what is asked; an institution must be asked."""
    have = F.col("_turned")
    unset = lambda want, got: want.isNull() | got.eqNullSafe(want)
    period = unset(quarter, have["quarter"]) & unset(month, have["month"]) & (year.isNull() | have["year"].isNull() | (have["year"] == year))
    return period & words_covered(have["metric"], label_words(metric)) & (F.size(institution) > 0) & words_covered(F.col("_c"), institution)


def asked_institution(column: Column) -> Column:
    """Words of the asked column or else those of the asked row that aren't the indicator."""
    rest = F.filter(label_words(F.col("asked_row")), lambda w: w != F.col("_a_indicator"))
    words = label_words(column)
    return F.when(F.size(words) > 0, words).otherwise(rest)


CELL_KEY = ("document_id", "_source", "sheet_name", "coordinate")


def transposed_lookups(visible: DataFrame) -> DataFrame:
    """question_id, status, value, coordinate of every question that sees a transposed row; no other question has a row here."""
    fits = turned_fits(F.col("asked_year"), F.col("asked_month"), F.col("asked_quarter"), F.col("asked_indicator"), asked_institution(F.col("asked_column")))
    got = transposed_cells(visible).withColumn("_fits", F.coalesce(fits, F.lit(False))).groupBy("question_id").agg(
        F.count_if("_fits").alias("_n"), F.min(F.when(F.col("_fits"), F.struct("source_title", "sheet_name", "coordinate", "value"))).alias("_c")
    )
    status = F.when(F.col("_n") == 1, "valid_cell").when(F.col("_n") == 0, "indicator_not_found").otherwise("ambiguous_candidates")
    one = F.col("_n") == 1
    return got.select("question_id", status.alias("status"), F.when(one, F.col("_c.value")).alias("value"), F.when(one, F.col("_c.coordinate")).alias("coordinate"))


def asked_once(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, ids): questions that ask the same in every column as one, whose question_id is a hash of these; ids has question_id and that hash as _same."""
    what = sorted(c for c in questions.columns if c != "question_id")
    hashed = questions.withColumn("_same", F.sha2(F.to_json(F.struct(*what)), 256))
    return hashed.drop("question_id").withColumnRenamed("_same", "question_id").dropDuplicates(["question_id"]), hashed.select("question_id", "_same")


def for_each(ids: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers of asked_once's questions for every question that asked them."""
    return ids.join(answers.withColumnRenamed("question_id", "_same"), "_same").select(*answers.columns)


def lookup_answers(questions: DataFrame, cells: DataFrame, least: float = 5.0) -> DataFrame:
    """One row per question: status, value, coordinate, assumption, reason and layout (plain or transposed).

    Questions that see no cell of their period are read a second time by the transposed
    layout; where no row of theirs has it, they keep their status. Questions that ask the
    same are answered once.
    """
    questions, ids = asked_once(questions)
    questions = kept(questions)
    visible = kept(visible_cells(questions, cells))
    fitting = in_period(visible)
    scored = kept(score(require_terms(fitting, required_terms())))  # read by each step of the lookup
    asked = prepared(questions)
    reached = fitting.select("question_id").distinct()
    found = table_lookup(scored, asked, least)
    # A period was found where only labels failed.
    failed = found["status"].isin("period_not_found", "sheet_not_found", "source_not_found", "no_candidates")
    turned = transposed_lookups(visible.join(reached, "question_id", "left_anti"))
    found = found.join(reached.withColumn("_reached", F.lit(True)), "question_id", "left")
    status = F.when(failed & F.col("_reached"), "indicator_not_found").otherwise(F.col("status"))
    found = found.select("question_id", status.alias("status"), "value", "coordinate", "assumption")
    both = found.join(turned.select("question_id", F.struct("status", "value", "coordinate").alias("_t")), "question_id", "left")
    take = lambda c: F.when(F.col("_t").isNotNull(), F.col(f"_t.{c}")).otherwise(F.col(c))
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    out = both.select("question_id", take("status").alias("status"), take("value").alias("value"), take("coordinate").alias("coordinate"), "assumption", F.when(F.col("_t").isNotNull(), "transposed").otherwise("plain").alias("layout"))
    return for_each(ids, out.withColumn("reason", reason[F.col("status")]))


# ---- F8: operands ----


def label_specificity(asked: Column, row: Column, leaf: Column) -> Column:
    """40 the row, 35 the header, 20 row and label within one another, 15 header, 12 all words in the row, 10 and 5 without a total's ending, 0 none."""
    within = lambda a, b: F.contains(a, b) | F.contains(b, a)
    words = F.split(asked, " ")
    bare = lambda t: F.regexp_replace(t, "(?:合计|总计)$", "")
    base = lambda a, b: (bare(a) != "") & (bare(b) != "") & within(bare(a), bare(b))
    return (
        F.when(asked == "", 0).when(asked == row, 40).when(asked == leaf, 35).when(within(asked, row), 20)
        .when((F.size(words) > 1) & F.forall(words, lambda w: F.contains(row, w)), 12).when(within(asked, leaf), 15).when(base(asked, row), 10).when(base(asked, leaf), 5).otherwise(0)
    )


def row_asked(asked: Column, row: Column) -> Column:
    words = label_words(asked)
    whole = (F.size(words) == 1) & plain_label(F.get(words, F.lit(0))).isin(*NATIONWIDE) & row.isin(*NATIONWIDE)
    return (F.size(words) == 0) | words_covered(row, words) | whole


def operand_pairs(scored: DataFrame) -> DataFrame:
    """Every numeric cell with each selector of its question: how specifically it fits (_spec), how well (_rank), whether at all (_ok) or on the second try (_retry)."""
    leaf = F.col("_leaf")
    named = F.filter(F.transform("selectors", lambda s: plain_label(s["source_title"])), lambda t: t != "")
    ours = (F.size(named) == 0) | F.exists(named, lambda t: F.contains(F.col("_source"), t))
    asks = ours & ~leaf.isin(*GENERIC_COLUMNS) & F.contains(plain_label(F.col("question")), leaf)
    wanted = scored.filter(asks).groupBy("question_id").agg(F.max_by(leaf, F.char_length(leaf)).alias("_wanted"))
    s = F.col("s")
    rows = scored.filter("numeric_value is not null").join(wanted, "question_id", "left").select("*", F.posexplode("selectors").alias("pos", "s"))
    label = F.array_join(F.transform(label_words(s["label"]), plain_label), " ")
    timed = F.coalesce(s["year"], s["month"], s["quarter"]).isNotNull()
    own = plain_label(s["column_label"])
    column = F.when((own == "") & ~timed, F.coalesce("_wanted", F.lit(""))).otherwise(own)
    rows = rows.withColumn("_label", label).withColumn("_column", column)
    # A placeholder such as "quarter" asks for any period of its kind.
    some = F.col("_column").rlike(r"^(?:年|季度|月度|月|季|度)+$")
    kind = F.when(F.contains("_column", F.lit("季")), F.coalesce("column_label", F.lit("")).rlike("[一二三四1-4]季度")).otherwise(F.coalesce("column_label", F.lit("")).rlike(r"\d{1,2}月"))
    scope = let(plain_label(s["scope"]), lambda t: F.when(t.isin("季度", "年季度", "月度", "年月度"), "").otherwise(t))
    rows = rows.withColumn("_some", some).withColumn("_scope", scope).withColumn("_target", F.when(some, "").otherwise(F.col("_column")))
    both = F.concat("_r", "_c")
    period = F.lit(True)
    for c in ("year", "month", "quarter"):
        period = period & (s[c].isNull() | F.col(c).eqNullSafe(s[c]))
    source = let(plain_label(s["source_title"]), lambda t: (t == "") | F.exists(title_variants(t), lambda v: F.contains(F.col("_source"), v)))
    held = period & source & (~F.col("_some") | kind) & F.contains(both, "_scope")
    under = F.contains("_c", "_target")
    unlabelled = (F.col("_target") == "本年累计截至当期") & F.col("_c").startswith("列") & ~under
    spec = label_specificity(F.col("_label"), F.col("_r"), F.col("_leaf"))
    ok = held & ((F.col("_label") == "") | (spec > 0)) & row_asked(s["row_label"], F.col("_r")) & (under | unlabelled)
    words = label_words(s["row_label"])
    rest = F.filter(words, lambda w: ~plain_label(w).rlike(INSTITUTION))
    rest = F.when(F.size(rest) > 0, rest).otherwise(words)
    retry = held & under & (F.size(words) > 1) & (F.size(rest) < F.size(words)) & words_covered(F.col("_r"), rest)
    parts = sum(F.when(c != "", 1).otherwise(0) for c in (F.col("_label"), F.trim(F.coalesce(s["row_label"], F.lit(""))), F.col("_target"), F.col("_scope")))
    down = F.coalesce("sheet_row", F.lit(0)) * 0.01
    rank = F.col("score") + parts * 10.0 - down + F.when(unlabelled, F.coalesce("sheet_column", F.lit(0)) * 0.01).otherwise(0.0)
    false = F.lit(False)
    return rows.select("*", spec.alias("_spec"), rank.alias("_rank"), (F.col("score") - down).alias("_rank2"), F.coalesce(ok, false).alias("_ok"), F.coalesce(retry, false).alias("_retry"))


def choose_operands(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """F8: the chosen cell of each selector: question_id, group, pos, cell (struct), retried and assumption.

    The most specific label wins, then the score with 10 for each stated locator, then the
    upper row; ties go to the first source, sheet and coordinate. Where a row locator of
    several words fits nothing, its words that name no institution are tried. A placeholder
    for a period takes the first of the table, in a transition's later selectors the last
    of the same row.
    """
    keys = ["question_id", *group]
    cell = F.struct(*[F.col(c) for c in ("source_title", "sheet_name", "sheet_row", "sheet_column", "coordinate", "row_label", "column_label", "document_id", "value", "numeric_value", "unit", "year", "score")])
    place = [F.coalesce("source_title", F.lit("")), F.coalesce("sheet_name", F.lit("")), F.coalesce("sheet_row", F.lit(0)), F.coalesce("sheet_column", F.lit(0))]
    pairs = kept(operand_pairs(scored))
    tokens = F.regexp_extract_all(F.concat_ws("", "row_label", "column_label"), F.lit(r"[一二三四1-4]季度|\d{1,2}月"), F.lit(0))
    seen = pairs.filter("_ok or _retry").groupBy(*keys, "pos").agg(
        F.min(F.when(F.col("_ok"), F.struct(-F.col("_spec"), -F.col("_rank"), *place, cell.alias("cell")))).alias("_first"),
        F.min(F.when(F.col("_retry"), F.struct(-F.col("_rank2"), *place, cell.alias("cell")))).alias("_second"),
        F.min(F.when(F.col("_ok"), F.struct((-F.col("_spec")).alias("spec"), *place, cell.alias("cell")))).alias("_top"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_ok"), tokens)))).alias("_periods"),
        F.first("_some").alias("_some"), F.first("s").alias("s"),
    )
    moves = F.exists("selectors", lambda x: F.coalesce(x["ordered_transition"], F.lit(False)))
    asked = scored.select("question_id", "selectors", moves.alias("_moves")).groupBy("question_id").agg(F.first("selectors").alias("selectors"), F.first("_moves").alias("_moves"))
    seen = seen.join(asked, "question_id")
    begin = seen.filter("pos = 0").select(*keys, F.when(F.col("_some"), F.col("_top.cell")).otherwise(F.coalesce("_first.cell", "_second.cell")).alias("_start"))
    seen = seen.join(begin, keys, "left")
    later = F.col("_some") & F.col("_moves") & (F.col("pos") > 0)
    same_row = F.trim(F.coalesce(F.col("s.row_label"), F.lit(""))) == F.trim(F.coalesce(F.get("selectors", F.lit(0))["row_label"], F.lit("")))
    anchored = seen.filter(later).select(*keys, "pos", F.col("_top.spec").alias("_best"), F.when(same_row, F.col("_start")).alias("_anchor"))
    near = lambda c: F.col("_anchor").isNull() | F.col(c).eqNullSafe(F.col(f"_anchor.{c}"))
    last = pairs.filter("_ok").join(anchored, [*keys, "pos"]).filter((-F.col("_spec") == F.col("_best")) & near("document_id") & near("source_title") & near("sheet_name") & near("sheet_row"))
    last = last.groupBy(*keys, "pos").agg(F.max(F.struct(*place, cell.alias("cell"))).alias("_last"))
    out = seen.join(last, [*keys, "pos"], "left")
    chosen = F.when(later, F.col("_last.cell")).when(F.col("_some"), F.col("_top.cell")).otherwise(F.coalesce("_first.cell", "_second.cell"))
    fixed = F.coalesce(F.col("s.month"), F.col("s.quarter")).isNotNull()
    assumption = F.when(later, "last_of_table").when(F.col("_some"), "first_of_table").when(~fixed & (F.size("_periods") > 1), "first_period")
    return out.select(*keys, "pos", chosen.alias("cell"), F.col("_first").isNull().alias("retried"), assumption.alias("assumption")).filter("cell is not null")


def transposed_operands(visible: DataFrame) -> DataFrame:
    """the only cell of each selector by the transposed layout: question_id, pos, cell."""
    s = F.col("s")
    metric = F.coalesce(F.nullif(F.trim(F.coalesce(s["label"], s["row_label"])), F.lit("")), F.col("asked_indicator"))
    rows = transposed_cells(visible).select("*", F.posexplode("selectors").alias("pos", "s"))
    year = s["year"].isNull() | F.col("year").eqNullSafe(s["year"])
    fits = turned_fits(s["year"], s["month"], s["quarter"], metric, asked_institution(F.coalesce(s["column_label"], F.col("asked_column"))))
    cell = F.struct(*[F.col(c) for c in ("source_title", "sheet_name", "coordinate", "row_label", "column_label", "value", "numeric_value", "unit")], F.lit(0.0).alias("score"))
    got = rows.filter(year & fits).groupBy("question_id", "pos").agg(F.count_distinct(F.struct(*CELL_KEY)).alias("_n"), F.min(cell).alias("cell"))
    return got.filter("_n = 1").select("question_id", "pos", "cell")


def complete(chosen: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The groups in which every selector has a cell and no two have the same."""
    where = F.struct("cell.source_title", "cell.sheet_name", "cell.coordinate")
    found = chosen.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_distinct(where).alias("_cells"), F.max("cell.score").alias("_score"))
    return found.join(asked.select("question_id", F.size("selectors").alias("_asked"), F.col("_a_scope").alias("_scope")), "question_id").filter("_n = _asked and _cells = _asked")


#: How a question asks for places, a percentage and a multiple.
PLACES, PERCENT, MULTIPLE = r"保留([零〇一二两三四五六七八九十\d]+)位小数", r"百分比|百分数|比重|占比|比例", r"[多少几]倍"
PLACE_WORDS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def asked_places(question: Column, operation: Column) -> Column:
    """the places a question asks for, 0 to 10; of ratios else 2 for percentages and multiples, 4 otherwise."""
    said = F.regexp_extract(F.coalesce(question, F.lit("")), PLACES, 1)
    known = F.coalesce(said.try_cast("int"), F.create_map(*[F.lit(x) for kv in PLACE_WORDS.items() for x in kv])[said])
    usual = F.when(operation == "ratio", F.when(F.coalesce(question, F.lit("")).rlike(f"{MULTIPLE}|{PERCENT}"), 2).otherwise(4))
    return F.coalesce(F.when(known.between(0, 10), known), usual)


def calculation_answers(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per question: status, result, places, layout, coordinates by selector, assumptions.

    A ratio's operands come from one source: of those that have all of them one that the
    asked scope names, then the one with the best score. Where selectors lack a cell, the
    transposed layout is tried; a question keeps its first status if none of its rows has it.
    Questions that ask the same are answered once.
    """
    questions, ids = asked_once(questions)
    questions = kept(questions)
    visible = kept(visible_cells(questions, cells))
    asked = prepared(questions)
    scored = score(in_period(visible))
    ratio = F.col("operation") == "ratio"
    scored = scored.withColumn("_group", F.when(ratio, F.col("_source")).otherwise(F.lit("")))
    chosen = kept(choose_operands(scored, ["_group"]))
    rank = F.struct(F.when((F.col("_scope") != "") & F.contains("_group", "_scope"), 1).otherwise(0), "_score", "_group")
    best = complete(chosen, asked, ["question_id", "_group"]).groupBy("question_id").agg(F.max_by("_group", rank).alias("_group"))
    plain = chosen.join(best, ["question_id", "_group"]).select("question_id", "pos", "cell.value", "cell.unit", "cell.coordinate", "assumption", F.lit("plain").alias("layout"))
    turned = transposed_operands(visible.join(best, "question_id", "left_anti"))
    whole = complete(turned, asked, ["question_id"]).select("question_id")
    turned = turned.join(whole, "question_id").select("question_id", "pos", "cell.value", "cell.unit", "cell.coordinate", F.lit(None).cast("string").alias("assumption"), F.lit("transposed").alias("layout"))
    operands = plain.union(turned).withColumn("_v", F.col("value").try_cast(MONEY))
    agg = operands.groupBy("question_id").agg(
        F.count("_v").alias("_n"), F.count_distinct(F.nullif("unit", F.lit(""))).alias("_units"), F.max("layout").alias("layout"),
        F.max(F.when(F.col("pos") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("pos") == 1, F.col("_v"))).alias("_b"), F.sum("_v").alias("_sum"),
        F.array_sort(F.collect_list(F.struct("pos", "coordinate"))).alias("_c"), F.array_sort(F.collect_set("assumption")).alias("assumptions"),
    )
    moves = F.exists("selectors", lambda x: F.coalesce(x["ordered_transition"], F.lit(False)))
    out = asked.select("question_id", "question", "operation", "selectors", moves.alias("_moves")).join(agg, "question_id", "left")
    n, op = F.size("selectors"), F.col("operation")
    status = (
        F.when((n < 2) | F.col("_n").isNull() | (F.col("_n") < n) | ((op == "ratio") & (n != 2)), "missing_operands").when(F.col("_units") > 1, "mixed_units")
        .when((op == "ratio") & (F.col("_b") == 0), "zero_denominator").otherwise("valid_calculation")
    )
    percent = F.when(F.coalesce("question", F.lit("")).rlike(PERCENT), 100.0).otherwise(1.0)
    difference = F.when(F.col("_moves") & (n == 2), F.col("_b") - F.col("_a")).otherwise(2 * F.col("_a") - F.col("_sum")).cast("double")
    value = F.when(op == "difference", difference).when(op == "sum", F.col("_sum").cast("double")).when(op == "ratio", F.try_divide(F.col("_a").cast("double"), F.col("_b").cast("double")) * percent)
    good = F.col("status") == "valid_calculation"
    out = out.withColumn("status", status).select(
        "question_id", "operation", "status", F.when(good, value).alias("result"), asked_places(F.col("question"), op).alias("places"), "layout", F.col("_c.coordinate").alias("coordinates"), F.coalesce("assumptions", F.array().cast("array<string>")).alias("assumptions")
    )
    return for_each(ids, out)
