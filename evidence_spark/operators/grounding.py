"""Whether what an answer states stands in its evidence (E8): dates, numbers, document numbers and actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Dates, numbers and document numbers, in this order; actors of a procedure.
ENTITY = r"(?:20\d{2}年(?:\d{1,2}月(?:\d{1,2}日)?)?)|(?:[-−－]?\d+(?:\.\d+)?%?)|(?:[A-Za-z一-龥]{1,10}〔\d{4}〕\d{1,6}号)"
ACTOR = r"(?:由|向|经)([一-鿿A-Za-z]{1,35}?(?:委员会|事务所|中心|公司|银行|部门|机构|总局|局|部|处|组|会))(?=审批|批准|备案|审核|核验|报告|报送|提交|负责|办理|确认)"
#: Periods, of which only the year is a statement; marks of layout and of citations.
PERIODS = ((r"(20\d{2})\s*(?:年|[-/—])\s*(?:\d{1,2}|[一二三四])\s*季度", "$1年"), (r"(20\d{2})\s*[-/—]\s*\d{1,2}(?!\s*[月日])", "$1年"), (r"(?:第)?[一二三四1-4]\s*季度", " "))
MARKS = (r"\[\d+\]", r"（\d+）", r"(?m)^\s*(?:(?:\d+|[一二三四五六七八九十]+)[.、)]|[-*•])\s+")
MONTH = r"^(\d{4})年0?(\d{1,2})月$"
DATE, NUMBER, NUMBERED = r"^20\d{2}年", r"^(-?\d+(?:\.\d+)?)(%?)$", r"\d{4}\d{1,6}号"


def plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "％－−﹣〔〕【】[]", "%---"), r"[\s,，]", ""))


def entities(text: Column) -> Column:
    """The distinct statements of a text, without its citations, ordinals of layout and periods (whose years stay)."""
    out = F.coalesce(text, F.lit(""))
    for mark in MARKS:
        out = F.regexp_replace(out, mark, "")
    for period, year in PERIODS:
        out = F.regexp_replace(out, period, year)
    return let(out, lambda t: F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)), F.regexp_extract_all(t, F.lit(ACTOR), F.lit(1)))))


def kind_of(entity: Column) -> Column:
    return F.when(entity.rlike(DATE), "date").when(plain(entity).rlike(NUMBER), "number").when(entity.rlike(r"\d号$"), "document_number").otherwise("actor")


def month_spellings(entity: Column) -> Column:
    year, month = F.regexp_extract(entity, MONTH, 1), F.regexp_extract(entity, MONTH, 2).try_cast("int")
    two, one = F.lpad(month.cast("string"), 2, "0"), month.cast("string")
    forms = F.array(F.concat(year, F.lit("年"), two, F.lit("月")), F.concat(year, F.lit("年"), one, F.lit("月")), F.concat(year, two, F.lit("月")), F.concat(year, F.lit("-"), two))
    return F.when((year != "") & month.between(1, 12), forms).otherwise(F.array().cast("array<string>"))


def statement(entity: Column) -> Column:
    """What a statement is looked up by, read once: struct(entity, plain, core, months, number, value, percent, tolerance)."""

    def of(s: Column) -> Column:
        # Casts of what is no number are kept off: each failed one costs an exception.
        value, places = F.when(s["digits"] != "", s["digits"].try_cast("double")), F.char_length(F.regexp_extract(s["digits"], r"\.(\d+)$", 1))
        months = F.when(s["plain"].rlike(MONTH), month_spellings(s["plain"])).otherwise(F.array().cast("array<string>"))
        tolerance = F.when(places == 0, 0.0).otherwise(0.5 * F.pow(F.lit(10.0), -places) + 1e-9)
        return F.struct(
            s["entity"].alias("entity"), s["plain"].alias("plain"), F.regexp_extract(s["plain"], NUMBERED, 0).alias("core"), months.alias("months"),
            (s["digits"] != "").alias("number"), value.alias("value"), s["percent"].alias("percent"), tolerance.alias("tolerance"),
        )

    parts = lambda p: F.struct(entity.alias("entity"), p.alias("plain"), F.regexp_extract(p, NUMBER, 1).alias("digits"), (F.regexp_extract(p, NUMBER, 2) == "%").alias("percent"))
    return let(let(plain(entity), parts), of)


def supported(said: Column, evidence: Column, have: Column) -> Column:
    """said: see statement; evidence is plain; have: the evidence's numbers as structs (value, percent).

    Held as it is; a document number by year and number alone; a month in another spelling; a
    number within half a unit of its last digit (a whole one exactly), with or without the
    percent sign, a percentage also as a ratio and the other way round.
    """
    value, percent = said["value"], said["percent"]
    close = lambda a, b: F.abs(a - b) <= said["tolerance"]
    near = F.exists(have, lambda h: close(value, h["value"]) | (percent & ~h["percent"] & close(value, h["value"] * 100)) | (~percent & h["percent"] & close(value * 100, h["value"])))
    core = said["core"]
    return F.contains(evidence, said["plain"]) | ((core != "") & F.contains(evidence, core)) | F.exists(said["months"], lambda m: F.contains(evidence, m)) | (said["number"] & F.coalesce(near, F.lit(False)))


def unsupported_entities(claims: DataFrame, cited: DataFrame, keys: list[str], claim: str = "claim", text: str = "text") -> DataFrame:
    """(keys, entity, kind) of every statement of a claim that none of its cited texts supports; a claim without any cites nothing.

    Cited texts meet per claim, of which there are few each; they are read once for numbers,
    and a statement once for what it is looked up by, before it meets any of them.
    """
    said = claims.select(*keys, F.explode(F.transform(entities(F.col(claim)), statement)).alias("_s"))
    evidence = cited.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(plain(F.col(text)))), "\n").alias("_e"))
    number = lambda n: F.struct(F.replace(n, F.lit("%"), F.lit("")).cast("double").alias("value"), F.endswith(n, F.lit("%")).alias("percent"))
    evidence = evidence.withColumn("_have", F.array_distinct(F.transform(F.regexp_extract_all("_e", F.lit(r"-?\d+(?:\.\d+)?%?"), F.lit(0)), number)))
    none = F.array().cast("array<struct<value:double,percent:boolean>>")
    rows = said.join(evidence, keys, "left")
    held = supported(F.col("_s"), F.coalesce("_e", F.lit("")), F.coalesce("_have", none))
    return rows.filter(~held).select(*keys, "_s.entity", kind_of(F.col("_s.entity")).alias("kind"))
