"""What evidence has to meet: its source, its facets, and the requirements it may be bound to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numeral

#: What a question asks for, and what shows that evidence has it.
NUMERIC_QUESTION = r"\d|百分之|比例|比率|阈值|限额|期限|天数|金额|余额|增速|增幅|资本|权重"
NUMERIC_VALUE = r"(\d+(?:\.\d+)?)\s*[%％]?"
CONDITION_QUESTION = "条件|情形|例外|除外|不适用|不得|应当|可以|前提|边界"
CONDITION_MARKER = "条件|情形|例外|除外|不适用|不得|应当|可以|前提|但书|但是|除"
LIST_QUESTION = "哪些|包括|分别|列出|情形|项目|清单"
LIST_MARKER = r"[（(]\s*[一二三四五六七八九十\d]+\s*[）)]|\n\s*\d+[.、]|[；;]"
DEFINITION_QUESTION, DEFINITION_MARKER = "定义|是什么|含义|界定|所称", "是指|系指|定义为|所称|指的是"
CRITICAL = ("source", "numeric", "definition", "table")
#: Terms too general to bind evidence by, and names that are common endings.
GENERIC_TERMS = ["规定", "要求", "内容", "方面", "情况", "相关", "问题", "哪些", "什么", "应当", "可以", "需要", "进行", "说明"]
GENERIC_ENDING = "(?:银行|机构|公司|部门|政府|人员|企业|单位|委员会|管理局)$"
ANCHOR_SPLIT = r"[，。；：、？！?!\s]|(?:应当|应|如何|哪些|什么|明确|说明|包括|进行|是否|分别|以及|其中|对于|根据|按照|所|就|对应|通过|由|部分)"
ANCHOR_TRIM = "的了中在对与和及或等其该本这那"
ANCHOR_START = "^(?:方面|部分|信息|内容|工作|情况|要求|规定|相关)"
VERSION_QUESTION = "哪一?版本|哪个版本|何种版本|什么版本|版本(?:是|为|号)|版次"
#: A version ahead of a title, words that make a title, and words that mark a version.
LEADING_VERSION = r"^\s*([^\s，,。；;：:（）()]{2,30}?版)(?=.+)"
PURE_VERSION = r"^\s*([^\s，,。；;：:（）()]{2,30}?版)\s*$"
TITLE_WORDS = "示例|办法|规则|通知|附件|制度|规定|指南|指引|规范|意见|条例|细则"
VERSION_WORDS = "版|修订|试行|暂行|征求意见"
FORMATS = ["pdf", "word", "doc", "docx", "excel", "xls", "xlsx"]


def _flat(text: Column) -> Column:
    """Without marks and white space, lower case: how facets compare."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[《》\\s·•、，,。.;；:：()（）\"'“”‘’]+", "")


def _half(text: Column) -> Column:
    """Full-width letters, digits and brackets as their plain forms."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    return F.translate(F.coalesce(text, F.lit("")), wide, "".join(chr(0x21 + i) for i in range(94)) + " ")


def title_key(title: Column) -> Column:
    """A title as it is compared: plain forms, lower case, without format note, serial number, file ending and marks."""
    t = F.lower(_half(title))
    t = F.regexp_replace(t, r"\((?:pdf|word|excel|docx?|xlsx?)\)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^\d{1,5}[_\-\s]+", ""), r"\.(?:pdf|docx?|xlsx?|csv)$", "")
    return F.regexp_replace(t, r"[^\p{L}\p{N}]", "")


def split_title(title: Column) -> Column:
    """(core, qualifiers): the name, and versions or scopes in brackets or ahead of it."""
    plain = F.coalesce(title, F.lit(""))
    bracketed = F.regexp_extract_all(plain, F.lit("[（(]([^）)]+)[）)]"), F.lit(1))
    core = F.regexp_replace(plain, "[（(][^）)]*[）)]", "")
    leading, pure = F.regexp_extract(core, LEADING_VERSION, 1), F.regexp_extract(core, PURE_VERSION, 1)
    only = (leading == "") & (pure != "") & ~pure.rlike(TITLE_WORDS)
    ahead = F.when(leading != "", F.array(leading)).when(only, F.array(pure)).otherwise(F.array().cast("array<string>"))
    rest = F.when(leading != "", F.regexp_replace(core, LEADING_VERSION, "")).when(only, "").otherwise(core)
    found = F.array_distinct(F.filter(F.transform(F.concat(ahead, bracketed), lambda x: F.trim(x)), lambda x: x != ""))
    return F.struct(rest.alias("core"), found.alias("qualifiers"))


def _quarter(text: Column) -> Column:
    return numeral(F.nullif(F.regexp_extract(text, r"([一二三四1-4])\s*季度", 1), F.lit("")))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(_half(text), r"[\s\-_/]", "")), r"(\d{4}年)版", "$1")


def _qualifier_holds(raw: Column, actual: Column, year: Column, month: Column, quarter: Column, version: Column, file_type: Column) -> Column:
    """Whether one qualifier is met by the identity text or the table's period, version or format."""
    q = F.regexp_replace(F.trim(_half(raw)), r"(\d{4}年)版", "$1")
    compact, shown = _squeezed(q), _squeezed(actual)
    expected = F.when(compact == "word", "docx").when(compact == "excel", "xlsx").otherwise(compact)
    asked_quarter, seen_quarter = _quarter(q), _quarter(actual)
    year_of = F.nullif(F.regexp_extract(q, r"^(20\d{2})\s*年?", 1), F.lit("")).cast("int")
    month_of = F.nullif(F.regexp_extract(q, r"^(\d{1,2})\s*月$", 1), F.lit("")).cast("int")
    named = lambda n, unit: F.regexp_count(actual, F.concat(n.cast("string"), F.lit(rf"\s*{unit}"))) > 0
    quarter_ok = F.when(quarter.isNotNull(), quarter == asked_quarter).otherwise(seen_quarter == asked_quarter)
    year_ok = year_of.isNull() | year.eqNullSafe(year_of) | named(year_of, "年")
    return F.coalesce(
        F.when((compact == "") | F.contains(shown, compact), True)
        .when(compact.isin(*FORMATS), F.coalesce(F.lower(file_type), F.lit("")) == expected)
        .when(asked_quarter.isNotNull(), quarter_ok & year_ok)
        .when(q.rlike(r"^20\d{2}\s*年?$"), year_ok)
        .when(month_of.isNotNull(), month.eqNullSafe(month_of) | named(month_of, "月"))
        .when(F.contains(compact, F.lit("月度")) | compact.isin("月", "月份"), month.isNotNull() | actual.rlike(r"\d{1,2}\s*月"))
        .when(compact.rlike(VERSION_WORDS), F.contains(_squeezed(version), compact)),
        F.lit(False),
    )


def source_matches(requirements: DataFrame, evidence: DataFrame, scope: DataFrame | None = None, q: str = "question_id") -> DataFrame:
    """(q, requirement_id, chunk_id, source_ok) for every requirement and candidate chunk of a question.

    requirements: q, requirement_id, source_titles (array); evidence: q, chunk_id, doc_id,
    filename, source_title, file_type, version_status, year, month, quarter. Every title's core
    has to be in the file name or title, and each of its qualifiers has to hold; a title that
    is a qualifier alone is held by that. No titles fit all. A chunk of a document in scope
    (q, requirement_id, doc_id) fits as well.
    """
    r = requirements.select(q, "requirement_id", F.transform(F.coalesce("source_titles", F.array().cast("array<string>")), split_title).alias("_titles"))
    r = r.withColumn("_titles", F.transform("_titles", lambda t: F.struct(title_key(t["core"]).alias("core"), t["qualifiers"].alias("qualifiers"))))
    identity = F.concat_ws(" ", "filename", "source_title", "version_status")
    bare = lambda c: title_key(F.regexp_replace(F.col(c), "[（(][^）)]*[）)]", ""))
    names = F.array_compact(F.array(bare("filename"), title_key(F.col("filename")), bare("source_title"), title_key(F.col("source_title"))))
    e = evidence.select(q, "chunk_id", "doc_id", identity.alias("_identity"), names.alias("_names"), "year", "month", "quarter", F.coalesce("version_status", F.lit("")).alias("_version"), "file_type")
    pairs = r.join(e, q)
    holds = lambda x: _qualifier_holds(x, F.col("_identity"), F.col("year"), F.col("month"), F.col("quarter"), F.col("_version"), F.col("file_type"))
    core = lambda t: F.when(t["core"] == "", F.size(t["qualifiers"]) > 0).otherwise(F.exists("_names", lambda n: F.contains(n, t["core"])))
    ok = F.forall("_titles", lambda t: core(t) & F.forall(t["qualifiers"], holds))
    out = pairs.select(q, "requirement_id", "chunk_id", "doc_id", ok.alias("source_ok"))
    if scope is not None:
        inside = scope.select(q, "requirement_id", "doc_id").distinct().withColumn("_in", F.lit(True))
        out = out.join(inside, [q, "requirement_id", "doc_id"], "left").withColumn("source_ok", F.col("source_ok") | F.coalesce("_in", F.lit(False)))
    return out.select(q, "requirement_id", "chunk_id", "source_ok")


def question_anchors(question: Column) -> Column:
    """Phrases of 4 to 12 characters by which a question's own clause is known, at most 12."""
    parts = F.split(F.regexp_replace(F.coalesce(question, F.lit("")), "《[^》]*》", " "), ANCHOR_SPLIT)
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, f"^[{ANCHOR_TRIM}]+|[{ANCHOR_TRIM}]+$", ""))
    good = lambda p: F.char_length(p).between(4, 12) & ~p.isin(*GENERIC_TERMS) & ~p.rlike(GENERIC_ENDING) & ~((F.char_length(p) <= 6) & p.rlike(ANCHOR_START))
    return F.slice(F.array_distinct(F.filter(trimmed, good)), 1, 12)


def bind_requirements(evidence: DataFrame, requirements: DataFrame, matches: DataFrame, q: str = "question_id") -> DataFrame:
    """(q, requirement_id, chunk_id) for selected chunks that answer a requirement they were not found for.

    evidence: q, chunk_id, text, section_title, identity, tags (requirement ids it has);
    requirements: q, requirement_id, question, intent, target_terms, attribute_terms; matches:
    E2's rows. A chunk is bound if it holds a term of eight or more characters or two terms;
    a term of six or more also counts by a third of its trigrams (two at least), except names
    with common endings; a question for a version is met by a year in the chunk's identity.
    A definition asked for needs a term and a defining word.
    """
    tight = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    of = lambda name, least: F.filter(F.transform(F.coalesce(name, F.array().cast("array<string>")), tight), lambda t: (F.char_length(t) >= least) & ~t.isin(*GENERIC_TERMS))
    anchors = F.transform(question_anchors(F.col("question")), tight)
    r = requirements.select(q, "requirement_id", "question", "intent", F.array_distinct(F.concat(of("target_terms", 4), of("attribute_terms", 2), anchors)).alias("_terms"))
    e = evidence.select(q, "chunk_id", F.coalesce("tags", F.array().cast("array<string>")).alias("_tags"), tight(F.concat_ws(" ", "text", "section_title")).alias("_t"), F.coalesce("identity", F.lit("")).alias("_who"))
    pairs = r.join(e, q).filter(~F.array_contains("_tags", F.col("requirement_id")))
    pairs = pairs.join(matches.filter("source_ok").select(q, "requirement_id", "chunk_id"), [q, "requirement_id", "chunk_id"])
    three = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(t) - 2), lambda i: F.substr(t, i, F.lit(3))))
    enough = lambda g: F.size(F.filter(g, lambda x: F.contains("_t", x))) >= F.greatest(F.lit(2), F.floor(F.size(g) / 3))
    loose = lambda t: F.when((F.char_length(t) >= 6) & ~t.rlike(GENERIC_ENDING), enough(three(t))).otherwise(False)
    hits = F.filter("_terms", lambda t: F.contains("_t", t) | loose(t))
    strong = F.exists("_h", lambda t: F.char_length(t) >= 8) | (F.size("_h") >= 2)
    held = F.when(F.col("intent") == "define", (F.size("_h") >= 1) & F.col("_t").rlike(DEFINITION_MARKER)).otherwise(strong)
    version = F.coalesce(F.col("question"), F.lit("")).rlike(VERSION_QUESTION) & F.col("_who").rlike(r"(?:19|20)\d{2}\s*年")
    return pairs.withColumn("_h", hits).filter(held | version).select(q, "requirement_id", "chunk_id")


def facets(requirements: DataFrame, bound: DataFrame, q: str = "question_id") -> DataFrame:
    """E5: the facets that each requirement asks for and whether its evidence has them; and the requirement's status.

    requirements: q, requirement_id, mandatory, question, intent, source_titles, target_terms,
    needs_table; bound: q, requirement_id, chunk_id, text, section_title, source, is_table.
    Returns q, requirement_id, mandatory, facets (array of facet and ok) and status: unbound
    without evidence, covered, missing (a critical facet, or all, fail), else partial.
    """
    got = bound.groupBy(q, "requirement_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("\n", "section_title", "text"))), "\n").alias("_text"),
        F.array_join(F.array_sort(F.collect_list(F.coalesce("source", F.lit("")))), " ").alias("_source"), F.bool_or("is_table").alias("_table"), F.count("*").alias("_n"),
    )
    out = requirements.join(got, [q, "requirement_id"], "left")
    asked, none = F.coalesce("question", F.lit("")), F.array().cast("array<string>")
    figures = lambda t: F.transform(F.regexp_extract_all(t, F.lit(NUMERIC_VALUE), F.lit(1)), lambda x: x.cast("double"))
    titles, terms = F.coalesce("source_titles", none), F.coalesce("target_terms", none)
    inside = lambda flat: lambda t: F.contains(flat, _flat(t))
    wanted = figures(asked)
    numeric = F.when(F.size(wanted) == 0, F.size(figures(F.col("_text"))) > 0).otherwise(F.size(F.array_except(wanted, figures(F.col("_text")))) == 0)
    marks = lambda p: F.regexp_count("_text", F.lit(p))
    checks = [
        ("source", F.size(titles) > 0, F.forall(titles, inside(_flat(F.col("_source"))))),
        ("target", F.size(terms) > 0, F.forall(terms, inside(_flat(F.col("_text"))))),
        ("numeric", asked.rlike(NUMERIC_QUESTION), numeric),
        ("condition", asked.rlike(CONDITION_QUESTION), marks(CONDITION_MARKER) > 0),
        ("enumeration", (F.col("intent") == "list") | asked.rlike(LIST_QUESTION), marks(LIST_MARKER) >= 2),
        ("definition", (F.col("intent") == "define") | asked.rlike(DEFINITION_QUESTION), marks(DEFINITION_MARKER) > 0),
        ("table", F.col("needs_table"), F.coalesce("_table", F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(due, F.lit(False)), F.struct(F.lit(name).alias("facet"), ok.alias("ok"))) for name, due, ok in checks]))
    out = out.withColumn("facets", F.when(F.col("_n").isNotNull(), found).otherwise(F.filter(found, lambda f: F.lit(False))))
    failed = F.filter("facets", lambda f: ~f["ok"])
    hard = F.exists("facets", lambda f: ~f["ok"] & f["facet"].isin(*CRITICAL))
    status = F.when(F.col("_n").isNull(), "unbound").when(F.size(failed) == 0, "covered").when(hard | (F.size(failed) == F.size("facets")), "missing").otherwise("partial")
    return out.select(q, "requirement_id", "mandatory", "facets", status.alias("status"))


def set_status(reports: DataFrame, q: str = "question_id") -> DataFrame:
    """E5: per question sufficient, partial or insufficient by its mandatory requirements, with those missing and partial."""
    must = F.col("mandatory")
    bad, part = must & F.col("status").isin("unbound", "missing"), must & (F.col("status") == "partial")
    out = reports.groupBy(q).agg(
        F.count("*").alias("requirements"), F.bool_and(F.col("status") == "unbound").alias("_none"),
        F.array_sort(F.collect_set(F.when(bad, F.col("requirement_id")))).alias("missing"), F.array_sort(F.collect_set(F.when(part, F.col("requirement_id")))).alias("partial"),
    )
    status = F.when(F.col("_none") | (F.size("missing") > 0), "insufficient").when(F.size("partial") > 0, "partial").otherwise("sufficient")
    return out.withColumn("status", status).drop("_none")
