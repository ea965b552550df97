"""Evaluation over answered cases: citations, evidence sets, manifests, options, entity errors, run summaries.

Rows with an error, a refusal or a blank answer count as not answered. Rates over nothing
are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, number_match, numbers
from .joins import contained
from .lineage import kept

#: A file reference in gold evidence, a locator's label, and periods and titles in a text.
GOLD_FILE = r"(\d{1,4})_([^/\\；;]+?\.(?:xlsx?|pdf|docx?))"
CLAUSE_LABEL = r"第[一二三四五六七八九十百\d]+条"
PERIOD = r"\d{4}\s*年(?:\s*\d{1,2}\s*月)?(?:\s*\d{1,2}\s*[日号])?|\d{1,2}\s*月(?:末|度|份)?|[一二三四1234]\s*季度(?:末)?"
#: Tolerances of a number that errs, and of one that names an option.
ENTITY_SHARE, OPTION_SHARE, OPTION_GAP = 0.005, 1e-4, 0.02


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s·•、，,。.;；:：()（）\"'“”‘’\-_/\\]+", "")


def _file_plain(text: Column) -> Column:
    """A file's name or text for comparison; ASCII marks are dropped by a class of their own, others only where a text has letters beyond ASCII."""
    beyond = lambda t, marks: let(t, lambda x: F.when(F.octet_length(x) > F.char_length(x), F.regexp_replace(x, marks, "")).otherwise(x))
    t = beyond(F.lower(F.coalesce(text, F.lit(""))), "[《》]")
    t = F.regexp_replace(t, r"\.(?:pdf|docx?|xlsx?|xls|csv|txt|md)$", "")
    return beyond(F.regexp_replace(t, r"[\s,.;:()\"'\-_]+", ""), r"[·•、，。；：（）“”‘’]+")


def _rate(flag: str, base: Column) -> Column:
    return F.round(F.try_divide(F.count_if(base & F.col(flag)), F.count_if(base)), 4).alias(f"{flag}_rate")


def answered(error: Column, refused: Column, answer: Column) -> Column:
    return error.isNull() & ~F.coalesce(refused, F.lit(False)) & (F.trim(F.coalesce(answer, F.lit(""))) != "")


def citation_rows(cases: DataFrame, citations: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case answered, and whether it cites anything, with a structure, with any locator, the gold source and the gold value.

    cases: case, answer, refused, error, gold, gold_title, gold_evidence; citations: case,
    filename, source_title, excerpt, section_title, structure_status, is_cell, page.
    """
    structured = F.col("structure_status").isin("resolved", "partial") | F.coalesce("is_cell", F.lit(False)) | F.col("page").isNotNull() | F.coalesce("section_title", F.lit("")).rlike(CLAUSE_LABEL)
    broad = F.trim(F.coalesce("section_title", F.lit(""))) != ""
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "excerpt", "section_title"))), "\n")
    names = F.array_join(F.array_sort(F.collect_list(F.concat(F.coalesce("filename", F.lit("")), F.coalesce("source_title", F.lit(""))))), " ")
    got = citations.groupBy(case).agg(F.count("*").alias("citations"), F.bool_or(F.coalesce(structured, F.lit(False))).alias("structured"), F.bool_or(broad).alias("broad"), text.alias("_text"), names.alias("_names"))
    out = cases.withColumn("answered", answered(F.col("error"), F.col("refused"), F.col("answer"))).join(got, case, "left")
    keys = F.array(_plain(F.col("gold_title")), _plain(F.regexp_extract("gold_evidence", GOLD_FILE, 2)), _plain(F.regexp_extract("gold_evidence", GOLD_FILE, 0)))
    source = F.exists(F.filter(keys, lambda k: k != ""), lambda k: F.contains(_plain(F.col("_names")), k))
    gold = F.coalesce("gold", F.lit(""))
    value = F.when(gold == "", False).when(F.size(numbers(gold)) > 0, number_match(gold, F.col("_text"))).otherwise((_plain(gold) != "") & F.contains(_plain(F.col("_text")), F.left(_plain(gold), F.lit(30))))
    yes = lambda c: F.col("answered") & F.coalesce(c, F.lit(False))
    return out.select(
        case, "answered", F.coalesce("citations", F.lit(0)).alias("citations"), yes(F.col("citations") > 0).alias("cited"), yes(F.col("structured")).alias("structured"),
        yes(F.col("broad")).alias("broad"), yes(source).alias("gold_source"), yes(value).alias("gold_value"),
    )


def citation_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The shares of answered cases."""
    base = F.col("answered")
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(base).alias("answered"), *[_rate(c, base) for c in ("cited", "structured", "broad", "gold_source", "gold_value")])


def evidence_rows(required: DataFrame, citations: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case the shares of required sources (case, path, evidence) that its citations name, hold in full, by their start, and with a resolved locator.

    citations: case, filename, source_title, excerpt, section_title, structure_status.
    """
    c = citations.select(case, _file_plain(F.concat_ws(" ", "filename", "source_title")).alias("_s"), _file_plain(F.concat_ws(" ", "excerpt", "section_title")).alias("_t"), F.coalesce("structure_status", F.lit("unresolved")).alias("_status"))
    path = F.regexp_replace(_file_plain(F.regexp_replace("path", r"^\d+[_-]+", "")), r"^\d+[_-]+", "")
    r = required.select(case, F.xxhash64("path", "evidence").alias("_r"), path.alias("_p"), _file_plain(F.col("evidence")).alias("_e")).distinct()
    start = F.left(F.col("_e"), F.greatest(F.lit(24), F.least(F.lit(60), F.char_length("_e"))))
    pairs = r.join(c, case, "left")
    held = (F.col("_e") != "") & F.contains("_t", "_e")
    flags = [
        F.bool_or(F.coalesce((F.col("_p") != "") & F.contains("_s", "_p"), F.lit(False))).alias("document"), F.bool_or(F.coalesce(held, F.lit(False))).alias("exact"),
        F.bool_or(F.coalesce((F.col("_e") != "") & F.contains("_t", start), F.lit(False))).alias("prefix"), F.bool_or(F.coalesce(held & (F.col("_status") == "resolved"), F.lit(False))).alias("article"),
    ]
    per = pairs.groupBy(case, "_r").agg(*flags)
    share = lambda f: F.round(F.avg(F.col(f).cast("double")), 4).alias(f"{f}_rate")
    rates = per.groupBy(case).agg(F.count("*").alias("required"), *[share(f) for f in ("document", "exact", "prefix", "article")])
    cover = c.groupBy(case).agg(F.count("*").alias("citations"), F.round(F.avg(F.col("_status").isin("resolved", "partial").cast("double")), 4).alias("structure_coverage"))
    return rates.join(cover, case, "full_outer")


def evidence_sets(cases: DataFrame, rows: DataFrame, case: str = "case_id") -> DataFrame:
    """The report over cases (case, error, sufficiency): errors are left out, cases without gold have no rates."""
    done = cases.join(rows, case, "left").withColumn("_ok", F.col("error").isNull())
    mean = lambda c: F.round(F.avg(F.when(F.col("_ok"), F.col(c))), 4).alias(c)
    status = F.coalesce("sufficiency", F.lit("unrecorded"))
    return done.agg(
        F.count("*").alias("rows"), F.count_if("_ok").alias("completed"), F.count_if(~F.col("_ok")).alias("errors"), F.count_if(F.col("_ok") & F.col("required").isNull()).alias("without_gold"),
        *[mean(c) for c in ("document_rate", "exact_rate", "prefix_rate", "article_rate", "structure_coverage")],
        F.round(F.avg(F.when(F.col("_ok"), F.coalesce("citations", F.lit(0)))), 4).alias("mean_citations"),
        *[F.count_if(F.col("_ok") & (status == s)).alias(s) for s in ("sufficient", "partial", "insufficient", "unrecorded")],
    )


def manifest_scores(aspects: DataFrame, final: DataFrame, cited: DataFrame, reranked: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case of a manifest final recall, rerank retention, citation completeness and accuracy, and the best acceptable rank.

    aspects: case, aspect_id, acceptable (array); final, cited: case, chunk_id; reranked: case, chunk_id, rank.
    Aspects without acceptable chunks are counted but not scored.
    """
    wanted = aspects.select(case, "aspect_id", F.explode("acceptable").alias("chunk_id")).distinct()
    hit = lambda df, name: wanted.join(df.select(case, "chunk_id").distinct(), [case, "chunk_id"]).select(case, "aspect_id").distinct().groupBy(case).agg(F.count("*").alias(name))
    base = aspects.groupBy(case).agg(F.count("*").alias("aspects"), F.count_if(F.size("acceptable") > 0).alias("evaluable"))
    union = wanted.select(case, "chunk_id").distinct()
    right = cited.join(union.withColumn("_ok", F.lit(True)), [case, "chunk_id"], "left").groupBy(case).agg(F.count("*").alias("_cited"), F.count_if("_ok").alias("_right"))
    ranks = reranked.join(union, [case, "chunk_id"]).groupBy(case).agg(F.min("rank").alias("best_rank"))
    any_ = reranked.select(case).distinct().withColumn("_any", F.lit(True))
    out = base
    for df in (hit(final, "_final"), hit(cited, "_c"), hit(reranked, "_r"), right, ranks, any_):
        out = out.join(df, case, "left")
    n = F.nullif(F.col("evaluable"), F.lit(0))
    part = lambda c: F.round(F.coalesce(c, F.lit(0)) / n, 6)
    return out.select(
        case, "aspects", "evaluable", part("_final").alias("final_recall"), F.when(F.col("_any"), part("_r")).alias("rerank_retention"), part("_c").alias("citation_completeness"),
        F.when(n.isNotNull(), F.round(F.col("_right") / F.col("_cited"), 6)).alias("citation_accuracy"), "best_rank",
    )


def run_summary(results: DataFrame, slices: list[str]) -> DataFrame:
    """Over all and by each slice: cases, errors, accuracy, source hits, grounding, entity errors, refusals of out-of-corpus cases, times.

    results: correct, source_hit, expected_refusal, refused, grounded (null if not checked),
    entity_error, citations, elapsed_ms, error and the slice columns, which hold no nulls.
    """
    done = F.col("error").isNull()
    rows = results.withColumn("_done", done)
    mean = lambda flag, where, name: F.round(F.avg(F.when(F.col("_done") & where, F.col(flag).cast("double"))), 6).alias(name)
    true, kept = F.lit(True), ~F.col("expected_refusal")
    cited = (F.coalesce("citations", F.lit(0)) > 0).cast("double")
    ms = F.when(F.col("_done"), F.col("elapsed_ms"))
    grouped = rows.groupingSets([[F.col(s)] for s in slices] + [[]], *[F.col(s) for s in slices])
    return grouped.agg(
        F.count("*").alias("cases"), F.count_if("_done").alias("completed"), F.count_if(~F.col("_done")).alias("errors"),
        mean("correct", true, "accuracy"), mean("source_hit", kept, "source_hit_rate"), mean("grounded", F.col("grounded").isNotNull(), "grounding_pass_rate"),
        mean("entity_error", F.col("grounded").isNotNull(), "entity_error_rate"), mean("refused", F.col("expected_refusal"), "ood_refusal_rate"),
        F.round(F.avg(F.when(F.col("_done") & kept, cited)), 6).alias("citation_rate"), F.round(F.avg(ms), 2).alias("avg_ms"), F.round(F.percentile(ms, F.lit(0.5)), 2).alias("p50_ms"), F.max(ms).alias("max_ms"),
    )


def resolve_gold_docs(refs: DataFrame, docs: DataFrame, key: str = "ref_id") -> DataFrame:
    """A gold reference (key, evidence, source_title) to a document (doc_id, filename, title).

    By the file's number, if one document has it or the rest of the name fits one; else by an
    equal title or file name; else the title whose containment, either way, covers the
    greatest share of the longer one. method says which: prefix, exact or containment.
    """
    d = docs.select("doc_id", F.regexp_extract("filename", r"^(\d{1,4})_", 1).alias("_n"), _plain(F.col("filename")).alias("_f"), _plain(F.col("title")).alias("_t"), _plain(F.regexp_replace("filename", r"^\d{1,4}_", "")).alias("_b"))
    r = refs.select(key, F.regexp_extract("evidence", GOLD_FILE, 1).alias("_n"), _plain(F.regexp_extract("evidence", GOLD_FILE, 2)).alias("_stem"), _plain(F.col("source_title")).alias("_w"))
    numbered = r.filter("_n <> ''").join(d.filter("_n <> ''"), "_n").withColumn("_fits", (F.col("_stem") != "") & F.contains("_f", "_stem"))
    by_number = numbered.groupBy(key).agg(F.count("*").alias("_c"), F.min("doc_id").alias("_only"), F.min(F.when(F.col("_fits"), F.col("doc_id"))).alias("_fit"))
    # What later steps read again is written once, and sides that grow with the rows are sorted: none is sent to all.
    one = kept(by_number.select(key, F.when(F.col("_c") == 1, F.col("_only")).otherwise(F.col("_fit")).alias("doc_id")).filter("doc_id is not null").withColumn("method", F.lit("prefix")))
    rest = kept(r.join(one.select(key).hint("merge"), key, "left_anti").filter("_w <> ''").select(key, "_w"))
    names = d.select("doc_id", F.explode(F.array_distinct(F.array("_t", "_f", "_b"))).alias("_k")).filter("_k <> ''")
    equal = kept(rest.join(names.hint("merge"), F.col("_w") == F.col("_k")).groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("_c")).filter("_c = 1").select(key, "doc_id", F.lit("exact").alias("method")))
    left = kept(rest.join(equal.select(key).hint("merge"), key, "left_anti"))
    held = contained(left, "_w", names, "_k").unionByName(contained(names, "_k", left, "_w"))
    share = F.least(F.char_length("_w"), F.char_length("_k")) / F.greatest(F.char_length("_w"), F.char_length("_k"))
    best = held.groupBy(key).agg(F.min_by("doc_id", F.struct((-F.round(share, 9)).alias("o"), "doc_id")).alias("doc_id")).withColumn("method", F.lit("containment"))
    return one.unionByName(equal).unionByName(best)


def entity_conflicts(gold: Column, answer: Column) -> Column:
    """What an answer has wrong against a gold conclusion: number (none within 0.5 %), period or title (some, but none of the gold ones)."""
    near = lambda g, a: F.abs(g - a) <= F.greatest(F.lit(0.01), F.abs(g) * ENTITY_SHARE)
    g, a = numbers(gold), numbers(answer)
    number = (F.size(g) > 0) & ~F.exists(g, lambda x: F.exists(a, lambda y: near(x, y)))
    found = lambda p, i: lambda t: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), F.lit(i)), lambda x: F.regexp_replace(x, r"\s+", "")))
    differ = lambda f: (F.size(f(gold)) > 0) & (F.size(f(answer)) > 0) & ~F.arrays_overlap(f(gold), f(answer))
    period, title = found(PERIOD, 0), found("《([^》]{2,60})》", 1)
    return F.array_compact(F.array(F.when(number, "number"), F.when(differ(period), "period"), F.when(differ(title), "title")))


def entity_error_rate(cases: DataFrame, facts: DataFrame, case: str = "case_id") -> DataFrame:
    """Facts of answered cases, those of failed cases that conflict with the answer, and their rate.

    cases: case, answer, refused, error, passed, facts_total; facts: case, conclusion.
    """
    rows = cases.filter(answered(F.col("error"), F.col("refused"), F.col("answer")))
    total = rows.select(F.col("facts_total").cast("long").alias("_n"), F.lit(None).cast("array<string>").alias("_c"))
    bad = rows.filter(~F.coalesce("passed", F.lit(False))).join(facts, case).select(F.lit(0).cast("long").alias("_n"), entity_conflicts(F.col("conclusion"), F.col("answer")).alias("_c")).filter(F.size("_c") > 0)
    kinds = [F.count_if(F.array_contains("_c", k)).alias(f"{k}_conflicts") for k in ("number", "period", "title")]
    out = total.unionByName(bad).agg(F.sum("_n").alias("facts_total"), F.count("_c").alias("error_facts"), *kinds)
    return out.withColumn("error_rate", F.round(F.try_divide("error_facts", "facts_total"), 4))


def infer_option(answers: DataFrame, options: DataFrame, case: str = "case_id") -> DataFrame:
    """The option a free answer means: a stated letter, else the closest of all-numeric options, else the longest option it contains.

    answers: case, answer; options: case, option (letter), option_text. rule says which; cases without any give no row.
    """
    stated = F.regexp_extract(F.upper("answer"), r"(?:答案(?:为|是)?\s*|^)([A-D])(?:[：:。\s]|$)", 1)
    plain = F.regexp_replace(F.coalesce("answer", F.lit("")), r"\[\d+\]", " ")
    value = lambda t: F.replace(F.regexp_replace(F.trim(t), "%$", ""), F.lit(","), F.lit("")).try_cast("double") / F.when(F.endswith(F.trim(t), F.lit("%")), 100.0).otherwise(1.0)
    norm = lambda t: F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), "[^0-9a-zA-Z%一-鿿]+", ""))
    a = answers.select(case, stated.alias("_l"), F.transform(F.regexp_extract_all(plain, F.lit(r"[-+]?\d[\d,]*(?:\.\d+)?%?"), F.lit(0)), value).alias("_xs"), norm(plain).alias("_a"))
    letter = a.filter("_l <> ''").select(case, F.col("_l").alias("option"), F.lit(0).alias("_rule"))
    numeric = options.groupBy(case).agg(F.bool_and(value(F.col("option_text")).isNotNull()).alias("_all"))
    o = options.select(case, "option", value(F.col("option_text")).alias("_y"), norm(F.col("option_text")).alias("_o")).join(numeric, case)
    pairs = a.join(o, case)
    near = lambda x: F.when(F.abs(x - F.col("_y")) <= F.greatest(F.lit(OPTION_GAP), OPTION_SHARE * F.greatest(F.abs(x), F.abs("_y"))), F.abs(x - F.col("_y")))
    gaps = pairs.filter("_all").withColumn("_gap", F.array_min(F.transform("_xs", near))).filter("_gap is not null")
    closest = gaps.groupBy(case).agg(F.min_by("option", F.struct("_gap", "option")).alias("option"), F.lit(1).alias("_rule"))
    held = pairs.filter((F.col("_o") != "") & F.contains("_a", "_o"))
    longest = held.groupBy(case).agg(F.max_by("option", F.struct(F.char_length("_o"), "option")).alias("option"), F.lit(2).alias("_rule"))
    best = letter.unionByName(closest).unionByName(longest).groupBy(case).agg(F.min(F.struct("_rule", "option")).alias("b"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("letter", "number", "containment")]), F.col("b._rule") + 1)
    return best.select(case, F.col("b.option").alias("option"), name.alias("rule"))


def answer_flags(rows: DataFrame, options: DataFrame, citations: DataFrame, case: str = "case_id") -> DataFrame:
    """Adds wrong_option (the answer holds another option of 20 or more characters), supported (a citation holds the gold) and needs_review.

    rows: score_answers' rows with case, gold, answer; options: case, option_text; citations: case, excerpt.
    A row needs review if it fails though its citations hold the gold, or passes with a wrong option.
    """
    wrong = options.select(case, _plain(F.col("option_text")).alias("_o")).filter(F.char_length("_o") >= 20).join(rows.select(case, _plain(F.col("gold")).alias("_g"), _plain(F.col("answer")).alias("_a")), case)
    wrong = wrong.groupBy(case).agg(F.bool_or(F.contains("_a", "_o") & (F.col("_o") != F.col("_g"))).alias("wrong_option"))
    text = citations.groupBy(case).agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("excerpt", F.lit("")))), "\n").alias("_x"))
    out = rows.join(wrong, case, "left").join(text, case, "left")
    held = F.when(F.size(numbers(F.col("gold"))) > 0, number_match(F.col("gold"), F.col("_x"))).otherwise((_plain(F.col("gold")) != "") & F.contains(_plain(F.col("_x")), _plain(F.col("gold"))))
    out = out.withColumn("wrong_option", F.coalesce("wrong_option", F.lit(False))).withColumn("supported", F.coalesce(held, F.lit(False)))
    match = F.col("outcome") == "match"
    return out.withColumn("needs_review", (~match & F.col("supported")) | (match & F.col("wrong_option"))).drop("_x")
