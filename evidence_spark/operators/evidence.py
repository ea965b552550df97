"""Evidence contract: requirements, coverage decisions, citation and entity checks, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import numbers, squeeze


def requirements(aspects: DataFrame) -> DataFrame:
    """One requirement per aspect; a table aspect with two or more selectors adds one per selector.

    aspects: question_id, aspect_id, kind, mandatory, selectors (array of string).
    """
    base = aspects.select("question_id", F.format_string("%s", F.col("aspect_id").cast("string")).alias("requirement_id"), "kind", "mandatory", F.lit(None).cast("string").alias("selector"))
    many = aspects.filter((F.col("kind") == "table") & (F.size("selectors") >= 2)).select("question_id", "aspect_id", "mandatory", F.posexplode("selectors").alias("pos", "selector"))
    each = many.select("question_id", F.format_string("%s-%d", F.col("aspect_id").cast("string"), F.col("pos") + 1).alias("requirement_id"), F.lit("operand").alias("kind"), "mandatory", "selector")
    return base.unionByName(each)


def evidence_bundle(reqs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per requirement selected and rejected chunks and its state: covered, not_selected, filtered or missing.

    decisions: question_id, requirement_id, chunk_id, source_ok, selected.
    """
    got = decisions.groupBy("question_id", "requirement_id").agg(
        F.count_if(F.col("selected") & F.col("source_ok")).alias("selected"), F.count_if(~F.col("source_ok")).alias("filtered"), F.count_if(F.col("source_ok") & ~F.col("selected")).alias("passed_over")
    )
    out = reqs.join(got, ["question_id", "requirement_id"], "left").fillna(0, ["selected", "filtered", "passed_over"])
    state = F.when(F.col("selected") > 0, "covered").when(F.col("passed_over") > 0, "not_selected").when(F.col("filtered") > 0, "filtered").otherwise("missing")
    return out.select("question_id", "requirement_id", "mandatory", "selected", "filtered", "passed_over", state.alias("state"))


def evidence_decisions(reqs: DataFrame, candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """question_id, requirement_id, chunk_id, stage and reason of every candidate that a requirement met.

    reqs: question_id, requirement_id; candidates: question_id, chunk_id, tags (requirements
    it was found for), selected; sources: question_id, requirement_id, chunk_id of candidates
    whose source is not the requirement's. A question's only requirement meets all its
    candidates. Stages: filtered (explicit_source_conflict), not_selected (context_budget),
    selected (source_and_requirement_match); missing (not_recalled) for a requirement that
    met none, with an empty chunk_id.
    """
    tagged = candidates.select("question_id", "chunk_id", "selected", F.explode(F.array_distinct("tags")).alias("requirement_id"))
    alone = reqs.groupBy("question_id").agg(F.count("*").alias("_n"), F.first("requirement_id").alias("requirement_id")).filter("_n = 1").drop("_n")
    met = tagged.join(reqs.select("question_id", "requirement_id"), ["question_id", "requirement_id"]).select("question_id", "requirement_id", "chunk_id", "selected")
    met = met.unionByName(candidates.join(alone, "question_id").select("question_id", "requirement_id", "chunk_id", "selected"))
    met = met.groupBy("question_id", "requirement_id", "chunk_id").agg(F.max(F.coalesce("selected", F.lit(False))).alias("_s"))
    conflict = sources.select("question_id", "requirement_id", "chunk_id", F.lit(True).alias("_x")).distinct()
    rows = met.join(conflict, ["question_id", "requirement_id", "chunk_id"], "left")
    stage = F.when(F.col("_x"), "filtered").when(F.col("_s"), "selected").otherwise("not_selected")
    missing = reqs.select("question_id", "requirement_id").join(met.select("question_id", "requirement_id").distinct(), ["question_id", "requirement_id"], "left_anti")
    all_ = rows.select("question_id", "requirement_id", "chunk_id", stage.alias("stage")).unionByName(missing.select("question_id", "requirement_id", F.lit("").alias("chunk_id"), F.lit("missing").alias("stage")))
    reasons = {"filtered": "explicit_source_conflict", "selected": "source_and_requirement_match", "not_selected": "context_budget", "missing": "not_recalled"}
    return all_.withColumn("reason", F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv])[F.col("stage")])


def missing_requirements(reqs: DataFrame, decisions: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Per requirement the chunks that cover it, and whether it is missing: none does, or a unit of one was cut.

    reqs: question_id, requirement_id, mandatory; incomplete: question_id, chunk_id.
    """
    ids = decisions.filter("stage = 'selected'").join(incomplete.select("question_id", "chunk_id", F.lit(True).alias("_cut")).distinct(), ["question_id", "chunk_id"], "left")
    got = ids.groupBy("question_id", "requirement_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("covered_by"), F.coalesce(F.bool_or("_cut"), F.lit(False)).alias("_cut"))
    out = reqs.join(got, ["question_id", "requirement_id"], "left")
    return out.select("question_id", "requirement_id", "mandatory", F.coalesce("covered_by", F.array().cast("array<string>")).alias("covered_by"), F.coalesce("_cut", F.lit(True)).alias("missing"))


def sufficiency(facets: DataFrame) -> DataFrame:
    """E5: per question sufficient, partial or insufficient from facets (question_id, requirement_id, facet, status).

    A requirement fails if a source, numeric, definition or table facet is missing or
    unbound; it is partial if any facet is not covered.
    """
    critical = F.col("facet").isin("source", "numeric", "definition", "table")
    per = facets.groupBy("question_id", "requirement_id").agg(F.bool_or(critical & F.col("status").isin("missing", "unbound")).alias("_bad"), F.bool_or(F.col("status") != "covered").alias("_part"))
    out = per.groupBy("question_id").agg(F.count("*").alias("requirements"), F.count_if("_bad").alias("failed"), F.count_if(F.col("_part") & ~F.col("_bad")).alias("partial"))
    status = F.when(F.col("failed") == F.col("requirements"), "insufficient").when((F.col("failed") > 0) | (F.col("partial") > 0), "partial").otherwise("sufficient")
    return out.withColumn("status", status)


#: States of documents whose chunks may be cited.
CITABLE = ("indexed", "table_indexed")


def _traced(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    status = F.col("status") if "status" in chunks.columns else F.lit(CITABLE[0])
    both = evidence.join(chunks.select("chunk_id", F.col("text").alias("_t"), status.alias("_s"), F.lit(True).alias("_known")), "chunk_id", "left")
    e, t = squeeze(F.col("excerpt")), squeeze(F.col("_t"))
    open_ = F.col("_known") & F.col("_s").isin(*CITABLE)
    return both.withColumn("_ok", F.coalesce(open_ & ((F.col("kind") == "calculation") | (F.col("_t").isNotNull() & (F.contains(t, e) | F.contains(e, t)))), F.lit(False)))


def trace_evidence(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Keeps excerpts of known chunks, of documents that are indexed, that stand in their chunk's text, or the reverse, white space aside; calculations need no text; ranks renewed.

    evidence: question_id, rank, chunk_id, excerpt, kind; chunks: a row per chunk with chunk_id,
    text and the document's status (without that column all are indexed).
    """
    kept = _traced(evidence, chunks).filter("_ok").drop("_t", "_s", "_known", "_ok")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy("rank", "chunk_id")))


def trace_summary(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question checked, valid and invalid excerpts, and the invalid chunk ids in order of rank."""
    rows = F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.struct("rank", F.col("chunk_id").alias("id")))))
    got = _traced(evidence, chunks).groupBy("question_id").agg(F.count("*").alias("checked"), F.count_if("_ok").alias("valid"), rows.alias("_r"))
    return got.select("question_id", "checked", "valid", (F.col("checked") - F.col("valid")).alias("invalid"), F.col("_r.id").alias("invalid_ids"))


def citation_checks(answers: DataFrame, claims: DataFrame, evidence: DataFrame, q: str = "question_id") -> DataFrame:
    """Per answer inline marks [n] without evidence, claimed ids without evidence, claimed ids not inline, and claims without any."""
    known = evidence.groupBy(q).agg(F.collect_set("evidence_no").alias("_known"))
    said = claims.groupBy(q).agg(F.array_distinct(F.flatten(F.collect_list("cited"))).alias("_claimed"), F.count_if(F.size("cited") == 0).alias("uncited_claims"))
    inline = F.array_distinct(F.transform(F.regexp_extract_all(F.col("answer"), F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))
    out = answers.join(known, q, "left").join(said, q, "left")
    none = F.array().cast("array<int>")
    out = out.withColumn("_i", inline).withColumn("_k", F.coalesce("_known", none)).withColumn("_c", F.coalesce("_claimed", none))
    diff = lambda a, b: F.array_sort(F.array_except(a, b))
    return out.select(q, diff("_i", "_k").alias("inline_unknown"), diff("_c", "_k").alias("claimed_unknown"), diff("_c", "_i").alias("claimed_not_inline"), F.coalesce("uncited_claims", F.lit(0)).alias("uncited_claims"))


def unsupported_numbers(claims: DataFrame, cited: DataFrame, keys: list[str], claim: str = "claim", text: str = "text") -> DataFrame:
    """Numbers of a claim that no cited text has: within half a unit of the last shown digit, a percentage also as a ratio."""
    token = F.regexp_extract_all(F.coalesce(F.col(claim), F.lit("")), F.lit(r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?%?"), F.lit(0))
    have = cited.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list(numbers(F.col(text))))).alias("_have"))
    rows = claims.select(*keys, F.explode(F.array_distinct(token)).alias("number")).join(have, keys, "left")
    plain = F.replace(F.replace("number", F.lit(","), F.lit("")), F.lit("%"), F.lit(""))
    places = F.char_length(F.regexp_extract(plain, r"\.(\d+)$", 1))
    tolerance = 0.5 * F.pow(F.lit(10.0), -places) + 1e-9
    value = plain.cast("double")
    near = F.exists(F.coalesce("_have", F.array().cast("array<double>")), lambda h: (F.abs(h - value) <= tolerance) | (F.endswith("number", F.lit("%")) & (F.abs(h * 100 - value) <= tolerance)))
    return rows.filter(~near).select(*keys, "number")


def compact_citations(answers: DataFrame, evidence: DataFrame, q: str = "question_id") -> DataFrame:
    """Cited evidence renumbered from 1 in order, marks rewritten in one pass; marks without evidence stay.

    answers: q, answer; evidence: q, evidence_no. Returns q, answer, kept (old numbers in new order).
    """
    marks = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))
    known = evidence.groupBy(q).agg(F.collect_set("evidence_no").alias("_known"))
    out = answers.join(known, q, "left").withColumn("kept", F.array_sort(F.array_intersect(marks, F.coalesce("_known", F.array().cast("array<int>")))))
    parts = F.split("answer", r"(?=\[\d{1,3}\])|(?<=\[\d{1,3}\])")
    number = lambda p: F.regexp_extract(p, r"^\[(\d{1,3})\]$", 1)
    place = lambda p: F.array_position("kept", number(p).cast("int"))
    text = F.array_join(F.transform(parts, lambda p: F.when((number(p) != "") & (place(p) > 0), F.concat(F.lit("["), place(p).cast("string"), F.lit("]"))).otherwise(p)), "")
    return out.select(q, text.alias("answer"), "kept")


def answer_coverage(expected: DataFrame, covered: DataFrame, q: str = "question_id") -> DataFrame:
    """Expected, covered and missing aspects, complete, and confidence (best score held to 0 .. 0.95)."""
    want = expected.groupBy(q).agg(F.array_sort(F.collect_set("aspect_id")).alias("expected"))
    got = covered.groupBy(q).agg(F.collect_set("aspect_id").alias("_got"), F.max("score").alias("_best"))
    out = want.join(got, q, "left").withColumn("_got", F.coalesce("_got", F.array().cast(dict(covered.select(F.array("aspect_id").alias("a")).dtypes)["a"])))
    missing = F.array_sort(F.array_except("expected", "_got"))
    return out.select(q, F.size("expected").alias("expected"), F.size(F.array_intersect("expected", "_got")).alias("covered"), missing.alias("missing"), (F.size(missing) == 0).alias("complete"), F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.coalesce("_best", F.lit(0.0)))).alias("confidence"))


def source_groups(claims: DataFrame, q: str = "question_id") -> DataFrame:
    """Per question and source title how many claims, how many supported, and covered, partial or missing."""
    got = claims.groupBy(q, "source_title").agg(F.count("*").alias("claims"), F.count_if("supported").alias("supported"))
    return got.withColumn("status", F.when(F.col("supported") == F.col("claims"), "covered").when(F.col("supported") > 0, "partial").otherwise("missing"))


def extract_options(questions: DataFrame, text: str = "question") -> DataFrame:
    """Labelled options (A. / A、 / (A)) where there are two or more; label, option text and the stem before them."""
    mark = r"(?:^|[\s（(])([A-H])[)）.、．:：]\s*"
    found = F.regexp_extract_all(text, F.lit(r"(?s)(?:^|(?<=[\s（(]))([A-H])[)）.、．:：]\s*(.*?)(?=(?:[\s（(][A-H][)）.、．:：])|$)"), F.lit(0))
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    rows = questions.withColumn("_o", found).filter(F.size("_o") >= 2).withColumn("stem", bare(F.element_at(F.split(text, mark), 1)))
    out = rows.select(*questions.columns, "stem", F.posexplode("_o").alias("pos", "_p"))
    return out.withColumn("label", F.regexp_extract("_p", r"([A-H])", 1)).withColumn("option", bare(F.regexp_replace("_p", r"^[\s（(]*[A-H][)）.、．:：]\s*", ""))).drop("_p")


def triage(question: Column) -> Column:
    """Prediction, advice, out_of_corpus or none; quoted text is not looked at."""
    plain = F.regexp_replace(question, "《[^》]*》|“[^”]*”|\"[^\"]*\"", "")
    return F.when(plain.rlike("预测|未来.*(?:走势|会怎样)|will .* (?:rise|fall)"), "prediction").when(plain.rlike("建议.*(?:买|投资)|应该(?:买|投)|should i (?:buy|invest)"), "advice").when(plain.rlike("今天天气|实时|最新新闻"), "out_of_corpus").otherwise("none")
