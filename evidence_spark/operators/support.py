"""Evidence found by words inside scoped documents: phrases, definitions, list items, references, table units.

All operators take tables of questions or hits and a table of chunks (doc_id, chunk_id,
pos, section_title, text) and join on document, position or an indexed phrase; no question
meets a document outside its scope. Null texts count as empty. Output ties go to the
smaller position, then chunk id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import anchor_coverage, bigram_support, critical_terms, let, normalize_support, numeral
from .joins import contained, paired
from .lineage import kept
from .structure import resolve_titles

#: Words that open a request, words that are none of its terms, and what a clause may end with.
REQUEST_WORDS = "请|根据|依据|结合|说明|判断|概括|比较|计算|回答|指出"
LONE_WORDS = ["说明", "判断", "比较", "计算", "回答", "指出"]
CLAUSE_ENDS = "是什么|有哪些|如何规定|是否正确|是否符合规定|请说明|请回答"
CLAUSE_SPLIT = r"[；;。？?]|以及|并且|并同时|同时|分别"
UNKNOWN_SLOT = r"(?:哪些|什么|何种|何类)(?:主体|对象|机构|人员|部门|条件|要求|方式|措施)?([一-鿿]{6,40})"
RELATION = r"([一-鿿]{4,40})相对([一-鿿]{4,30}?)(?:的)?(?:门槛|阈值|比例|限额)"
#: Questions for a definition, and how one is worded around its term.
DEFINITION_QUESTIONS = ["定义", "如何界定", "是指什么", "指什么", "是什么", "包括哪些", "如何理解"]
DEFINITION_FORMS = [("", "是指"), ("所称", ""), ("", "指"), ("", "是由于")]
DEFINING = [("本办法所称", ""), ("所称", ""), ("", "是指"), ("", "是以")]
#: What announces a list, and how its items begin.
LIST_LEADS = "以下条件|下列条件|如下条件|以下要求|下列要求|要求如下|规定如下"
LIST_WORDS = "包括|以下|下列|如下|条件|要求"
ITEM_WORDS = "应当|不得|包括|范围|条件|要求|期限|时限"
ITEM_MARK = r"(?:^|[\s。；;])(?:\d{1,2}|[一二三四五六七八九十]+)[.．、]|（[一二三四五六七八九十]+）"
OPEN_LEAD = r"(?:以下|下列|包括|分为|列明)[^。；]{0,30}[：:]?\s*$|[:：]\s*$"
ITEM_START = r"^\s*(?:\d+[.、]|[（(][一二三四五六七八九十百\d]+[）)]|[一二三四五六七八九十百]+、)"
#: A duty or permission that governs a list, an item that it may govern, and how a statement's list and scope are worded.
GOVERNING = r"(?:不得|禁止|严禁|应当|可以|可).{0,40}(?:以下|下列).{0,12}(?:行为|情形|事项|活动|要求|规定)?[:：]"
GOVERNED = r"(?:^|[；;。])（[一二三四五六七八九十百0-9]+）"
ENUMERATION, SCOPE = r"(?:包括|包含|分为)([^。；;]+)", r"^(.{4,80}?)(?:包括|包含|分为)"
SECTION_START = r"^(?:[一二三四五六七八九十百]+[、.]|第[一二三四五六七八九十百\d]+章)"
#: How a named part is asked for, what asks for its contents, and how a heading begins.
NAMED_PART, CONTENTS_WORDS = r"([一-鿿]{2,12})部分", "哪些方面|哪些内容|包括哪些|涵盖哪些|说明哪些"
HEADING = r"(?:^|\n)\s*((?:[（(][一二三四五六七八九十百\d]+[）)]|\d+[.、])[^\n]{1,50})"


def _length(text: Column) -> Column:
    return F.char_length(normalize_support(text))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, "^[ ，,：:]+|[ ，,：:]+$", "")


def _phrases_of(text: Column) -> Column:
    """All phrases of one text, in order: windows of its terms, terms, open slots, relations, clauses."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "《[^》]{2,80}》", " ")), r"(?i)^[A-DＡ-Ｄ][、.．：:]\s*", ""), r"^\s+|\s+$", "")
    opened = lambda x: _trim(F.regexp_replace(_trim(x), f"^(?:{REQUEST_WORDS})+", ""))
    good = lambda x: _length(x).between(2, 20) & ~x.isin(*LONE_WORDS) & ~F.endswith(x, F.lit("版")) & ~F.contains(x, F.lit("示例"))
    none = F.array().cast("array<string>")

    def of(t: Column) -> Column:
        def windows(terms: Column) -> Column:
            run = lambda n: F.when(F.size(terms) >= n, F.transform(F.sequence(F.lit(1), F.size(terms) - n + 1), lambda i: F.array_join(F.slice(terms, i, n), ""))).otherwise(none)
            some = [run(n) for n in (4, 3, 2)]
            return F.concat(F.filter(F.concat(*some), lambda x: _length(x).between(6, 60)), F.filter(terms, lambda x: _length(x).between(6, 40)))

        terms = let(F.filter(F.transform(F.split(t, r"\s+"), opened), good), windows)
        slot = F.filter(F.array(F.regexp_extract(t, UNKNOWN_SLOT, 1)), lambda x: _length(x).between(6, 40))
        left, right = (F.regexp_extract_all(t, F.lit(RELATION), F.lit(i)) for i in (1, 2))
        ends = lambda x: F.when(F.char_length(x) > 8, F.array(F.right(x, F.lit(8)), F.right(x, F.lit(6)))).otherwise(none)
        relations = F.flatten(F.zip_with(left, right, lambda x, y: F.concat(F.array(x, y), ends(x))))
        clauses = F.transform(F.split(t, CLAUSE_SPLIT), lambda x: _trim(F.regexp_replace(F.regexp_replace(_trim(x), f"^(?:{REQUEST_WORDS})+", ""), f"(?:{CLAUSE_ENDS})$", "")))
        return F.concat(terms, slot, relations, F.filter(clauses, lambda x: _length(x).between(6, 120)))

    return let(plain, of)


def lexical_phrases(texts: Column, limit: int = 12) -> Column:
    """The phrases by which an array of texts (queries, then the question, then keywords) is looked up, distinct, at most limit."""
    return F.slice(F.array_distinct(F.flatten(F.transform(texts, _phrases_of))), 1, limit)


def required_figures(texts: Column) -> Column:
    """Percentages that evidence has to hold."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\d+(?:\.\d+)?%"), F.lit(0)))))


def _share(terms: Column, text: Column) -> Column:
    """Share of terms whose normal form a normal text holds; no terms give 0."""
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, normalize_support(t)))) / F.size(terms)).otherwise(0.0)


def _searchable(title: str = "section_title", text: str = "text") -> Column:
    return F.concat_ws("\n", F.nullif(F.col(title), F.lit("")), F.coalesce(F.col(text), F.lit("")))


def phrase_support(phrases: DataFrame, chunks: DataFrame, scope: DataFrame, limit: int = 6, q: str = "question_id") -> DataFrame:
    """The best chunk of the scoped documents for each phrase, one phrase per chunk, at most limit per question.

    phrases: q, phrase_no, phrase, figures (array); scope: q, doc_id. A chunk qualifies if it
    holds the phrase, or at bigram recall of 0.72, or of 0.58 with three quarters of the
    phrase's critical terms; it has to hold every figure. Score: recall + 0.35 if held + 1 if
    worded as a definition + 0.2 of the critical share. Phrases under six characters are
    passed over.
    """
    p = phrases.withColumn("_p", normalize_support(F.col("phrase"))).filter(F.char_length("_p") >= 6)
    c = chunks.select("doc_id", "chunk_id", "pos", _searchable().alias("_s")).withColumn("_t", normalize_support(F.col("_s")))
    pairs = p.join(scope.select(q, "doc_id").distinct(), q).join(c, "doc_id")
    pairs = pairs.filter(F.forall(F.coalesce("figures", F.array().cast("array<string>")), lambda f: F.contains("_t", normalize_support(f))))
    pairs = pairs.withColumn("_exact", F.contains("_t", "_p")).withColumn("_recall", bigram_support(F.col("phrase"), F.col("_s"))).withColumn("_critical", _share(critical_terms(F.col("phrase")), F.col("_t")))
    worded = F.greatest(*[F.contains("_t", F.concat(F.lit(a), F.col("_p"), F.lit(b))) for a, b in DEFINING])
    pairs = pairs.filter(F.col("_exact") | (F.col("_recall") >= 0.72) | ((F.col("_recall") >= 0.58) & (F.col("_critical") >= 0.75)))
    score = F.col("_recall") + F.when(F.col("_exact"), 0.35).otherwise(0.0) + F.when(worded, 1.0).otherwise(0.0) + 0.2 * F.col("_critical")
    best = pairs.withColumn("score", F.round(score, 6)).groupBy(q, "phrase_no").agg(
        F.min(F.struct((-F.col("score")).alias("o"), "doc_id", "pos", "chunk_id", "phrase", F.char_length("_p").alias("n"))).alias("b")
    )
    one = best.groupBy(q, F.col("b.chunk_id").alias("chunk_id")).agg(F.min(F.struct("phrase_no", "b")).alias("f"))
    order = [F.col("f.b.o"), F.desc("f.b.n"), F.col("f.phrase_no")]
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy(*order))).filter(F.col("rank") <= limit)
    return ranked.select(q, "chunk_id", F.col("f.b.doc_id").alias("doc_id"), F.col("f.b.phrase").alias("phrase"), (-F.col("f.b.o")).alias("score"), "rank")


def quoted_terms(question: Column) -> Column:
    """Quoted terms of 2 to 24 characters, without white space."""
    raw = F.regexp_extract_all(question, F.lit("[“‘'\"]([^”’'\"]+)[”’'\"]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda t: F.regexp_replace(t, r"\s+", "")), lambda t: F.char_length(t).between(2, 24)))


def definition_support(questions: DataFrame, chunks: DataFrame, scope: DataFrame, definitions: DataFrame, q: str = "question_id", markers: list[str] | None = None) -> DataFrame:
    """The chunks that define a question's quoted terms, score 1.5, and the chunk after each, score 1.4.

    questions: q, question; definitions: term_norm, chunk_id. Looked up in the scoped
    documents first; where that finds nothing, in the dictionary; then in all chunks.
    source says which (scope, dictionary, corpus, or successor).
    """
    asked = F.exists(F.array(*[F.lit(m) for m in (markers or DEFINITION_QUESTIONS)]), lambda m: F.contains("question", m))
    named = lambda rows: rows.select(q, F.explode(quoted_terms(F.col("question"))).alias("term"))
    worded = lambda rows: rows.select(q, "term", F.posexplode(F.array(*[normalize_support(F.concat(F.lit(a), F.col("term"), F.lit(b))) for a, b in DEFINITION_FORMS])).alias("_n", "_form"))
    questions = questions.filter(asked).select(q, "question")
    texts = chunks.select("doc_id", "chunk_id", normalize_support(F.col("text")).alias("_t"))
    inside = kept(worded(named(questions)).join(scope.select(q, "doc_id").distinct(), q).join(texts, "doc_id").filter(F.contains("_t", "_form")).select(q, "chunk_id", "term", F.lit("scope").alias("source")))
    # Without a definition in scope only its wording tells a question: equal ones are answered once, as _same.
    left = questions.join(inside.select(q).distinct(), q, "left_anti").groupBy(q).agg(F.array_sort(F.collect_set("question")).alias("question"))
    left = kept(left.withColumn("_same", F.sha2(F.to_json("question"), 256)))
    once = kept(named(left.dropDuplicates(["_same"]).select(F.col("_same").alias(q), F.explode("question").alias("question"))))
    norm = F.regexp_replace(F.translate(F.lower(F.trim("term")), "（）：“”", "():"), r"\s+", "")
    known = kept(once.withColumn("term_norm", norm).join(definitions.select("term_norm", "chunk_id"), "term_norm").select(q, "chunk_id", "term", F.lit("dictionary").alias("source")))
    rest = worded(once).join(known.select(q).distinct(), q, "left_anti")
    anywhere = contained(rest.select(q, "term", "_form"), "_form", texts.select("chunk_id", "_t"), "_t").select(q, "chunk_id", "term", F.lit("corpus").alias("source"))
    w = W.partitionBy("doc_id").orderBy("pos")
    after = chunks.select(F.col("chunk_id").alias("_c"), F.lead("chunk_id").over(w).alias("chunk_id")).filter("chunk_id is not null")

    def scored(hits: DataFrame) -> DataFrame:
        found = kept(hits.groupBy(q, "chunk_id").agg(F.min("term").alias("term"), F.min("source").alias("source")))
        next_ = found.withColumnRenamed("chunk_id", "_c").join(after, "_c").select(q, "chunk_id", "term", F.lit("successor").alias("source"))
        next_ = next_.join(found.select(q, "chunk_id"), [q, "chunk_id"], "left_anti").groupBy(q, "chunk_id").agg(F.min("term").alias("term"), F.min("source").alias("source"))
        return found.withColumn("score", F.lit(1.5)).unionByName(next_.withColumn("score", F.lit(1.4)))

    own = scored(inside)
    shared = kept(scored(known.unionByName(anywhere)).withColumnRenamed(q, "_same"))
    return own.unionByName(paired(shared, left.select(q, "_same"), "_same").select(*own.columns))


def continue_list(anchors: DataFrame, chunks: DataFrame, phrases: DataFrame, terms: DataFrame, reach: int = 4, q: str = "question_id", leads: str = LIST_LEADS) -> DataFrame:
    """The chunks up to reach places behind a list's announcement that carry the list on.

    anchors: q, chunk_id; phrases: q, phrase; terms: q, term. A chunk that itself covers a
    phrase (held, recall 0.72, or 0.58 with half the critical terms) scores recall + 0.35 if
    held + 0.2 of the critical share; else a numbered item of the same section that covers a
    term to 0.45 scores coverage + 0.25 if held + up to 0.2 by length.
    """
    c = chunks.select("doc_id", "chunk_id", "pos", "section_title", F.coalesce("text", F.lit("")).alias("text"), normalize_support(_searchable()).alias("_all"))
    heads = anchors.select(q, "chunk_id").distinct().join(c, "chunk_id").filter(F.col("_all").rlike(leads))
    heads = heads.select(q, "doc_id", F.col("chunk_id").alias("anchor_id"), F.col("pos").alias("_from"), normalize_support(F.col("section_title")).alias("_section"), F.col("_all").rlike(LIST_WORDS).alias("_lists"))
    near = heads.withColumn("pos", F.explode(F.array(*[F.col("_from") + i for i in range(1, reach + 1)]))).join(c.drop("_all"), ["doc_id", "pos"])
    near = near.withColumn("_t", normalize_support(F.col("text")))
    held = F.contains("_t", "_p")
    one = near.join(phrases.select(q, "phrase"), q).withColumn("_p", normalize_support(F.col("phrase"))).filter(F.char_length("_p") >= 6)
    one = one.withColumn("_r", bigram_support(F.col("phrase"), F.col("text"))).withColumn("_c", _share(critical_terms(F.col("phrase")), F.col("_t"))).filter(held | (F.col("_r") >= 0.72) | ((F.col("_r") >= 0.58) & (F.col("_c") >= 0.5)))
    one = one.select(q, "anchor_id", "chunk_id", F.col("phrase").alias("by"), (F.col("_r") + F.when(held, 0.35).otherwise(0.0) + 0.2 * F.col("_c")).alias("score"), F.lit(0).alias("_rule"))
    mine = normalize_support(F.col("section_title"))
    same = (F.col("_section") == "") | (mine == "") | (F.col("_section") == mine)
    items = near.filter(F.col("_lists") & same & F.col("text").rlike(ITEM_MARK) & (F.char_length("_t") >= 24) & F.col("_t").rlike(ITEM_WORDS))
    two = items.join(terms.select(q, "term"), q).withColumn("_p", normalize_support(F.col("term"))).filter(F.char_length("_p") >= 2)
    two = two.withColumn("_r", anchor_coverage(F.col("term"), F.col("text"))).filter(held | (F.col("_r") >= 0.45))
    two = two.select(q, "anchor_id", "chunk_id", F.col("term").alias("by"), (F.col("_r") + F.when(held, 0.25).otherwise(0.0) + F.least(F.char_length("_p") / 80, F.lit(0.2))).alias("score"), F.lit(1).alias("_rule"))
    best = one.unionByName(two).groupBy(q, "chunk_id").agg(F.min(F.struct("_rule", (-F.round("score", 6)).alias("o"), "by", "anchor_id")).alias("b"))
    return best.select(q, "chunk_id", F.col("b.anchor_id").alias("anchor_id"), F.col("b.by").alias("by"), (-F.col("b.o")).alias("score"))


def table_unit(hits: DataFrame, chunks: DataFrame, q: str = "question_id", most: int = 8) -> DataFrame:
    """What a hit table row needs: the paragraph before its table, the table's summary, and the row, or all its 2 to `most` rows where siblings are wanted.

    hits: q, chunk_id, siblings (boolean); chunks with table_id and table_role (summary or
    row). Other hits, and rows of tables without summary, stand alone. part names the place.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    c = chunks.select("doc_id", "chunk_id", "pos", "table_id", "table_role", F.lag("chunk_id").over(w).alias("_before"), F.lag("table_id").over(w).alias("_above"))
    summary = c.filter("table_role = 'summary'").groupBy("doc_id", "table_id").agg(F.min(F.struct("pos", "chunk_id", F.when(F.col("_above").isNull(), F.col("_before")).alias("scope"))).alias("s"))
    rows = c.filter("table_role = 'row'").groupBy("doc_id", "table_id").agg(F.count("*").alias("_rows"))
    hit = hits.join(c.drop("_before", "_above"), "chunk_id").join(summary, ["doc_id", "table_id"], "left").join(rows, ["doc_id", "table_id"], "left")
    whole = (F.col("table_role") == "row") & F.col("s").isNotNull()
    hit = hit.withColumn("_whole", F.coalesce(whole, F.lit(False))).withColumn("_all", F.col("_whole") & F.col("siblings") & F.col("_rows").between(2, most))
    parts = F.array_compact(F.array(
        F.when(F.col("_whole") & F.col("s.scope").isNotNull(), F.struct(F.lit("scope").alias("part"), F.col("s.scope").alias("chunk_id"))),
        F.when(F.col("_whole"), F.struct(F.lit("summary").alias("part"), F.col("s.chunk_id").alias("chunk_id"))),
        F.when(~F.col("_all"), F.struct(F.lit("row").alias("part"), F.col("chunk_id").alias("chunk_id"))),
    ))
    own = hit.select(q, F.col("chunk_id").alias("hit_id"), F.explode(parts).alias("p")).select(q, "hit_id", "p.part", "p.chunk_id")
    kin = hit.filter("_all").select(q, F.col("chunk_id").alias("hit_id"), "doc_id", "table_id").join(c.filter("table_role = 'row'").select("doc_id", "table_id", "chunk_id"), ["doc_id", "table_id"])
    return own.unionByName(kin.select(q, "hit_id", F.lit("row").alias("part"), "chunk_id"))


def lead_continuation(selected: DataFrame, chunks: DataFrame, most: int = 3, q: str = "question_id") -> DataFrame:
    """A selected chunk that ends in an open list takes up to `most` directly following chunks that begin as items; blank ones are passed over."""
    filled = chunks.filter(F.trim("text") != "").select("doc_id", "chunk_id", "pos", "text")
    w = W.partitionBy("doc_id").orderBy("pos")
    # Items in a row share the number of other chunks before them.
    runs = filled.withColumn("_item", F.col("text").rlike(ITEM_START)).withColumn("_run", F.sum((~F.col("_item")).cast("int")).over(w)).withColumn("_at", F.row_number().over(w))
    lead = F.right(F.regexp_replace("text", r"\s+$", ""), F.lit(140)).rlike(OPEN_LEAD)
    heads = runs.filter(lead).select("doc_id", F.col("chunk_id").alias("lead_id"), F.col("_run").alias("_r"), F.col("_at").alias("_h"))
    heads = heads.join(selected.select(q, F.col("chunk_id").alias("lead_id")).distinct(), "lead_id")
    after = heads.withColumn("_at", F.explode(F.array(*[F.col("_h") + i for i in range(1, most + 1)]))).join(runs.filter("_item"), ["doc_id", "_at"])
    got = after.filter(F.col("_run") == F.col("_r")).select(q, "lead_id", "chunk_id", (F.col("_at") - F.col("_h")).alias("step"))
    return got.join(selected.select(q, "chunk_id").distinct(), [q, "chunk_id"], "left_anti")


def needs_recovery(aspects: DataFrame, matches: DataFrame, scope: DataFrame, q: str = "aspect_id", defining: str = r".{0,8}(?:是指|是由|指的是|定义为)") -> DataFrame:
    """The aspects that need a recovery pass, and which: definition (D29) or phrases.

    aspects: q, intent, targets (array). A definition is there if a match words one of the
    targets; else direct evidence of at least 0.55, inside the scope if there is one, is enough.
    """
    scoped = scope.select(q, "doc_id").distinct().withColumn("_in", F.lit(True))
    asked = aspects.select(q, "intent", "targets")
    m = matches.join(asked, q).join(scoped.select(q).distinct().withColumn("_scoped", F.lit(True)), q, "left").join(scoped, [q, "doc_id"], "left")
    worded = F.exists(F.coalesce("targets", F.array().cast("array<string>")), lambda t: F.regexp_count("text", F.concat(F.lit(r"\Q"), t, F.lit(r"\E" + defining))) > 0)
    direct = (F.col("role") == "direct") & (F.col("rerank_score") >= 0.55) & (F.col("_scoped").isNull() | F.col("_in").isNotNull())
    fine = m.groupBy(q).agg(F.bool_or(F.coalesce(F.when(F.col("intent") == "define", worded).otherwise(direct), F.lit(False))).alias("_fine"))
    out = asked.join(fine, q, "left").filter(~F.coalesce("_fine", F.lit(False)))
    return out.select(q, F.when(F.col("intent") == "define", "definition").otherwise("phrases").alias("pass"))


def cross_references(chunks: DataFrame, docs: DataFrame, clauses: DataFrame, most: int = 2, c: str = "chunk_id") -> DataFrame:
    """《title》第X条 in a chunk to the clause's chunk in the document of that title, at most `most` documents per chunk.

    docs: doc_id, filename, title (as for resolve_titles); clauses: doc_id, clause_number, chunk_id, and
    chunks has section_title, where the label is looked for if the index has no such clause.
    """
    pattern = r"《([^》\n]{2,50})》第([一二三四五六七八九十百零\d]{1,4})条"
    text = F.coalesce(F.col("text"), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("n"))
    refs = chunks.select(F.col(c).alias("from_id"), F.posexplode(pairs).alias("_at", "r")).select("from_id", "_at", F.col("r.t").alias("wanted"), F.col("r.n").alias("label"))
    titles = refs.select("wanted").distinct().withColumn("title_id", F.col("wanted"))
    found = refs.join(resolve_titles(titles, docs).withColumnRenamed("title_id", "wanted"), "wanted")
    first = found.groupBy("from_id", "doc_id").agg(F.min("_at").alias("_first"))
    kept = first.withColumn("_k", F.row_number().over(W.partitionBy("from_id").orderBy("_first"))).filter(F.col("_k") <= most).select("from_id", "doc_id")
    found = found.join(kept, ["from_id", "doc_id"]).withColumn("clause_number", numeral(F.col("label")))
    index = clauses.groupBy("doc_id", "clause_number").agg(F.min("chunk_id").alias("_hit"))
    found = found.join(index, ["doc_id", "clause_number"], "left")
    by_title = chunks.select("doc_id", F.col(c).alias("_other"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("section_title", F.lit("")), F.lit(r"第([一二三四五六七八九十百零\d]{1,4})条"), F.lit(1)))).alias("label"))
    by_title = by_title.groupBy("doc_id", "label").agg(F.min("_other").alias("_other"))
    found = found.join(by_title, ["doc_id", "label"], "left").withColumn("chunk_id", F.coalesce("_hit", "_other")).filter("chunk_id is not null")
    return found.groupBy("from_id", "chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("clause_number").alias("clause_number"))


def resolve_references(refs: DataFrame, objects: DataFrame, most: int = 2, c: str = "chunk_id") -> DataFrame:
    """References of one hop to the chunks of the object they name in their own document, at most `most` per chunk.

    refs: doc_id, c, pos, ref_no, kind, number or direction (next, previous); objects: doc_id, kind,
    number, identity (what tells two objects of one number apart), chunk_id, chunk_pos.
    Several identities of a number give nothing; a direction takes the nearest object and all its chunks.
    """
    o = objects.select("doc_id", "kind", F.col("number").alias("_number"), "identity", F.col("chunk_id").alias("target_id"), F.col("chunk_pos").alias("_at"))
    pairs = refs.join(o, ["doc_id", "kind"]).filter(F.col("target_id") != F.col(c))
    numbered = pairs.filter(F.col("direction").isNull() & (F.col("number") == F.col("_number")))
    one = numbered.groupBy(c, "ref_no").agg(F.count_distinct("identity").alias("_n")).filter("_n = 1").select(c, "ref_no")
    named = numbered.join(one, [c, "ref_no"])
    facing = F.when(F.col("direction") == "next", F.col("_at") > F.col("pos")).otherwise(F.col("_at") < F.col("pos"))
    fits = F.col("number").isNull() | (F.col("number") == F.col("_number"))
    near = pairs.filter(F.col("direction").isNotNull() & facing & fits)
    nearest = near.groupBy(c, "ref_no").agg(F.min_by("identity", F.struct(F.abs(F.col("_at") - F.col("pos")).alias("d"), "_at")).alias("identity"))
    hits = named.select(c, "ref_no", "kind", "target_id", "_at").unionByName(near.join(nearest, [c, "ref_no", "identity"]).select(c, "ref_no", "kind", "target_id", "_at"))
    once = hits.groupBy(c, "target_id").agg(F.min(F.struct("ref_no", "_at", "kind")).alias("f"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy(c).orderBy("f.ref_no", "f._at", "target_id"))).filter(F.col("rank") <= most)
    return ranked.select(c, "target_id", F.col("f.kind").alias("kind"), "rank")


def statements_of(texts: Column) -> Column:
    """Statements, then their clauses, then the items of their lists, distinct."""
    plain = F.filter(F.transform(texts, lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
    clauses = F.flatten(F.transform(plain, lambda t: F.concat(F.array(t), F.filter(F.transform(F.split(t, "[；;，,]"), lambda p: F.trim(p)), lambda p: _length(p) >= 4))))
    lists = lambda t: F.regexp_extract(t, ENUMERATION, 1)
    parts = lambda x: F.filter(F.transform(F.split(x, "、"), lambda p: F.regexp_replace(p, "^[ ，,。]+|[ ，,。]+$", "")), lambda p: F.char_length(p) >= 3)
    items = F.flatten(F.transform(clauses, lambda t: F.when(F.contains(lists(t), F.lit("、")), parts(lists(t))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(clauses, F.array_sort(F.array_distinct(items))))


def statement_support(statements: DataFrame, chunks: DataFrame, scope: DataFrame, limit: int = 10, leads: int = 4, q: str = "question_id") -> DataFrame:
    """Per question the chunks of its documents that best carry its statements, the lead-ins that govern them, and sections it names.

    statements: q, statement; scope: q, doc_id. Per document and statement the chunk of the
    greatest bigram recall, at least 0.45, that holds all quoted terms; per chunk its best
    statement; the best `limit`. For an enumerated item the nearest governing lead-in of the
    eight chunks before; at most `leads`. A chunk whose first line is a heading that holds the
    scope of a listing statement comes as section. role: support, lead or section.
    """
    s = statements.select(q, "statement").distinct().withColumn("_p", normalize_support(F.col("statement")))
    quoted = F.regexp_extract_all("statement", F.lit("[“\"‘']([^”\"’']{2,40})[”\"’']"), F.lit(1))
    text = F.coalesce("text", F.lit(""))
    c = chunks.select("doc_id", "chunk_id", "pos", text.alias("_x"), normalize_support(text).alias("_t"), F.regexp_replace(text, r"\s+", "").alias("_flat"))
    mine = scope.select(q, "doc_id").distinct()
    pairs = s.join(mine, q).join(c, "doc_id").filter(F.forall(quoted, lambda t: F.contains("_t", normalize_support(t))))
    pairs = pairs.withColumn("score", F.round(bigram_support(F.col("statement"), F.col("_x")), 6)).filter("score >= 0.45")
    best = pairs.groupBy(q, "doc_id", "statement").agg(F.min(F.struct((-F.col("score")).alias("o"), "pos", "chunk_id")).alias("b"))
    one = best.groupBy(q, "doc_id", F.col("b.chunk_id").alias("chunk_id"), F.col("b.pos").alias("pos")).agg(F.min(F.struct(F.col("b.o").alias("o"), (-F.char_length("statement")).alias("l"), "statement")).alias("f"))
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy("f.o", "f.l", "f.statement", "chunk_id"))).filter(F.col("rank") <= limit)
    support = ranked.select(q, F.lit("support").alias("role"), "rank", "chunk_id", F.col("f.statement").alias("statement"), (-F.col("f.o")).alias("score"))
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(-8, -1)
    modal = F.col("_flat").rlike(GOVERNING)
    ruled = c.withColumn("_lead", F.last(F.when(modal, F.col("chunk_id")), ignorenulls=True).over(w)).filter(F.col("_flat").rlike(GOVERNED) & ~modal & F.col("_lead").isNotNull()).select("chunk_id", "_lead")
    led = ranked.join(ruled, "chunk_id").groupBy(q, "_lead").agg(F.min("rank").alias("_first"))
    lead = led.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy("_first", "_lead"))).filter(F.col("rank") <= leads)
    lead = lead.select(q, F.lit("lead").alias("role"), "rank", F.col("_lead").alias("chunk_id"), F.lit(None).cast("string").alias("statement"), F.lit(None).cast("double").alias("score"))
    scopes = s.select(q, normalize_support(F.regexp_extract("statement", SCOPE, 1)).alias("_s")).filter("_s <> ''").distinct()
    heads = c.withColumn("_first", F.substring_index(F.regexp_replace("_x", r"^\s+", ""), "\n", 1)).filter(F.col("_first").rlike(SECTION_START))
    named = scopes.join(mine, q).join(heads, "doc_id").filter(F.contains(normalize_support(F.col("_first")), F.col("_s"))).select(q, "chunk_id").distinct()
    section = named.select(q, F.lit("section").alias("role"), F.lit(0).alias("rank"), "chunk_id", F.lit(None).cast("string").alias("statement"), F.lit(1.0).alias("score"))
    return support.unionByName(lead).unionByName(section)


def section_outline(questions: DataFrame, chunks: DataFrame, scope: DataFrame, most: int = 12, q: str = "question_id") -> DataFrame:
    """For a question after the contents of a named part the first chunk in scope whose last path element holds its name, and up to `most` headings under the same top heading.

    chunks: doc_id, chunk_id, pos, section_path (array), text. Fewer than two headings give an empty outline.
    """
    asked = questions.filter(F.col("question").rlike(CONTENTS_WORDS)).select(q, F.regexp_extract("question", NAMED_PART, 1).alias("_label")).filter("_label <> ''")
    c = chunks.filter(F.size("section_path") > 0).select("doc_id", "chunk_id", "pos", F.element_at("section_path", 1).alias("_top"), F.element_at("section_path", -1).alias("_end"), F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("_x"))
    hit = asked.join(scope.select(q, "doc_id").distinct(), q).join(c, "doc_id").filter(F.contains("_end", F.col("_label")))
    first = hit.groupBy(q).agg(F.min(F.struct("doc_id", "pos", "chunk_id", "_top")).alias("f")).select(q, "f.doc_id", "f.chunk_id", "f._top")
    found = c.select("doc_id", "_top", "pos", F.posexplode(F.regexp_extract_all("_x", F.lit(HEADING), F.lit(1))).alias("_i", "_h")).withColumn("_h", F.trim(F.regexp_replace("_h", r"\s+", " ")))
    kin = first.join(found, ["doc_id", "_top"]).groupBy(q, "_h").agg(F.min(F.struct("pos", "_i")).alias("_at"))
    kept = kin.withColumn("_r", F.row_number().over(W.partitionBy(q).orderBy("_at"))).withColumn("_n", F.count("*").over(W.partitionBy(q))).filter((F.col("_r") <= most) & (F.col("_n") >= 2))
    lists = kept.groupBy(q).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_h"))), lambda x: x["_h"]).alias("outline"))
    return first.join(lists, q, "left").select(q, "chunk_id", F.coalesce("outline", F.array().cast("array<string>")).alias("outline"))
