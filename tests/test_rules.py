"""Fixtures for rules on Chinese text, odd inputs, and plans without nested loops."""

import pytest
from pyspark.sql import functions as F

from evidence_spark.functions import text as T
from evidence_spark.operators import chunking, contract, evaluation, grids, scoring, search, support, tables
from evidence_spark.operators import structure as S
from evidence_spark.operators.joins import contained
from evidence_spark.plans import relational, retrieval, rules
from evidence_spark.plans import support as support_plans
from evidence_spark.sources import documents as readers

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_numerals_with_thousands_and_zero(spark):
    words = ["一千零二", "十", "二〇", "三千五百", "2024", "第十条", "", "万"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(T.numeral(F.col("w"))).collect()] == [1002, 10, 0, 3500, 2024, None, None, None]


def test_windows_join_units_without_blanks_between_chinese(spark):
    text = "银行资本 net capital，第 3 条" + "资" * 900
    rows = chunking.split_windows(spark.createDataFrame([(1, text)], "d int, text string")).orderBy("pos").collect()
    assert rows[0]["piece"].startswith("银行资本net capital，第3条资") and rows[1]["piece"].startswith("（承接上文）资") and " " not in rows[1]["piece"]
    assert [r["units"] for r in rows] == [800, 910 - 720]


def test_articles_with_thousands_and_suffix(spark):
    df = spark.createDataFrame([("序言\n第一千零二条 甲。\n\n 第一百零五条之二 乙。见第三条。",)], "text string")
    rows = chunking.split_articles(df).orderBy("part_no").collect()
    assert [(r["article"], r["article_label"]) for r in rows] == [(None, None), (1002, "第一千零二条"), (105, "第一百零五条之二")]


def test_packing_sends_long_units_to_windows(spark):
    units = [(1, 0, "短。"), (1, 1, "字" * 2001), (1, 2, "尾 word"), (1, 3, "more"), (2, 0, " ")]
    rows = chunking.pack_units(spark.createDataFrame(units, "d int, o int, t string"), "d", "o", "t").orderBy("pos").collect()
    assert [r["units"] for r in rows] == [2, 800, 794, 561, 2] and all(T_count(r["piece"]) <= 800 for r in rows)
    assert rows[0]["piece"] == "短。" and rows[-1]["piece"] == "尾 wordmore"  # two ASCII words that touch are one token


def T_count(text):
    import re

    return len(re.findall(r"[一-鿿]|[a-zA-Z0-9_]+|[^\s]", text))


def test_semantic_units_and_pieces(spark):
    text = "甲。乙。\n\n" + "丙" * 300 + "。" + "丁" * 300 + "。\n\n戊"
    units = [r["unit"] for r in chunking.semantic_units(spark.createDataFrame([(1, text)], "d int, text string"), "d").orderBy("pos").collect()]
    assert units == ["甲。乙。", "\n\n" + "丙" * 300 + "。", "丁" * 300 + "。", "\n\n戊"]
    rows = [(1, i, t, v) for i, (t, v) in enumerate([("甲", [1.0, 0.0]), ("乙", [0.9, 0.1]), ("丙", [0.0, 1.0]), ("丁" * 512, [0.0, 1.0]), ("戊", [0.0, 1.0])])]
    got = chunking.semantic_pieces(spark.createDataFrame(rows, "d int, o int, t string, v array<double>"), "d", "o", "t", "v").orderBy("pos").collect()
    assert [r["piece"] for r in got] == ["甲\n\n乙", "丙\n\n" + "丁" * 512, "戊"]


def test_sections_take_captions_and_split_by_title(spark):
    rows = [(1, 0, "heading", "一、总则", None), (1, 1, "paragraph", "单位：亿元", "一、总则"), (1, 2, "table", "| a | b |", "一、总则"), (1, 3, "paragraph", "甲", "一、总则"), (1, 4, "paragraph", "乙", "二、附则"), (1, 5, "formula", "a = b", "二、附则"), (1, 6, "heading", "空", None), (1, 7, "heading", "三", None), (1, 8, "paragraph", "丙" * 200, "三"), (1, 9, "table", "| c |", "三")]
    got = chunking.group_blocks(spark.createDataFrame(rows, "doc_id int, order_index int, block_type string, text string, section_title string")).orderBy("group_index", F.desc("block_type")).collect()
    assert [(r["block_type"], r["section_title"], r["text"][:12]) for r in got] == [
        ("table", "一、总则", "一、总则\n\n单位：亿元\n"), ("paragraph", "一、总则", "甲"), ("paragraph", "二、附则", "乙"), ("formula", "二、附则", "a = b"), ("paragraph", "三", "三\n\n" + "丙" * 9), ("table", "三", "表格：\n| c |"),
    ]


def test_csv_cells(spark, tmp_path):
    wide = ",".join(f"h{i}" for i in range(1, 30))
    (tmp_path / "统计2024年二季度.csv").write_text(f"\ufeff{wide},单位\n\n" + "甲," + '"1,234.5",' + ",".join(str(i) for i in range(3, 30)) + ',"亿\n元"\n', encoding="utf-8")
    rows = {r["coordinate"]: r for r in readers.csv_cells(spark, f"file://{tmp_path}").collect()}
    assert len(rows) == 30 and rows["B2"]["numeric_value"] == 1234.5 and rows["AA2"]["column_label"] == "h27" and rows["AC2"]["value"] == "29"
    assert {(r["row_label"], r["unit"], r["year"], r["quarter"]) for r in rows.values()} == {("甲", "亿\n元", 2024, 2)}
    assert [r[0] for r in spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (18278,)], "n int").select(readers.column_letters(F.col("n"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]


def test_jsonl_keeps_scalars_only(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "甲", "n": 3, "o": {"a": 1}, "l": [1], "s": "[x]", "b": true}\n[1]\n{"n": 1}\nbroken\n', encoding="utf-8")
    good, bad = readers.read_jsonl(spark, f"file://{tmp_path}/x.jsonl")
    assert good.first()["metadata"] == {"n": "3", "s": "[x]", "b": "true"} and bad.count() == 3


CELL = "source_title string, row_label string, column_label string, year int, quarter int, unit string, value string, coordinate string, numeric_value double"
ASKED = "question_id int, asked_source string, asked_year int, asked_quarter int, asked_row string, asked_column string"


def test_every_table_question_gets_a_state(spark):
    cells = spark.createDataFrame([("保险统计", "合计", "收入", 2024, q, "亿元", str(q), f"B{q}", float(q)) for q in (1, 2)] + [("保险统计", "小计", "收入", 2023, 1, "亿元", "5", f"C{i}", 5.0) for i in (1, 2)] + [("银行统计", "合计", "收入", None, None, "", v, c, n) for v, c, n in (("1", "D1", 1.0), ("2", "D2", 2.0), ("x", "D3", None))], CELL)
    q = [(1, "保险", 2024, 1, "合计", "收入"), (2, "保险", 2024, None, "合计", "收入"), (3, "保险", 2023, None, "小计", "收入"), (4, "保险", 1999, None, "合计", "收入"), (5, "没有此表", None, None, "合计", "收入"), (6, "银行", None, None, "合计", "收入"), (7, "银行", None, None, "负债", "支出")]
    q = spark.createDataFrame(q, ASKED)
    got = {r["question_id"]: r for r in tables.table_lookup(tables.score_cells(tables.cell_candidates(q, cells)), q).collect()}
    assert [got[i]["status"] for i in range(1, 8)] == ["valid_cell", "valid_cell", "valid_cell", "period_not_found", "source_not_found", "ambiguous_candidates", "indicator_not_found"]
    assert (got[1]["value"], got[2]["value"], got[2]["assumption"], got[3]["assumption"]) == ("1", "2", "latest_period", "equal_values") and got[6]["reason"] and got[1]["reason"] is None


def test_tie_rules(spark):
    rows = [(1, "t", "合计", "a", 5, "x"), (1, "t", "合计", "b", 7, "x"), (2, "t", "甲地区", "a", None, "甲地区的收入"), (2, "u", "乙地区", "a", None, "甲地区的收入"), (3, "t", "甲", "a", None, ""), (3, "u", "乙", "a", None, "")]
    df = spark.createDataFrame([(q, s, r, c, None, None, f"{s}{c}", n, text) for q, s, r, c, n, text in rows], "question_id int, source_title string, row_label string, column_label string, year int, quarter int, coordinate string, sheet_row int, question string")
    got = {r["question_id"]: (r["coordinate"], r["tie_rule"]) for r in tables.resolve_ties(df).collect()}
    assert got == {1: ("ta", "first_block"), 2: ("ta", "question_wording")}


def test_locator_items_and_suffix(spark):
    rows = [("a", ["第二章"], "第 十 条 之 二", "（三）项"), ("b", None, None, "第一千零二条 见第三条"), ("c", None, "（一）", "文")]
    got = {r["id"]: r["locator_key"] for r in S.locate(spark.createDataFrame(rows, "id string, section_path array<string>, section_title string, text string")).collect()}
    assert got == {"a": "chapter:2|article:10-2|item:3", "b": "article:1002", "c": "item:1"}


def test_contained_against_all_pairs(spark):
    needles = ["abcd", "bc", "c", "xyzabc", "", None, "资本", "abcdabcd"]
    texts = ["xxabcdyy", "xyzabcd", "c", None, "", "银行资本管理", "abcdabc", "ABCD"]
    n = spark.createDataFrame(list(enumerate(needles)), "i int, n string")
    t = spark.createDataFrame(list(enumerate(texts)), "j int, t string")
    want = sorted((i, j) for i, a in enumerate(needles) for j, b in enumerate(texts) if a and b is not None and a in b)
    got = sorted((r["i"], r["j"]) for r in contained(n, "n", t, "t").select("i", "j").collect())
    assert got == want and contained(n.limit(0), "n", t, "t").count() == 0 and contained(n, "n", t.limit(0), "t").count() == 0
    with pytest.raises(ValueError):
        contained(n, "n", t.withColumnRenamed("j", "i"), "t")


def test_phrases_of_a_question(spark):
    q = "根据《商业银行资本管理办法》说明 资本充足率 监管要求 ；银行应与哪些主体开展有效沟通工作？"
    got = one(spark, support.lexical_phrases(F.array(F.lit(q))).alias("p"))["p"]
    assert "资本充足率监管要求" in got and "开展有效沟通工作" in got and all("商业银行" not in p for p in got)
    got = one(spark, support.lexical_phrases(F.array(F.lit("A. 单一客户贷款余额相对一级资本净额的比例"))).alias("p"))["p"]
    assert {"单一客户贷款余额", "一级资本净额"} <= set(got)


CHUNKS = "doc_id int, chunk_id string, pos int, section_title string, text string"


def test_phrase_and_definition_support(spark):
    chunks = spark.createDataFrame([(1, "a", 0, "第一条", "本办法所称最低资本，是指保险公司"), (1, "b", 1, None, "应当持有的资本数额。"), (2, "c", 0, None, "资本充足率不得低于8%，应当按季报送"), (3, "d", 0, None, None)], CHUNKS)
    scope = spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "question_id int, doc_id int")
    phrases = spark.createDataFrame([(1, 0, "所称最低资本", []), (2, 0, "资本充足率不得低于", ["8%"]), (2, 1, "资本充足率不得低于", ["9%"]), (2, 2, "短", [])], "question_id int, phrase_no int, phrase string, figures array<string>")
    got = {r["question_id"]: (r["chunk_id"], r["score"]) for r in support.phrase_support(phrases, chunks, scope).collect()}
    assert got[1][0] == "a" and got[2][0] == "c" and got[1][1] >= 1.35 and 1.35 <= got[2][1] <= 1.55
    q = spark.createDataFrame([(1, "“最低资本”是如何定义的？"), (2, "“最低资本”是什么"), (3, "“ 资本数额 ”指什么"), (4, "最低资本是什么")], "question_id int, question string")
    defs = spark.createDataFrame([("最低资本", "a")], "term_norm string, chunk_id string")
    rows = {(r["question_id"], r["chunk_id"]): (r["source"], r["score"]) for r in support.definition_support(q, chunks, scope, defs).collect()}
    assert rows == {(1, "a"): ("scope", 1.5), (1, "b"): ("successor", 1.4), (2, "a"): ("dictionary", 1.5), (2, "b"): ("successor", 1.4)}


def test_lists_go_on(spark):
    item = "（一）注册资本应当不低于十亿元人民币，并且为实缴货币资本；"
    chunks = spark.createDataFrame([(1, "a", 0, "第五条", "应当符合下列条件："), (1, "b", 1, "第五条", item), (1, "c", 2, "第六条", item), (1, "d", 3, "第五条", "其他内容")], CHUNKS)
    anchors = spark.createDataFrame([(1, "a")], "question_id int, chunk_id string")
    none = spark.createDataFrame([], "question_id int, phrase string")
    terms = spark.createDataFrame([(1, "注册资本不低于十亿元")], "question_id int, term string")
    got = support.continue_list(anchors, chunks, none, terms).collect()
    assert [r["chunk_id"] for r in got] == ["b"] and got[0]["score"] > 0.45
    lead = spark.createDataFrame([(1, "a")], "question_id int, chunk_id string")
    assert [r["chunk_id"] for r in support.lead_continuation(lead, chunks).orderBy("step").collect()] == ["b", "c"]


def test_recovery_gate(spark):
    aspects = spark.createDataFrame([(1, "define", ["资本(净额)"]), (2, "define", ["资本"]), (3, "explain", []), (4, "explain", None)], "aspect_id int, intent string, targets array<string>")
    m = spark.createDataFrame([(1, 1, "资本(净额)，是指", "direct", 0.9), (2, 1, "资本", "direct", 0.9), (3, 1, "x", "direct", 0.55), (4, 2, "x", "direct", 0.9)], "aspect_id int, doc_id int, text string, role string, rerank_score double")
    scope = spark.createDataFrame([(4, 1)], "aspect_id int, doc_id int")
    assert {r["aspect_id"]: r["pass"] for r in support.needs_recovery(aspects, m, scope).collect()} == {2: "definition", 4: "phrases"}


def test_source_titles(spark):
    parts = lambda t: tuple(one(spark, contract.split_title(F.lit(t)).alias("s"))["s"])
    assert parts("恢复计划示例（商业银行版）") == ("恢复计划示例", ["商业银行版"]) and parts("商业银行版恢复计划示例") == ("恢复计划示例", ["商业银行版"]) and parts("商业银行版") == ("", ["商业银行版"])
    assert one(spark, contract.title_key(F.lit("012_保险公司（ＰＤＦ）规则 II.pdf")).alias("k"))["k"] == "保险公司规则ii"
    ev = "question_id int, chunk_id int, doc_id int, filename string, source_title string, file_type string, version_status string, year int, month int, quarter int"
    rows = [(1, 1, 1, "3_资本办法（2023年）.pdf", None, "pdf", None, None, None, 1), (1, 2, 2, "资本办法.docx", "资本办法", "docx", "试行", 2023, None, 2), (1, 3, 3, "其他.pdf", None, "pdf", None, None, None, None)]
    want = {"资本办法": [1, 2], "资本办法（2023年版）": [1, 2], "资本办法（一季度）": [1], "资本办法（Word）": [2], "资本办法（试行）": [2], "资本办法（2022年）": [], "（2023年版）": [1, 2]}
    req = spark.createDataFrame([(1, t, [t]) for t in want] + [(1, "none", None)], "question_id int, requirement_id string, source_titles array<string>")
    got = {t: [] for t in [*want, "none"]}
    for r in contract.source_matches(req, spark.createDataFrame(rows, ev)).filter("source_ok").orderBy("chunk_id").collect():
        got[r["requirement_id"]].append(r["chunk_id"])
    assert got == {**want, "none": [1, 2, 3]}  # the second has its year in the table's period
    scope = spark.createDataFrame([(1, "资本办法", 3)], "question_id int, requirement_id string, doc_id int")
    assert contract.source_matches(req, spark.createDataFrame(rows, ev), scope).filter("source_ok and requirement_id = '资本办法'").count() == 3


def test_bindings_and_facets(spark):
    ev = spark.createDataFrame([(1, 1, "流动性覆盖率不得低于100%", "第三条", "办法2023年", ["a"]), (1, 2, "无关", None, "办法", [])], "question_id int, chunk_id int, text string, section_title string, identity string, tags array<string>")
    req = spark.createDataFrame([(1, "a", "x", "explain", ["流动性覆盖率不得低于"], []), (1, "b", "x", "explain", ["流动性覆盖率不得低于"], []), (1, "c", "适用哪个版本", "explain", [], []), (1, "d", "x", "define", ["流动性覆盖率"], [])], "question_id int, requirement_id string, question string, intent string, target_terms array<string>, attribute_terms array<string>")
    fits = ev.crossJoin(req.select("requirement_id")).select("question_id", "requirement_id", "chunk_id", F.lit(True).alias("source_ok"))
    assert {(r["requirement_id"], r["chunk_id"]) for r in contract.bind_requirements(ev, req, fits).collect()} == {("b", 1), ("c", 1)}
    r = spark.createDataFrame([(1, "a", True, "比例不低于 8% 吗", "explain", ["资本办法"], ["资本充足率"], False), (1, "b", False, "有哪些情形", "list", None, None, True), (2, "a", True, "x", "explain", None, None, False)], "question_id int, requirement_id string, mandatory boolean, question string, intent string, source_titles array<string>, target_terms array<string>, needs_table boolean")
    b = spark.createDataFrame([(1, "a", 1, "资本充足率不低于8.0%", None, "《资本办法》", False), (1, "b", 2, "（一）甲；", None, None, False)], "question_id int, requirement_id string, chunk_id int, text string, section_title string, source string, is_table boolean")
    rep = {(x["question_id"], x["requirement_id"]): (x["status"], {f["facet"]: f["ok"] for f in x["facets"]}) for x in contract.facets(r, b).collect()}
    assert rep[1, "a"] == ("covered", {"source": True, "target": True, "numeric": True}) and rep[2, "a"] == ("unbound", {})
    assert rep[1, "b"] == ("missing", {"condition": False, "enumeration": True, "table": False})
    assert {x["question_id"]: x["status"] for x in contract.set_status(contract.facets(r, b)).collect()} == {1: "sufficient", 2: "insufficient"}


def test_entity_conflicts_and_options(spark):
    got = lambda g, a: one(spark, scoring.entity_conflicts(F.lit(g), F.lit(a)).alias("c"))["c"]
    assert got("余额 100.0 亿元", "100.4 亿元") == [] and got("100", "102") == ["number"] and got("2024年1季度", "2023 年") == ["period"] and got("2024年", "1 2月") == ["number", "period"] and got("《甲办法》", "依据《乙办法》") == ["title"] and got("《甲办法》", None) == []
    a = spark.createDataFrame([(1, "答案是C。"), (2, "为 12.5% [3]"), (3, "甲方案以及乙方案较长"), (4, "都不是"), (5, None)], "case_id int, answer string")
    o = [(1, x, x) for x in "ABC"] + [(2, "A", "0.124"), (2, "B", "12.5%")] + [(3, "A", "甲方案"), (3, "B", "乙方案较长")] + [(4, "A", "甲")]
    assert {r["case_id"]: (r["option"], r["rule"]) for r in scoring.infer_option(a, spark.createDataFrame(o, "case_id int, option string, option_text string")).collect()} == {1: ("C", "letter"), 2: ("B", "number"), 3: ("B", "containment")}


def test_run_comparison_lists_what_is_missing(spark):
    a = spark.createDataFrame([(1, "x", 10.0), (2, "y", 20.0)], "case_id int, f string, ms double")
    b = spark.createDataFrame([(2, None, 30.0), (3, "z", 50.0)], "case_id int, f string, ms double")
    r = evaluation.compare_runs(a, b, ["f"], ms="ms").first()
    assert (r["cases"], r["missing_left"], r["missing_right"], r["mean_ms_left"], r["mean_ms_right"], r["differing"]) == (1, 1, 1, 15.0, 40.0, 1)


def test_embedding_jobs(spark):
    df = spark.createDataFrame([(1, "A b a"), (2, "c")], "chunk_id int, text string")
    v = {r["chunk_id"]: r["vector"] for r in search.embed(df).collect()}
    assert len(v[1]) == 64 and abs(sum(x * x for x in v[1]) - 1) < 1e-9 and sorted(x for x in v[2] if x) == [1.0]

    def encoder():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    assert {r["chunk_id"]: list(r["vector"]) for r in search.embed(df, encoder=encoder).collect()} == {1: [5.0, 1.0], 2: [1.0, 1.0]}
    for bad in (None, "  "):
        with pytest.raises(Exception, match="blank text"):
            search.embed(df.unionByName(spark.createDataFrame([(3, bad)], "chunk_id int, text string"))).collect()


def test_postings_and_dense_ties(spark, monkeypatch):
    df = spark.createDataFrame([(1, {"a": "1.5", "b": "0", "c": "x", "d": None, "e": "NaN"})], "chunk_id int, weights map<string,string>")
    assert [tuple(r) for r in search.to_postings(df, "chunk_id").collect()] == [(1, "a", 1.5)]
    v = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(20)] + [(99, None)], "chunk_id int, vector array<double>")
    q = spark.createDataFrame([(7, [0.0, 1.0])], "query_id int, vector array<double>")
    for block in (16_384, 3):
        monkeypatch.setattr(search, "VECTOR_BLOCK", block)
        assert [r["chunk_id"] for r in search.dense_topk(q, v, 3).orderBy("rank").collect()] == [1, 3, 5]
    assert search.dense_topk(q, v.filter("chunk_id = 2"), 3).count() == 1 and search.dense_topk(q.limit(0), v, 3).count() == 0


def test_statements_and_their_scope(spark):
    got = one(spark, support.statements_of(F.array(F.lit("银行业务包括吸收存款、发放贷款；禁止洗钱"), F.lit(None).cast("string"))).alias("s"))["s"]
    assert got == ["银行业务包括吸收存款、发放贷款；禁止洗钱", "银行业务包括吸收存款、发放贷款", "禁止洗钱", "发放贷款", "吸收存款"]
    chunks = spark.createDataFrame([(1, "a", 0, None, "银行不得从事下列行为："), (1, "b", 1, None, "（一）违规发放贷款；"), (1, "c", 2, None, "一、商业银行业务范围\n正文"), (2, "d", 0, None, "（一）违规发放贷款；")], CHUNKS)
    s = spark.createDataFrame([(1, "违规发放贷款"), (1, "“存款”违规发放贷款"), (1, "商业银行业务包括贷款")], "question_id int, statement string")
    rows = support.statement_support(s, chunks, spark.createDataFrame([(1, 1)], "question_id int, doc_id int")).collect()
    assert {(r["role"], r["chunk_id"]) for r in rows} == {("support", "b"), ("support", "c"), ("lead", "a"), ("section", "c")}


def test_outline_of_a_named_part(spark):
    chunks = spark.createDataFrame([(1, "a", 0, ["三、管理"], "（一）甲\n（二）乙"), (1, "b", 1, ["三、管理", "风险管理部分"], "1. 丙"), (1, "c", 2, ["四"], "（一）丁"), (1, "d", 3, None, "（一）戊")], "doc_id int, chunk_id string, pos int, section_path array<string>, text string")
    q = spark.createDataFrame([(1, "风险管理部分包括哪些"), (2, "风险管理部分的要求"), (3, "其他部分包括哪些")], "question_id int, question string")
    got = support.section_outline(q, chunks, q.select("question_id", F.lit(1).alias("doc_id"))).collect()
    assert [(r["question_id"], r["chunk_id"], list(r["outline"])) for r in got] == [(1, "b", ["（一）甲", "（二）乙", "1. 丙"])]


def test_grid_layout(spark):
    rows = [("s", 3, 2, "统计表"), ("s", 4, 4, "单位：亿元"), ("s", 5, 2, "地区"), ("s", 5, 3, "收入"), ("s", 5, 4, "收入"), ("s", 6, 3, "本月"), ("s", 6, 4, "累计"), ("s", 7, 2, "北京"), ("s", 7, 3, "1,234"), ("s", 7, 4, "5%"), ("t", 1, 1, "甲"), ("t", 2, 1, "乙"), ("u", 1, 1, " ")]
    got = {r["sheet"]: r for r in grids.infer_layout(spark.createDataFrame(rows, "sheet string, row int, col int, value string"), ["sheet"]).collect()}
    r = got["s"]
    assert (r["first_row"], r["first_col"], r["data_row"], list(r["header_rows"]), list(r["headers"]), list(r["label_cols"])) == (3, 2, 7, [5, 6], ["地区", "收入 / 本月", "收入 / 累计"], [1])
    assert got["t"]["data_row"] is None and list(got["t"]["headers"]) == ["列1"] and list(got["t"]["label_cols"]) == [1] and "u" not in got


PLANS = relational.QUERIES | retrieval.QUERIES | rules.QUERIES | support_plans.QUERIES


@pytest.mark.parametrize("name", ["table_lookup", "indicator_match", "identity_lookup", "inferred_topics", "document_references", "gold_files", "definition_evidence", "retrieval_recall", "dense_topk", "gold_documents"])
def test_no_nested_loops(spark, name):
    plan = PLANS[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
