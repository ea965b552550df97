"""Table questions: periods in headers and row labels, ledger filters, scores, operands."""

import pytest
from pyspark.sql import functions as F

from evidence_spark.operators import spreadsheets as sp

CELL = "document_id string, source_title string, sheet_name string, row_label string, column_label string, coordinate string, sheet_row int, sheet_column int, value string, numeric_value double, unit string, year int, month int, quarter int, status string, version_status string, issuing_authority string"
ASK = "question_id int, question string, operation string, asked_source string, asked_sheet string, asked_year int, asked_month int, asked_quarter int, asked_row string, asked_column string, asked_indicator string, asked_scope string, asked_issuing_authority string, selectors " + sp.SELECTOR
BANKS, RATIOS = "2025年商业银行主要指标分机构类情况表（季度）", "2024年商业银行主要监管指标情况表（季度）"


def cell(source, row, column, coordinate, value, year=None, month=None, quarter=None, unit="亿元", doc="D1", **more):
    digits = "".join(c for c in coordinate if c.isdigit())
    at = ord(coordinate[0]) - 64
    return (doc, source, more.get("sheet", "S1"), row, column, coordinate, int(digits), at, str(value), None if value == "-" else float(value), unit, year, month, quarter, more.get("status", "indexed"), more.get("version"), more.get("authority"))


CELLS = [cell(BANKS, f"{q}季度 / 不良贷款余额", "农村商业银行", f"G{i}", v, 2025) for q, i, v in (("一", 5, 8234.537443), ("二", 6, 8051.364405), ("三", 7, 8274.705191), ("四", 8, 8064.958648))]
CELLS += [cell(BANKS, "一季度 / 不良贷款率", "农村商业银行", "G9", 0.02862, 2025)]
CELLS += [cell(RATIOS, "资本充足率", f"{q}季度", f"{c}43", v, 2024, unit="") for q, c, v in (("一", "D", 0.1543), ("二", "E", 0.15534), ("三", "F", 0.15617), ("四", "G", 0.15736))]
CELLS += [cell(RATIOS, "核心一级资本充足率", "四季度", "H43", 0.10997, 2024, unit="")]
MONTHLY = "2024年3月保险业经营情况表"
CELLS += [cell(MONTHLY, r, "本年累计 / 截至当期", f"B{i}", v, 2024, 3) for i, (r, v) in enumerate([("原保险保费收入", 100.5), ("其中：财产险公司 / 银行存款", 20.25), ("债券", 50), ("全国合计", 400), ("赔付支出", 40)], 4)]
CELLS += [cell("2024年3月人身险公司经营情况表", "原保险保费收入", "本年累计 / 截至当期", "B4", 70, 2024, 3, doc="D2"), cell("2024年3月人身险公司经营情况表", "赔付支出", "本年累计 / 截至当期", "B5", 35, 2024, 3, doc="D2")]
CELLS += [cell("2020年旧表", "总资产", "金额", "B2", 1, 2020, version="repealed", doc="D3"), cell("2020年旧表", "总资产", "金额", "B3", 2, 2020, status="failed", doc="D4"), cell("2020年新表", "总资产", "金额", "B2", 9, 2020, doc="D5", authority="甲局"), cell("2020年新表", "总资产", "金额", "B2", 8, 2020, doc="D6", authority="乙局")]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS, CELL)


def ask(spark, *questions):
    names = [c.split()[0] for c in ASK.split(", ")[:13]] + ["selectors"]
    rows = []
    for i, q in enumerate(questions):
        chosen = [tuple({**dict.fromkeys(("label", "row_label", "column_label", "scope", "source_title", "year", "month", "quarter", "ordered_transition")), **s}.values()) for s in q.get("selectors", [])]
        rows.append(tuple(({"question_id": i, **q} | {"selectors": chosen}).get(n) for n in names))
    return spark.createDataFrame(rows, ASK)


def lookups(spark, cells, *questions):
    return {r["question_id"]: r for r in sp.lookup_answers(ask(spark, *questions), cells).collect()}


def results(spark, cells, *questions):
    return {r["question_id"]: r for r in sp.calculation_answers(ask(spark, *questions), cells).collect()}


def test_label_parts(spark):
    rows = [("一季度 / 不良贷款余额",), ("2024年3月 | 总资产",), ("第四季度/利润",), ("资本充足率",), ("12月",), (None,)]
    got = [tuple(r["p"]) if r["p"] else None for r in spark.createDataFrame(rows, "t string").select(sp.row_period(F.col("t")).alias("p")).collect()]
    assert got == [(None, None, 1, "不良贷款余额"), (2024, 3, None, "总资产"), (None, None, 4, "利润"), None, None, None]
    rows = [("四季度",), ("2024年四季度",), ("第2季度",), ("3月",), ("13月",), ("机构",), (None,)]
    got = [tuple(r["p"]) for r in spark.createDataFrame(rows, "t string").select(sp.header_period(F.col("t")).alias("p")).collect()]
    assert got == [(4, None), (4, None), (2, None), (None, 3), (None, None), (None, None), (None, None)]
    cover = lambda row, words: spark.range(1).select(sp.words_covered(F.lit(row), F.array(*map(F.lit, words))).alias("c")).first()["c"]
    assert cover("债券", ["债券投资"]) and not cover("不良贷款率", ["不良贷款余额"]) and cover("财产险公司银行存款", ["财产险公司", "银行存款"]) and cover("任何", [])


def test_title_variants(spark):
    got = lambda t: set(spark.range(1).select(sp.title_variants(F.lit(t)).alias("v")).first()["v"])
    assert {"148_2023年10月财产险公司经营情况表", "2023年10月财产险公司经营情况表", "财产险公司经营情况表", "财产保险公司经营表"} <= got("148_2023年10月财产险公司经营情况表")
    assert "2023年03月甲表" in got("2023年3月甲表") and "2023年3月甲表" in got("2023年03月甲表") and "甲情况表" in got("甲情况表(季度)")
    assert got("") == set()


def test_transposed_lookup(spark, cells):
    row = {"asked_source": BANKS, "asked_year": 2025, "asked_row": "农村商业银行", "asked_indicator": "不良贷款余额"}
    got = lookups(spark, cells, row | {"asked_quarter": 1}, row | {"asked_quarter": 3, "asked_row": None, "asked_column": "农村商业银行"}, row | {"asked_quarter": 1, "asked_row": "大型银行"}, row | {"asked_quarter": 1, "asked_indicator": None}, row | {"asked_quarter": 1, "asked_year": 2023})
    assert (got[0]["status"], got[0]["coordinate"], got[0]["value"], got[0]["layout"]) == ("valid_cell", "G5", "8234.537443", "transposed")
    assert (got[1]["status"], got[1]["coordinate"]) == ("valid_cell", "G7")
    assert got[2]["status"] == "indicator_not_found" and got[3]["status"] == "ambiguous_candidates"
    assert (got[4]["status"], got[4]["layout"]) == ("period_not_found", "plain")


def test_period_in_the_header_is_no_transposed_layout(spark, cells):
    row = {"asked_source": RATIOS, "asked_year": 2024, "asked_indicator": "资本充足率", "asked_row": "资本充足率"}
    got = lookups(spark, cells, row | {"asked_quarter": 4}, row, row | {"asked_quarter": 4, "asked_row": "核心一级资本充足率", "asked_indicator": None}, row | {"asked_month": 7}, row | {"asked_quarter": 2, "asked_row": "利润总额", "asked_indicator": None})
    assert (got[0]["status"], got[0]["coordinate"], got[0]["layout"]) == ("valid_cell", "G43", "plain")
    assert (got[1]["coordinate"], got[1]["assumption"]) == ("G43", "latest_period")
    assert got[2]["coordinate"] == "H43" and got[3]["status"] == "period_not_found" and got[4]["status"] == "indicator_not_found"


def test_filters_of_the_ledger_status_and_version(spark, cells):
    got = lookups(
        spark, cells, {"asked_source": "2020年旧表", "asked_row": "总资产"}, {"asked_source": "2020年新表", "asked_row": "总资产", "asked_issuing_authority": "乙局"}, {"asked_source": "2020年新表", "asked_row": "总资产"},
        {"asked_source": "2020年新表", "asked_row": "总资产", "asked_sheet": "S9"}, {"asked_row": "总资产", "asked_year": 2020, "asked_issuing_authority": "甲局"}, {"question": "什么都没有"}, {"asked_source": "无此表"},
    )
    assert got[0]["status"] == "source_not_found" and (got[1]["status"], got[1]["value"]) == ("valid_cell", "8") and got[2]["status"] == "ambiguous_candidates"
    assert got[3]["status"] == "sheet_not_found" and got[4]["value"] == "9" and got[5]["status"] == "no_candidates" and got[6]["status"] == "source_not_found"


def test_family_scope_breaks_a_tie_between_tables(spark, cells):
    row = {"asked_source": "经营情况表", "asked_year": 2024, "asked_month": 3, "asked_row": "原保险保费收入"}
    got = lookups(spark, cells, row | {"asked_scope": "保险业"}, row | {"asked_scope": "人身险公司"}, row)
    assert got[0]["value"] == "100.5" and got[1]["value"] == "70.0" if got[1]["value"] == "70.0" else got[1]["value"] == "70"
    assert got[2]["status"] == "ambiguous_candidates"


def test_transposed_difference_across_periods(spark, cells):
    shared = {"asked_source": BANKS, "asked_row": "农村商业银行", "asked_indicator": "不良贷款余额", "operation": "difference"}
    two = [{"year": 2025, "quarter": 1, "row_label": "不良贷款余额"}, {"year": 2025, "quarter": 4, "row_label": "不良贷款余额"}]
    got = results(spark, cells, shared | {"selectors": two}, shared | {"selectors": [s | {"ordered_transition": True} for s in two]}, shared | {"selectors": [two[0], two[0]]}, shared | {"selectors": two[:1]}, shared | {"selectors": [two[0], two[1] | {"year": 2023}]})
    assert got[0]["status"] == "valid_calculation" and got[0]["result"] == pytest.approx(169.578795) and got[0]["layout"] == "transposed" and got[0]["coordinates"] == ["G5", "G8"]
    assert got[1]["result"] == pytest.approx(-169.578795)
    assert {got[i]["status"] for i in (2, 3, 4)} == {"missing_operands"}


def test_operands_by_specificity_retry_and_placeholder(spark, cells):
    month = {"asked_source": MONTHLY, "asked_year": 2024, "asked_month": 3}
    got = results(
        spark, cells,
        month | {"operation": "sum", "selectors": [{"label": "财产险公司 银行存款"}, {"label": "全国"}]},  # all words in the row; a total without its ending
        month | {"operation": "difference", "selectors": [{"row_label": "商业银行 债券投资"}, {"label": "赔付支出"}]},  # retried without the institution
        {"asked_source": RATIOS, "asked_year": 2024, "operation": "difference", "selectors": [{"row_label": "资本充足率", "label": "资本充足率", "column_label": "季度", "ordered_transition": True}] * 2},
        {"asked_source": RATIOS, "asked_year": 2024, "operation": "sum", "selectors": [{"label": "资本充足率"}, {"label": "核心一级资本充足率"}]},
        {"asked_source": RATIOS, "asked_year": 2024, "operation": "sum", "selectors": [{"label": "资本充足率", "quarter": 2}, {"label": "资本充足率", "quarter": 3}]},
        month | {"operation": "sum", "selectors": [{"label": "全国合计"}, {"label": "全国合计"}]},
    )
    assert got[0]["coordinates"] == ["B5", "B7"] and got[0]["result"] == pytest.approx(420.25)
    assert got[1]["coordinates"] == ["B6", "B8"] and got[1]["result"] == pytest.approx(10)
    assert got[2]["coordinates"] == ["D43", "G43"] and got[2]["result"] == pytest.approx(0.00306) and got[2]["assumptions"] == ["first_of_table", "last_of_table"]
    assert got[3]["coordinates"] == ["D43", "H43"] and got[3]["assumptions"] == ["first_period"]
    assert got[4]["coordinates"] == ["E43", "F43"] and got[4]["assumptions"] == []
    assert got[5]["status"] == "missing_operands"


def test_ratio_keeps_to_one_source_and_prefers_the_family(spark, cells):
    two = {"asked_source": "经营情况表", "asked_month": 3, "operation": "ratio", "selectors": [{"label": "赔付支出"}, {"label": "原保险保费收入"}]}
    got = results(spark, cells, two | {"asked_scope": "人身险公司", "question": "占比是多少"}, two | {"asked_scope": "保险业", "question": "比值保留三位小数"}, two | {"asked_scope": "保险业", "question": "多少倍"}, two | {"asked_scope": "保险业", "question": "比值"})
    assert got[0]["result"] == pytest.approx(50.0) and got[0]["places"] == 2
    assert got[1]["result"] == pytest.approx(40 / 100.5) and got[1]["places"] == 3
    assert got[2]["places"] == 2 and got[3]["places"] == 4


def test_empty_tables(spark, cells):
    assert sp.lookup_answers(ask(spark, {"asked_source": "x"}), cells.limit(0)).collect()[0]["status"] == "source_not_found"
    assert sp.calculation_answers(ask(spark, {"asked_source": "x", "operation": "sum"}), cells.limit(0)).collect()[0]["status"] == "missing_operands"
    assert sp.lookup_answers(ask(spark, {"asked_source": "x"}).limit(0), cells).count() == 0
