"""Questions that ask the same are read once."""

import pytest

from evidence_spark.operators import spreadsheets as sp
from evidence_spark.operators import support


@pytest.mark.parametrize("answer", [sp.lookup_answers, sp.calculation_answers])
def test_equal_questions_are_answered_once(spark, monkeypatch, answer):
    asked, visible = [], sp.visible_cells
    monkeypatch.setattr(sp, "visible_cells", lambda q, c: asked.append(q.count()) or visible(q, c))
    cells = spark.createDataFrame([("d", "收入表", "Sheet1", "甲", "金额", "A1", "5", 5.0, "元", 2024), ("d", "收入表", "Sheet1", "乙", "金额", "A2", "7", 7.0, "元", 2024)], "document_id string, source_title string, sheet_name string, row_label string, column_label string, coordinate string, value string, numeric_value double, unit string, year int")
    one = lambda row: (None, row, None, None, None, None, None, None, False)
    rows = [(i, "sum", "收入表", "甲" if i % 2 else "乙", "金额", [one("甲"), one("乙")] if answer is sp.calculation_answers else None) for i in range(40)]
    out = answer(spark.createDataFrame(rows, f"question_id int, operation string, asked_source string, asked_row string, asked_column string, selectors {sp.SELECTOR}"), cells)
    got = {r["question_id"]: (r["status"], r["value"] if "value" in out.columns else r["result"]) for r in out.collect()}
    assert asked == [2] and sorted(got) == list(range(40)) and len(set(got.values())) == (2 if "value" in out.columns else 1)
    if answer is sp.calculation_answers:
        assert set(got.values()) == {("valid_calculation", 12.0)}


def test_definitions_are_looked_up_once_for_equal_questions(spark, monkeypatch):
    looked, contained = [], support.contained
    monkeypatch.setattr(support, "contained", lambda needles, n, texts, t: looked.append(needles.count()) or contained(needles, n, texts, t))
    questions = spark.createDataFrame([(i, "“资本”的定义") for i in range(20)], "question_id int, question string")
    chunks = spark.createDataFrame([(1, 10, 0, None, "资本是指甲"), (1, 11, 1, None, "乙"), (2, 20, 0, None, "丙")], "doc_id int, chunk_id int, pos int, section_title string, text string")
    scope = spark.createDataFrame([(0, 1), (1, 2)], "question_id int, doc_id int")
    none = spark.createDataFrame([], "term_norm string, chunk_id int")
    got = sorted(tuple(r) for r in support.definition_support(questions, chunks, scope, none).select("question_id", "chunk_id", "source").collect())
    assert got == sorted(r for i in range(20) for r in ((i, 10, "corpus" if i else "scope"), (i, 11, "successor")))
    assert looked == [4]
