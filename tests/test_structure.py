from pyspark.sql import functions as F

from evidence_spark.operators import structure as S


def test_locator(spark):
    rows = [("a", ["第二章 总则"], "第十条 要求", "文"), ("b", None, None, "第一百零五条 资本"), ("c", ["第三章"], None, "x"), ("d", None, None, "根据第十条的规定")]
    got = {r["id"]: r for r in S.locate(spark.createDataFrame(rows, "id string, section_path array<string>, section_title string, text string")).collect()}
    assert got["a"]["locator_key"] == "chapter:2|article:10" and got["b"]["article"] == 105
    assert [got[k]["locator_status"] for k in "abcd"] == ["resolved", "resolved", "partial", "unresolved"]


def test_match_structure(spark):
    cols = [f"{s}{k}" for s in ("gold_", "got_") for k in ("doc", *S.LEVELS)]
    row = lambda doc, art, para: [doc, None, 2, None, art, para, None]
    rows = [(*row(1, 10, None), *row(1, 10, 3)), (*row(1, 10, 2), *row(1, 11, 2)), (*row(1, 10, 2), *row(2, 10, 2))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    assert [r["mismatch"] for r in S.match_structure(df, "paragraph").collect()] == [None, "article", "document"]
    assert S.match_structure(df, "paragraph", "strict").first()["mismatch"] == "paragraph"


def test_fills(spark):
    g = spark.createDataFrame([("s", 1, "A", "x"), ("s", 2, "", "y"), ("s", 3, "B", "")], "sheet string, row int, l1 string, l2 string")
    assert [r["row_label"] for r in S.fill_row_labels(g, ["l1", "l2"], ["sheet"]).orderBy("row").collect()] == ["A / x", "A / y", "B / y"]
    cells = spark.createDataFrame([("s", r, c, f"{r}{c}" if (r, c) != (1, 2) else None) for r in (1, 2) for c in (1, 2, 3)], "sheet string, row int, col int, value string")
    ranges = spark.createDataFrame([("s", 1, 1, 1, 2)], "sheet string, top int, left int, bottom int, right int")
    got = {(r["row"], r["col"]): r["value"] for r in S.fill_merged(cells, ranges, ["sheet"]).collect()}
    assert got[1, 2] == "11" and got[1, 3] == "13" and len(got) == 6


def test_table_context_and_cells(spark):
    g = spark.createDataFrame([("s", 1, 1, "2024年第一季度统计表"), ("s", 2, 1, "单位：亿元")], "sheet string, row int, col int, value string")
    assert tuple(S.infer_table_context(g, ["sheet"]).first()) == ("s", "亿元", 2024, None, 1)
    js = '[{"row": "合计", "column": "第一季度", "value": "1,234.5", "coordinate": "B2"}, {"row": "是否", "column": "x", "value": "true", "coordinate": "B3"}]'
    got = S.build_cells(spark.createDataFrame([(1, js)], "doc_id int, cells string")).orderBy("coordinate").collect()
    assert [(r["column_label"], r["numeric_value"]) for r in got] == [("1季度", 1234.5), ("x", None)]


def test_titles_and_scope(spark):
    docs = spark.createDataFrame([(1, "资本办法.docx", "资本管理办法"), (2, "商业银行资本管理办法.pdf", "商业银行资本管理办法"), (3, "x.pdf", "其他")], "doc_id int, filename string, title string")
    t = spark.createDataFrame([(1, "资本管理办法"), (2, "银行资本"), (3, "没有")], "title_id int, wanted string")
    assert {r["title_id"]: r["doc_id"] for r in S.resolve_titles(t, docs).collect()} == {1: 1, 2: 2}
    scope = S.resolve_scope(spark.createDataFrame([(1, "资本"), (2, "没有此文"), (3, "")], "query_id int, wanted string"), docs)
    got = {r["query_id"]: (r["scoped"], r["doc_ids"]) for r in scope.collect()}
    assert got == {1: (True, [1, 2]), 2: (True, []), 3: (False, [])}
    cand = spark.createDataFrame([(q, d) for q in (1, 2, 3) for d in (1, 3)], "query_id int, doc_id int")
    assert sorted(map(tuple, S.in_scope(cand, scope).collect())) == [(1, 1), (3, 1), (3, 3)]


def test_embedding_text_and_expected_cells(spark):
    df = spark.createDataFrame([("办法", None, "正文")], "a string, b string, c string")
    assert df.select(S.embedding_text({"来源": F.col("a"), "页": F.col("b")}, F.col("c")).alias("t")).first()["t"] == "来源：办法\n正文"
    cells = spark.createDataFrame([(1, "s", "B2", "12.344")], "doc_id int, sheet string, coordinate string, value string")
    want = spark.createDataFrame([(1, "s", "B2", "12.34"), (1, "s", "B3", "1")], "doc_id int, sheet string, coordinate string, expected string")
    assert [(r["located"], r["equal"]) for r in S.validate_cells(want, cells).orderBy("coordinate").collect()] == [(True, True), (False, False)]
