"""Operators on inline fixtures: language rules, folds, precedence, state."""

import datetime as dt
import random

from pyspark.sql import functions as F

from evidence_spark.functions import text as T
from evidence_spark.operators import chunking, evaluation, evidence, identity, search, tables
from evidence_spark.sources import documents, indexes
from evidence_spark.streaming import events


def one(spark, col, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(col.alias("x")).first()["x"]


def test_numerals(spark):
    want = {"十": 10, "二十一": 21, "一百零五": 105, "2024": 2024, "第十条": None}
    assert {k: one(spark, T.numeral(F.col("a")), a=k) for k in want} == want


def test_token_count(spark):
    assert one(spark, T.token_count(F.col("a")), a="消费 abc_1, x。") == 6


def test_values(spark):
    want = {"1,234.5": 1234.5, "12%": 0.12, "—": None, "abc": None, "-3": -3.0}
    assert {k: one(spark, T.normalize_value(F.col("a")), a=k) for k in want} == want


def test_scores(spark):
    assert one(spark, T.number_match(F.col("g"), F.col("a")), g="31739.18", a="共 31,739.18 亿元") is True
    assert one(spark, T.number_match(F.col("g"), F.col("a")), g="-424047.16", a="200373.485") is False
    assert one(spark, T.bigram_support(F.col("g"), F.col("a")), g="资本净额", a="银行的资本净额是指") == 1.0


def test_definitions_and_clauses(spark):
    rows = [("c1", "第二条 本办法所称消费金融公司，是指非银行金融机构。", ""), ("c2", "第三条 其他事项。", ""), ("c3", "第一百零五条 资本净额是指扣除后的资本。", "")]
    ch = spark.createDataFrame(rows, "chunk_id string, text string, section_title string")
    found = {(r["chunk_id"], r["term"]) for r in chunking.extract_definitions(ch).collect()}
    assert ("c1", "消费金融公司") in found and ("c3", "资本净额") in found and not [x for x in found if x[0] == "c2"]
    assert sorted(r["clause_number"] for r in chunking.extract_clauses(ch).collect()) == [2, 3, 105]


def test_articles(spark):
    df = spark.createDataFrame([("b", "前言\n第一条 甲。\n第二条 乙。")], "id string, text string")
    assert [r["article"] for r in chunking.split_articles(df).orderBy("part_no").collect()] == [None, 1, 2]


def test_heading_paths(spark):
    rows = [(1, i, lv, t) for i, (lv, t) in enumerate([(1, "A"), (2, "a"), (None, "x"), (1, "B"), (None, "y")])]
    got = chunking.heading_paths(spark.createDataFrame(rows, "doc int, pos int, level int, title string"), "doc", "pos").orderBy("pos").collect()
    assert [r["path"] for r in got] == [["A"], ["A", "a"], ["A", "a"], ["B"], ["B"]]


def test_token_budget_skips_and_continues(spark):
    rows = [(1, r, n) for r, n in enumerate([3000, 700, 500, 100], 1)]
    got = search.token_budget(spark.createDataFrame(rows, "query_id int, rank int, tokens int"))
    assert sorted(r["rank"] for r in got.collect()) == [1, 3, 4]


def test_coverage_against_loop(spark):
    random.seed(3)
    rows = [(q, random.choice([None, "a", "b", "c"]), r) for q in range(6) for r in range(1, random.randint(2, 9))]
    got = search.limit_with_coverage(spark.createDataFrame(rows, "query_id int, document_id string, rank int"), 4)
    have: dict = {}
    for r in got.orderBy("query_id", "selected_rank").collect():
        have.setdefault(r["query_id"], []).append(r["rank"])
    for q in {x[0] for x in rows}:
        items = [x for x in rows if x[0] == q]
        if len(items) <= 4:
            want = [x[2] for x in items]
        else:
            seen, first, rest = set(), [], []
            for x in items:
                (first if x[1] and x[1] not in seen else rest).append(x[2])
                seen.add(x[1])
            want = (first + rest)[:4]
        assert have[q] == want


def test_metadata_clear_opens_field(spark):
    rows = [(1, "title", "A", "user", 1.0, 1), (1, "title", "", "user", 1.0, 2), (1, "title", "B", "legacy", 2.0, 3), (2, "title", "C", "manifest", 0.5, 1), (2, "title", "D", "parser", 0.5, 2)]
    obs = spark.createDataFrame(rows, "doc_id int, field string, value string, source string, confidence double, seq int")
    assert {r["doc_id"]: (r["value"], r["confidence"]) for r in identity.merge_metadata(obs).collect()} == {1: ("B", 1.0), 2: ("C", 0.5)}


def test_table_cell(spark):
    cells = spark.createDataFrame([("保险统计 2024", "全国合计", "原保险保费收入", 2024, 1, "亿元", "123.45", "C5", 123.45)], "source_title string, row_label string, column_label string, year int, quarter int, unit string, value string, coordinate string, numeric_value double")
    q = spark.createDataFrame([(1, "保险统计", 2024, 1, "全国合计", "原保险保费收入")], "question_id int, asked_source string, asked_year int, asked_quarter int, asked_row string, asked_column string")
    got = tables.table_lookup(tables.score_cells(tables.cell_candidates(q, cells))).first()
    assert (got["status"], got["value"], got["coordinate"]) == ("valid_cell", "123.45", "C5")
    assert one(spark, tables.display_value(F.col("a").cast("decimal(38,10)"), F.lit(2)), a="2.345") == "2.35"


def test_html_and_text_blocks(spark):
    html = "<html><title>T</title><script>no</script><h2>Head</h2><p>a <b>b</b></p><table><tr><td>1</td><td>2</td></tr></table>"
    got = documents.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()
    assert [(r["block_type"], r["text"], r["section_title"]) for r in got] == [("heading", "Head", "Head"), ("paragraph", "a b", "Head"), ("table", "| 1 | 2 |", "Head")]
    md = spark.createDataFrame([("d", "# One\ntext\nmore\n\n| a | b |\n| 1 | 2 |\n## Two\nend")], "doc_id string, text string")
    rows = documents.to_blocks(md).orderBy("order_index").collect()
    assert [(r["block_type"], r["level"]) for r in rows] == [("heading", 1), ("paragraph", None), ("table", None), ("heading", 2), ("paragraph", None)]
    assert rows[1]["text"] == "text\nmore" and rows[4]["section_title"] == "Two"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("名称,,值\n甲,x,\"12%\"\n")
    got = documents.csv_cells(spark, str(tmp_path / "a.csv")).orderBy("coordinate").collect()
    assert [(r["column_label"], r["row_label"], r["numeric_value"]) for r in got] == [("名称", "甲", None), ("列2", "甲", None), ("值", "甲", 0.12)]
    (tmp_path / "b.jsonl").write_text('{"text": "hello", "title": "t", "k": 1}\n{"title": "x"}\nnot json\n')
    good, bad = documents.read_jsonl(spark, str(tmp_path / "b.jsonl"))
    assert [r["body"] for r in good.collect()] == ["hello"] and bad.count() == 2
    (tmp_path / "m.json").write_text('{"files": [{"name": "a"}, {"name": "b"}]}')
    assert documents.read_manifest(spark, str(tmp_path / "m.json"), "json").count() == 2


def test_indexes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string")
    new = spark.createDataFrame([(2, "c")], "doc_id int, v string")
    assert sorted(map(tuple, indexes.replace_by_key(old, new, "doc_id").collect())) == [(1, "a"), (2, "c")]
    assert indexes.copy_verified(old, str(tmp_path / "copy")) == (2, 0)


def test_ratio_guards(spark):
    q = spark.createDataFrame([(1, "ratio"), (2, "sum")], "question_id int, operation string").withColumn("selectors", F.array(F.lit("a"), F.lit("b")))
    ops = spark.createDataFrame([(1, 0, "t", "x", "1"), (1, 1, "t", "x", "0"), (2, 0, "t", "x", "1"), (2, 1, "t", "y", "2")], "question_id int, pos int, source_title string, unit string, operand string").withColumn("operand", F.col("operand").cast("decimal(38,10)"))
    assert {r["question_id"]: r["status"] for r in tables.calculate(q, ops).collect()} == {1: "zero_denominator", 2: "mixed_units"}


def test_holdout_exact(spark):
    cases = spark.range(300).select(F.col("id").alias("case_id"), (F.col("id") % 7).alias("s"))
    assert evaluation.split_holdout(cases, ["s"], 60).filter("holdout").count() == 60


def event_rows():
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=m), "k", "doc", None, "info", d) for i, (m, d) in enumerate([(0, "a"), (10, ""), (15, "b"), (40, "c")])]
    return rows, "event_id long, ts timestamp, event_key string, target_type string, target_id string, severity string, detail string"


def test_sessions_batch_and_windowed(spark):
    rows, schema = event_rows()
    df = spark.createDataFrame(rows, schema)
    want = [(3, "b"), (1, "c")]
    assert sorted([(r["occurrences"], r["detail"]) for r in events.aggregate_events(df).collect()], reverse=True) == want
    got = events.aggregate_events_windowed(df.withColumn("resolved", F.lit(False)))
    assert sorted([(r["occurrences"], r["detail"]) for r in got.collect()], reverse=True) == want


def test_sessions_stream_equals_batch(spark, tmp_path):
    rows, schema = event_rows()
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    late = spark.createDataFrame([(99, dt.datetime(2024, 1, 2), "z", "doc", None, "info", "z")], schema)
    q = events.aggregate_events(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e")), watermark="10 minutes").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    q.processAllAvailable()
    q.stop()
    got = sorted((r["occurrences"], r["detail"]) for r in spark.table("sessions").filter("event_key = 'k'").collect())
    assert got == sorted((r["occurrences"], r["detail"]) for r in events.aggregate_events(df).collect())


def test_spans_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, i, t0 + dt.timedelta(seconds=10 * i), s) for k in (1, 2) for i, s in enumerate(["end", "start", "start", "end", "end", "start"])]
    df = spark.createDataFrame(rows, "user long, n int, ts timestamp, kind string")
    batch = events.stage_spans(df, "user", "ts", "n", F.col("kind") == "start", F.col("kind") == "end")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = events.stage_spans_stream(stream, "user", "long", "ts", "kind", "start", "end").writeStream.format("memory").queryName("spans").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("spans").collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 2


def test_options_and_triage(spark):
    from evidence_spark.operators import evidence

    q = spark.createDataFrame([(1, "哪项正确？ A. 甲方 B. 乙方 C. 丙方"), (2, "没有选项")], "id int, question string")
    got = evidence.extract_options(q).orderBy("pos").collect()
    assert [(r["label"], r["option"]) for r in got] == [("A", "甲方"), ("B", "乙方"), ("C", "丙方")] and got[0]["stem"] == "哪项正确？"
    assert one(spark, evidence.triage(F.col("a")), a="请预测明年保费") == "prediction" and one(spark, evidence.triage(F.col("a")), a="《预测办法》第三条") == "none"


def test_percent_counts_as_ratio(spark):
    from evidence_spark.operators import evidence

    claims = spark.createDataFrame([(1, "占比 12.5% ，共 40 家")], "id int, claim string")
    cited = spark.createDataFrame([(1, "比例 0.125"), (1, "41 家")], "id int, text string")
    assert [r["number"] for r in evidence.unsupported_numbers(claims, cited, ["id"]).collect()] == ["40"]


def test_spans_stream_waits_for_late_rows(spark, tmp_path):
    """A late start, written after its end, pairs as in the batch job; a start without end leaves the state."""
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    files = [[(1, at(5), "end"), (2, at(1), "start")], [(1, at(2), "start"), (2, at(4), "end")], [(3, at(40), "start")], [(3, at(90), "start")]]
    shape = "user long, ts timestamp, kind string"
    folder = str(tmp_path / "in")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder) if i else spark.createDataFrame(rows, shape).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)
    q = events.stage_spans_stream(stream, "user", "long", "ts", "kind", "start", "end", delay="10 minutes").writeStream.format("memory").queryName("late_spans").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["user"], r["started"], r["ended"], r["seconds"]) for r in spark.table("late_spans").collect()}
    assert got == {(1, at(2), at(5), 180.0), (2, at(1), at(4), 180.0)}


def test_overlap_takes_whole_sentences_from_the_piece_before(spark):
    """The longest run of last sentences within the overlap goes ahead, unless the piece grows too long."""
    rows = [("a", 0, "一。二二。三三三。"), ("a", 1, "新的内容。"), ("a", 2, "很长" * 8), ("a", 3, "尾。"), ("b", 0, "甲乙丙丁戊己庚。"), ("b", 1, "后。"), ("c", 0, None), ("c", 1, "独。")]
    df = spark.createDataFrame(rows, "d string, pos int, piece string")
    got = {(r["d"], r["pos"]): r["overlapped"] for r in chunking.add_overlap(df, "d", overlap=7, max_tokens=20).collect()}
    assert got == {
        ("a", 0): "一。二二。三三三。", ("a", 1): "二二。三三三。\n\n新的内容。", ("a", 2): "很长" * 8, ("a", 3): "尾。", ("b", 0): "甲乙丙丁戊己庚。", ("b", 1): "后。", ("c", 0): None, ("c", 1): "独。",
    }


def test_packed_sentences_with_overlap_against_a_loop(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    units = chunking.split_sentences(docs).select("doc_id", "pos", "sentence")
    pieces = chunking.add_overlap(chunking.pack_units(units, "doc_id", "pos", "sentence"), "doc_id").select("doc_id", "pos", "piece", "overlapped").collect()
    count = lambda t: len(re.findall(r"[一-鿿]|[a-zA-Z0-9_]+|[^\s]", t or ""))
    by = {(r["doc_id"], r["pos"]): r for r in pieces}
    assert len(pieces) > 200
    for (d, p), r in by.items():
        before, tail = by.get((d, p - 1)), ""
        for s in reversed([s.strip(" ") for s in re.findall(chunking.SENTENCE, before["piece"], re.S) if s.strip(" ")] if before else []):
            if count(s + tail) > chunking.OVERLAP:
                break
            tail = s + tail
        joined = f"{tail.strip(' ')}\n\n{r['piece']}" if tail.strip(" ") else r["piece"]
        assert r["overlapped"] == (r["piece"] if count(joined) > chunking.SIZE else joined)


def test_trace_summary_tells_invalid_excerpts(spark):
    chunks = spark.createDataFrame([("a", "资本 充足率", "indexed"), ("b", "其他", "table_indexed"), ("c", "旧文", "failed"), ("d", None, "indexed")], "chunk_id string, text string, status string")
    rows = [(1, 1, "a", "资本充足", "text"), (1, 2, "b", "没有", "text"), (1, 3, "b", "没有", "calculation"), (1, 4, "c", "旧文", "text"), (1, 5, "x", "旧文", "calculation"), (2, 1, "d", "无", "text"), (3, 1, "a", "见：资本 充足率。", "text")]
    e = spark.createDataFrame(rows, "question_id int, rank int, chunk_id string, excerpt string, kind string")
    got = {r["question_id"]: tuple(r)[1:] for r in evidence.trace_summary(e, chunks).collect()}
    assert got == {1: (5, 2, 3, ["b", "c", "x"]), 2: (1, 0, 1, ["d"]), 3: (1, 1, 0, [])}
    assert sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in evidence.trace_evidence(e, chunks).collect()) == [(1, 1, "a"), (1, 2, "b"), (3, 1, "a")]
