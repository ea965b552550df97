"""Steps whose work must not grow faster than their input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidence_spark.operators import context, joins, scoring, spreadsheets, support
from evidence_spark.plans import context as context_plans
from evidence_spark.plans import relational, retrieval, rules


@pytest.mark.parametrize("few", [0, 256])
def test_containment_of_needles_of_all_lengths(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW", few)
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "abc" * 20]
    needles = [t[i : i + size] for t in texts if t for size in (1, 3, 4, 7, 8, 15, 16, 31, 32, 40) for i in [rng.randint(0, 9)]][:150] + ["", None, "b" * 50]
    n = spark.createDataFrame(list(enumerate(needles)), "i int, n string")
    t = spark.createDataFrame(list(enumerate(texts)), "j int, t string")
    want = sorted((i, j) for i, a in enumerate(needles) for j, b in enumerate(texts) if a and b is not None and a in b)
    assert sorted((r["i"], r["j"]) for r in joins.contained(n, "n", t, "t").collect()) == want


def test_numbered_names_draw_no_pairs_but_their_own(spark, monkeypatch):
    """By runs of 4 characters every name would meet those that share some digits."""
    written, kept = [], joins.kept
    monkeypatch.setattr(joins, "kept", lambda df: written.append(kept(df)) or written[-1])
    names = spark.range(3000).selectExpr("id as i", "concat('rule no ', lpad(id, 7, '0'), ' of parts') as n")
    texts = spark.range(3000).selectExpr("id as j", "concat('the rule no ', lpad(id, 7, '0'), ' of parts and tools') as t")
    assert joins.contained(names, "n", texts, "t").filter("i = j").count() == 3000
    pairs = [df for df in written if set(df.columns) == {"_tid", "_nid"}]
    assert len(pairs) == 1 and pairs[0].count() == 3000


def test_runs_are_hashed_alike_on_both_sides_and_only_wanted_ones_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_HELD", 50)
    texts = ["abcabcabcd", "中文字符中文字符", "a😀b😀a😀b", "", "xy", "".join(random.Random(3).choice("abc") for _ in range(400))]
    df = spark.createDataFrame([(i, t, min(max(len(t), 1), 4)) for i, t in enumerate(texts)], "i long, t string, n int")
    rows = lambda out: sorted((r["i"], r["_g"]) for r in out.collect())
    whole = rows(joins.run_hashes(df, "i", "t", [2, 4]))
    runs = {(i, t[k : k + n]) for i, t in enumerate(texts) for n in (2, 4) for k in range(len(t) - n + 1)}
    assert len(whole) == len(set(whole)) == len(runs)
    own = rows(joins.run_hashes(df.filter("n = 4"), "i", "t", [], "n"))
    assert len(own) == len({(i, x) for i, x in runs if len(x) == 4}) and set(own) <= set(whole)
    some = sorted({g for i, g in whole if i == 1})
    assert rows(joins.run_hashes(df, "i", "t", [2, 4], only=some)) == [(i, g) for i, g in whole if g in some]


@pytest.mark.parametrize("lot", [1, 7, 1 << 16])
def test_runs_of_texts_that_are_hashed_together_end_with_their_text(spark, monkeypatch, lot):
    monkeypatch.setattr(joins, "LOT", lot)
    texts = ["abab", "", "bab", "a", "😀bab", "abab", "", "cabab" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    rows = [(r["i"], r["_g"]) for r in joins.run_hashes(df, "i", "t", [2, 3, 8]).collect()]
    assert len(rows) == len(set(rows)) == len({(i, t[k : k + n]) for i, t in enumerate(texts) for n in (2, 3, 8) for k in range(len(t) - n + 1)})
    assert {g for i, g in rows if i == 0} == {g for i, g in rows if i == 5}


def test_containment_beyond_the_runs_that_are_sent(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW", 0)
    monkeypatch.setattr(joins, "MOST_WANTED", 3)
    n = spark.createDataFrame([(i, f"no {i:04d} of") for i in range(40)], "i int, n string")
    t = spark.createDataFrame([(j, f"the no {j:04d} of all") for j in range(0, 60, 2)], "j int, t string")
    assert sorted((r["i"], r["j"]) for r in joins.contained(n, "n", t, "t").collect()) == [(i, i) for i in range(0, 40, 2)]


@pytest.mark.parametrize("most", [0, 4096])
@pytest.mark.parametrize("pairs", [5, 4_000_000])
def test_pairs_of_lists_equal_a_join(spark, monkeypatch, most, pairs):
    for name, value in (("LISTED", 3), ("INNER", 2), ("GROUPED", 7), ("MOST_LISTS", most), ("DEALS", 4), ("TASK_PAIRS", pairs)):
        monkeypatch.setattr(joins, name, value)
    rng = random.Random(5)
    some = [(rng.choice("aaaabcd"), i, f"c{i}" if i % 5 else None) for i in range(60)]
    others = [(rng.choice("aaaabcef"), i) for i in range(50)]
    a, b = spark.createDataFrame(some, "k string, c long, t string"), spark.createDataFrame(others, "k string, q long")
    key = lambda r: (r[0], r[1], r[3])
    got = [(r["k"], r["c"], r["t"], r["q"]) for r in joins.paired(a, b, "k").collect()]
    assert sorted(got, key=key) == sorted(((k, c, t, q) for k, c, t in some for x, q in others if k == x), key=key)
    assert joins.paired(a, b.limit(0), "k").count() == 0 == joins.paired(a.limit(0), b, "k").count()


def test_many_questions_with_many_definitions_take_little_disk(spark, tmp_path):
    """The rows are questions times chunks by definition; in their order a file holds one in a few bits."""
    asks = spark.range(20000).selectExpr("id as question_id", "'“甲乙”是什么' as question")
    chunks = spark.range(200).selectExpr("0L as doc_id", "id as chunk_id", "id as pos", "cast(null as string) as section_title", "'无' as text")
    known = chunks.selectExpr("'甲乙' as term_norm", "chunk_id")
    path = tmp_path / "rows"
    support.definition_support(asks, chunks, asks.selectExpr("question_id", "0L as doc_id").limit(0), known).write.parquet(f"file://{path}")
    rows = spark.read.parquet(f"file://{path}")
    assert rows.count() == rows.select("question_id", "chunk_id").distinct().count() == 20000 * 200
    assert sum(p.stat().st_size for p in path.glob("*.parquet")) < 0.5 * 20000 * 200


def test_cells_are_made_once_for_a_lookup(spark):
    """What cells are counted from is read once, not again for titles, labels and each question's cells."""
    made = spark.sparkContext.accumulator(0)

    def say(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    kinds = "document_id string, source_title string, sheet_name string, row_label string, column_label string, coordinate string, value string, numeric_value double, unit string, year int"
    cells = spark.createDataFrame([("d", "收入表", "Sheet1", "甲", "金额", "A1", "5", 5.0, "元", 2024), ("d", "收入表", "Sheet1", "乙", "金额", "A2", "7", 7.0, "元", 2024)], kinds).mapInArrow(say, kinds)
    asked = spark.createDataFrame([(1, "收入表", "甲", "金额")], "question_id int, asked_source string, asked_row string, asked_column string")
    assert [r["value"] for r in spreadsheets.lookup_answers(asked, cells).collect()] == ["5"]
    assert made.value == 2


SF = "/root/testdata/sf0.001"


def shuffles(df) -> list[tuple[str, str]]:
    """The columns that each shuffle of a plan deals by, and what it is made for."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?)\), (\w+)", plan)


def test_words_are_counted_where_documents_are_cut(spark, monkeypatch):
    """Tasks of so many documents; no words travel by chunk."""
    monkeypatch.setattr(retrieval, "TASK_CHUNKS", 50)
    made = shuffles(retrieval.term_postings(spark, SF))
    assert [kind for by, kind in made if "doc_id" in by] == ["REPARTITION_BY_NUM"]
    assert not [by for by, _ in made if "chunk_id" in by]


@pytest.mark.parametrize("query", [rules.inferred_scores, relational.metadata_audit])
def test_lines_are_dealt_once_so_many_to_a_task(spark, monkeypatch, query):
    monkeypatch.setattr(joins, "TASK_ROWS", 1000)
    assert {kind for _, kind in shuffles(query(spark, SF))} == {"REPARTITION_BY_NUM"}


def sent(df) -> int:
    """How many tables a plan sends to every task by way of the driver."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_chunks_of_units_are_not_sent_by_the_driver(spark, monkeypatch):
    """Written tables look as small as their files; only what was counted before may be sent."""
    monkeypatch.setattr(context, "checked_broadcast", lambda df, merge: df.hint("merge"), raising=False)
    assert sent(context_plans.source_units(spark, SF)) == 0


def test_units_and_costs_of_a_budget_are_not_sent_by_the_driver(spark, monkeypatch):
    monkeypatch.setattr(context, "checked_broadcast", lambda df, merge: df.hint("merge"), raising=False)
    c = joins.kept(context_plans.lines(spark, SF))
    anchors = c.selectExpr("l_orderkey as question_id", "chunk_id", "pos as rank", "array('t') as tags")
    units = c.selectExpr("l_orderkey as question_id", "chunk_id as anchor_id", "chunk_id", "pos as place", "false as unit_incomplete")
    assert sent(context.unit_budget(units, anchors, c)) == 0 == sent(context_plans.unit_budget(spark, SF))


def test_names_lose_the_same_marks_whether_ascii_or_not(spark):
    texts = ["A b-c_d.PDF", "《甲.pdf》", "甲、乙·丙；（丁）.docx", "x.md》", "“q”: 'r' (s)\t\n", "é.x l.csv", "", None, "。.txt", "a.pdf.pdf", "—-–"]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(scoring._file_plain(F.col("t")).alias("p")).collect()]

    def plain(t):
        t = re.sub("[《》]", "", (t or "").lower())
        t = re.sub(r"\.(?:pdf|docx?|xlsx?|xls|csv|txt|md)$", "", t)
        return re.sub(r"[ \t\n\x0b\f\r·•、，,。.;；:：()（）\"'“”‘’\-_]+", "", t)

    assert got == [plain(t) for t in texts]


def test_marks_beyond_ascii_are_only_looked_for_where_there_may_be_some(spark):
    plan = spark.range(1).select(scoring._file_plain(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("octet_length") + plan.count("octetlength") >= 2, plan
