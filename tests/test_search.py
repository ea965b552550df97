"""Sparse and dense search against plain loops: classes of common tokens, filters inside the search, odd vectors."""

import random

import pytest
from pyspark.sql import functions as F

from evidence_spark.functions.text import join_units
from evidence_spark.operators import chunking, search


def corpus(rng, negative):
    weight = lambda: rng.choice([0.5, 1.0, 2.0, 3.5]) * (-1 if negative and rng.random() < 0.3 else 1)
    tokens = ["a"] * 8 + ["b"] * 4 + ["c", "d"] * 2 + [f"r{i}" for i in range(30)]
    chunks = [(f"c{i:03d}", t, weight()) for i in range(220) for t in sorted({rng.choice(tokens) for _ in range(5)})]
    queries = [(i, t, weight() * (20 if t.startswith("r") else 1)) for i in range(40) for t in sorted({rng.choice(tokens) for _ in range(4)})]
    return chunks, queries


def plain_sparse(chunks, queries, k, allowed):
    out = {}
    by = {}
    for c, t, w in chunks:
        by.setdefault(c, {})[t] = w
    for q in {q for q, *_ in queries}:
        asked = {t: w for x, t, w in queries if x == q}
        scores = [(-round(sum(w * by[c][t] for t, w in asked.items() if t in by[c]), 9), c) for c in by if asked.keys() & by[c].keys() and allowed(q, c)]
        out[q] = sorted(scores)[:k]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("negative", [False, True])
@pytest.mark.parametrize("common", [1, 8, 10_000])
def test_sparse_search_by_classes_of_tokens(spark, negative, common):
    chunks, queries = corpus(random.Random(common + negative), negative)
    got = {}
    out = search.sparse_topk(spark.createDataFrame(queries, "query_id int, token string, weight double"), spark.createDataFrame(chunks, "chunk_id string, token string, weight double"), 3, common=common)
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["chunk_id"]))
    assert got == plain_sparse(chunks, queries, 3, lambda q, c: True)


WANTS = [(0, None, None, None), (1, ["d1", "d2"], None, None), (2, [], None, None), (3, None, 2024, ""), (4, ["d0"], None, "active"), (5, None, 1999, None)]


def fits(q, c):
    want = {w[0]: w[1:] for w in WANTS}.get(q)
    i = int(c[1:])
    return want is None or ((want[0] is None or f"d{i % 4}" in want[0]) and (want[1] is None or 2023 + i % 2 == want[1]) and (want[2] in (None, "") or ("active" if i % 3 else "old") == want[2]))


@pytest.fixture(scope="module")
def sides(spark):
    filters = spark.createDataFrame(WANTS, "query_id int, document_ids array<string>, year int, version_status string")
    chunks = spark.createDataFrame([(f"c{i:03d}", f"d{i % 4}", 2023 + i % 2, "active" if i % 3 else "old") for i in range(220)], "chunk_id string, document_id string, year int, version_status string")
    return filters, chunks


def test_filters_leave_k_results_of_a_sparse_search(spark, sides):
    chunks, queries = corpus(random.Random(9), False)
    allow = search.filtered(*sides)
    out = search.sparse_topk(spark.createDataFrame(queries, "query_id int, token string, weight double"), spark.createDataFrame(chunks, "chunk_id string, token string, weight double"), 5, common=4, allow=allow)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["chunk_id"]))
    assert got == plain_sparse(chunks, queries, 5, fits) and 2 not in got and 5 not in got


def test_filters_and_lengths_in_a_dense_search(spark, sides, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 50)
    rng = random.Random(2)
    vector = lambda n: [rng.choice([-1.0, 0.5, 0.0, 2.0]) for _ in range(n)]
    vectors = [(f"c{i:03d}", vector(4 if i % 7 else 6)) for i in range(218)] + [("c218", None), ("c219", [])]
    queries = [(i, vector(4)) for i in range(8)] + [(8, vector(6)), (9, None), (10, vector(3))]
    schema = "id {}, vector array<double>"
    out = search.dense_topk(
        spark.createDataFrame(queries, schema.format("int")).withColumnRenamed("id", "query_id"), spark.createDataFrame(vectors, schema.format("string")).withColumnRenamed("id", "chunk_id"), 4, filters=sides[0], chunks=sides[1]
    )
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["chunk_id"]))
    want = {q: sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in vectors if w and v and len(w) == len(v) and fits(q, c))[:4] for q, v in queries}
    assert got == {q: v for q, v in want.items() if v}


def test_filters_by_any_of_a_fields_names(spark):
    meta = lambda **x: x
    candidates = [
        (1, "a", meta(title="商业银行资本管理办法（2023年版）", version_status="active", source_format="pdf"), "x_1.pdf", "3.1"), (1, "b", meta(source_title="商业银行 资本-管理办法"), None, None), (1, "c", None, "商业银行_资本管理办法.docx", None),
        (1, "d", meta(title="流动性办法", version_status="inactive"), None, None), (2, "a", meta(article_number="第十条"), None, None), (2, "b", meta(), None, "第十条"), (2, "c", meta(article_number=None), None, None), (3, "z", None, None, None),
        (4, "a", meta(version_status="active"), None, None), (4, "b", meta(version_status="active2"), None, None), (5, "a", meta(title="如何计算"), None, None),
    ]
    filters = [(1, "source_title", "商业银行资本管理办法"), (1, "issuing_authority", ""), (1, "no_such_field", "x"), (2, "article_number", "第十条"), (3, "source_title", None), (4, "version_status", "active"), (4, "version_status", "active"), (5, "filename", "x"), (5, "source_title", "怎样计算")]
    out = search.filter_by_fields(
        spark.createDataFrame(candidates, "query_id int, chunk_id string, metadata map<string,string>, filename string, section_number string"), spark.createDataFrame(filters, "query_id int, field string, wanted string")
    )
    assert sorted((r["query_id"], r["chunk_id"]) for r in out.collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "z"), (4, "a")]
    assert out.columns == ["query_id", "chunk_id", "metadata", "filename", "section_number"]


def test_words_of_few_questions_meet_postings_in_one_pass(spark, sides, monkeypatch):
    """Nothing is written and only the postings of asked words are scored; beyond ASKED words, classes are read."""
    chunks, queries = corpus(random.Random(10), True)
    written, kept = [], search.kept
    monkeypatch.setattr(search, "kept", lambda df: written.append(1) or kept(df))
    p, q = spark.createDataFrame(chunks, "chunk_id string, token string, weight double"), spark.createDataFrame(queries, "query_id int, token string, weight double")
    read = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    for allow, seen in ((None, lambda q, c: True), (search.filtered(*sides), fits)):
        want = sorted((q, i + 1, c, -s) for q, rows in plain_sparse(chunks, queries, 5, seen).items() for i, (s, c) in enumerate(rows))
        assert read(search.sparse_topk(q, p, 5, allow=allow)) == want and not written
        with monkeypatch.context() as m:
            m.setattr(search, "ASKED", len(queries) - 1)
            assert read(search.sparse_topk(q, p, 5, allow=allow)) == want and written
        written.clear()


def test_postings_of_asked_words(spark):
    df = spark.createDataFrame([(1, "a b a c"), (1, "A x"), (2, None), (3, "c")], "k int, t string")
    only = spark.createDataFrame([("a",), ("a",), ("c",)], "token string")
    all_ = {(r["k"], r["token"]): r["weight"] for r in chunking.postings(df, "k", F.col("t")).collect()}
    assert {(r["k"], r["token"]): r["weight"] for r in chunking.postings(df, "k", F.col("t"), only=only).collect()} == {x: w for x, w in all_.items() if x[1] in "ac"} and len(all_) == 5


def test_units_are_joined_as_words_and_letters(spark):
    units = [["a", "b1", "，", "_c", "中", "d", "e", "é", "f", "."], ["a"], [], ["\x00", "a", "b", "\x85", "c"]]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u array<string>").orderBy("i").select(join_units(F.col("u"))).collect()]
    assert got == ["a b1，_c中d eéf.", "a", "", "\x00a b\x85c"]


def test_candidates_meet_all_filters_of_their_query_each_row_by_itself(spark):
    """A candidate given twice stays twice: its filters are not counted over its copies."""
    cand = [(1, "a", {"type": "X", "name": "A Ring"}), (1, "a", {"type": "X", "name": "A Ring"}), (1, "b", {"type": "Y", "name": "ring"}), (1, "c", {"type": "X"}), (1, "d", None), (2, "e", None), (3, "f", {"type": None}), (4, "g", {"type": "X"})]
    filters = [(1, "type", "exact", "X"), (1, "name", "contains", "RING"), (3, "type", "exact", "X"), (4, None, "exact", "X")]
    got = search.filter_metadata(spark.createDataFrame(cand, "query_id int, chunk_id string, metadata map<string,string>"), spark.createDataFrame(filters, "query_id int, field string, mode string, wanted string"))
    assert sorted((r["query_id"], r["chunk_id"]) for r in got.collect()) == [(1, "a"), (1, "a"), (2, "e")]
