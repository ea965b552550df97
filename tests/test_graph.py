"""Neighbours as a graph against a loop, and support of stated entities."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidence_spark.operators import graph, grounding


def plain_graph(hits, chunks, refs, clauses, terms):
    """hits in rank order: (chunk, plain); terms: words of the question."""
    place = {c[2]: c for c in chunks}
    number = lambda c: (m := re.match(graph.NUMBERED, c[3] or "")) and m[1]
    kept, seen = [], set()
    for chunk, plain in hits:
        if plain or chunk not in seen:
            kept.append((chunk, None))
            seen.add(chunk)
        else:
            continue
        if plain:
            continue
        doc = sorted((c for c in chunks if c[0] == place[chunk][0]), key=lambda c: (c[1], c[2]))
        mine, found = number(place[chunk]), []
        if mine and "." not in mine:
            found += [(c[2], "child_section") for c in doc if (number(c) or "").startswith(mine + ".")]
        if mine and "." in mine:
            found += [(c[2], "parent_section") for c in doc if number(c) == mine.rsplit(".", 1)[0]]
        found += [(t, f"referenced_{k}") for s, t, k, _ in sorted(refs, key=lambda r: (r[3], r[1])) if s == chunk]
        at = [c[2] for c in doc].index(chunk)
        found += [(doc[at - 1][2], "previous_chunk")] if at else []
        found += [(doc[at + 1][2], "next_chunk")] if at + 1 < len(doc) else []
        rated = []
        for to, reason in found:
            text = "\n".join(x for x in (place[to][3], place[to][4]) if x)
            score = sum(t in text for t in terms) / len(terms)
            score += {"previous_chunk": -0.05, "next_chunk": -0.05}.get(reason, 0.1 if reason.startswith("referenced_") else 0)
            if to != chunk and (score > 0 or reason in ("child_section", "parent_section")):
                rated.append((to, reason, round(score, 9)))
        rated.sort(key=lambda x: (x[1].startswith("referenced_"), x[2], x[1] in ("child_section", "parent_section")), reverse=True)
        options = list(dict.fromkeys(t for t, *_ in rated))
        why = {}
        for t, r, _ in rated:
            why.setdefault(t, r)
        options = [(t, why[t]) for t in options] + [(t, "cross_document_referenced_clause") for s, t, _ in sorted(clauses, key=lambda r: (r[2], r[1])) if s == chunk]
        new = 0
        for to, reason in options:
            if to not in seen and new < 2:
                kept.append((to, reason))
                seen.add(to)
                new += 1
    return kept[:36]


def test_graph_equals_a_loop(spark):
    rng = random.Random(4)
    words = ["资本充足", "流动性", "风险", "监管", "披露"]
    chunks = [(f"D{d}", p, f"D{d}-{p:02d}", rng.choice(["1. 总则", "1.1 范围", "1.2 定义", "2. 要求", "2.1.1 细则", "2.1 条件", None, "附则"]), "".join(rng.sample(words, rng.randint(0, 3)))) for d in range(8) for p in range(12)]
    ids = [c[2] for c in chunks]
    refs = sorted({(s, t): (s, t, rng.choice(["clause", "table"]), n) for n, (s, t) in enumerate((rng.choice(ids), rng.choice(ids)) for _ in range(60)) if s[:2] == t[:2]}.values())
    clauses = sorted({(rng.choice(ids), rng.choice(ids), n) for n in range(40)})
    clauses = [c for c in clauses if c[0][:2] != c[1][:2]]
    hits, want = [], {}
    for q in range(40):
        asked = rng.sample(words, 2)
        mine = [(c, rng.random() < 0.1) for c in rng.sample(ids, rng.choice([1, 5, 14]))]
        hits += [(q, "“" + "”“".join(asked) + "”", c, r, p) for r, (c, p) in enumerate(mine)]
        want[q] = (mine, asked)
    terms = {r["question"]: r["t"] for r in spark.createDataFrame([(h[1],) for h in hits], "question string").select("question", graph.question_terms(F.col("question")).alias("t")).collect()}
    asked = {h[0]: terms[h[1]] for h in hits}
    out = graph.expand_graph(
        spark.createDataFrame(hits, "question_id int, question string, chunk_id string, rank int, plain boolean"), spark.createDataFrame(chunks, "document_id string, pos int, chunk_id string, section_title string, text string"),
        spark.createDataFrame(refs, "chunk_id string, to_id string, kind string, turn int"), spark.createDataFrame(clauses, "chunk_id string, to_id string, turn int"),
    )
    got = {}
    for r in out.orderBy("question_id", "pick").collect():
        got.setdefault(r["question_id"], []).append((r["chunk_id"], r["reason"]))
    assert got == {q: plain_graph(mine, chunks, refs, clauses, asked[q]) for q, (mine, _) in want.items()}
    assert {r for v in got.values() for _, r in v} >= {None, "child_section", "parent_section", "next_chunk", "referenced_clause", "cross_document_referenced_clause"} and max(map(len, got.values())) == 36


@pytest.mark.parametrize(
    ("claim", "cited", "missing"),
    [
        ("2023年3月的余额为8234.54亿元[1]", ["余额 8234.537443（2023-03）"], []),
        ("拨备覆盖率为10.997%", ["0.10997"], []), ("比例为0.15", ["15.2%"], [("0.15", "number")]), ("比例为0.15", ["15%"], []), ("增长283.7%", ["283.7 单位%"], []),
        ("期限为1年，20万元", ["期限为1年"], [("20", "number")]), ("（1）符合规定\n2. 应当备案", ["无"], []), ("2023年3季度增加", ["2023年度"], []), ("第三季度末", ["无"], []), ("2022年增加", ["2023年"], [("2022年", "date")]),
        ("严格遵守财会〔2022〕39号", ["《通知》（财会[2022]39号）"], []), ("银保监〔2021〕7号", ["无"], [("银保监〔2021〕7号", "document_number")]),
        ("经董事会批准，向银保监局报告", ["董事会应当批准"], [("银保监局", "actor")]), ("下降-3.5%", ["－3.5％"], []), ("金额5", [], [("5", "number")]), (None, ["x"], []), ("", [], []),
    ],
)
def test_entities_are_supported(spark, claim, cited, missing):
    claims = spark.createDataFrame([(1, claim)], "claim_id int, claim string")
    texts = spark.createDataFrame([(1, t) for t in cited], "claim_id int, text string")
    assert sorted((r["entity"], r["kind"]) for r in grounding.unsupported_entities(claims, texts, ["claim_id"]).collect()) == sorted(missing)


def test_statements_are_read_once_before_they_meet_numbers(spark):
    """Read within the search through the evidence's numbers, a statement was read once more for each of them."""
    claims = spark.createDataFrame([(1, "比例12.5%")], "claim_id int, claim string")
    out = grounding.unsupported_entities(claims, claims.select("claim_id", F.col("claim").alias("text")), ["claim_id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    held = next(line for line in plan.split("\n") if "exists(" in line)
    assert "regexp_extract(" not in held and "regexp_replace(" not in held
