"""Near matches of gold passages against all pairs, and gold cells of stated cases."""

import random
import re

from evidence_spark.operators import gold


def plain(text):
    return re.sub(gold.DROPPED, "", re.sub(gold.SUFFIX, "", (text or "").lower().replace("《", "").replace("》", "")))


def probes(t):
    if len(t) <= 8:
        return [t] if t else []
    step = max(1, (len(t) - 8) // 3)
    return [t[i * step : i * step + 8] for i in range(4) if len(t[i * step : i * step + 8]) >= 4]


def grams(t):
    return {t[i : i + 2] for i in range(len(t) - 1)}


def share(p, c):
    return len(grams(p) & grams(c)) / len(grams(p)) if grams(p) else 0


def pairs(passages, chunks):
    out = set()
    for key, doc, text in passages:
        p = plain(text)
        found = {(key, c, "anywhere") for c, _, t in chunks if plain(t) and any(w in plain(t) for w in probes(p)) and share(p, plain(t)) >= 0.7}
        if p and not found and doc is not None:
            found = {(key, c, "named") for c, d, t in chunks if d == doc and plain(t) and (p in plain(t) or (plain(t) in p and len(plain(t)) >= 20) or share(p, plain(t)) >= 0.55)}
        out |= found
    return out


def test_passages_equal_all_pairs(spark):
    rng = random.Random(8)
    letters = "商业银行资本充足率不得低于监管要求的百分之八应当建立风险管理制度"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    chunks = [(f"c{i}", f"d{i % 6}", text(rng.choice([0, 3, 30, 120]))) for i in range(80)] + [("n", None, None)]
    passages = []
    for k in range(90):
        source = rng.choice(chunks)[2] or text(12)
        at = rng.randrange(max(1, len(source) - 5))
        part = source[at : at + rng.choice([1, 6, 9, 25, 60])]
        for _ in range(rng.choice([0, 0, 1, 4, 9])):
            i = rng.randrange(len(part) + 1)
            part = part[:i] + rng.choice(letters + "，。 ") + part[i + 1 :]
        passages.append((k, rng.choice([None, "d0", "d1", "d2", "d9"]), part))
    passages += [(900, "d1", None), (901, "d1", "，。")]
    got = gold.passage_chunks(spark.createDataFrame(passages, "aspect_id int, document_id string, text string"), spark.createDataFrame(chunks, "chunk_id string, document_id string, text string"))
    want = pairs(passages, chunks)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {s for *_, s in want} == {"anywhere", "named"}


def test_cells_of_stated_cases(spark):
    evidence = [(1, "工作表：表一；单元格 C5 与 D6", "d"), (2, "工作表：无；C5", "d"), (3, "合计=1,234；健康险=77", "d"), (4, "C9", "d"), (5, "C5", None), (6, None, "d"), (7, "ABCD5 与 C55555", "d")]
    cells = [("d", "表一", "c5", "x1"), ("d", "表二", "C5", "x2"), ("d", "表二", "D6", "x3"), ("e", "表一", "C5", "x4")]
    chunks = [("d", "t1", "合计 1234 亿元"), ("d", "t2", "无"), ("e", "t3", "77")]
    got = gold.cell_chunks(spark.createDataFrame(evidence, "case_id int, text string, document_id string"), spark.createDataFrame(cells, "document_id string, sheet string, coordinate string, chunk_id string"), spark.createDataFrame(chunks, "document_id string, chunk_id string, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "cell:C5", "x1"), (1, "cell:D6", "x3"), (2, "cell:C5", "x1"), (2, "cell:C5", "x2"), (3, "value:1234", "t1"), (3, "value:77", None), (4, "cell:C9", None)], key=repr
    )
