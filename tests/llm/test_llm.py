"""The llm operators: SQL twins, brute force, exact round trips, held-out accuracy, odd inputs."""

import hashlib
import io
import itertools
import math
import random
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evidence_spark.llm import bpe, codes, fingerprints, jaccard, language, lm, mixing, packing, queries, tokens, topk, toxicity, warc, whiten

SF = "/root/testdata/sf0.001"
BPE = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, size string, c string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    texts = [None, "", " \t\n", "one", "one two", long, long + " tail", "a b c d e f", "a b c d e f", "<|endoftext|> x", "é" * 50, "日本 語"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 0, 7, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "a b c d e f", "en", "s", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    norm = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(norm, df.select(*cols).collect()), key=repr) == sorted((norm([r[i] for i in at]) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same(spark, name)


# ---- 1 mixing ----


def test_mixing_targets_and_odd_rows(spark, docs, odd):
    rows = mixing.mixing_plan(docs).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        by[r["_row"]["source"]][0] += r["size"]
        by[r["_row"]["source"]][1] = r["target"]
    assert abs(sum(t for _, t, _ in by.values()) - sum(s for s, _, _ in by.values())) < 1e-3
    assert all(t <= 3 * s + 1e-6 for s, t, _ in by.values()) and max(r["copies"] for r in rows) <= 3
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(odd).collect()))


# ---- 2 packing, 6 token counts ----


def test_tokens_equal_the_library(odd):
    lib, count, encode = Tokenizer.from_file(BPE), tokens.counter(BPE), tokens.encoder(BPE)
    rng = random.Random(5)
    alphabet = [chr(i) for i in range(0x180)] + list(" \t\n\r\x0b\x0c\x1c\x85\xa0 　'''  stmlldrve日本é") * 3 + ["<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a" * 2000, " " * 700, "ab" * 900]
    texts += [r["text"] for r in odd.collect() if r["text"]]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert count.count(t) == len(ids), t[:50]
        assert encode.encode(t) == np.array(ids, "<u4").tobytes()
    for t in texts[:2000]:  # chunks cut anywhere compose to the same count (special strings are cut out before)
        for size in (1, 3):
            state, n = tokens.START, 0
            for i in range(0, len(t), size):
                state, more = count.advance(state, t[i : i + size])
                n += more
            assert n + count.finish(state) == count.plain(t), t


@pytest.mark.parametrize("frame", ["docs", "odd"])
def test_token_counts_in_rows_of_chunks(spark, frame, request):
    df = request.getfixturevalue(frame)
    lib = Tokenizer.from_file(BPE)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect()), key=repr)
    for how in ({}, {"size": 64}, {"size": 50, "lead": 1}, {"size": 7000, "lead": 0}):
        assert sorted(((r["_id"], r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(df, BPE, **how).collect()), key=repr) == want
    assert tokens.token_counts(df.limit(0), BPE).count() == 0


def test_token_counts_of_texts_without_borders(spark):
    """No white space, no-break spaces only, one letter, digits, a special string across a chunk's end: several tasks, one result."""
    rng, lib = random.Random(6), Tokenizer.from_file(BPE)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    texts = [letters(40_000, "abcdefghijklmnopqrstuvwxyz"), "\xa0" * 30_000, "a" * 30_000, " " * 20_001 + "x", "\n" * 20_000, letters(30_000, "0123456789"), letters(30_000, "'srevmlld"), letters(30_000, " \xa0\n\u3000"), "日本語" * 9_000]
    texts += [letters(5_000, "xyz") + "<|endoftext|>" + letters(11_370, "xyz ") + "<|endoftext|><|endoftext|>", "<|endoftext|>" * 3_000, letters(25_000, "=-_.!'")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for size in (1_000, tokens.CHUNK):
        assert {r["_id"]: r["n_tokens"] for r in tokens.token_counts(df, BPE, size=size).collect()} == want
    c = tokens.counter(BPE)
    settled = sum(c.advance(tokens.START, texts[0][i - 256 : i])[0] == c.advance(tokens.START, texts[0][:i])[0] for i in range(1_000, 40_000, 1_000))
    assert settled == 39  # a chunk's state is known from a few characters before it


def test_token_count_query_equals_the_library(spark, docs):
    lib = Tokenizer.from_file(BPE)
    want = {}
    for r in docs.collect():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 1024)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op6_token_counts(spark, SF).collect()} == want


@pytest.mark.parametrize("frame", ["docs", "odd"])
def test_packing_round_trip(spark, frame, request):
    df = request.getfixturevalue(frame)
    lib = Tokenizer.from_file(BPE)
    got = packing.pack(df, BPE, keep_ids=True).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["_id"]].append((r["start"], bytes(r["ids"])))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for r in df.collect():
        want[r["doc_id"]].append(np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    for k, texts in want.items():
        if len(texts) == 1:
            assert b"".join(p for _, p in sorted(pieces[k])) == texts[0]
        assert sum(len(p) for _, p in pieces[k]) == sum(map(len, texts))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    if frame == "docs":
        total = sum(r["length"] for r in got)
        assert total / (1024 * len(seqs)) > 0.97
    assert packing.pack(df.limit(0), BPE).count() == 0


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(0)
    for n in (300, 20_000):
        hist = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 128, n), return_counts=True), strict=True)}
        plan = packing.plan_patterns(hist, 128)
        served = defaultdict(int)
        for pattern, k in plan:
            assert sum(c * a for c, a in pattern.items()) <= 128
            for c, a in pattern.items():
                served[c] += a * k
        assert dict(served) == hist
        assert sum(k for _, k in plan) <= 1.06 * sum(c * v for c, v in hist.items()) / 128 + 2


# ---- 3 language ----


def test_language_held_out_accuracy(spark, docs):
    rows = queries.op3_language(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_marginals(chain, scores):
    n, k = scores.shape
    total = np.zeros((n, k))
    for path in np.ndindex(*[k] * n):
        p = np.exp(chain.start[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, y in enumerate(path):
            total[i, y] += p
    return total / total.sum(1, keepdims=True)


def test_forward_backward_against_all_paths(monkeypatch):
    rng = np.random.default_rng(2)
    chain = language.Chain(["a", "b", "c"], np.zeros((1, 3)), {}, rng.normal(size=(3, 3)), rng.normal(size=3))
    scores = [rng.normal(size=(n, 3)) for n in (1, 5, 2, 6)]
    first = np.concatenate([np.r_[True, np.zeros(len(s) - 1, bool)] for s in scores])
    monkeypatch.setattr(language, "PIECE", 3)
    got = chain.marginals(np.vstack(scores), first)
    assert np.allclose(got, np.vstack([brute_marginals(chain, s) for s in scores]))


def test_language_follows_switches_and_odd_rows(spark, docs, odd):
    rows = docs.select("text", "lang").collect()
    chain = language.fit_chain([(r["lang"], language.LETTERS.findall(r["text"].lower())[:40]) for r in rows if r["lang"] and r["text"]])
    out = {r["_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, chain).filter("_id is not null").collect()}
    assert out[0] == out[1] == out[2] == ("und", 0.0) and out[5][0] in chain.labels
    kept = language.keep_known(odd, chain)
    assert kept.columns == odd.columns and {0, 1, 2}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert language.predict(odd, language.fit(odd.filter("lang = 'xx'"))).filter("lang_pred <> 'und'").count() == 0


def test_numerals_are_no_letters(spark, docs):
    chain = language.fit_chain([("a", ["abc"]), ("b", ["xyz"])])
    df = spark.createDataFrame(list(enumerate(["²", "½ ①", "Ⅷ 12", "x²", "一"])), "doc_id int, text string")
    assert [r["lang_pred"] == "und" for r in language.predict(df, chain).orderBy("_id").collect()] == [True, True, True, False, False]
    assert language.predict(df.limit(0), chain).count() == 0


def test_language_query_against_plain_python(spark, docs):
    """Documents one at a time, with a forward-backward pass over a plain list of words."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = docs.filter("crc32(cast(doc_id as string)) % 3 <> 1")
    chain = language.fit(train)
    for r in [x for x in queries.op3_language(spark, SF).collect() if x["doc_id"] % 7 == 0]:
        words = language.words_of(texts[r["doc_id"]])
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        e = np.array([np.sum([chain.weights[f] for f in chain.features(w)], axis=0) for w in words])
        e = np.exp(e - e.max(1, keepdims=True))
        move, f = np.exp(chain.moves), [np.exp(chain.start) * e[0]]
        for x in e[1:]:
            f.append((f[-1] / f[-1].sum()) @ move * x)
        b = [np.ones(len(chain.labels))]
        for x in e[:0:-1]:
            v = move @ (x * b[-1])
            b.append(v / v.sum())
        m = np.array(f) * np.array(b[::-1])
        share = ((m / m.sum(1, keepdims=True)) * np.array([len(w) for w in words])[:, None]).sum(0)
        share /= share.sum()
        assert abs(share.max() - r["score"]) < 1e-6 and (chain.labels[int(share.argmax())] == r["lang_pred"] or np.sort(share)[-1] - np.sort(share)[-2] < 1e-6)


def test_language_reads_every_letter_of_long_runs(spark, docs):
    """Runs whose middle is of another language than both ends, and runs that switch, in fitting and prediction."""
    rows = docs.select("text", "lang").filter("text is not null and lang is not null").collect()
    words = defaultdict(list)
    for r in rows:
        words[r["lang"]] += [w for w in language.LETTERS.findall(r["text"].lower()) if len(w) > 2]
    a, b = sorted(words, key=lambda x: -len(words[x]))[:2]
    glued = lambda lang, n: "".join(words[lang][:400])[:n]
    chain = language.fit_chain([(r["lang"], language.LETTERS.findall(r["text"].lower())[:40]) for r in rows])
    (lang, share), (_, mixed) = chain.documents([glued(a, 20) + glued(b, 800) + glued(a, 20), glued(a, 400) + glued(b, 400)])
    assert lang == b and share > 0.7 and mixed < 0.8
    # Fitting: the languages differ only beyond the 40th letter of each run.
    df = spark.createDataFrame([(i, "x" * 40 + ("abab" if i % 2 else "cdcd") * 20, str(i % 2)) for i in range(40)], "doc_id long, text string, lang string")
    assert language.predict(df, language.fit(df)).filter("lang_pred <> cast(_id % 2 as string)").count() == 0


def test_unlabelled_corpus_keeps_texts_with_letters(spark):
    df = spark.createDataFrame([(1, "clean words", None), (2, None, None), (3, "12 - 7", None), (4, "日本", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.reject_unknown_language(spark, df, SF).collect()) == [1, 4]


# ---- 4 WARC ----


def test_warc_round_trip_and_rejects(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a/\r\nx y", "<p>é</p>", "z"), (1, None, "<p>é</p>", "z"), (2, "u", None, "z"), (5, "u", "", "z"), (None, "u", "solo", "z"), (9, "u", "w" * 300_000, "z")], "page_id long, url string, html string, payload string")
    listed = warc.write_archives(pages, f"file://{tmp_path}")
    got = {r["record_id"]: r for r in warc.read_archives(listed).collect()}
    assert got["3"]["record_type"] == "revisit" and got["3"]["refers_to"] == "1" and got["5"]["refers_to"] == "2"
    assert bytes(got["1"]["payload"]) == "<p>é</p>".encode() and got["9"]["payload_bytes"] == 300_000 and got["3"]["payload_bytes"] == 9
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}")).count() == 0
    record = warc.make_record("1", "u", b"abc", warc.base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None)
    assert warc.parse_record(record)["payload"] == b"abc"
    for bad in (record.replace(b"abc", b"abd"), record[:-1], record.replace(b"WARC/1.1", b"WARC/x"), record.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    engine = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"some raw words " * 50))
    raw = b"some raw words " * 50
    data = struct.pack("<II", warc.MAGIC_DICT, len(raw)) + raw + b"".join(engine.compress(x) for x in (b"one", b"some raw words two"))
    assert list(warc.read_frames(io.BytesIO(data), 3)) == [b"one", b"some raw words two"]
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(data[:-2]), 3))


# ---- 5 top-k ----


@pytest.mark.parametrize("block", [4096, 40])
def test_topk_brute_force_with_ties_and_bad_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LOT", 7 * block)
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(300, 8)).tolist()
    vecs[10:60] = [vecs[10]] * 50
    rows = list(enumerate(vecs)) + [(300, None), (301, [float("nan")] * 8), (302, [None] + [0.1] * 7), (303, [1.0, 2.0]), (304, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    got = defaultdict(list)
    for r in topk.exact_topk(df, df.filter("vec_id % 5 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    m = np.floor(256 * np.array(vecs)).astype(int)
    for q in range(0, 300, 5):
        s = m @ m[q]
        assert got[q] == [(int(i), int(s[i])) for i in sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]]
    assert set(got) == set(range(0, 300, 5)) and topk.exact_topk(df.limit(0), df).count() == 0


@pytest.mark.parametrize("scale", [1, 300, 10**6])
def test_index_stops_on_proof_only(scale):
    """Small, larger and very large parts (single, double and integer sums), with bounds from elsewhere and without."""
    rng = np.random.default_rng(scale)
    v = (rng.normal(size=(700, 16)) * 40 * scale).astype(np.int64)
    v[100:140] = v[100]
    ids, q = rng.permutation(700), v[::50]
    index = topk.Index(ids, v, topk.lengths(q).max())
    scores = v @ q.T
    for share in (None, 0.98):
        bounds = np.full(len(q), -np.inf) if share is None else np.quantile(scores, share, axis=0).astype(np.int64).astype(float)
        for j, (found, got) in enumerate(index.search(q, ids[::50], bounds, 5)):
            best = sorted((-int(s), int(i)) for s, i in zip(scores[:, j], ids, strict=True) if i != ids[::50][j] and s >= bounds[j])[:5]
            assert [(-int(s), int(i)) for s, i in zip(got, found, strict=True)][: len(best)] == best


def test_topk_clashing_columns_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1, 2], 0, 0), (1, [1, 2], 0, 0), (2, [3, 4], 0, 0), (None, [9, 9], 0, 0)], "vec_id long, vector array<long>, _id int, _block int")
    got = [tuple(r) for r in topk.exact_topk(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 11), (2, 1, 1, 11), (2, 2, 1, 11)]


# ---- 7 toxicity, 8 language models ----


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("_id"), F.col("toxic").alias("grade")))
    rows = toxicity.severity(docs, model).join(labels.withColumnRenamed("toxic", "label").filter("doc_id % 2 = 1"), F.col("_id") == F.col("doc_id")).collect()
    hits, flagged = sum(r["toxic"] and r["label"] == 1 for r in rows), sum(r["toxic"] for r in rows)
    assert hits >= 0.6 * sum(r["label"] for r in rows) and flagged - hits <= 2
    assert all(a < b for a, b in zip(model.thresholds, model.thresholds[1:], strict=False))


def plain_toxicity(model, text):
    """P(grade > j) from a model's weights and thresholds alone: words once, stems by their share."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    total = sum(w for f, w in model.weights.items() if not f.endswith("*") and f in words)
    for f, w in model.weights.items():
        n = sum(x.startswith(f[:-1]) for x in words) if f.endswith("*") else 0
        share = 100 * n / (len(words) + 20)
        total += w * min(2.0, share) if n >= 2 and share >= 0.5 else 0.0
    return np.array([1 / (1 + math.exp(-(total - t))) for t in model.thresholds])


def test_toxicity_query_is_the_model_row_by_row(spark, docs):
    model = queries.toxicity_model(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op7_toxicity(spark, SF).collect():
        up = plain_toxicity(model, texts[r["doc_id"]])
        assert abs(r["severity"] - up.sum()) < 1e-9 and abs(r["p_toxic"] - up[0]) < 1e-9 and r["toxic"] == (up[0] >= 0.5)


def test_three_grades_share_weights_across_thresholds(spark):
    """Grades 0, 1, 2 by how many bad words a text holds: one weight each, two ordered thresholds."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        g = i % 3
        rows.append((i, " ".join([f"w{rng.randrange(50)}" for _ in range(20)] + rng.sample(["bad", "worse", "vile", "foul"], 2 * g)), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(df, df.select(F.col("doc_id").alias("_id"), "grade"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = toxicity.severity(df, model).join(df, F.col("_id") == F.col("doc_id")).collect()
    assert all(abs(r["severity"] - r["grade"]) < 0.5 for r in out)
    assert toxicity.severity(df.limit(0), model).count() == 0


def test_toxicity_odd_rows(spark, odd):
    model = toxicity.OrdinalModel({"one": 9.0}, [2.0, 4.0])
    out = {r["_id"]: r for r in toxicity.severity(odd, model).filter("_id is not null").collect()}
    assert out[0]["severity"] == out[1]["severity"] and out[3]["toxic"] and not out[0]["toxic"] and 0 <= out[3]["severity"] <= 2
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.fit(odd, spark.createDataFrame([], "_id long, grade int")).above("x")[0] == 0


def test_lm_against_plain_counts(spark, odd):
    target = spark.createDataFrame([(7,), (7,), (None,)], "_id long")
    small = odd.filter("doc_id in (0, 1, 7, 8)").dropDuplicates(["doc_id"])
    got = {r["_id"]: r for r in lm.score(small, lm.fit(small, target)).collect()}
    assert got[0]["score"] is None and got[0]["n_words"] == 0 and got[7]["n_words"] == 6
    v, a, k = lm.VOCABULARY, lm.ADDED, lm.BACK_OFF

    def loss(copies):
        own = (copies + a) / (6 * copies + a * v)
        return -np.log((copies + k * own) / (copies + k))

    assert abs(got[7]["background_loss"] - loss(2)) < 1e-6 and abs(got[7]["target_loss"] - loss(0)) < 1e-6  # itself it isn't in the target
    assert abs(got[8]["background_loss"] - loss(2)) < 1e-6 and abs(got[8]["target_loss"] - loss(1)) < 1e-6


def without_itself(w, inside, one, two, size, vocabulary):
    """The mean loss of words under plain counts, less the words' own if they are inside."""
    mine, pairs = defaultdict(int), defaultdict(int)
    for a, b in zip([None, *w], w, strict=False):
        mine[b] += inside
        pairs[a, b] += inside
    mine[None] = inside
    losses = []
    for a, b in zip([None, *w], w, strict=False):
        own = (one[b] - mine[b] + lm.ADDED) / (size - inside * len(w) + lm.ADDED * vocabulary)
        losses.append(-np.log((two[a, b] - pairs[a, b] + lm.BACK_OFF * own) / (one[a] - mine[a] + lm.BACK_OFF)))
    return np.mean(losses) if w else None


def test_lm_query_against_plain_counts(spark, docs):
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    one, two, sizes = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)], [0, 0]
    for i, w in texts.items():
        for k in (0, 1) if i in good else (1,):
            sizes[k] += len(w)
            one[k][None] += bool(w)
            for a, b in zip([None, *w], w, strict=False):
                one[k][b] += 1
                two[k][a, b] += 1
    vocabulary = max(lm.VOCABULARY, len(one[1]) - 1)
    for r in queries.op8_lm_scores(spark, SF).collect():
        w = texts[r["doc_id"]]
        want = [without_itself(w, inside, one[k], two[k], sizes[k], vocabulary) for k, inside in ((0, r["doc_id"] in good), (1, False))]
        assert r["n_words"] == len(w) and ((r["score"] is None) if not w else abs(r["score"] - (want[0] - want[1])) < 1e-7)


def test_lm_tells_held_out_targets_from_the_rest(spark):
    """Area under the curve of the target's documents, each scored without itself, against those labelled quality 0."""
    larger = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    scores = {r["doc_id"]: r["score"] for r in queries.op8_lm_scores(spark, larger).collect() if r["score"] is not None}
    good, bad = ([s for i, s in scores.items() if quality.get(i) == q] for q in (1, 0))
    assert np.mean([[(a < b) + (a == b) / 2 for b in bad] for a in good]) > 0.95


def test_lm_empty_table_and_long_text(spark, odd):
    target = spark.createDataFrame([(5,)], "_id long")
    assert lm.score(odd.limit(0), lm.fit(odd.limit(0), target)).count() == 0
    assert {r["_id"]: r["n_words"] for r in lm.score(odd, lm.fit(odd, target)).filter("_id is not null").collect()}[5] == 60_000


def test_lm_counts_are_exact_beyond_any_fixed_table(spark):
    """More words than VOCABULARY, each in bigrams of its own, against counts in plain Python; models applied to other documents, too."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(9_000)) + " a b" * (i + 1)) for i in range(6)] + [(None, "a b a"), (None, "a b a"), (9, " ")]
    rows += [(20 + i, " ".join(rng.choice("abcde") for _ in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(0,), (3,), (25,)], "_id long")
    one, two, sizes = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)], [0, 0]
    for i, t in rows:
        for k in (0, 1) if i in (0, 3, 25) else (1,):
            w = t.split()
            sizes[k] += len(w)
            one[k][None] += bool(w)
            for a, b in zip([None, *w], w, strict=False):
                one[k][b] += 1
                two[k][a, b] += 1
    vocabulary = len(one[1]) - 1
    assert vocabulary > lm.VOCABULARY

    def losses(t, in_target=False):
        return [without_itself(t.split(), inside, one[k], two[k], sizes[k], vocabulary) for k, inside in ((0, in_target), (1, False))]

    models = lm.fit(df, target)
    others = spark.createDataFrame([(100, "a b new words a"), (101, None)], "doc_id long, text string")
    got, apart = lm.score(df, models).collect(), {r["_id"]: r for r in lm.score(others, models).collect()}
    texts = dict(rows)
    assert len(got) == len(rows) and sorted(str(r["_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        if r["_id"] == 9:
            assert r["score"] is None and r["n_words"] == 0
        else:
            want = losses(texts[r["_id"]], r["_id"] in (0, 3, 25))
            assert np.allclose([r["target_loss"], r["background_loss"], r["score"]], [*want, want[0] - want[1]], atol=1e-7)
    assert set(apart) == {100, 101} and apart[101]["score"] is None and np.allclose([apart[100]["target_loss"], apart[100]["background_loss"]], losses("a b new words a"), atol=1e-7)


# ---- 9 n-gram join ----


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= max(len(a), len(b)) * percent and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, docs, width, percent):
    got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs, width=width, percent=percent).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], width, percent)


def test_join_on_common_passages_and_near_copies(spark):
    """Frequent tokens (so combinations are indexed), chains of near copies, all sharing a passage."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(200)]
    rows = []
    for i in range(260):
        words = list(passage)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(200)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(passage[:100] + [f"y{i}_{j}" for j in range(100)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width, percent in ((3, 90), (5, 80)):
        want = brute_components(rows, width, percent)
        for how in ({}, {"rounds": 0, "listed": 2, "block": 32}, {"rounds": 1, "listed": 10_000}):  # by pivots, by blocks, by listing
            got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(df, width=width, percent=percent, **how).collect()}
            assert got == want


def test_join_without_a_centre(spark):
    """Copies with two edits each and no original: nearly all share entries, few link."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(220):
        words = list(base)
        for k in rng.sample(range(5, 145), 2):
            words[k] = f"z{i}_{k}"
        rows.append((i, " ".join(words if i % 7 else words[: 150 - i % 5])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for how in ({}, {"rounds": 1, "listed": 4, "block": 16}):
        got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(df, width=3, percent=90, **how).collect()}
        assert got == brute_components(rows, 3, 90)


def test_join_tells_classes_of_one_hash_apart(spark, monkeypatch):
    """Where different sets share the first hash, the second stands in."""
    shared = frozenset({jaccard.set_class(jaccard.token_set(b"a b c d", 3, jaccard.Words()))[0]})
    s = jaccard.token_set(b"a b c d", 3, jaccard.Words())
    assert jaccard.class_of(s, shared) == jaccard.set_class(s)[1] != jaccard.class_of(s, frozenset())


def test_join_odd_rows(spark, odd):
    got = jaccard.link_components(odd, width=3, percent=90).collect()
    by = defaultdict(set)
    for r in got:
        by[r["_id"]].add((r["n_shingles"], r["component_id"]))
    assert len(got) == odd.count() and by[0] == {(0, 0)} and by[3] == {(1, 3)} and by[8] == {(4, 7)} and by[6] == {(next(iter(by[6]))[0], 5)}
    kept = jaccard.keep_first(odd, width=3, percent=90)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10, 11]
    assert jaccard.link_components(odd.limit(0)).count() == 0


def test_keep_first_decides_by_row(spark):
    """Equal ids with different texts, one of them a copy; copies without ids; wordless rows."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("c") + " tail"), (None, text("e")), (None, text("e")), (None, text("d")), (4, text("e") + " tail"), (None, text("f")), (None, text("f")), (5, None), (5, ""), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _row string").repartition(3)
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    either = [(3, text("c") + " tail") if (3, text("c") + " tail") in got else (3, text("c"))]
    want = [(1, text("a")), (2, text("b")), *either, (3, text("d")), (4, text("e") + " tail"), (None, text("f")), (5, None), (5, ""), (None, None)]
    assert got == sorted(want, key=repr)


# ---- 10 fingerprints ----


def brute_sketch(text, k=fingerprints.K, width=5):
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    h = [signed(xxhash.xxh64_intdigest(w, 42)) for w in (text or "").encode().split()]

    def chain(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return signed(seed)

    if not h:
        return []
    if len(h) < width:
        acc = 0
        for v in h:
            acc = chain([acc, v])
        return [acc]
    return sorted({chain(h[i : i + width]) for i in range(len(h) - width + 1)})[:k]


def test_fingerprints_against_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts)
    for r in queries.op10_fingerprints(spark, SF).collect():
        t, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        text_of = lambda s: "".join(f"{x & (1 << 64) - 1:016X}" for x in s)
        assert r["fingerprint"] == text_of(brute_sketch(t)) and r["edited_fingerprint"] == text_of(brute_sketch(edited))
        for near, other in ((r["near_edited"], edited), (r["near_next"], after)):
            a, b = brute_sketch(t), brute_sketch(other)
            union = sorted({*a, *b})[: fingerprints.K]
            assert near == (sum(x in a and x in b for x in union) / len(union) if union else 1.0)


def test_next_text_of_sparse_large_and_null_ids(spark):
    rng = random.Random(8)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(60)] + [2**62 + 5, 2**63 - 1, 0, 255, 256] + [None] * 5
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, f"t{k}", "x") for k, i in enumerate(ids)], "doc_id long, text string, _block string").repartition(3)
    got = {(r["_id"], r["_text"]): r["_next_text"] for r in fingerprints.with_next_text(df).collect()}
    named = sorted((i, f"t{k}") for k, i in enumerate(ids) if i is not None)
    assert len(got) == len(ids) and all(got[a] == b[1] for a, b in zip(named, named[1:], strict=False))
    chain, at = [named[0][1]], {x[1]: n for x, n in got.items()}
    while (after := at[chain[-1]]) != chain[0]:
        chain.append(after)
    assert sorted(chain) == sorted(at) and chain[: len(named)] == [t for _, t in named]


def test_sketch_estimates_and_merge(spark):
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(2000, 6000))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct(fingerprints.merge(F.col("a"), F.col("b"))).alias("n"), (fingerprints.from_text(fingerprints.to_text(F.col("a"))) == F.col("a")).alias("same")).first()
    assert abs(r["j"] - 1 / 3) < 0.15 and abs(r["c"] - 0.5) < 0.2 and abs(r["n"] / 6000 - 1) < 0.3 and r["same"]


def test_fingerprints_odd_rows(spark, odd):
    assert fingerprints.fingerprint_edits(odd).count() == odd.count()
    assert fingerprints.fingerprint_edits(odd.limit(0)).count() == 0


# ---- pipeline ----


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    clean = corpus_pipeline.reject_toxic(spark, docs, d)
    gone = {r["doc_id"] for r in docs.select("doc_id").subtract(clean.select("doc_id")).collect()}
    assert clean.columns == docs.columns and gone and not [i for i in gone if labels.get(i) == 0]
    once = corpus_pipeline.keep_one_of_each_group(spark, docs, d)
    want = {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80).values()}
    assert {r["doc_id"] for r in once.collect()} == want
    kept = corpus_pipeline.reject_unknown_language(spark, docs, d)
    assert kept.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in docs.collect() if not language.LETTERS.search(r["text"] or "")} | {r["_id"] for r in language.predict(docs, language.fit(docs)).filter("score < 0.3").collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, d)
    plan = {r["_id"]: r["copies"] for r in mixing.mixing_plan(docs).collect()}
    assert mixed.columns == docs.columns and {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in plan.items() if n}
    packed = corpus_pipeline.pack_sequences(spark, docs, d)
    lib = Tokenizer.from_file(BPE)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "mixing", "packing"]


def test_pipeline_is_its_stages_one_after_another(spark, odd):
    """Every document that run() packs went through all stages; odd rows pass each stage without harm."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
    counted = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert counted(corpus_pipeline.run(spark, SF)) == counted(at)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    rest = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rest = stage(spark, rest, SF)
        assert rest.columns == odd.columns


# ---- 11 byte-level BPE ----

RANKS = P.path("byte_bpe_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})


def test_bpe_equals_the_library_on_random_unicode():
    rng, lib, model = random.Random(3), library(), bpe.Encoder(RANKS, P.PATTERN)
    alphabet = [chr(i) for i in range(0x180)] + list(" \t\n\r\x0b\x0c\x1c\x85\xa0　'''  stmlldrve日本é") * 3 + ["<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["", "a" * 2000, " " * 700, "ab" * 900, "aaaa" * 1000 + "b", "".join(rng.choice("abc") for _ in range(30_000)), "the" * 500]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)} ." for c in range(0x180, 0x110000, 13) if not 0xD800 <= c < 0xE000]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == lib.encode_ordinary(t), t[:60]


def test_replay_waits_for_a_merge_of_lower_rank():
    """Merges whose results come before their parts: (x, bc) before (b, c), among two places of (b, c) in one word."""
    tokens = [bytes((b,)) for b in range(256)] + [b"xbc", b"xbcb", b"bc", b"bcx", b"bcbc"]
    ranks = {t: i for i, t in enumerate(tokens)}
    lib, model = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}), bpe.Replay(ranks)
    words = ["".join(w) for n in range(1, 8) for w in itertools.product("xbc", repeat=n)]
    words = [w for w in words if w.encode() not in ranks]
    for w, ids in zip(words, model.encode([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == lib.encode_ordinary(w), w


@pytest.mark.parametrize("frame", ["docs", "odd"])
def test_bpe_round_trip(spark, frame, request, monkeypatch):
    df, lib = request.getfixturevalue(frame), library()
    monkeypatch.setattr(bpe, "LOT", 1000)
    monkeypatch.setattr(bpe, "WORDS", 50)
    want = sorted(((r["doc_id"], lib.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in df.collect()), key=repr)
    coded = bpe.encode(df, RANKS, P.PATTERN)
    assert sorted(((r["_id"], r["ids"], bytes(r["decoded"])) for r in bpe.decode(coded.withColumn("decoded", F.lit(1)), RANKS).collect()), key=repr) == want
    assert bpe.decode(bpe.encode(df.limit(0), RANKS, P.PATTERN), RANKS).count() == 0
    assert bpe.decode(coded.limit(1).select(F.lit(None).cast("array<int>").alias("ids")), RANKS).first()["decoded"] is None
    with pytest.raises(Exception, match="no id 60000"):
        bpe.decode(coded.limit(1).select(F.array(F.lit(60_000)).alias("ids")), RANKS).collect()


def test_bpe_query_equals_the_library(spark, docs):
    lib, hexed = library(), lambda raw: hashlib.sha256(raw).hexdigest()
    want = {}
    for r in docs.collect():
        ids = lib.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hexed(" ".join(map(str, ids)).encode()), hexed((r["text"] or "").encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_bpe(spark, SF).collect()} == want


# ---- 12 vector codes, 13 whitening ----


@pytest.fixture(scope="module")
def vectors(spark):
    """Ties, repeated rows and ids, null and non-finite vectors, one vector that many rows share, clashing column names."""
    rng = random.Random(4)
    rows = [(i, i % 3 if i % 5 else None, [rng.choice([rng.gauss(0, 1), 0.5, -0.0]) for _ in range(16)]) for i in range(150)]
    rows += [(3, 1, rows[3][2]), (3, 1, rows[4][2]), (None, None, rows[3][2]), (900, 1, None), (901, 1, []), (902, 2, [float("nan")] * 16)]
    rows += [(903, 2, [None] * 16), (904, 2, [float("inf")] * 16), (905, 2, [1.0] * 8)] + [(1000 + i, 1, [0.1] * 16) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return df.withColumn("_id", F.lit(1)).withColumn("_v", F.lit("x")).withColumn("index", F.lit(2)).withColumn("_x", F.lit("y"))


def whole_vectors(rows, scale, size=16):
    """(id, label, floored vector) of the rows that take part."""
    good = [r for r in rows if r["embedding"] and len(r["embedding"]) == size and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    return [(r["vec_id"], r["label"], [math.floor(scale * x) for x in r["embedding"]]) for r in good]


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[2], p) for r in rows[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for r in rows:
                groups[near(cut(r[2], p), books[p])[1]].append(cut(r[2], p))
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [(r, [near(cut(r[2], p), books[p]) for p in range(parts)]) for r in rows]
    return [(r[0], r[1], [k for _, k in best], sum(d for d, _ in best)) for r, best in found], books


@pytest.mark.parametrize("how", [{}, {"parts": 4, "entries": 5, "rounds": 3, "scale": 10}, {"parts": 16, "entries": 3, "rounds": 2}, {"parts": 1, "entries": 300}])
def test_codes_equal_brute_force(vectors, monkeypatch, how):
    monkeypatch.setattr(codes, "BLOCK", 7)
    out, books = codes.compress(vectors, **how)
    want, plain = plain_codes(whole_vectors(vectors.collect(), how.get("scale", codes.SCALE)), how.get("parts", 8), how.get("entries", 16), how.get("rounds", 6))
    assert [b.tolist() for b in books] == plain
    assert sorted(map(tuple, out.select("_id", "label", "codes", "error").collect()), key=repr) == sorted(want, key=repr)


def test_codes_labels_and_odd_tables(vectors):
    rows = [r for r in codes.with_label_errors(codes.compress(vectors, rounds=1)[0]).collect()]
    by = defaultdict(int)
    for r in rows:
        by[r["label"]] += r["error"]
    assert None in by and all(r["label_error"] == by[r["label"]] for r in rows)
    assert codes.compress(vectors.limit(0))[0].count() == 0 and codes.compress(vectors.filter("embedding is null"))[0].count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(vectors, parts=5)


def test_shortlist_and_curve():
    rng = np.random.default_rng(1)
    short = 0
    for _ in range(300):
        points, entries = rng.integers(-50, 50, (20, 3)) // 4 + rng.integers(-40, 40, 3), rng.integers(-50, 50, (8, 3))
        entries[5] = entries[2]
        kept = codes.shortlist(points.min(0), points.max(0), entries)
        short += len(kept) < 8
        assert (kept[codes.nearest(points, entries[kept])[0]] == codes.nearest(points, entries)[0]).all()
    assert short > 100
    grid = np.array(list(itertools.product(range(8), repeat=2)))
    walk = grid[np.argsort(codes.hilbert(grid * 32, 0, 255), kind="stable")]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # the curve goes from neighbour to neighbour


def whitening_holds(rows, got, most=4):
    """Rows against numpy, each component up to its sign."""
    distinct = {tuple(v) for _, _, v in rows}
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array(sorted(distinct), float) - np.array(sums) / n
    variance = centred.T @ centred / n
    values, basis = np.linalg.eigh(variance)
    order = [d for d in np.argsort(-values)[:most] if values[d] > 1e-12 * values.max()]
    assert len(got) == len(order) * len(rows)
    by = defaultdict(list)
    for r in got:
        assert r["n"] == n and 0 <= r["identity_error"] < 1e-9
        by[r["_id"], r["deviation"], r["component"]].append(r)
    for c, d in enumerate(order):
        pairs = []
        for i, _, v in rows:
            key = i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), c + 1
            white = (np.array(v) - np.array(sums) / n) @ basis[:, d] / math.sqrt(values[d])
            pairs.append((white, min((r["whitened"] for r in by[key]), key=lambda w: abs(abs(w) - abs(white)))))
            assert all(abs(r["explained"] - values[d] / variance.trace()) < 1e-9 for r in by[key])
        white, found = np.array(pairs).T
        assert min(np.abs(found - white).max(), np.abs(found + white).max()) < 1e-7


@pytest.mark.parametrize("block", [16, 1024])
def test_whitening_equals_numpy(vectors, monkeypatch, block):
    monkeypatch.setattr(whiten, "BLOCK", block)
    whitening_holds(whole_vectors(vectors.collect(), 256), whiten.whiten(vectors).collect())


def test_whitening_of_few_dimensions_and_odd_tables(spark, vectors):
    line = spark.createDataFrame([(i, [float(i % 7), 2.0 * (i % 7)]) for i in range(20)], "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], 0, [256 * int(x) for x in r["embedding"]]) for r in line.collect()]
    whitening_holds(rows, whiten.whiten(line).collect())  # one component: the other's eigenvalue is zero
    assert whiten.whiten(line.filter("vec_id % 7 = 1")).count() == 0 and whiten.whiten(vectors.limit(0)).count() == 0


def test_whitening_query_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    whitening_holds(whole_vectors(table, 256, 64), queries.op13_whiten(spark, SF).withColumnRenamed("vec_id", "_id").collect())


def test_whole_sets_travel_only_for_members_of_large_groups(spark):
    """Sets that no large group holds are left where they lie: before, all were dealt out."""
    sets = spark.createDataFrame([(c, list(range(c % 2, 20))) for c in range(40)], "c long, tokens array<long>")
    members = spark.createDataFrame([(9, 9, 9, c, 20, 25, c) for c in range(4)], "gid long, own long, facing long, c long, n int, reach int, comp long")
    counts = spark.createDataFrame([(9, 4, 20)], "gid long, m long, most int")
    out = jaccard.links_in_blocks(members, counts, jaccard.stored(sets), 90, listed=2, block=2)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    linked = {frozenset((r["a"], r["b"])) for r in out.collect()}
    near = {c: c for c in range(4)}
    for _ in range(4):
        for a, b in map(tuple, linked):
            near[a] = near[b] = min(near[a], near[b])
    assert set(near.values()) == {0}
