"""Toxicity grades by cumulative-link (proportional odds) regression.

P(grade > j) = logistic(w . x - threshold_j): one weight vector, ordered thresholds. x is
sparse: which of the selected words a text holds (1 each), and which share of its words
begins with a selected stem (in hundredths, two at most; 20 words are added to short
texts), where at least two do. Words are runs of letters, lower case; stems are their
first 4 to 7 letters. The model is fitted to at most about SAMPLE graded documents, chosen by a hash of
the id; features are selected among those of the sample by the likelihood ratio of their
presence in graded-up against grade-0 documents (at least LEAST, the best FEATURES).
There are as many thresholds as the labels have grades above 0: labels that only say toxic
or not give one. Expected severity is the sum of P(grade > j).

Defined cases: null and empty texts hold no word and get the severity of a text without
any; a document without grade is not used, one graded twice at its highest grade;
without graded documents of two grades every severity is 0; texts of any length are read
whole; repeated rows get equal results, one each; an empty table gives no rows; extra
columns are kept by keep_clean and never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, uniform

SAMPLE, FEATURES, LEAST = 20_000, 4096, 12.0
STEMS = (4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> dict[str, float]:
    """All features of a text: words, and stems with a star behind."""
    words = LETTERS.findall(text.lower()) if text else []
    stems: Counter = Counter()
    out = dict.fromkeys(words, 1.0)
    for w, n in Counter(words).items():
        for k in STEMS:
            if len(w) >= k:
                stems[w[:k]] += n
    for s, n in stems.items():
        if n >= 2 and (share := 100 * n / (len(words) + 20)) >= 0.5:
            out[s + "*"] = min(2.0, share)
    return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class OrdinalModel:
    """Weights by feature and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.array(thresholds)
        self.stems = frozenset(f[:-1] for f in weights if f.endswith("*"))
        self.seen: dict[str, tuple[str, ...]] = {}

    def stems_of(self, word: str) -> tuple[str, ...]:
        if (found := self.seen.get(word)) is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found = self.seen[word] = tuple(s for k in STEMS if len(word) >= k and (s := word[:k]) in self.stems)
        return found

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > j) for every j."""
        words = LETTERS.findall(text.lower()) if text else []
        held = Counter(words)
        s = sum(self.weights[w] for w in sorted(self.weights.keys() & held.keys()))
        stems: Counter = Counter()
        for w, n in held.items():
            for stem in self.stems_of(w):
                stems[stem] += n
        for stem, n in sorted(stems.items()):
            if n >= 2 and (share := 100 * n / (len(words) + 20)) >= 0.5:
                s += self.weights[stem + "*"] * min(2.0, share)
        return logistic(s - self.thresholds)


def fit_ordinal(rows: list[tuple[int, list[int], list[float]]], features: int, grades: int, decay: float = 2e-4, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on all rows."""
    y = np.array([g for g, _, _ in rows])
    of = np.repeat(np.arange(len(rows)), [len(x) for _, x, _ in rows])
    at = np.array([i for _, x, _ in rows for i in x], int)
    value = np.array([v for _, _, vs in rows for v in vs], float)
    share = np.array([(y > j).mean() for j in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.r_[np.zeros(features), start[0], gaps]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        w, t0, g = p[:features], p[features], p[features + 1 :]
        theta = t0 + np.r_[0, np.cumsum(np.exp(g))]
        s = np.bincount(of, w[at] * value, len(rows))
        up = logistic(s[:, None] - theta)  # P(y > j)
        full = np.hstack([np.ones((len(y), 1)), up, np.zeros((len(y), 1))])
        slope = np.hstack([np.zeros((len(y), 1)), up * (1 - up), np.zeros((len(y), 1))])
        r = np.arange(len(y))
        prob = np.maximum(full[r, y] - full[r, y + 1], 1e-12)
        ds = (slope[r, y] - slope[r, y + 1]) / prob / len(y)
        dtheta = np.array([(np.where(y == j + 1, -slope[:, j + 1], 0) + np.where(y == j, slope[:, j + 1], 0)) / prob for j in range(grades - 1)]).sum(1) / len(y)
        later = np.cumsum(dtheta[::-1])[::-1]
        grad = np.r_[np.bincount(at, ds[of] * value, features) - decay * w, later[0], later[1:] * np.exp(g)]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return p[:features], p[features] + np.r_[0, np.cumsum(np.exp(p[features + 1 :]))]


def fit(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """grades: _id and grade (0, 1, ...)."""
    grades = grades.filter("grade is not null and _id is not null").groupBy("_id").agg(F.max("grade").cast("int").alias("grade"))
    n = grades.count()
    chosen = grades.filter(uniform("toxicity", F.col("_id")) < sample / max(n, 1))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                found = [features_of(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.float64()))], ["grade", "features", "shares"]
                )

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = cut(texts.join(F.broadcast(chosen.select(F.col("_id").cast("long"), "grade")), "_id").select("grade", "_text").mapInArrow(features, "grade int, features array<string>, shares array<double>"))
    sizes = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    total, high = sum(sizes.values()), sum(c for g, c in sizes.items() if g)
    if not high or high == total:
        return OrdinalModel({}, [np.inf])
    per = rows.select(F.col("grade"), F.explode("features").alias("word")).groupBy("word").agg(F.sum((F.col("grade") > 0).cast("long")).alias("a"), F.count("*").alias("ab"))

    def term(count, of):
        return F.when(count > 0, count * F.log(count / of)).otherwise(0.0)

    a, b = F.col("a"), F.col("ab") - F.col("a")
    p = F.col("ab") / F.lit(float(total))
    c, d = F.lit(high) - a, F.lit(total - high) - b
    ratio = 2 * (term(a, F.lit(high) * p) + term(b, F.lit(total - high) * p) + term(c, F.lit(high) * (1 - p)) + term(d, F.lit(total - high) * (1 - p)))
    best = per.filter("ab >= 3").withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST).orderBy(F.desc("ratio"), "word").limit(FEATURES)
    names = [r["word"] for r in best.select("word").collect()]
    index = {w: i for i, w in enumerate(names)}

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [[(index[f], v) for f, v in zip(fs, vs, strict=True) if f in index] for fs, vs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[i for i, _ in x] for x in kept], pa.list_(pa.int32())), pa.array([[v for _, v in x] for x in kept], pa.list_(pa.float64()))], ["grade", "at", "shares"]
            )

    data = sorted((r["grade"], list(r["at"]), list(r["shares"])) for r in rows.mapInArrow(positions, "grade int, at array<int>, shares array<double>").collect())  # at most about sample rows
    w, theta = fit_ordinal(data, len(index), max(g for g, _, _ in data) + 1)
    return OrdinalModel(dict(zip(names, w.tolist(), strict=True)), theta.tolist())


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, severity (expected grade), p_toxic (P(grade > 0)) and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            up = np.array([model.above(t.as_py()) for t in b.column(1)]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(up.sum(1)), pa.array(up[:, 0]), pa.array(up[:, 0] >= 0.5)], ["_id", "severity", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, severity double, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs without those held for toxic; same columns."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.above(t.as_py())[0] < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
