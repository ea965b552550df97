"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, lower case; a run of more than LONGEST letters (as in scripts
without spaces) is several words, one after another, so every letter is read in fitting
and prediction. A word's score for each language is the sum of weights of its features:
prefixes and suffixes up to four letters, letter n-grams up to three, and membership in
each language's lexicon (its most frequent words in the sample). Transition weights between neighbouring words are learned with them, on
sequences that change language from snippet to snippet, so switches inside a text are
followed. Forward-backward gives every word's distribution; a document's language is the
one with the greatest share of letters, and that share its score.

Words of many documents are one chain: a document's first word is entered by a transition
that forgets what was before. The chain is cut into pieces; transition products of
pieces (maps of label distributions) are composed in a scan, then all pieces run at once.

The model is fitted to at most about DOCS documents per language, chosen by a hash of
the id, and at most SNIPPETS stretches of LENGTH words from each, at places all over the
text. Prediction reads whole texts.

Defined cases: a null text or one without a letter is `und` with score 0; without
labelled documents all are `und`; with one language that one is predicted; equal texts
get equal results, repeated rows one each; texts of any length are read whole; an empty
table gives no rows; extra columns are kept by keep_known and never read.
"""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import uniform

DOCS, SNIPPETS, LENGTH, LEXICON, SLOTS = 500, 6, 12, 400, 1 << 16
#: Words per piece of the chain; words per lot.
PIECE, LOT = 128, 60_000
#: Letters of a word at most; longer runs are cut into consecutive words.
LONGEST = 40
LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def words_of(text: str | None) -> list[str]:
    """The words of a text, lower case."""
    words = LETTERS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, words)):  # numerals that are no digits, as in x²
        words = LETTERS.findall("".join(c if c.isalpha() else " " for c in text).lower())
    return words


class Slots(dict):
    """Feature text to weight row, by hash."""

    def __missing__(self, feature: str) -> int:
        if len(self) > 100_000:
            self.clear()
        slot = self[feature] = xxhash.xxh32_intdigest(feature) % SLOTS
        return slot


SLOT = Slots()


def word_features(word: str) -> list[int]:
    """Weight rows of affixes (with the marked n-grams, up to four letters) and n-grams."""
    m = f"^{word}$"
    n = len(m)
    found = [*m[1:-1], *[m[i : i + 2] for i in range(n - 1)], *[m[i : i + 3] for i in range(n - 2)], m[:4], m[-4:]]
    if n > 5:
        found += [m[:5], m[-5:]]
    return [SLOT[f] for f in found]


class Chain:
    """A fitted field: weights [feature, label], transitions and starts."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: dict[str, tuple[int, ...]], moves: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.lexicon, self.moves, self.start = labels, weights, lexicon, moves, start
        self.cache: dict[str, int] = {}
        self.table = np.zeros((0, len(labels)))

    def features(self, word: str) -> list[int]:
        return word_features(word) + [SLOTS + i for i in self.lexicon.get(word, ())]

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores [word, label], by word from a cache."""
        if len(self.cache) > 100_000:
            self.cache, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if new:
            base = len(self.cache)
            if base + len(new) > len(self.table):
                self.table = np.vstack([self.table, np.zeros((base + 2 * len(new), len(self.labels)))])
            for i in range(0, len(new), 20_000):
                per = [self.features(w) for w in new[i : i + 20_000]]
                sizes = np.fromiter(map(len, per), np.int64, len(per))
                at = np.fromiter(itertools.chain.from_iterable(per), np.int64, int(sizes.sum()))
                self.table[base + i : base + i + len(per)] = np.add.reduceat(self.weights[at], np.cumsum(sizes) - sizes)
            self.cache.update(zip(new, range(base, base + len(new)), strict=True))
        return self.table[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))]

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Label distributions [word, label] of a chain in which `first` marks where texts begin."""
        forward, later = self.messages(scores, first)
        both = forward * later
        return both / both.sum(1, keepdims=True)

    def messages(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages [word, label], each up to a factor per word."""
        n, k = scores.shape
        pieces = -(-n // PIECE)
        e = np.ones((pieces * PIECE, k))
        e[:n] = np.exp(scores - scores.max(1, keepdims=True))
        reset = np.zeros(pieces * PIECE, bool)
        reset[:n] = first
        reset[n:] = True
        e, reset = e.reshape(pieces, PIECE, k), reset.reshape(pieces, PIECE)
        move = np.exp(self.moves - self.moves.max())
        start = np.exp(self.start - self.start.max())

        product = np.broadcast_to(np.eye(k), (pieces, k, k)).copy()
        for t in range(PIECE):
            r = reset[:, t]
            moved = np.matmul(product.reshape(-1, k), move).reshape(pieces, k, k)
            if r.any():
                moved[r] = product[r].sum(2, keepdims=True) * start
            product = moved * e[:, t, None, :]
            if t % 4 == 3:
                product /= product.max((1, 2), keepdims=True)
        entering, leaving = np.ones((pieces, k)), np.ones((pieces, k))
        for p in range(1, pieces):
            v = entering[p - 1] @ product[p - 1]
            entering[p] = v / v.sum()
        for p in range(pieces - 2, -1, -1):
            v = product[p + 1] @ leaving[p + 1]
            leaving[p] = v / v.sum()
        forward, backward = np.empty_like(e), np.empty_like(e)
        v = entering
        for t in range(PIECE):
            v = np.where(reset[:, t, None], start, np.matmul(v, move)) * e[:, t]
            v = v / v.sum(1, keepdims=True)
            forward[:, t] = v
        v = leaving
        for t in range(PIECE - 1, -1, -1):
            backward[:, t] = v
            v = np.where(reset[:, t, None], 1.0, np.matmul(v * e[:, t], move.T))
            v = v / v.sum(1, keepdims=True)
        return forward.reshape(-1, k)[:n], backward.reshape(-1, k)[:n]

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(label, score) of every text."""
        lists = list(map(words_of, texts))
        words = [w for x in lists for w in x]
        out = [("und", 0.0)] * len(texts)
        if not words or not self.labels:
            return out
        some = [i for i, x in enumerate(lists) if x]
        starts = np.cumsum([0, *[len(lists[i]) for i in some]])[:-1]
        first = np.zeros(len(words), bool)
        first[starts] = True
        m = self.marginals(self.scores(words), first) * np.fromiter(map(len, words), np.int64, len(words))[:, None]
        sums = np.add.reduceat(m, starts)
        for i, s in zip(some, sums / sums.sum(1, keepdims=True), strict=True):
            out[i] = (self.labels[int(s.argmax())], float(min(1.0, s.max())))
        return out


def fit_chain(snippets: list[tuple[str, list[str]]], rounds: int = 40, rate: float = 0.15, decay: float = 1e-5) -> Chain:
    """The field of greatest penalised likelihood on sequences of snippets, by Adam."""
    labels = sorted({lang for lang, _ in snippets})
    k = len(labels)
    counts = {lang: Counter() for lang in labels}
    for lang, words in snippets:
        counts[lang].update(words)
    lexicon: dict[str, tuple[int, ...]] = {}
    for i, lang in enumerate(labels):
        for w, n in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n > 2:
                lexicon[w] = (*lexicon.get(w, ()), i)
    chain = Chain(labels, np.zeros((SLOTS + k, k)), lexicon, np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return chain
    snippets = sorted(snippets)
    random.Random(0).shuffle(snippets)
    runs = [snippets[i : i + 4] for i in range(0, len(snippets), 4)]
    words = [w for run in runs for _, ws in run for w in ws]
    gold = np.array([labels.index(lang) for run in runs for lang, ws in run for _ in ws])
    first = np.zeros(len(words), bool)
    first[np.cumsum([0, *[sum(len(ws) for _, ws in run) for run in runs]])[:-1]] = True
    types = {w: i for i, w in enumerate(dict.fromkeys(words))}
    which = np.fromiter(map(types.__getitem__, words), np.int64, len(words))
    per = [chain.features(w) for w in types]
    at = np.fromiter(itertools.chain.from_iterable(per), np.int64)
    of = np.repeat(np.arange(len(per)), list(map(len, per)))
    ends = np.cumsum([0, *map(len, per)])[:-1]
    onehot = np.eye(k)[gold]
    inner = ~first
    pairs = np.bincount(gold[:-1][inner[1:]] * k + gold[1:][inner[1:]], minlength=k * k).reshape(k, k)
    size = len(words)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (chain.weights, chain.moves, chain.start)]
    for r in range(1, rounds + 1):
        emission = np.add.reduceat(chain.weights[at], ends)
        scores = emission[which]
        forward, backward = chain.messages(scores, first)
        m = forward * backward
        m /= m.sum(1, keepdims=True)
        diff = onehot - m
        by_type = np.stack([np.bincount(which, diff[:, j], len(per)) for j in range(k)], 1)
        grad_w = np.stack([np.bincount(at, by_type[of, j], SLOTS + k) for j in range(k)], 1) / size - decay * chain.weights
        into = np.exp(scores - scores.max(1, keepdims=True)) * backward
        left, right = forward[:-1][inner[1:]], into[1:][inner[1:]]
        joint = left[:, :, None] * np.exp(chain.moves - chain.moves.max())[None] * right[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        grad_m = (pairs - joint.sum(0)) / size - decay * chain.moves
        grad_s = (np.bincount(gold[first], minlength=k) - m[first].sum(0)) / size
        for x, g, (a, b) in zip((chain.weights, chain.moves, chain.start), (grad_w, grad_m, grad_s), state, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            x += rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-8)
    return chain


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Chain:
    """The chain learned from docs; rows without language or text are not used."""
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")).filter("_lang is not null and _text is not null")
    counts = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}  # a row per language
    if not counts:
        return Chain([], np.zeros((SLOTS, 0)), {}, np.zeros((0, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, DOCS / n)])
    chosen = rows.filter(uniform("language", F.col("_id")) < share[F.col("_lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str]] = []
            for ident, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                places = max(1, len(words) - LENGTH + 1)
                for i in sorted({xxhash.xxh32_intdigest(f"{ident}:{j}") % places for j in range(SNIPPETS)}):
                    if piece := words[i : i + LENGTH]:
                        out.append((lang, " ".join(piece)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["lang", "words"])

    got = chosen.mapInArrow(cut, "lang string, words string").collect()  # DOCS * SNIPPETS * LENGTH words a language
    return fit_chain([(r["lang"], r["words"].split(" ")) for r in got])


def lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = max(1, int(batch.num_rows * LOT * 6 / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((chain.labels, chain.weights, chain.lexicon, chain.moves, chain.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*shared.value)
        for batch in batches:
            for b in lots(batch):
                found = model.documents(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, lang_pred string, score double")


def keep_known(docs: DataFrame, chain: Chain, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """docs without those of no language or of none that reaches the least score; same columns.

    Where no language was learned, all texts with letters stay. A text of four or more
    languages of which none has the least share of its letters is rejected, too.
    """
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((chain.labels, chain.weights, chain.lexicon, chain.moves, chain.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*shared.value)
        for batch in batches:
            for b in lots(batch):
                texts = b.column(at).to_pylist()
                if model.labels:
                    keep = [lang != "und" and score >= least for lang, score in model.documents(texts)]
                else:
                    keep = [bool(words_of(t)) for t in texts]
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
