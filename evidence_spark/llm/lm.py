"""Cross-entropy difference under two matched bigram models.

Both models, target and background, hold every word and every bigram with its exact
count, whatever the input's size, and have the same smoothing: a bigram's share of its
first word, weighed against the word's own share by how often the first word was seen.
A word's own share has ADDED put to every count, for as many words as the background
has, VOCABULARY at least. The background is every document, the target those chosen. A
target document's own counts are taken out of the target before it is scored, so that it
is not its own model (the background holds every document scored alike). A document's
score is the mean over its words of target loss less background loss, in
nats: the lower, the more it resembles the target.

Documents are dealt into lots by a hash of the row, and travel compressed with the others
that their task holds of a lot. A lot's distinct words and bigrams, counted, go to the bucket of their hash, where all lots' counts are added up; each
bucket sends every lot the totals of the lot's own keys, in the keys' order, and there
the texts are scored. So a key travels once per lot, however common it is, and no
vocabulary or table of counts meets in one place. Words and bigrams are held by 63-bit
hashes; losses are added in steps of 2^-32, so equal texts score equally in any lot.

Defined cases: a null or wordless text has no words and a null score; with an empty
target all counts of the target are 0 and its loss is that of equal shares; equal rows
score equally if all or none of them are in the target (a copy counts for the others, not
for itself); texts of any length are read whole; an empty table gives no rows; a document marked several times as target counts once; columns beyond id
and text are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .jaccard import LONGS, ODD, Words, scramble

#: Words that smoothing provides for at least.
VOCABULARY = 32_768
#: Weight of the word's own share in the mix with the bigram's; added count of every word.
BACK_OFF, ADDED = 20.0, 0.5
#: About so many words in a lot and a bucket at most; buckets at least.
LOT, BUCKET, BUCKETS = 400_000, 4_000_000, 64
#: Bytes of documents that a task holds before it hands their lots on.
HELD = 32 << 20
STEPS = 2.0**32
#: What stands before a text's first word; words have odd keys, bigrams even ones.
START = np.uint64(1)


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


class Keys:
    """Every word of the texts, the one before it and their bigram by key, and the distinct keys in order."""

    def __init__(self, texts: list, words: Words):
        lists = [split(t) for t in texts]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        n = int(self.sizes.sum())
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        word = scramble(np.fromiter((words[w] for x in lists for w in x), np.uint64, n)) | np.uint64(1)
        before = np.roll(word, 1)
        before[self.starts] = START
        pair = scramble(before * ODD + word) & ~np.uint64(1)
        self.distinct, at = np.unique(np.concatenate([word, pair, np.full(len(self.starts), START)]), return_inverse=True)
        self.word, self.pair, self.start = at[:n], at[n : 2 * n], at[2 * n :]
        self.before = np.roll(self.word, 1)
        self.before[self.starts] = self.start

    @functools.cached_property
    def of(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each word, its bigram and what stands before it occur in its own text."""
        n, text = len(self.word), self.of * len(self.distinct)
        _, at, times = np.unique(np.concatenate([text + self.word, text + self.pair]), return_inverse=True, return_counts=True)
        word, pair = times[at[:n]], times[at[n:]]
        before = np.roll(word, 1)
        before[self.starts] = 1
        return word, pair, before

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each distinct key occurs in the chosen texts."""
        of, some = np.repeat(chosen, self.sizes), chosen[self.sizes > 0]
        return np.bincount(np.concatenate([self.word[of], self.pair[of], self.start[some]]), minlength=len(self.distinct))


def packed(keys: np.ndarray, base: int) -> bytes:
    """Ascending keys from base on, as differences of as many bytes as the greatest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(base))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, base: int) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, : data[0]] = raw
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(base)


def table_of(counts: np.ndarray) -> bytes:
    """Counts in numbers as narrow as the greatest needs."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return kind.char.encode() + zlib.compress(np.ascontiguousarray(counts, kind).tobytes(), 1)


def counts_of(data: bytes) -> np.ndarray:
    """[background or target, key]"""
    return np.frombuffer(zlib.decompress(data[1:]), data[:1].decode()).astype(np.int64).reshape(2, -1)


def by_lot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_lot, rows): the rows of every lot that a task holds, compressed."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by("_lot").combine_chunks()
        lots = t["_lot"].to_numpy()
        starts = np.flatnonzero(np.diff(lots, prepend=-1))
        blobs = []
        for i, j in zip(starts, np.r_[starts[1:], len(lots)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(t.slice(i, j - i))
            blobs.append(sink.getvalue().to_pybytes())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(lots[starts]), pa.array(blobs, pa.binary())], ["_lot", "rows"])

    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size > HELD:
            size = 0
            yield flush()
    if held:
        yield flush()


def rows_of(lot: pa.Table) -> pa.Table:
    """The documents of a lot."""
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for x in lot["rows"].chunks for b in x])


class Models(NamedTuple):
    """The documents both models count: _id, _text and whether each is in the target."""

    rows: DataFrame
    source: DataFrame
    columns: tuple[str, str]


def fit(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """target: the ids (_id) of the target documents. The counting itself is done with the scoring."""
    chosen = cut(target.select(F.col("_id").cast("long").alias("_key")).filter("_key is not null").distinct().withColumn("_target", F.lit(True)))
    if chosen.limit(LONGS + 1).count() <= LONGS:
        chosen = F.broadcast(chosen)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    key = rows["_id"].cast("long")
    named = rows.filter(key.isNotNull()).join(chosen, key == chosen["_key"], "left").select("_id", "_text", F.coalesce("_target", F.lit(False)).alias("_target"))
    return Models(named.unionByName(rows.filter(key.isNull()).withColumn("_target", F.lit(False))), docs, (id_col, text_col))


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_words, target_loss, background_loss and score of every document."""
    yes, no = F.lit(True), F.lit(False)
    kind = dict(docs.select(F.col(id_col).alias("_id")).dtypes)["_id"]
    rows = models.rows.withColumn("_counts", yes).withColumn("_scored", yes)
    if docs is not models.source or (id_col, text_col) != models.columns:
        others = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), no.alias("_target"), no.alias("_counts"), yes.alias("_scored"))
        rows = rows.withColumn("_scored", no).withColumn("_id", F.lit(None).cast(kind)).unionByName(others)
    words = (rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // 6  # words of some six bytes
    lots = max(words // LOT + 1, 2 * partitions(docs.sparkSession))
    bits = max(BUCKETS.bit_length() - 1, (words // BUCKET).bit_length())
    shift, buckets = 64 - bits, 1 << bits
    rows = rows.withColumn("_lot", F.pmod(F.xxhash64("_id", "_text"), F.lit(lots))).mapInArrow(by_lot, "_lot long, rows binary")

    def count(lot: pa.Table) -> pa.Table:
        lot = rows_of(lot)
        keys = Keys(lot["_text"].to_pylist(), Words())
        counted, target = (np.array(lot[c].to_pylist(), bool) for c in ("_counts", "_target"))
        both = np.stack([keys.counts(counted), keys.counts(target)])
        edges = np.r_[np.searchsorted(keys.distinct, np.arange(buckets, dtype=np.uint64) << np.uint64(shift)), len(keys.distinct)]
        asks = any(lot["_scored"].to_pylist())
        data = [(packed(keys.distinct[i:j], b << shift), table_of(both[:, i:j])) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False))]
        cols = [pa.array([lot["_lot"][0].as_py()] * buckets, pa.int64()), pa.array(range(buckets), pa.int32()), pa.array([asks] * buckets)]
        return pa.Table.from_arrays([*cols, *[pa.array([d[i] for d in data], pa.binary()) for i in (0, 1)]], ["_lot", "bucket", "asks", "keys", "data"])

    def add(bucket: pa.Table) -> pa.Table:
        base = bucket["bucket"][0].as_py() << shift
        keys = [unpacked(k, base) for k in bucket["keys"].to_pylist()]
        ends = np.cumsum([0, *map(len, keys)])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        both = np.concatenate([counts_of(d) for d in bucket["data"].to_pylist()], 1)
        total = np.zeros((2, len(distinct)), np.int64)
        for k in (0, 1):
            np.add.at(total[k], at, both[k])
        word = (distinct & np.uint64(1)).astype(bool) & (distinct != START)
        facts = [int((total[0, word] > 0).sum()), int(total[0, word].sum()), int(total[1, word].sum())]
        asks = [i for i, x in enumerate(bucket["asks"].to_pylist()) if x]
        cols = [bucket["_lot"].take(pa.array(asks, pa.int64())), pa.array([bucket["bucket"][0].as_py()] * len(asks), pa.int32())]
        answers = pa.array([table_of(total[:, at[ends[i] : ends[i + 1]]]) for i in asks], pa.binary())
        return pa.Table.from_arrays([*cols, answers, *[pa.array([x] * len(asks), pa.int64()) for x in facts]], ["_lot", "bucket", "data", "vocabulary", "background", "target"])

    def losses(lot: pa.Table, answers: pa.Table) -> pa.Table:
        lot = rows_of(lot)
        scored = np.array(lot["_scored"].to_pylist(), bool)
        if len(answers) != (buckets if scored.any() else 0):
            raise ValueError(f"{len(answers)} of {buckets} buckets answered")
        keys = Keys(lot["_text"].to_pylist(), Words())
        answers = answers.sort_by("bucket")
        counts = np.concatenate([counts_of(d) for d in answers["data"].to_pylist()] or [np.zeros((2, 0), np.int64)], 1)
        vocabulary = max(VOCABULARY, sum(answers["vocabulary"].to_pylist()))
        mean = np.zeros((2, len(keys.sizes)))
        counted, target = (np.array(lot[c].to_pylist(), bool) for c in ("_counts", "_target"))
        for k, (name, inside) in enumerate((("background", np.zeros_like(target)), ("target", counted & target))):
            if len(answers):
                word, pair, before = (counts[k][at] - mine * inside[keys.of] for at, mine in zip((keys.word, keys.pair, keys.before), keys.own(), strict=True))
                all_words = (sum(answers[name].to_pylist()) - keys.sizes * inside)[keys.of]
                own = (word + ADDED) / (all_words + ADDED * vocabulary)
                loss = -np.log((pair + BACK_OFF * own) / (before + BACK_OFF))
                total = np.r_[0, np.cumsum(np.rint(loss * STEPS).astype(np.int64))]
                ends = np.cumsum(keys.sizes)
                mean[k] = (total[ends] - total[ends - keys.sizes]) / STEPS / np.maximum(keys.sizes, 1)
        none = keys.sizes == 0
        cols = [pa.array(x, pa.float64(), mask=none) for x in (mean[1], mean[0], mean[1] - mean[0])]
        out = pa.Table.from_arrays([lot["_id"], pa.array(keys.sizes), *cols], ["_id", "n_words", "target_loss", "background_loss", "score"])
        return out.filter(pa.array(scored))

    asked = rows.groupBy("_lot").applyInArrow(count, "_lot long, bucket int, asks boolean, keys binary, data binary")
    answered = asked.groupBy("bucket").applyInArrow(add, "_lot long, bucket int, data binary, vocabulary long, background long, target long")
    shape = f"_id {kind}, n_words long, target_loss double, background_loss double, score double"
    return rows.groupBy("_lot").cogroup(answered.groupBy("_lot")).applyInArrow(losses, shape)
