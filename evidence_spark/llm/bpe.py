"""Byte-level BPE encoding and decoding by merge replay over the words of many documents.

A tokenizer's pattern cuts every text into words; merges never cross a word's border, so
each distinct word is merged once for all its places. The words of a lot of documents that
are new to a worker (whole entries of the vocabulary need no merge) are laid out as one
row of symbols with links to their neighbours. An inverted index leads from the token that
a pair of neighbours makes to the places of all such pairs. Every merge is applied to all
its places at once, in rank order, and only the two neighbours of a place are looked up
and indexed anew. Should a neighbour's new pair come before the merge at hand, the places
left wait until it is done, so every word sees its merges in exactly the library's order.

Lots are bounded by the length of their texts; a worker keeps the words it has encoded
and drops them all when a lot begins with more than WORDS. Nothing is shuffled,
so a lost executor costs its own tasks only. Decoding maps ids to their bytes.

Defined cases: a null or empty text has no ids (an empty array) and decodes to no bytes;
null ids decode to null, an id that the vocabulary lacks raises an error; texts of any
length and words of any length are encoded whole; special strings are ordinary text;
repeated rows stay as they are, ids may be null or repeat; an empty table gives no rows;
of a table's columns only the two named ones are read, whatever else they are called.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .tokens import OTHER_SPACE, SEGMENT

#: Characters of a lot's texts; a longer text is a lot of its own.
LOT = 4 << 20
#: Words that a worker keeps encoded.
WORDS = 300_000


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay:
    """Merges of a vocabulary, applied to many words together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.shift = max(ranks.values(), default=0).bit_length() or 1
        self.single = np.array([ranks.get(bytes((b,)), -1) for b in range(256)], np.int32)
        #: Two neighbours -> the token they make, which is its merge's rank.
        self.made: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.made[a << self.shift | b] = rank
        get = self.made.get
        self.first = np.array([[get(int(a) << self.shift | int(b), -1) if a >= 0 and b >= 0 else -1 for b in self.single] for a in self.single], np.int32)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, four bytes each."""
        if not any(words):
            return [b""] * len(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        n, sizes = len(data), np.array([len(w) for w in words], np.int64)
        ends = sizes.cumsum()
        symbols = self.single[data]
        if symbols.min() < 0:
            raise ValueError("the vocabulary lacks a single byte")
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1

        makes = np.where(after[:-1] >= 0, self.first[data[:-1], data[1:]], -1)
        order = makes.argsort(kind="stable").astype(np.int32)
        present, starts = np.unique(makes[order], return_index=True)
        bounds = {r: span for r, span in zip(present.tolist(), itertools.pairwise([*starts.tolist(), len(order)]), strict=True) if r >= 0}
        heap = sorted(bounds)

        tok, nxt, prv = (array.array("i", x.astype(np.int32).tobytes()) for x in (symbols, after, before))
        added: dict[int, list[int]] = {}
        get, shift, push = self.made.get, self.shift, heapq.heappush
        while heap:
            rank = heapq.heappop(heap)
            lo, hi = bounds.pop(rank, (0, 0))
            places = order[lo:hi].tolist()
            if rank in added:
                places = sorted(places + added.pop(rank))
            for at, i in enumerate(places):
                left, j = tok[i], nxt[i]
                if left < 0 or j < 0 or get(left << shift | tok[j]) != rank:
                    continue  # the pair is gone
                k, p, least = nxt[j], prv[i], rank
                tok[i], tok[j], nxt[i] = rank, -1, k
                if k >= 0:
                    prv[k] = i
                    if (new := get(rank << shift | tok[k])) is not None:
                        if new in added:
                            added[new].append(i)
                        else:
                            added[new] = [i]
                            if new not in bounds:
                                push(heap, new)
                        if new < least:
                            least = new
                if p >= 0 and (new := get(tok[p] << shift | rank)) is not None:
                    if new in added:
                        added[new].append(p)
                    else:
                        added[new] = [p]
                        if new not in bounds:
                            push(heap, new)
                    if new < least:
                        least = new
                if least < rank:
                    if rest := places[at + 1 :]:
                        added[rank] = rest
                        push(heap, rank)
                    break
        ids = np.frombuffer(tok, np.int32)
        kept = ids >= 0
        raw, stops = ids[kept].astype("<i4").tobytes(), 4 * np.concatenate([[0], kept.cumsum()])
        return [raw[a:b] for a, b in zip(stops[ends - sizes].tolist(), stops[ends].tolist(), strict=True)]


class Encoder:
    """Ids of texts, lot by lot."""

    def __init__(self, path: str, pattern: str):
        self.replay = Replay(ranks_of(path))
        self.pattern = regex.compile(pattern)
        self.words: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """Parts of a text that begin at a border of words; the same few where white space is plain."""
        return SEGMENT.findall(text) if text.isascii() or not OTHER_SPACE.search(text) else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts are a lot."""
        if len(self.words) > WORDS:
            self.words.clear()
        whole, words = self.replay.ranks, self.words
        cut = [self.segments(t) for t in texts]
        split = {s: () for segments in cut for s in segments}
        fresh: dict[str, bytes] = {}
        for s in split:
            split[s] = found = self.pattern.findall(s)
            for w in found:
                if w not in words and w not in fresh:
                    raw = w.encode()
                    if (known := whole.get(raw)) is not None:
                        words[w] = known.to_bytes(4, "little")
                    else:
                        fresh[w] = raw
        words.update(zip(fresh, self.replay.encode(list(fresh.values())), strict=True))
        ids = {s: words[found[0]] if len(found) == 1 else b"".join(map(words.__getitem__, found)) for s, found in split.items()}
        return [b"".join(map(ids.__getitem__, segments)) for segments in cut]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: t for t, i in ranks_of(path).items()}


def lots(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of LOT characters at the most, or a single one."""
    lot, size = [], 0
    for t in texts:
        if lot and size + len(t) > LOT:
            yield lot
            lot, size = [], 0
        lot.append(t)
        size += len(t)
    if lot:
        yield lot


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and ids (array of int) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, pattern)
        for batch in batches:
            at = 0
            for lot in lots([t.as_py() or "" for t in batch.column(1)]):
                found = model.encode(lot)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(found))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lot)), pa.ListArray.from_arrays(pa.array(offsets), values)], ["_id", "ids"])
                at += len(lot)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, ids array<int>")


def decode(coded: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds name: the bytes that the ids stand for, in place of a column that has that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            column = batch.column(names.index(ids_col))
            out = []
            for ids in column:
                try:
                    out.append(b"".join(map(table.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid else None)
                except KeyError as e:
                    raise ValueError(f"the vocabulary has no id {e}") from None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, name])

    rows = coded.drop(name)
    names = rows.columns
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, BinaryType())]))
