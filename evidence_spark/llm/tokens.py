"""Token counts from a compiled byte-pair tokenizer, and token ids cached by segment.

Counting. A byte-pair tokenizer is compiled, as far as the input needs it, into a
deterministic transducer over bytes. The last token of every prefix of a piece is
unique: it is the token that ends there and may follow the last token of the prefix
before it, where two tokens may follow each other if their bytes together are cut into
just these two. So a state holds the longest suffix that begins some longer token and, for
each place in it where a later token may start, the last token and the count there
relative to now; each
transition is annotated with the tokens it adds (a token may also swallow earlier ones,
so this can be below zero). Pieces are separated by the tokenizer's pattern, and the
transducer starts anew at each.

A chunk of a text is a map of states: from the state it is entered in to the state it is
left in and the tokens added on the way. A state is the piece that is open (its kind and
the transducer's state in it, or a few characters that may still become a contraction), so
a chunk may end anywhere: within a word, a run of digits or of white space of any kind.
Maps compose, and a text's count is that of its chunks' maps composed in order, from the
state before any text. Texts of more than CHUNK characters are dealt out as rows of chunks.
Each is mapped for the state that the characters before it suggest; transducers forget
quickly, so that is nearly always the state the chunk before is left in. Where it isn't,
the chunks are mapped for the states found, round by round, until the maps compose. Only
maps meet per text, a state and a number for each chunk: no task reads a whole long text,
whatever it is made of.

Defined cases: a null or empty text has no tokens; special strings inside a text count
as the library's default has it, one token each; texts of any length are read whole;
repeated rows are counted each on its own, ids may be null; an empty table gives no rows;
columns beyond the two named ones are not read, whatever they are called.
"""

from __future__ import annotations

import array
import ast
import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, stored

#: Characters of a chunk; before a chunk, those that suggest the state it is entered in.
CHUNK, LEAD = 1 << 14, 256
#: Entries after which a worker drops its cached segments or states and compiles anew.
CACHE, STATES = 150_000, 400_000
#: Segments for caching: a run of ASCII white space with what follows it. Each begins at
#: a sure boundary unless other white space stands before it.
SEGMENT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: Runs of letters, numbers, white space and others, at the start of a text and at its end.
KINDS = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s", "O": r"[^\s\p{L}\p{N}]"}
FIRST = {k: regex.compile(f"{c}*+") for k, c in KINDS.items()}
LAST = {k: regex.compile(f"(?r){c}*+$") for k, c in KINDS.items()}
SPACE_BEFORE = regex.compile(r"(?r)\s*+$")
#: What may still become a contraction with what follows.
OPEN_CONTRACTIONS = ("r", "v", "l")
#: The state before any text: nothing is open.
START = ("", "")


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def as_bytes(token: str) -> bytes:
    letters = byte_letters()
    return bytes(letters[c] for c in token)


def vocabulary(path: str) -> dict:
    spec = json.load(open(path, encoding="utf-8"))
    if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("a byte-level vocabulary without normalizer is needed")
    return spec


#: A transducer's state at the start of a piece.
EMPTY = (b"", ((None, 0),))


class Transducer:
    """Tokens of one piece, by transitions compiled on first use."""

    def __init__(self, tokens: set[bytes], merges: dict[tuple[bytes, bytes], int]):
        self.tokens, self.merges = tokens, merges
        #: What a longer token may begin with: only there can a later token start.
        self.stems = {t[:i] for t in tokens for i in range(len(t))}
        self.split = {}
        for (a, b), rank in merges.items():
            self.split.setdefault(a + b, (a, b, rank))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states = [EMPTY]
        self.ids = {self.states[0]: 0}
        #: state and byte -> next state, shifted by 9 bits, and tokens added, plus 256
        self.moves: dict[int, int] = {}
        self.places: dict[tuple, tuple] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The pieces by the merge list itself; for short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.merges.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one edge (0 left, 1 right) while a token is merged, each with the rank of the merge that ends it."""
        out, ends = [(token, 1 << 60)], 1 << 60
        while made := self.split.get(token):
            ends, token = made[2], made[side]
            out.append((token, ends))
        return out

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether a and b stay two tokens: no merge across their border comes first."""
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) > STATES:
                self.pairs.clear()
            right, left, get = self.edge(a, 1), self.edge(b, 0), self.merges.get
            # Of equal merges the leftmost comes first: the one across the border before b's own.
            ok = self.pairs[a, b] = not any((r := get((x, y))) is not None and r < ends and r <= until for x, ends in right for y, until in left)
        return ok

    def stands(self, t: bytes) -> bool:
        if (ok := self.whole.get(t)) is None:
            ok = self.whole[t] = t in self.tokens and self.merge(t) == [t]
        return ok

    def compile(self, state: int, byte: int) -> int:
        suffix, window = self.states[state]
        grown = suffix + bytes((byte,))
        size = len(grown)
        for k in range(size):
            token = grown[k:]
            if (place := window[k]) is not None and self.stands(token) and (place[0] is None or self.follows(place[0], token)):
                break
        else:
            raise ValueError("no token ends here")
        added = place[1] + 1
        if not -256 <= added < 256:
            raise ValueError("a transition's count takes nine bits")
        k = next(k for k in range(size + 1) if grown[k:] in self.stems)
        shared = self.places.setdefault
        kept = [shared(q := (p[0], p[1] - added), q) if (p := window[i]) is not None and grown[i:] in self.stems else None for i in range(k, size)]
        new = (grown[k:], (*kept, shared(q := (token, 0), q)))
        if (to := self.ids.get(new)) is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
        move = self.moves[state << 8 | byte] = to << 9 | added + 256
        return move

    def run(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        """The state that data leads to, and the tokens added."""
        if len(self.moves) > STATES:
            self.reset()
        if (at := self.ids.get(state)) is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
        end, n = self.walk(at, data)
        return self.states[end], n

    def count(self, data: bytes) -> int:
        if len(self.moves) > STATES:
            self.reset()
        return self.walk(0, data)[1]

    def walk(self, state: int, data: bytes) -> tuple[int, int]:
        moves, n = self.moves, 0
        for b in data:
            move = moves.get(state << 8 | b)
            if move is None:
                move = self.compile(state, b)
            state = move >> 9
            n += (move & 511) - 256
        return state, n


class Counter(dict):
    """Counts by segment, filled from the transducer."""

    def __init__(self, path: str):
        super().__init__()
        spec = vocabulary(path)
        special = {t["content"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.transducer = Transducer({as_bytes(t) for t in spec["model"]["vocab"] if t not in special}, {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)})
        import public_tokenizers

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, segment: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self[segment] = self.pieces(segment)
        return n

    def pieces(self, text: str) -> int:
        return sum(self.transducer.count(p.encode()) for p in self.pattern.findall(text))

    def plain(self, text: str) -> int:
        """Tokens of a text taken alone."""
        if text.isascii() or not OTHER_SPACE.search(text):
            return sum(map(self.__getitem__, SEGMENT.findall(text)))
        return self.pieces(text)

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        return len(parts) - 1 + sum(map(self.plain, parts))

    def open(self, text: str) -> tuple[tuple, int]:
        """(state, tokens) after a text that begins at a border of pieces; special strings are ordinary text."""
        if not text:
            return START, 0
        kind = next(k for k, r in FIRST.items() if r.match(text[-1]).end())
        at = LAST[kind].search(text).start()
        if kind == "S":
            closed, run = text[:at], text[at:]
            state, n = self.transducer.run(EMPTY, run[:-1].encode())
            return ("S", *state, run[-1]), self.plain(closed) + n
        if kind == "L" and at and text[at - 1] == "'":
            at = LAST["O"].search(text, 0, at).start()
        at = SPACE_BEFORE.search(text, 0, at).start()
        n, parts = self.plain(text[:at]), self.pattern.findall(text[at:])
        last = parts.pop()
        if kind == "L" and last in OPEN_CONTRACTIONS and parts and parts[-1] == "'":
            last = parts.pop() + last
            state = ("", last)
        elif kind == "L" and last[0] == "'":  # a contraction, which ends its piece
            n += self.transducer.count(last.encode())
            state = START
        elif last == "'":
            state = ("", last)
        else:
            inner, more = self.transducer.run(EMPTY, last.encode())
            n += more
            state = (kind, *inner)
        return state, n + sum(self.transducer.count(p.encode()) for p in parts)

    def advance(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The map of a chunk at one state: the state it is left in and the tokens added."""
        kind = state[0]
        if not text:
            return state, 0
        if kind == "":
            return self.open(state[1] + text)
        run = FIRST[kind].match(text).group()
        if kind != "S":
            inner, n = self.transducer.run(state[1:3], run.encode())
            if len(run) == len(text):
                return (kind, *inner), n
            end, more = self.open(text[len(run) :])
            return end, n + more
        inner, last = state[1:3], state[3]
        n = 0
        if run:
            inner, n = self.transducer.run(inner, (last + run[:-1]).encode())
            last = run[-1]
        if len(run) == len(text):
            return ("S", *inner, last), n
        # The last space before anything else joins it; another character stands alone.
        joined = " " if last == " " else ""
        alone = 0 if joined else self.transducer.count(last.encode())
        end, more = self.open(joined + text[len(run) :])
        return end, n + alone + more

    def finish(self, state: tuple) -> int:
        """The tokens that the end of the text adds."""
        if state[0] == "":
            return self.plain(state[1])
        return self.transducer.run(state[1:3], state[3].encode())[1] if state[0] == "S" else 0


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


MAPS = "_row long, segment int, at int, entry string, leaves string, n long"


def mapped(chunks: DataFrame, path: str) -> DataFrame:
    """The map of every chunk (_row, segment, at, lead, part) at its state: that in a column entry, or else the one that lead suggests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            entries, leaves, counts = [], [], []
            for at, lead, part, entry in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                state = ast.literal_eval(entry) if entry is not None else c.advance(START, lead)[0] if at else START
                end, n = c.advance(state, part)
                entries.append(repr(state))
                leaves.append(repr(end))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(entries, pa.string()), pa.array(leaves, pa.string()), pa.array(counts, pa.int64())], ["_row", "segment", "at", "entry", "leaves", "n"])

    return chunks.select("_row", "segment", "at", "lead", "part", "entry").mapInArrow(run, MAPS)


def composed(maps: DataFrame) -> DataFrame:
    """(_row, segment, leaves, n) of every segment: its chunks' maps composed in order; leaves is empty where a map lacks the state it is entered in."""
    known = maps.groupBy("_row", "segment", "at").agg(F.map_from_entries(F.collect_list(F.struct("entry", F.struct("leaves", "n").alias("to")))).alias("map"))
    chain = known.groupBy("_row", "segment").agg(F.array_sort(F.collect_list(F.struct("at", "map")), lambda a, b: a["at"] - b["at"]).alias("chain"))
    begin = F.struct(F.lit(repr(START)).alias("leaves"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        to = F.try_element_at(x["map"], a["leaves"])
        return F.struct(F.coalesce(to["leaves"], F.lit("")).alias("leaves"), (a["n"] + F.coalesce(to["n"], F.lit(0))).alias("n"))

    return chain.select("_row", "segment", F.aggregate("chain", begin, step).alias("c")).select("_row", "segment", "c.leaves", "c.n")


def chunked_counts(rows: DataFrame, path: str, size: int, lead: int) -> DataFrame:
    """_id, n_bytes and n_tokens of long texts, from maps of chunks that all tasks share."""
    c = counter(path)
    cut_at = F.lit(c.special.pattern) if c.special else F.lit("(?!)")
    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.char_length("_segment") - 1, F.lit(0)) / size).cast("int")),
        lambda i: F.struct(F.substr("_segment", F.greatest(i * size - lead, F.lit(0)) + 1, F.least(i * size, F.lit(lead))).alias("lead"), F.substr("_segment", i * size + 1, F.lit(size)).alias("part")),
    )
    whole = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_id", "n_bytes", F.posexplode(F.split("_text", cut_at, -1)).alias("segment", "_segment"))
    chunks = whole.select("_row", "_id", "n_bytes", "segment", F.posexplode(parts).alias("at", "_p")).select("_row", "_id", "n_bytes", "segment", "at", "_p.lead", "_p.part")
    chunks = stored(chunks.repartition(partitions(rows.sparkSession), "_row", "segment", "at"))
    maps = cut(mapped(chunks.withColumn("entry", F.lit(None).cast("string")), path))
    while True:  # each round settles one more chunk of every open segment, at least
        done = cut(composed(maps))
        open_ = done.filter("leaves = ''")
        if not open_.limit(1).count():
            break
        mine = maps.join(open_.select("_row", "segment"), ["_row", "segment"], "left_semi")
        found = mine.select("_row", "segment", (F.col("at") + 1).alias("at"), F.col("leaves").alias("entry")).distinct()
        new = found.join(mine.select("_row", "segment", "at", "entry"), ["_row", "segment", "at", "entry"], "left_anti")
        maps = cut(maps.unionByName(mapped(chunks.join(new, ["_row", "segment", "at"]), path)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            last = [c.finish(ast.literal_eval(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n + m for n, m in zip(batch.column(2).to_pylist(), last, strict=True)], pa.int64())], ["_row", "n"])

    ended = done.select("_row", "leaves", "n").mapInArrow(finish, "_row long, n long")
    totals = ended.groupBy("_row").agg((F.sum("n") + F.count("*") - 1).alias("n_tokens"))  # special strings stand between segments
    return chunks.filter("segment = 0 and at = 0").select("_row", "_id", "n_bytes").join(totals, "_row").select("_id", "n_bytes", "n_tokens")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, lead: int = LEAD) -> DataFrame:
    """_id, n_bytes and n_tokens of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = pa.array((c.count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["_id", "n_bytes", "n_tokens"])

    bytes_ = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), bytes_.alias("n_bytes"), F.col(text_col).cast("string").alias("_text"))
    one = F.coalesce(F.char_length("_text") <= size, F.lit(True))  # a single chunk is its text's whole map
    short = rows.filter(one).mapInArrow(count, f"_id {dict(rows.dtypes)['_id']}, n_bytes long, n_tokens long")
    return short.unionByName(chunked_counts(rows.filter(~one), path, size, lead))


class Encoder(dict):
    """Token ids (little-endian, four bytes each) by segment.

    The vocabulary is the tokenizers library's file; segments are merged by tiktoken,
    which gives the same ids several times faster (the tests hold one against the other).
    """

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import tiktoken

        spec = vocabulary(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def __missing__(self, segment: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        ids = self[segment] = self.pieces(segment)
        return ids

    def pieces(self, text: str) -> bytes:
        return array.array("I", self.model.encode_ordinary(text)).tobytes()

    def plain(self, text: str) -> bytes:
        if text.isascii() or not OTHER_SPACE.search(text):
            return b"".join(map(self.__getitem__, SEGMENT.findall(text)))
        return self.pieces(text)

    def encode(self, text: str) -> bytes:
        if not self.split or not self.split.search(text):
            return self.plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.plain(p) for p in self.split.split(text))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)

