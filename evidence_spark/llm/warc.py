"""Zstandard WARC archives: a writer and a reader, one frame per record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
itself perhaps compressed; every record is a frame of its own. A response record holds
the HTTP head and the payload; a revisit record holds the head alone and refers to the
response of the same payload. The reader streams an archive frame by frame and checks
each record: version line, header lines, mandatory fields, Content-Length against the
block and the closing line ends, block digest, payload digest and the HTTP length. A
record that fails comes out with its error, the others unharmed.

Archives are written by the tasks through Arrow's file systems, under names of their own
per attempt; only archives listed by tasks that ended count. An archive is closed at
ARCHIVE_BYTES, so a reading task holds one record at a time and no archive is long.

Defined cases: a null payload is empty; a null URL is written as urn:null; line ends and
spaces in a URL are percent-encoded; an id may be null; of equal payloads of at least
min_revisit bytes every row with the smallest id is the response (rows with null ids only
if no other has the payload); an empty table gives no archive and no row; columns beyond
the three named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup_join, partitions, shared_dir

MAGIC_DICT = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 32 << 20
#: The dictionary is fitted to the starts of so many payloads, chosen by a hash of the payload.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 500, 16_384, 65_536
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: eight groups of twenty bits."""

    def digits(sha: Column) -> Column:
        groups = [F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
        digit = lambda g, s: F.substr(F.lit(BASE32), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1))
        return F.concat(*[digit(g, s) for g in groups for s in (15, 10, 5, 0)])

    return F.element_at(F.transform(F.array(F.sha1(payload)), digits), 1)


def fit_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from bounded samples; raw content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _fields(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode()


def make_record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = head if refers_to is not None else head + payload
    pairs = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{record_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "urn:null" if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + _fields(pairs) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The checked parts of one record; ValueError where it breaks a rule."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not re.fullmatch(r"[!#-'*+.0-9A-Z^-z|~-]+", name):
            raise ValueError(f"bad header line {line[:60]!r}")
        if name.lower() in fields:
            raise ValueError(f"{name} twice")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the block")
    block = rest[:-4]
    if (d := fields.get("warc-block-digest")) and d != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("block digest differs")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not mark or not length:
        raise ValueError("no HTTP head with a length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != int(length[1]):
            raise ValueError("HTTP length does not fit the payload")
        if digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError("payload digest differs")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields or len(digest) != 32:
            raise ValueError("bad revisit")
    else:
        raise ValueError(f"unexpected type {kind}")
    ident = lambda v: v.removeprefix("<urn:page:").removesuffix(">") if v else None
    return {
        "record_id": ident(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload": payload if kind == "response" else None,
        "payload_bytes": int(length[1]), "payload_digest": digest, "refers_to": ident(fields.get("warc-refers-to")), "error": None,
    }


def read_frames(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, each decoded from its own frame."""
    data = stream.read(8)
    raw = b""
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == MAGIC_DICT:
        raw = stream.read(struct.unpack("<I", data[4:])[0])
        if raw[:4] == FRAME:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        data = b""
    engine = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    while data := data or stream.read(piece):
        frame, out = engine.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(piece)):
                raise ValueError("the archive ends inside a frame")
        yield b"".join(out)


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Writes the archives; returns their list (path, records, bytes)."""
    rows = pages.select(F.col(id_col).cast("string").alias("_id"), F.col(id_col).alias("_order"), F.col(url_col).cast("string").alias("_url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("_payload"))
    rows = rows.withColumn("_digest", base32_sha1(F.col("_payload")))
    again = rows.filter(F.octet_length("_payload") >= min_revisit).groupBy("_digest").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = lookup_join(rows, cut(again), "_digest", by=["_order", "_url"], how="left")
    refers = F.when((F.octet_length("_payload") >= min_revisit) & F.col("_first").isNotNull() & ~F.col("_order").eqNullSafe(F.col("_first")), F.col("_first").cast("string"))
    rows = rows.select("_id", "_url", "_payload", "_digest", refers.alias("_refers"))

    # Hashes of payloads are chosen first; only the chosen payloads' starts travel, one for each.
    hashed = pages.filter(F.length(payload_col) > 0).select(F.xxhash64(payload_col).alias("h"), F.substring(F.col(payload_col), 1, SAMPLE_BYTES).alias("p"))
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    sample = hashed.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("p").alias("p")).orderBy("h").collect() if chosen else []
    raw = fit_dictionary([r["p"].encode() for r in sample])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(raw), write_checksum=True, write_content_size=True)
        system, base = _file_system(directory)
        sink, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for ident, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if sink is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    sink = system.open_output_stream(path)
                    if raw:
                        sink.write(struct.pack("<II", MAGIC_DICT, len(raw)) + raw)
                frame = engine.compress(make_record(ident.as_py() or "null", url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
                sink.write(frame)
                size, n = size + len(frame), n + 1
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    done.append((path, n, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    scheme = directory.split("://")[0] + "://" if "://" in directory else ""
    listed = cut(rows.mapInArrow(write, "path string, records long, bytes long"))
    return listed.withColumn("path", F.concat(F.lit(scheme), F.col("path"))) if scheme and scheme != "file://" else listed


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row per record of the archives in the column path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("error", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _file_system(path)
                rows, held = [], 0
                with system.open_input_stream(name) as stream:
                    for raw in read_frames(stream):
                        try:
                            row = parse_record(raw)
                        except (ValueError, UnicodeDecodeError) as e:
                            row = {k: None for k in schema.names} | {"error": str(e)}
                        if not keep_payload:
                            row["payload"] = None
                        rows.append(row | {"path": path})
                        held += len(row["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    out = "path string, record_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, error string"
    return archives.select("path").repartition(partitions(archives.sparkSession), "path").mapInArrow(read, out)


def archive_folder(spark) -> str:
    """A new folder under the shared one."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    system, name = _file_system(path)
    system.create_dir(name, recursive=True)
    return path
