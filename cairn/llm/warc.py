"""Zstandard-compressed WARC archives: a writer and a reader.

An archive begins with a skippable frame that holds the compression dictionary (itself compressed or plain); then comes
one frame for each record. The reader loads the dictionary, decodes frame by frame and never holds more than one record;
it checks magic numbers, the version line, the headers that a record must have, the declared lengths, the blank lines that
end a record, and payload digests. Anything else is an error that names the archive and the place in it.

Archives are files in a folder that all machines share; each write task makes some and lists those that are whole, so what
a lost executor has left unfinished is never read. A file is written under a name of its own and renamed when complete.

Dictionaries are trained on a bounded sample: the first `sample_bytes` of an archive's own payloads.

Nulls: a null payload is empty; a null page_id is written as an empty header and read as null. Repeated rows and ids each
give a record. Empty tables give no archive and no record. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import in_arrow, new_folder, stored, table

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first != VERSION:
        raise ValueError(f"not a record of {VERSION.decode()}: {raw[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line!r}")
        if name in headers:
            raise ValueError(f"header {name} twice")
        headers[name] = value.strip()
    if missing := [n for n in NEEDED if n not in headers]:
        raise ValueError(f"headers missing: {missing}")
    if not headers["Content-Length"].isdecimal():
        raise ValueError(f"bad Content-Length {headers['Content-Length']!r}")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, but {len(rest) - 4} bytes and the end follow")
    return headers, rest[:length]


class Writer:
    def __init__(self, out: BinaryIO, dictionary: bytes = b"", level: int = 3):
        self.out = out
        body = zstandard.ZstdCompressor(level=level).compress(dictionary) if dictionary else b""
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        of = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=of, write_content_size=True, write_checksum=True)

    def write(self, raw: bytes) -> None:
        self.out.write(self.compressor.compress(raw))


def read_frames(source: BinaryIO, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    head = source.read(8)
    if len(head) < 8 or (parts := struct.unpack("<II", head))[0] != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    body = source.read(parts[1])
    if len(body) != parts[1]:
        raise ValueError("the dictionary frame is cut off")
    if body[:4] == FRAME_MAGIC:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if body and body[:4] != DICTIONARY_MAGIC:
        raise ValueError("the leading frame holds no dictionary")
    of = zstandard.ZstdCompressionDict(body) if body else None
    left = b""
    while True:
        left = left or source.read(chunk)
        if not left:
            return
        while len(left) < 4 and (more := source.read(chunk)):
            left += more
        if left[:4] != FRAME_MAGIC:
            raise ValueError(f"no frame where one must begin: {left[:4]!r}")
        frame, out = zstandard.ZstdDecompressor(dict_data=of).decompressobj(), []
        while not frame.eof:
            if not left:
                left = source.read(chunk)
                if not left:
                    raise ValueError("the last frame is cut off")
            out.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def train(samples: list[bytes], dictionary_bytes: int) -> bytes:
    """A dictionary, or none where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples, level=3).as_bytes() if len(samples) > 15 else b""
    except zstandard.ZstdError:
        return b""


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(folder: str) -> str:
    return "file://" + folder[len("file:") :] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def deduplicated(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the largest page_id of those with the same payload, null on that one itself and where the ids are null.

    Digests alone are brought together, counted by payload in every task first; a page learns by its id and digest what it refers to, so the copies of a payload stay where they are spread."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("mark", F.sha1("payload"))
    ids = rows.select("page_id", "mark").filter("page_id is not null")
    last = ids.groupBy("mark").agg(F.max("page_id").alias("last"), F.min("page_id").alias("least")).filter("least < last")
    known = stored(ids.distinct().join(last, "mark").filter("page_id < last").select(F.col("page_id").alias("_id"), F.col("mark").alias("_mark"), F.col("last").alias("refers_to")), "revisits")
    return rows.join(known, (rows.page_id == F.col("_id")) & (rows.mark == F.col("_mark")), "left").select("page_id", "url", "payload", "refers_to")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20, sample_bytes: int = 1 << 20, dictionary_bytes: int = 64 << 10, level: int = 3) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) and returns the archives that are whole: (path, records, bytes)."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        held: list[tuple] = []
        size = 0
        writer = out = None
        name, records, written = "", 0, 0

        def begin() -> None:
            nonlocal writer, out, name, records, written
            name, records, written = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
            out = fs.open_output_stream(f"{name}.part", compression=None)
            writer = Writer(out, train([p for _, _, p, r in held if r is None and p], dictionary_bytes), level)

        def put() -> None:
            nonlocal records, written, held, size
            for page_id, url, payload, refers in held:
                of = digest(payload)
                headers = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": " ".join((url or "").split()), "WARC-Payload-Digest": f"sha1:{of}", "X-Page-ID": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload))}
                if refers is not None:
                    headers |= {"WARC-Refers-To": record_id(refers), "X-Refers-To-Page": str(refers), "WARC-Profile": REVISIT}
                raw = record(headers, payload if refers is None else b"")
                writer.write(raw)
                records, written = records + 1, written + len(raw)
            held, size = [], 0

        def close() -> None:
            nonlocal out, writer
            n = out.tell()
            out.close()
            fs.move(f"{name}.part", name)
            done.append((name, records, n))
            writer = out = None

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[2])
                if size >= sample_bytes:
                    if writer is None:
                        begin()
                    put()
                    if written >= archive_bytes:
                        close()
        if held:
            if writer is None:
                begin()
            put()
        if writer is not None:
            close()
        scheme = folder.split("://")[0] + "://" if "://" in folder else ""
        host = "" if scheme in ("", "file://") else folder.split("://")[1].split("/")[0]
        paths = [scheme + (f"{host}{p}" if host and p.startswith("/") else f"{p}") for p, _, _ in done]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["path", "records", "bytes"])

    listed = in_arrow(rows.select("page_id", "url", "payload", "refers_to"), run, "path string, records long, bytes long")
    return stored(listed, "archives")


def read_archives(listed: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record, read one archive at a time."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def row(raw: bytes) -> tuple:
        headers, block = parse_record(raw)
        kind, of = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        length = int(headers.get("X-Payload-Length", len(block)))
        if kind == "response" and (digest(block) != of or length != len(block)):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't have its digest or length")
        if kind == "revisit" and (block or "WARC-Refers-To" not in headers or headers.get("WARC-Profile") != REVISIT):
            raise ValueError(f"bad revisit record {headers['WARC-Record-ID']}")
        page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
        return (int(page) if page else None, headers.get("WARC-Target-URI"), length, of, kind, int(refers) if refers else None, block)[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = _fs(path)
                found, out, size = 0, [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    try:
                        for raw in read_frames(source):
                            out.append(row(raw))
                            found, size = found + 1, size + (len(raw) if with_payload else 200)
                            if size > 4 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                                out, size = [], 0
                    except (ValueError, zstandard.ZstdError) as e:
                        raise ValueError(f"{path}, record {found}: {e}") from e
                if found != expected:
                    raise ValueError(f"{path} has {found} records; its writer listed {expected}")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    count = max(1, listed.count())
    return in_arrow(listed.select("path", "records").repartition(count), run, schema)


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = write_archives(deduplicated(table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    return read_archives(listed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
