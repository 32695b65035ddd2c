"""Dump files as ordered lines: (dump_id, block, seq, value).

A plain file is read by Spark's text reader, split by split: block is the split's first byte and seq grows along it. A file
that is compressed, whatever its name says, is read by the data source "dump_lines", one task a file, which decodes it and
no more: its lines are dealt to blocks of 65,536 lines. Codecs are told by the first bytes. Lines end at line feeds only. Text that is not UTF-8 is an error.
"""

from __future__ import annotations

import gzip
import io
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import file_system

#: The first bytes of compressed files.
MAGIC = {"zstd": b"\x28\xb5\x2f\xfd", "gzip": b"\x1f\x8b", "xz": b"\xfd7zXZ\x00"}
#: Lines of a block of a compressed file, as a power of two.
BLOCK_BITS = 16
SCHEMA = "dump_id string, block long, seq long, value string"


def codec_of(head: bytes) -> str:
    return next((name for name, magic in MAGIC.items() if head.startswith(magic)), "plain")


def open_stream(path: str):
    """The plain bytes of a file, decoded by what its first bytes say."""
    fs, at = file_system(path)
    raw = fs.open_input_file(at)
    codec = codec_of(raw.read(6))
    raw.seek(0)
    if codec == "gzip":
        return gzip.GzipFile(fileobj=raw)
    if codec == "xz":
        return lzma.LZMAFile(raw)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return raw


def head_of(spark: SparkSession, path: str, n: int = 6) -> bytes:
    """The first bytes, by the file system that Spark would use."""
    return read_at(spark, path, [(0, n)])[0][0]


def read_at(spark: SparkSession, path: str, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """Byte ranges of a file, cut at its end, and its size."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(where).getLen()
    stream, out = fs.open(where), []
    try:
        for at, n in spans:
            stream.seek(min(at, size))
            out.append(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, max(0, min(n, size - at))))) if at < size and n > 0 else b"")
    finally:
        stream.close()
    return out, size


class _File(InputPartition):
    def __init__(self, dump_id: str, path: str):
        super().__init__(path)
        self.dump_id, self.path = dump_id, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_File]:
        return [_File(self.options[f"id{i}"], self.options[f"path{i}"]) for i in range(int(self.options["files"]))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        seq, held, size = 0, [], 0
        with io.TextIOWrapper(io.BufferedReader(open_stream(partition.path), 1 << 20), encoding="utf-8", errors="strict", newline="\n") as lines:
            for line in lines:
                held.append(line.removesuffix("\n"))
                size += len(line)
                if size >= 4 << 20:
                    yield self.batch(partition.dump_id, seq, held)
                    seq, held, size = seq + len(held), [], 0
        yield self.batch(partition.dump_id, seq, held)

    @staticmethod
    def batch(dump_id: str, seq: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([dump_id] * n, pa.string()), pa.array([i >> BLOCK_BITS for i in range(seq, seq + n)], pa.int64()), pa.array(range(seq, seq + n), pa.int64()), pa.array(lines, pa.string())], names=["dump_id", "block", "seq", "value"])


class DumpLines(DataSource):
    """spark.read.format("dump_lines") with files, and id0, path0, id1, ... for each."""

    @classmethod
    def name(cls) -> str:
        return "dump_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_lines(spark: SparkSession, dumps: dict[str, str]) -> DataFrame:
    """The lines of dumps (id -> path)."""
    spark.dataSource.register(DumpLines)
    plain = {i: p for i, p in dumps.items() if codec_of(head_of(spark, p)) == "plain" and not p.endswith((".gz", ".zst", ".bz2", ".lz4", ".snappy", ".deflate", ".xz"))}
    rest = [(i, p) for i, p in dumps.items() if i not in plain]
    out = spark.createDataFrame([], SCHEMA)
    for dump_id, path in plain.items():
        text = spark.read.option("lineSep", "\n").text(path)
        valid = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.lit(f"{path}: not UTF-8")))
        out = out.union(text.select(F.lit(dump_id), F.col("_metadata.file_block_start"), F.monotonically_increasing_id(), valid))
    if rest:
        options = {"files": str(len(rest))} | {k: v for n, (i, p) in enumerate(rest) for k, v in ((f"id{n}", i), (f"path{n}", p))}
        out = out.union(spark.read.format("dump_lines").options(**options).load())
    return out


def numbered(lines: DataFrame, block: int = 65_536) -> DataFrame:
    """(dump_id, line_no, value), for lines that have numbers already, in the form of read_lines()."""
    return lines.select("dump_id", F.floor(F.col("line_no") / block).alias("block"), F.col("line_no").alias("seq"), "value")
