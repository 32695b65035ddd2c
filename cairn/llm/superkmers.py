"""Super-k-mers: an exchange that brings equal windows of k units (bytes or words) of all documents together.

A window's minimiser is the m-gram in it whose hash is smallest, the last of equal ones. Equal windows have equal
minimisers at equal offsets, so a minimiser's bucket holds every copy of a window. Consecutive windows that share one
minimiser travel as one packed string, k - 1 units longer than there are windows; no two windows of such a string are equal.

A map task packs its strings chunk by chunk: a chunk has one compressed row for each bucket that it has strings for, in
which a string that several of its documents hold is written once with their places. A passage that a third of all
documents share thus reaches its bucket once a chunk. Nothing is collected, and no row is bound to another one's task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import apart, in_arrow, mix64, release

CHUNK = 2 << 20
#: Longer texts are cut into parts that overlap by a window less one unit.
PART = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, for so many places."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n + (n >> 2)), _powers(BACK, n + (n >> 2))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of value * base^place, one longer than the values."""
        self.to(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the spans."""
        return (sums[end] - sums[start]) * self.down[start]


POWERS = Powers()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(out) - (width - have)], out[width - have :])


@dataclass
class Units:
    """The units of several parts of texts, end to end: where each begins in data, and one more for the end."""

    data: np.ndarray
    letter: np.ndarray  # a hash of each unit
    begin: np.ndarray  # of each unit
    end: np.ndarray
    part: np.ndarray  # first unit of each part, and their number


def byte_units(parts: list[bytes]) -> Units:
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.arange(len(data) + 1)
    return Units(data, LETTERS[data], at[:-1], at[1:], np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64))


def word_units(parts: list[bytes]) -> Units:
    """Of parts whose words are joined by one blank."""
    data = np.frombuffer(b" ".join(parts), np.uint8)
    gaps = np.flatnonzero(data == 32)
    begin, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    sums = POWERS.sums(LETTERS[data])
    letter = mix64(POWERS.of(sums, begin, end) ^ (end - begin).astype(np.uint64))
    counts = [p.count(b" ") + 1 for p in parts]
    return Units(data, letter, begin, end, np.concatenate(([0], np.cumsum(counts))).astype(np.int64))


def runs(units: Units, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First unit, number of windows, minimiser and its unit, of each super-k-mer."""
    n = len(units.letter)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = POWERS.sums(units.letter)
    first = np.arange(n - m + 1)
    gram = mix64((sums[m:] - sums[: n - m + 1]) * POWERS.down[: n - m + 1])
    packed = (gram & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - first.astype(np.uint64))
    place = np.int64(0xFFFFFF) - (sliding_min(packed, k - m + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    inside = np.ones(n - k + 1, bool)  # windows that lie in one part
    for edge in units.part[1:-1]:
        inside[max(0, edge - k + 1) : edge] = False
    starts = np.flatnonzero(inside & np.concatenate(([True], (place[1:] != place[:-1]) | ~inside[:-1])))
    stops = np.flatnonzero(inside & np.concatenate(((place[1:] != place[:-1]) | ~inside[1:], [True]))) + 1
    return starts, stops - starts, gram[place[starts]], place[starts]


def _flat_spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all spans, end to end."""
    total = int(length.sum())
    step = np.ones(total, np.int64)
    if total:
        at = np.cumsum(length) - length
        step[at[0]] = begin[0]
        step[at[1:]] = begin[1:] - (begin[:-1] + length[:-1]) + 1
        np.cumsum(step, out=step)
    return step


@dataclass
class Strings:
    """Packed strings of one bucket: byte lengths, windows, the byte where the minimiser begins, its high bits, how many places hold each; the places (a document of the table, a first unit); the table of documents; the bytes."""

    length: np.ndarray
    windows: np.ndarray
    offset: np.ndarray
    mark: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    doc_id: np.ndarray
    text_hash: np.ndarray
    data: np.ndarray

    KINDS = ("<u4", "<u2", "<u4", "<u4", "<u4", "<u4", "<u4", "<i8", "<i8", "u1")
    NAMES = ("length", "windows", "offset", "mark", "count", "doc", "at", "doc_id", "text_hash", "data")

    def pack(self, compressor: zstandard.ZstdCompressor) -> bytes:
        """Marks ascend and are written as steps."""
        arrays = [np.diff(self.mark, prepend=0) if name == "mark" else getattr(self, name) for name in self.NAMES]
        head = np.array([len(a) for a in arrays], "<u4").tobytes()
        return compressor.compress(head + b"".join(np.ascontiguousarray(a.astype(t, copy=False)).tobytes() for a, t in zip(arrays, self.KINDS)))

    @classmethod
    def unpack(cls, blob: bytes, decompressor: zstandard.ZstdDecompressor) -> Strings:
        raw = decompressor.decompress(blob)
        sizes, at, out = np.frombuffer(raw, "<u4", len(cls.KINDS)), 4 * len(cls.KINDS), []
        for n, t in zip(sizes.tolist(), cls.KINDS):
            out.append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
        own = cls(*out)
        own.mark = np.cumsum(own.mark, dtype=np.int64)
        return own

    @classmethod
    def together(cls, many: list[Strings]) -> Strings:
        shift = np.cumsum([0] + [len(s.doc_id) for s in many[:-1]])
        docs = np.concatenate([s.doc.astype(np.int64) + d for s, d in zip(many, shift)])
        return cls(*(docs if name == "doc" else np.concatenate([getattr(s, name) for s in many]) for name in cls.NAMES))


def _packed(parts: list[tuple[int, int, int, bytes]], k: int, m: int, buckets: int, units_of: Callable, compressor: zstandard.ZstdCompressor) -> Iterator[tuple[int, bytes]]:
    """parts: doc_id, hash of the text, first unit, bytes."""
    units = units_of([p[3] for p in parts])
    start, windows, gram, place = runs(units, k, m)
    if not len(start):
        return
    begin, length = units.begin[start], units.end[start + windows + k - 2] - units.begin[start]
    part = np.searchsorted(units.part, start, side="right") - 1
    base = np.array([p[2] for p in parts])
    at = start - units.part[part] + base[part]
    whole = POWERS.of(POWERS.sums(LETTERS[units.data]), begin, begin + length)
    gram = mix64(gram)  # the smallest hashes lie close together
    bucket = ((gram & np.uint64(0xFFFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((whole, gram, bucket))  # equal strings side by side
    b, g, w, n = bucket[order], gram[order], whole[order], length[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (n[1:] != n[:-1])))
    firsts = np.flatnonzero(new)
    counts = np.diff(np.concatenate((firsts, [len(order)])))
    ids, hashes = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
    edges = np.concatenate(([0], np.flatnonzero(b[firsts][1:] != b[firsts][:-1]) + 1, [len(firsts)]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = order[firsts[lo:hi]]
        places = order[firsts[lo] : firsts[hi] if hi < len(firsts) else len(order)]
        used, doc = np.unique(part[places], return_inverse=True)
        data = units.data[_flat_spans(begin[own], length[own])]
        strings = Strings(length[own], windows[own], units.begin[place[own]] - begin[own], (gram[own] >> np.uint64(40)).astype(np.int64), counts[lo:hi], doc, at[places], ids[used], hashes[used], data)
        yield int(b[firsts[lo]]), strings.pack(compressor)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_hash, which name a row but for rows that are alike in both; and rest, a struct of all other columns."""
    return apart(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "rest").withColumn("text_hash", F.xxhash64("text"))


def dictionary(rows: DataFrame, size: int = 1 << 20) -> bytes:
    """Text that helps compression, of some documents; of no effect on what is found. At most `size` bytes."""
    some = rows.select(F.substring("text", 1, 2048).alias("text")).limit(size // 1024).collect()
    return "".join(r.text for r in some).encode()[:size]


def pack(rows: DataFrame, k: int, m: int, buckets: int, words: bool, known: bytes, level: int = 3) -> DataFrame:
    """(bucket, blob) of keyed() rows; a null id is packed as the largest."""
    units_of = word_units if words else byte_units
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(sent.value, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) if sent.value else zstandard.ZstdCompressor(level=level)

        def out() -> pa.RecordBatch:
            made = list(_packed(held, k, m, buckets, units_of, compressor))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            ids = batch.column(0).fill_null((1 << 63) - 1).to_pylist()
            for doc_id, raw, mark in zip(ids, batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist()):
                raw = raw.as_py()
                if words:
                    split = raw.split()
                    if len(split) < k:
                        continue
                    step = PART // 8
                    cuts = [(i, b" ".join(split[i : i + step + k - 1])) for i in range(0, len(split) - k + 1, step)]
                else:
                    if len(raw) < k:
                        continue
                    cuts = [(i, raw[i : i + PART + k - 1]) for i in range(0, len(raw) - k + 1, PART)]
                for first, piece in cuts:
                    held.append((doc_id, mark, first, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return in_arrow(rows.select("doc_id", "text", "text_hash"), run, "bucket int, blob binary")


def number_of_buckets(rows: DataFrame, bytes_each: int) -> int:
    return max(1, -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // bytes_each))


def exchange(docs: DataFrame, k: int, m: int, words: bool, spans_of: Callable[[Strings], Iterator[tuple]], bucket_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """All rows of docs as doc_id, text and rest (see keyed()), with spans array<struct<at, windows>>: runs of a document's windows that spans_of() marks.

    spans_of() gets a bucket's Strings and gives arrays: places (by number), first windows and numbers of windows."""
    rows = keyed(docs)
    buckets, known = number_of_buckets(rows, bucket_bytes), dictionary(rows)
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def meet(table: pa.Table) -> pa.Table:
        of = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(sent.value, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) if sent.value else zstandard.ZstdDecompressor()
        strings = Strings.together([Strings.unpack(x.as_py(), of) for x in table.column("blob")])
        place, first, n = spans_of(strings)
        doc = strings.doc[place]
        found = pa.table({"doc_id": pa.array(strings.doc_id[doc].astype(np.int64)), "text_hash": pa.array(strings.text_hash[doc].astype(np.int64)), "at": pa.array((strings.at[place] + first).astype(np.int64)), "windows": pa.array(n.astype(np.int32))})
        del strings, place, first, n, doc
        release()
        return found

    met = pack(rows, k, m, buckets, words, known, level).groupBy("bucket").applyInArrow(meet, "doc_id long, text_hash long, at long, windows int")
    by = met.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "windows")).alias("spans"))
    by = by.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    return rows.join(by, (F.coalesce(rows.doc_id, F.lit((1 << 63) - 1)) == by._id) & (rows.text_hash == by._hash), "left").select("doc_id", "text", "rest", "spans")


def covered(spans: list | None, k: int) -> list[tuple[int, int]]:
    """The units that the windows of the spans cover, as maximal runs [from, to) in order."""
    out: list[tuple[int, int]] = []
    for at, n in sorted((s["at"], s["windows"]) for s in spans or ()):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], at + n - 1 + k))
        else:
            out.append((at, at + n - 1 + k))
    return out
