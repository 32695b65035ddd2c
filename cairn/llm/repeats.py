"""Repeated passages: windows of bytes by a Burrows-Wheeler transform, windows of words by sorting super-k-mers.

Both meet in the buckets of superkmers.exchange(). Only what shares a minimiser with something else is looked at there:
a string without company that stands in one place has no repeated window. Of bytes, each different string goes through the
transform once, with the number of its places. Of words, where all strings of a minimiser are alike, their places decide.

Nulls: a null text is empty; a null doc_id counts as larger than any other, and two of them as equal. Rows alike in
doc_id and text are one document for words (an id isn't smaller than itself), and copies of each other for bytes.
Texts shorter than a window lose nothing. An empty table gives an empty result. Other columns travel in a struct of their own,
so that their names clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .bwt import shared_prefixes, spans
from .common import in_arrow, joined, table
from .superkmers import LETTERS, POWERS, Strings, covered, exchange

BYTES, WORDS = 200, 13
#: Bytes and words of a minimiser; bytes of strings that are sorted together, or of one larger group.
MINIMISER, WORD_MINIMISER, TOGETHER = 24, 3, 1 << 19


class Contents:
    """The different strings of a bucket that share their minimiser: those alone with it (one content in all its places) and those in company."""

    def __init__(self, s: Strings):
        n = len(s.length)
        ends = np.cumsum(s.length.astype(np.int64))
        self.begin = ends - s.length
        by = np.argsort(s.mark, kind="stable")
        new = np.concatenate(([True], s.mark[by][1:] != s.mark[by][:-1])) if n else np.zeros(0, bool)
        group = np.empty(n, np.int64)
        group[by] = np.cumsum(new) - 1
        sizes = np.bincount(group, minlength=1)
        raw, known = s.data.tobytes(), {}
        #: The content of each string, numbered; strings that are alone have a number of their own.
        self.content = np.arange(n)
        for i in np.flatnonzero(sizes[group] > 1).tolist():
            self.content[i] = known.setdefault(raw[self.begin[i] : ends[i]], i)
        first = self.content == np.arange(n)
        kinds = np.bincount(group[first], minlength=len(sizes))
        self.company = kinds[group] > 1
        self.raw, self.ends, self.group = raw, ends, group
        self.place_content = np.repeat(self.content, s.count)

    def text(self, i: int) -> bytes:
        return self.raw[self.begin[i] : self.ends[i]]

    def in_company(self) -> np.ndarray:
        return np.flatnonzero(self.company & (self.content == np.arange(len(self.content))))


def _runs(s: Strings, contents: Contents, places: np.ndarray, marked: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """places: of contents in company; marked: for each of their windows, places end to end; at: where each place's begin."""
    n = s.windows[contents.place_content[places]].astype(np.int64)
    owner = np.repeat(np.arange(len(places)), n)
    first = marked & ~(np.concatenate(([False], marked[:-1])) & np.concatenate(([False], owner[1:] == owner[:-1])))
    last = marked & ~(np.concatenate((marked[1:], [False])) & np.concatenate((owner[1:] == owner[:-1], [False])))
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return places[owner[a]], a - at[owner[a]], b - a + 1


def near(s: Strings, c: Contents, some: np.ndarray) -> np.ndarray:
    """Which of these contents may share a window with another one. Such a window holds the minimiser and, on one side of it, half of its other bytes at least."""
    half = (BYTES - MINIMISER + 1) // 2
    offset, length = s.offset[some].astype(np.int64), s.length[some].astype(np.int64)
    there = (offset + MINIMISER + half <= length, offset >= half)
    sides = [np.zeros(len(some), np.uint64) for _ in there]
    ends = np.cumsum(length)
    lo = 0
    while lo < len(some):  # so many strings at a time that their sums stay small
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - length[lo] + TOGETHER, side="right")))
        sums = POWERS.sums(LETTERS[s.data[spans(c.begin[some[lo:hi]], length[lo:hi])]])
        at = ends[lo:hi] - length[lo:hi] - (ends[lo] - length[lo]) + offset[lo:hi]
        for side, low, high, ok in zip(sides, (at, at - half), (at + MINIMISER + half, at + MINIMISER), there):
            rows = np.flatnonzero(ok[lo:hi])
            side[lo + rows] = POWERS.of(sums, low[rows], high[rows])
        lo = hi
    out = np.zeros(len(some), bool)
    for side, ok in zip(sides, there):
        rows = np.flatnonzero(ok)
        _, which, times = np.unique(side[rows], return_inverse=True, return_counts=True)
        out[rows[times[which] > 1]] = True
    return out


def repeated_bytes(s: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that also start anywhere else: what the transform finds among the different contents, each with the number of its places."""
    c = Contents(s)
    total = np.bincount(c.content, weights=s.count, minlength=len(s.length)).astype(np.int64)
    some = c.in_company()
    some = some[near(s, c, some) | (total[some] > 1)] if len(some) else some
    again = np.flatnonzero((c.content == np.arange(len(c.content))) & ~c.company & (total > 1))
    some = np.concatenate((some, again))
    some = some[np.argsort(c.group[some], kind="stable")]
    start = np.full(len(s.length), -1)
    lengths = s.length[some].astype(np.int64) + 1
    start[some] = np.cumsum(lengths) - lengths
    edges = np.flatnonzero(np.diff(c.group[some], prepend=-1))
    parts, at = [], 0
    for edge in [*edges[1:].tolist(), len(some)]:  # whole groups, so many at a time
        if edge > at and (edge == len(some) or start[some[edge]] - start[some[at]] >= TOGETHER):
            parts.append(shared_prefixes([c.text(i) for i in some[at:edge].tolist()], BYTES, total[some[at:edge]]))
            at = edge
    shared = np.concatenate(parts) if parts else np.zeros(0, bool)
    rest = np.flatnonzero(start[c.place_content] >= 0)
    k = c.place_content[rest]
    n = s.windows[k].astype(np.int64)
    return _runs(s, c, rest, shared[spans(start[k], n)], np.cumsum(n) - n)


def repeated_words(s: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that also start in a document with a smaller id, by sorting those of strings in company."""
    c = Contents(s)
    ids = s.doc_id[s.doc]
    least = np.full(len(s.length), np.iinfo(np.int64).max)
    np.minimum.at(least, c.place_content, ids)
    places = np.arange(len(ids))
    lone = ~c.company[c.place_content] & (ids > least[c.place_content])
    own = places[lone]
    out = (own, np.zeros(len(own), np.int64), s.windows[c.place_content[own]].astype(np.int64))
    some = c.in_company()
    if not len(some):
        return out
    start = np.zeros(len(s.length), np.int64)
    windows = s.windows[some].astype(np.int64)
    start[some] = np.cumsum(windows) - windows
    rows: list[tuple[bytes, int, int]] = []
    for i in some.tolist():
        words, low = c.text(i).split(b" "), int(least[i])
        rows += [(b" ".join(words[j : j + WORDS]), low, int(start[i]) + j) for j in range(len(words) - WORDS + 1)]
    rows.sort()
    smallest = np.empty(len(rows), np.int64)
    before, low = None, 0
    for window, least_id, at in rows:  # of equal windows, that with the smallest id comes first
        if window != before:
            before, low = window, least_id
        smallest[at] = low
    rest = places[c.company[c.place_content]]
    k = c.place_content[rest]
    n = s.windows[k].astype(np.int64)
    marked = smallest[spans(start[k], n)] < np.repeat(ids[rest], n)
    more = _runs(s, c, rest, marked, np.cumsum(n) - n)
    return tuple(np.concatenate(x) for x in zip(out, more))


def byte_spans(docs: DataFrame, bucket_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, text, rest, spans) of repeated windows of BYTES bytes."""
    return exchange(docs, BYTES, MINIMISER, False, repeated_bytes, bucket_bytes)


def word_spans(docs: DataFrame, bucket_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, text, rest, spans) of windows of WORDS words that start in a document with a smaller id."""
    return exchange(docs, WORDS, WORD_MINIMISER, True, repeated_words, bucket_bytes, level=5)


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that they cover in part."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without_repeated_bytes(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, the texts without their repeated bytes (of a character cut by a window's end, all bytes stay), and n_chars to match where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if found:
                    raw = text.encode()
                    text = kept_bytes(raw, whole_characters(raw, covered(found, BYTES))).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("rest")], names=["doc_id", "text", "rest"])

    rows = byte_spans(docs)
    rows = in_arrow(rows, run, StructType([f for f in rows.schema.fields if f.name != "spans"])).withColumn("n_chars", F.length("text").cast("long"))
    return joined(rows, docs.columns, "doc_id", "text", "n_chars")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                raw, runs = text.encode(), covered(found, BYTES)
                out.append((doc_id, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=schema)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = pa.schema([(n, pa.int64()) for n in names[:-1]] + [(names[-1], pa.string())])
    return in_arrow(byte_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                words, kept, at = text.encode().split(), [], 0
                for a, b in covered(found, WORDS):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=schema)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    schema = pa.schema([(n, pa.int64()) for n in names[:-1]] + [(names[-1], pa.string())])
    return in_arrow(word_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "spans"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
