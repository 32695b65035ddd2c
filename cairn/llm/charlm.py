"""The letter model of the toxicity lattice: character n-grams with modified Kneser-Ney smoothing, counted by Spark over all documents.

Text is read in lower case as 32 symbols (a to z, blanks, digits, punctuation, signs, two classes of other letters), four
at a time, so a language has at most 32^4 different n-grams whatever the corpus: counts, models and what is broadcast are
bounded by that (18 MB a model at most; `most` languages have one of their own, all others share one). Counting adds up
in each task first and then by language and n-gram.

A model is kept as sorted arrays: 64-bit hashes of the n-grams seen, of any order, with their probabilities, and of their
contexts with the weight left for the order below.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, mix64

SYMBOLS, ORDER, BITS = 32, 4, 5
SIZE = SYMBOLS**ORDER
BLANK, DIGIT, STOP, SIGN, LETTER = 26, 27, 28, 29, 30
OTHER = "\0"


def _table() -> np.ndarray:
    out = np.array([LETTER + c % 2 for c in range(1 << 16)], np.uint8)
    for c in range(1 << 16):
        x = chr(c)
        if x.isspace():
            out[c] = BLANK
        elif x.isdigit():
            out[c] = DIGIT
        elif x in ".,;:!?'\"-()":
            out[c] = STOP
        elif not x.isalpha():
            out[c] = SIGN
    for i, x in enumerate(string.ascii_lowercase):
        out[ord(x)] = i
    return out


TABLE = _table()


def symbols(text: str) -> np.ndarray:
    """The text's symbols; characters beyond the first 65,536 are signs."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.where(points < len(TABLE), TABLE[np.minimum(points, len(TABLE) - 1)], SIGN).astype(np.int32)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of the texts, each after blanks, as a number; and where each text begins, with one more for the end."""
    pad = " " * (ORDER - 1)
    parts = [symbols(pad + t) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    s = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    code = s.copy()
    for i in range(1, ORDER):
        code[i:] |= s[:-i] << (BITS * i)
    begin = np.cumsum(lengths) - lengths
    inner = np.ones(len(s), bool)
    for i in range(ORDER - 1):
        inner[begin + i] = False
    own = lengths - (ORDER - 1)
    return code[inner], np.concatenate(([0], np.cumsum(own)))


def in_chunks(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of so many characters, or of one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def main_languages(docs: DataFrame, most: int) -> list[str]:
    """Those with most documents, by name where equal."""
    rows = docs.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    return [r.lang for r in rows]


def count(docs: DataFrame, own: list[str]) -> DataFrame:
    """(lang, code, n): all n-grams of all texts; languages not in own count as OTHER."""
    known = set(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang if lang in known else OTHER, []).append(text or "")
            for lang, some in by.items():
                sums = total.setdefault(lang, np.zeros(SIZE, np.int64))
                for a, b in in_chunks(some, 1 << 22):
                    sums += np.bincount(codes(some[a:b])[0], minlength=SIZE)
        for lang, sums in total.items():
            seen = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(sums[seen])], names=["lang", "code", "n"])

    parts = in_arrow(docs.select("text", "lang"), run, "lang string, code int, n long")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _key(order: int, code: np.ndarray) -> np.ndarray:
    return mix64((np.uint64(order) << np.uint64(32)) | code.astype(np.uint64))


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of n-grams
    probability: np.ndarray
    context_keys: np.ndarray  # sorted hashes of contexts
    weight: np.ndarray

    def _find(self, keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def probabilities(self, code: np.ndarray) -> np.ndarray:
        """Of the last symbol of each n-gram given the others: the discounted share, and the weight left times the order below."""
        p = np.full(len(code), 1.0 / SYMBOLS)
        for order in range(1, ORDER + 1):
            c = code & ((1 << (BITS * order)) - 1)
            p = self._find(self.keys, self.probability, _key(order, c), 0.0) + p * self._find(self.context_keys, self.weight, _key(order, c >> BITS), 1.0)
        return p


def kneser_ney(code: np.ndarray, n: np.ndarray) -> Model:
    """The interpolated model of counts of the highest order. Lower orders count in how many contexts an n-gram stands; each
    order has discounts of its own for counts of one, two and more."""
    counts = np.zeros(SIZE, np.int64)
    counts[code] = n
    keys, values, context_keys, weights = [], [], [], []
    for order in range(ORDER, 0, -1):
        c = counts if order == ORDER else (below.reshape(SYMBOLS, -1) > 0).sum(0)  # noqa: F821
        below = c
        of = np.bincount(np.minimum(c, 5), minlength=6).astype(float)
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        d = np.array([0.0] + [np.clip(i - (i + 1) * y * of[i + 1] / of[i], 0.05, i - 0.05) if of[i] else 0.5 for i in (1, 2, 3)])
        discount = d[np.minimum(c, 3)]
        total = c.reshape(-1, SYMBOLS).sum(1)
        left = discount.reshape(-1, SYMBOLS).sum(1)
        seen, contexts = np.flatnonzero(c), np.flatnonzero(total)
        keys.append(_key(order, seen))
        values.append((c[seen] - discount[seen]) / total[seen >> BITS])
        context_keys.append(_key(order, contexts))
        weights.append(left[contexts] / total[contexts])
    k, v, ck, w = map(np.concatenate, (keys, values, context_keys, weights))
    by, cby = np.argsort(k), np.argsort(ck)
    return Model(k[by], v[by], ck[cby], w[cby])


def models(counted: DataFrame) -> dict[str, Model]:
    """A model for each language; at most 32^4 rows of a language reach the driver."""
    found = counted.toArrow()
    lang = np.array(found.column("lang").to_pylist(), dtype=object)
    code, n = found.column("code").to_numpy(), found.column("n").to_numpy()
    return {x: kneser_ney(code[lang == x], n[lang == x]) for x in sorted(set(lang.tolist()))}


class Scorer:
    """log2 probabilities of n-grams, worked out once each."""

    def __init__(self, model: Model):
        self.model, self.table, self.known = model, np.zeros(SIZE, np.float32), np.zeros(SIZE, bool)

    def logs(self, code: np.ndarray) -> np.ndarray:
        new = np.flatnonzero(np.bincount(code[~self.known[code]], minlength=1))
        if len(new):
            self.table[new] = np.log2(self.model.probabilities(new))
            self.known[new] = True
        return self.table[code]
