"""Toxicity scores of deobfuscated text.

A noisy channel has turned letters into look-alikes, put signs or blanks between them or repeated them. Each word that
shows a trace of that, and each run of short words, is a lattice: at each place a character stands for itself, for a letter
that looks like it, for nothing (a sign or a blank in between) or for the letter before (a repetition); a blank may stand
for itself too. Viterbi decoding under a character model of the whole corpus finds the likeliest letters and blanks, with no
state dropped. The restored words are scored.

The lexicon is learned from labelled documents of the training folds: words and word beginnings, by how many toxic and
other documents hold them, on a bounded sample (`sample` documents of each label, drawn by a hash). A document's
features are its largest word scores and their number by its length; a logistic regression turns them into a score.
A drawn document counts for as many as its label has for each one drawn, so the share of toxic ones is the labels' own.
It is fitted on scores that each half of the sample gets from the other half's lexicon. What is learned or counted of
the corpus (the character model) covers all documents.

Nulls: a null text is empty; texts without words get the score that no trace of toxicity gives. A null doc_id is in no
held-out fold and has no label. Repeated rows are scored alike; repeated ids count as often as they stand.
Without labels of both kinds every score is 0. An empty table gives an empty result. Other columns are not read, whatever
their names; scored() replaces one named `score`, untoxic() none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .charlm import BITS, OTHER, SIZE, Model, count, models
from .common import Memo, apart, in_arrow, joined, table

SAMPLE = 6000
FOLDS = 5
#: What a character may stand for besides itself.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "µ": "u", "*": "aeiou"}
#: Costs, in bits, of the channel's steps.
SWAP, DROP, REPEAT, KEEP_TWICE, CLOSE = 1.0, 1.5, 0.5, 2.0, 0.5
#: Three words or more of one or two characters, at least one of them a single one; signs may stand among them.
SPACED = re.compile(r"(?<!\S)(?:\S{1,2}[ \t]+){2,}\S{1,2}(?!\S)")
#: A word from its first letter or the look-alikes before it to its last letter or the look-alikes behind it.
CORE = re.compile(r"[0-9@$!|+€£¢µ]*[^\W\d_](?:.*[^\W\d_])?[0-9@$€£¢µ]*")
#: Between letters: signs or digits, or a look-alike before or behind; or three equal letters.
TRACE = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|^[^\W\d_]?[\W\d_]|[0-9@$€£¢µ]$|([^\W\d_])\1\1")
TRIPLE = re.compile(r"(.)\1\1")
PLAIN = re.compile(r"[^\W\d_]+")


class Channel:
    """Viterbi decoding under log2 probabilities of four-symbol sequences of letters."""

    def __init__(self, table: np.ndarray):
        self.cost = memoryview(np.ascontiguousarray(-table, np.float32))

    def symbol(self, c: str) -> int:
        return ord(c) - 97 if "a" <= c <= "z" else 26 if c == " " else 30 + ord(c) % 2

    def decode(self, word: str) -> str:
        """The likeliest letters and blanks of a word, or of a run of them, in lower case. States are the last three symbols and the last letter."""
        blank = 26
        start = (blank << (2 * BITS)) | (blank << BITS) | blank
        mask, costs = (1 << (3 * BITS)) - 1, self.cost
        states: dict[tuple[int, str], tuple[float, tuple]] = {(start, ""): (0.0, ())}
        for c in word:
            if c in " \t":
                choices = [(" ", 0.0), ("", CLOSE)]
            else:
                choices = [(c, 0.0)] if c.isalpha() else []
                choices += [(x, SWAP) for x in LOOKALIKES.get(c, "")]
                if not c.isalpha():
                    choices.append(("", DROP))
            new: dict[tuple[int, str], tuple[float, tuple]] = {}
            for (context, last), (cost, path) in states.items():
                for x, price in choices:
                    if not x or x == " " and context & 31 == blank:  # nothing, or one more blank
                        key, total, way = (context, last), cost + price, path
                    else:
                        code = (context << BITS) | self.symbol(x)
                        key, total, way = (code & mask, x), cost + price + costs[code] + (KEEP_TWICE if x == last else 0.0), (x, path)
                    if key not in new or total < new[key][0]:
                        new[key] = (total, way)
                    if x and x == last:  # a repetition of the letter before
                        key, total = (context, last), cost + price + REPEAT
                        if key not in new or total < new[key][0]:
                            new[key] = (total, path)
            states = new
        ends = ((cost + costs[((context << BITS) | blank) & (SIZE - 1)], path) for (context, _), (cost, path) in states.items())
        path, out = min(ends, key=lambda e: e[0])[1], []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def words(self, token: str) -> list[str]:
        """The words of a token of lower-case text, or of a run of short ones: as they stand, and restored where it shows a trace of the channel. A token with fewer letters than a third is a number or an address and is not restored."""
        if token.isalpha() and not TRIPLE.search(token):
            return [token]
        out = PLAIN.findall(token)
        if " " in token:
            if 3 * sum(map(str.isalpha, token)) >= len(token) - token.count(" "):
                out += self.decode(token).split()
            return out
        core = CORE.search(token)
        if core and TRACE.search(core := core.group()) and 3 * sum(map(str.isalpha, core)) >= len(core):
            out.append(self.decode(core))
        return out


def tokens(text: str) -> set[str]:
    """The different tokens of a text; runs of short ones, with one blank between, as one more each."""
    text = text.lower()
    out = set(text.split())
    out.update(" ".join(m.group().split()) for m in SPACED.finditer(text) if any(len(x) == 1 for x in m.group().split()))
    return out


def features(word: str) -> list[str]:
    """The word, and its beginnings where more follows."""
    return [word + "$", *(word[:n] for n in range(3, min(len(word), 9)))]


class Scorer:
    def __init__(self, channel: Channel, weights: dict[str, float], fit: list[float] | tuple = ()):
        self.channel, self.weights, self.fit = channel, weights, fit
        self.stems = {f[:3] for f in weights}
        self.tokens = Memo(self.token, 100_000)

    def token(self, token: str) -> float:
        get, stems = self.weights.get, self.stems
        return max((get(f, 0.0) for w in self.channel.words(token) if w[:3] in stems or w + "$" in self.weights for f in features(w)), default=0.0)

    def vector(self, text: str) -> list[float]:
        own = tokens(text)
        top = sorted([s for s in map(self.tokens.__getitem__, own) if s], reverse=True)
        total = sum(s for s in top if s > 2)
        first = (top + [0.0] * 3)[:3]
        return [*first, total / (1 + np.log1p(len(own))), np.log1p(len(own)), 1.0]

    def score(self, text: str) -> float:
        if not self.fit:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.fit, self.vector(text)), -30, 30))))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def lexicon(pos: Counter, neg: Counter, n_pos: int, n_neg: int, least: int = 4) -> dict[str, float]:
    """Log odds of features that at least so many toxic documents hold, less their standard error."""
    out = {}
    for f, a in pos.items():
        if a >= least:
            b = neg.get(f, 0)
            odds = np.log((a + 0.5) / (n_pos + 1) * (n_neg + 1) / (b + 0.5)) - np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) * 0.5
            if odds > 0.7:
                out[f] = float(odds)
    return out


def regression(x: np.ndarray, y: np.ndarray, each: np.ndarray | float = 1.0, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method; each: how many documents a row stands for."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + ridge * w
        h = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def character_table(docs: DataFrame) -> np.ndarray:
    """log2 probabilities of all four-symbol sequences, from one model of all documents."""
    counted = count(docs.select("text", F.lit(None).cast("string").alias("lang")), [])
    model: Model | None = models(counted).get(OTHER)
    out = np.full(SIZE, -float(BITS))
    if model is not None:
        for at in range(0, SIZE, 1 << 16):
            code = np.arange(at, min(SIZE, at + (1 << 16)))
            out[code] = np.log2(np.maximum(model.probabilities(code), 1e-12))
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, float], list[float]]:
    """The character table, the lexicon and the regression's weights. Labels outside the training folds aren't read."""
    letters = character_table(docs)
    docs = docs.select("doc_id", "text")  # no other column may clash with what follows
    labels = labels.filter(fold(F.col("doc_id")) != 0).filter("toxic in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("_draw"))
    drawn = labels.filter("toxic = 1").orderBy("_draw", "_id").limit(sample).union(labels.filter("toxic = 0").orderBy("_draw", "_id").limit(sample))
    of_label = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    rows = docs.join(F.broadcast(drawn), docs.doc_id == drawn._id).select("text", "toxic", F.pmod(F.shiftright("_draw", 7), F.lit(2)).cast("int").alias("half"))
    table_ = docs.sparkSession.sparkContext.broadcast(letters)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, counts = Channel(table_.value), {}
        for batch in batches:
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
                own = {f for t in tokens(text or "") for w in channel.words(t) for f in features(w)}
                counts.setdefault((toxic, half), Counter()).update(own)
                counts[toxic, half][""] += 1
        for (toxic, half), c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64()), pa.array([2 * toxic + half] * len(c), pa.int32())], names=["feature", "n", "kind"])

    held = in_arrow(rows, tally, "feature string, n long, kind int").groupBy("feature").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(4)))
    found = held.filter("k2 + k3 >= 4 and (k2 + k3) * 1.0 >= 0.02 * (k0 + k1) or feature = ''").toArrow()  # words that toxic documents hold as often as not are few
    names = found.column("feature").to_pylist()
    k = {i: dict(zip(names, found.column(f"k{i}").to_pylist())) for i in range(4)}
    sizes = {i: c.pop("", 0) for i, c in k.items()}

    def of(halves: tuple[int, ...]) -> dict[str, float]:
        pos, neg = Counter(), Counter()
        for h in halves:
            pos.update(k[2 + h])
            neg.update(k[h])
        return lexicon(pos, neg, sum(sizes[2 + h] for h in halves), sum(sizes[h] for h in halves), least=4 if len(halves) > 1 else 3)

    if min(sizes[2] + sizes[3], sizes[0] + sizes[1]) == 0:
        return letters, {}, []
    crossed = docs.sparkSession.sparkContext.broadcast({0: of((1,)), 1: of((0,))})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {h: Scorer(Channel(table_.value), w) for h, w in crossed.value.items()}
        for batch in batches:
            out = [scorers[half].vector(text or "") for text, _, half in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    sample_rows = in_arrow(rows, vectors, "x array<double>, y int").toArrow()
    x = np.array(sample_rows.column("x").to_pylist())
    y = np.array(sample_rows.column("y").to_pylist(), float)
    each = np.where(y == 1, *(of_label[k] / min(of_label[k], sample) for k in (1, 0)))
    return letters, of((0, 1)), regression(x, y, each)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of docs, and score double (replacing one of that name)."""
    letters, weights, fit = learn(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast((letters, weights, fit))
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, lex, w = sent.value
        scorer = Scorer(Channel(table_), lex, w)
        for batch in batches:
            score = [scorer.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    return in_arrow(docs, run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def untoxic(docs: DataFrame, labels: DataFrame, most: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows and columns of docs whose text scores below `most`."""
    return joined(scored(apart(docs, "doc_id", "text"), labels, sample).filter(F.col("score") < most), docs.columns, "doc_id", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
