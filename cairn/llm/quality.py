"""Quality rules: counts of a text's form, and perplexity bands for each language.

A document whose form is sound is kept if its perplexity under its language's character model lies within the language's
band: the median of log2 perplexity (per character, over that language's sound documents) less and plus a multiple of the
distance between the quartiles, the two sides having multiples of their own. As a mean over few characters varies more, the
band of a text of fewer than `words` words is wider by the root of their ratio. Documents of unusual noise lie above, those
that repeat themselves below. Models, medians and quartiles are taken over all documents, of every language.

Nulls: a null text has no words and fails; a null language counts as its own, not as the empty one. Repeated rows are judged alike. A band of a
language with no sound document rejects nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SEPARATORS, in_arrow, stored, table
from .ngrams import Reader, Store, by_language, count, kneser_ney

SIGNS = "#*$%&|<>"


def form(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SEPARATORS))
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)] if "\n" in text else []
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return len(words), chars, sum(map(text.count, SIGNS)), len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, form..., base_failed, log_perplexity) of every row; lang begins with = but for null."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"))
    store = Store.write(kneser_ney(count(docs)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(store)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = np.array([form(t or "") for t in texts], np.int64).reshape(len(texts), 5)
            logs = np.zeros(len(texts))
            for lang, some in by_language(texts, batch.column(2).to_pylist()).items():
                logs[[i for i, _ in some]] = reader.log_perplexities(lang, [t for _, t in some])
            failed = (forms[:, 0] < 50) | (100 * forms[:, 4] > 50 * forms[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(forms[:, i]) for i in range(5)), pa.array(failed), pa.array(logs)], names=["doc_id", "lang", *names, "base_failed", "log_perplexity"])

    return stored(in_arrow(docs, run, "doc_id long, lang string, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, log_perplexity double"), "measured")


def judged(docs: DataFrame, below: float = 2.3, above: float = 2.2, words: int = 250) -> DataFrame:
    """measured() with the document's band (low, high) and kept."""
    rows = measured(docs)
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    bands = rows.filter(~F.col("base_failed")).groupBy("lang").agg(quartiles.alias("q")).select(F.col("lang").alias("_lang"), F.col("q")[1].alias("_middle"), (F.col("q")[2] - F.col("q")[0]).alias("_spread"))
    bands = stored(bands, "bands")  # a row a language: Spark sees how small it is, and moves no document by its language
    rows = rows.join(bands, rows.lang == F.col("_lang"), "left")
    width = F.col("_spread") * F.sqrt(F.greatest(F.lit(1.0), words / F.greatest("n_words", F.lit(1))))
    rows = rows.withColumn("low", F.col("_middle") - below * width).withColumn("high", F.col("_middle") + above * width).drop("_lang", "_middle", "_spread")
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True)))


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
