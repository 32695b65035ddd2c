"""Character n-gram models of languages with modified Kneser-Ney smoothing, counted by Spark over all documents.

Text is read in lower case, blanks of any kind as one, digits as 0, every other character as itself, five at a time. A task
counts the different n-grams of each few megabytes of text; Spark adds them up. Lower orders count in how many contexts an
n-gram stands. Each order of each language has discounts of its own for counts of one, two and more; n-grams of two
characters or more that are counted fewer than `least` times (one place, which the text that is judged may be itself) leave
all of their count to the order below, so a text that nothing else is like can't vouch for itself.

A model is a table of sorted hash arrays: 64-bit hashes of n-grams of any order and language with their discounted shares,
and of contexts with the weight left for the order below. It grows with the corpus and is never sent to the driver or
broadcast: it lies in the shared folder in shards of bounded size, and workers look their n-grams up shard by shard, keeping
the shards where they are small enough together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import in_arrow, mix64, new_folder, stored

ORDER = 5
#: Entries of a shard, about; entries that a worker keeps.
SHARD, KEPT = 1 << 20, 4 << 20
BLANK, ZERO = 32, 48


def points(text: str) -> np.ndarray:
    """Code points, after so many blanks as the first n-gram needs."""
    return np.frombuffer((" " * (ORDER - 1) + text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)


def different(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of the texts, a row of code points each; which of them ends at each character; and where each text begins, with one more for the end."""
    parts = [points(t) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths - (ORDER - 1))))
    if not ends[-1]:
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int32), ends
    s = np.concatenate(parts)
    seen = np.flatnonzero(np.bincount(s))
    plain = seen.copy()  # what each character is read as
    plain[(seen >= 9) & (seen <= 13) | (seen == 0xA0) | (seen == 0x3000)] = BLANK
    plain[(seen > ZERO) & (seen < ZERO + 10)] = ZERO
    alphabet, place = np.unique(plain, return_inverse=True)
    number = np.zeros(int(seen[-1]) + 1, np.int32)
    number[seen] = place
    own, base = number[s], len(alphabet)
    n = len(own) - ORDER + 1
    code, room = own[:n].astype(np.int64), base
    for i in range(1, ORDER):
        if room * base >= 1 << 62:  # many characters: number what there is so far
            code = pa.array(code).dictionary_encode().indices.to_numpy().astype(np.int64)
            room = len(code)
        code *= base
        code += own[i : n + i]
        room *= base
    begin = np.cumsum(lengths) - lengths
    inner = np.ones(n, bool)  # n-grams that lie in one text
    for i in range(1, ORDER):
        inner[np.minimum(begin[1:] - i, n - 1)] = begin[1:] - i >= n
    start = np.flatnonzero(inner)
    which = pa.array(code[start]).dictionary_encode().indices.to_numpy()
    first = np.empty(int(which.max()) + 1, np.int64)
    first[which[::-1]] = start[::-1]
    return alphabet[own[first[:, None] + np.arange(ORDER)]].astype(np.uint32), which, ends


def as_text(rows: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(rows.astype(np.uint32)).view(f"<U{rows.shape[1]}").reshape(-1), pa.string())


def keys(lang: str, rows: np.ndarray, context: bool = False) -> np.ndarray:
    """Hashes of n-grams, or of contexts, of one order."""
    h = np.full(len(rows), xxhash.xxh64_intdigest(lang.encode(), 2 * rows.shape[1] + context), np.uint64)
    for i in range(rows.shape[1]):
        h = mix64(h ^ rows[:, i].astype(np.uint64)) + np.uint64(i + 1)
    return mix64(h)


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of docs (text, lang): all n-grams of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, some in by_language(batch.column(0).to_pylist(), batch.column(1).to_pylist()).items():
                rows, which, _ = different([t for _, t in some])
                n = np.bincount(which, minlength=len(rows))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), as_text(rows), pa.array(n)], names=["lang", "gram", "n"])

    parts = in_arrow(docs.select("text", "lang"), run, "lang string, gram string, n long")
    return stored(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def by_language(texts: list[str | None], langs: list[str]) -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for i, (text, lang) in enumerate(zip(texts, langs)):
        out.setdefault(lang, []).append((i, text or ""))
    return out


def kneser_ney(counted: DataFrame, least: int = 2) -> DataFrame:
    """(lang, size, gram, share, weight) of n-grams of all orders: share is what the n-gram keeps of its context's count (null: nothing), weight what its context leaves to the order below (on one n-gram of each context, else null)."""
    level = counted.select("lang", F.lit(ORDER).alias("size"), "gram", "n")
    every = level
    for size in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n")).select("lang", F.lit(size).alias("size"), "gram", "n")
        level = stored(level, "grams")  # read by two: the union and the next order
        every = every.union(level)
    of = {i: F.count_if(F.col("n") == i).cast("double") for i in range(1, 5)}
    found = every.groupBy("lang", "size").agg(*(x.alias(f"n{i}") for i, x in of.items()))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    cut = [F.when(F.col(f"n{i}") > 0, F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(0.5) for i in (1, 2, 3)]
    discounts = stored(found.select("lang", "size", *(c.alias(f"d{i}") for i, c in enumerate(cut, 1))), "discounts")
    rows = every.join(discounts, ["lang", "size"]).withColumn("d", F.when((F.col("n") < least) & (F.col("size") > 1), F.col("n")).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    rows = rows.select("lang", "size", "gram", "n", "d", F.substring("gram", 1, F.col("size") - 1).alias("context"))
    own = Window.partitionBy("lang", "size", "context")
    rows = rows.withColumn("total", F.sum("n").over(own)).withColumn("left", F.sum("d").over(own)).withColumn("place", F.row_number().over(own.orderBy("gram")))
    share = F.when(F.col("n") > F.col("d"), (F.col("n") - F.col("d")) / F.col("total"))
    weight = F.when(F.col("place") == 1, F.col("left") / F.col("total"))
    return rows.select("lang", "size", "gram", share.alias("share"), weight.alias("weight")).filter("share is not null or weight is not null")


class Store:
    """A model as it lies in the shared folder."""

    def __init__(self, path: str, shards: int, entries: int):
        self.path, self.shards, self.keep = path, shards, entries <= KEPT

    @classmethod
    def write(cls, rows: DataFrame) -> Store:
        """Of kneser_ney()'s rows, sorted arrays of hashes and values, a file each shard."""
        spark = rows.sparkSession
        rows = stored(rows, "model")
        entries = rows.agg(F.count("share") + F.count("weight")).first()[0]
        shards = 1 << max(0, (-(-entries // SHARD) - 1).bit_length())

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang, size = (np.array(batch.column(i).to_pylist(), object) for i in (0, 1))
                gram = np.array(batch.column(2).to_pylist(), object)
                share, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                for own in set(zip(lang.tolist(), size.tolist())):
                    some = np.flatnonzero((lang == own[0]) & (size == own[1]))
                    grams = np.frombuffer("".join(gram[some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, own[1])
                    own_share, own_weight = (x[some].astype(float) for x in (share, weight))
                    seen, heads = np.flatnonzero(~np.isnan(own_share)), np.flatnonzero(~np.isnan(own_weight))
                    key = np.concatenate((keys(own[0], grams[seen]), keys(own[0], grams[heads, :-1], True)))
                    value = np.concatenate((own_share[seen], own_weight[heads]))
                    yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(shards)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(value.astype(np.float32))], names=["shard", "key", "value"])

        def arranged(table: pa.Table) -> pa.Table:
            key = table.column("key").combine_chunks().to_numpy().view(np.uint64)
            by = np.argsort(key)
            value = table.column("value").combine_chunks().to_numpy()[by]
            return pa.table({"shard": table.column("shard")[:1], "keys": pa.array([key[by].tobytes()], pa.binary()), "values": pa.array([value.tobytes()], pa.binary())})

        path = new_folder(spark, "model-arrays")
        arrays = in_arrow(rows, hashed, "shard int, key long, value float").groupBy("shard").applyInArrow(arranged, "shard int, keys binary, values binary")
        arrays.write.partitionBy("shard").parquet(path)
        return cls(path, shards, entries)

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        uri = "file://" + self.path[len("file:") :] if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        fs, at = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{at}/shard={i}", allow_not_found=True)) if f.path.endswith(".parquet")]
        if not files:
            return np.zeros(0, np.uint64), np.zeros(0, np.float32)
        with fs.open_input_file(files[0]) as source:
            row = pq.read_table(source, columns=["keys", "values"])
        return np.frombuffer(row.column("keys")[0].as_py(), np.uint64), np.frombuffer(row.column("values")[0].as_py(), np.float32)


class Reader:
    """Looks hashes up; keeps the shards if all of them together are small enough."""

    def __init__(self, store: Store):
        self.store, self.kept = store, {}

    def values(self, wanted: np.ndarray) -> np.ndarray:
        """NaN where there is none."""
        out = np.full(len(wanted), np.nan, np.float32)
        of = (wanted % np.uint64(self.store.shards)).astype(np.int64)
        by = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by], np.arange(self.store.shards + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            key, value = self.kept.get(i) or self.store.shard(i)
            if self.store.keep:
                self.kept[i] = key, value
            if len(key):
                some = by[edges[i] : edges[i + 1]]
                at = np.minimum(np.searchsorted(key, wanted[some]), len(key) - 1)
                out[some] = np.where(key[at] == wanted[some], value[at], np.nan)
        return out

    def probabilities(self, lang: str, rows: np.ndarray) -> np.ndarray:
        """Of the last character of each n-gram given the others: the discounted share, and the weight left times the order below. Before any, each code point is as likely."""
        grams = [rows[:, ORDER - size :] for size in range(1, ORDER + 1)]
        wanted = [keys(lang, g) for g in grams] + [keys(lang, g[:, :-1], True) for g in grams]
        found = self.values(np.concatenate(wanted)).reshape(2, ORDER, len(rows)).astype(float)
        p = np.full(len(rows), 1.0 / 0x110000)
        for share, weight in zip(*found):
            p = np.nan_to_num(share) + p * np.where(np.isnan(weight), 1.0, weight)
        return p

    def log_perplexities(self, lang: str, texts: list[str]) -> np.ndarray:
        """log2 of each text's perplexity per character; 0 for an empty one."""
        rows, which, ends = different(texts)
        logs = -np.log2(self.probabilities(lang, rows))
        sums = np.concatenate(([0.0], np.cumsum(logs[which])))
        return (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(1, np.diff(ends))
