"""SimHash near-duplicates, found with pivot distance tables.

Every distinct fingerprint's Hamming distances to reference fingerprints, the pivots, are worked out once and stored with
it. By the triangle inequality two fingerprints at distance d differ by d at most in each coordinate. A fingerprint gets one
row in each of several tables: a key (the bits that the table's mask keeps) and its coordinates. Within a key rows are in
order of their first coordinate, so that candidates are the rows ahead whose first coordinate is the threshold larger at
most; of these, pairs whose largest coordinate difference is above the threshold are discarded; survivors are verified.

For a threshold t the masks of exact_masks() miss nothing: of t + 2 blocks, two fingerprints agree in two at least.
A key that very many distinct fingerprints share is not paired in one task: its members go on to a join by one-bit
variants (two fingerprints at distance 2 or less share one), which is linear, exact and spread by value.

Similar sets of shingles may have fingerprints that lie far apart, so without_near_duplicates() takes the links between
fingerprints only as its first candidates: sets that are similar enough share one of their first shingles in a common
order, and all that meet there are verified by their shingles. That is exact, at any size.

Nulls: a null text counts as empty; the fingerprint of a text without words is zero and links like any other. A null
doc_id is kept and gives no component id. Repeated rows and ids each give a row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, in_arrow, stored, table, texts
from .graph import components

#: Rows of one key that are paired in one place; beyond, the variants take over.
RUN = 2048
#: How often documents look for their group before all pairs across groups are looked at; of no effect on what is found.
SEEK_ROUNDS = 1
#: Rows of one shingle that are paired without a look at their sketches.
FEW = 64
PIVOTS = tuple(int(xxhash.xxh64_intdigest(f"pivot {i}", 7)) for i in range(16))


def shingles(data: bytes, k: int) -> list[bytes]:
    """Word k-shingles, repeats included; a text of fewer words is one shingle, one without words none."""
    words = data.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def simhash(data: bytes, k: int = 3, seed: int = 42) -> int:
    """64 bits; bit i is 1 if set in over half the shingles' XXH64."""
    parts = shingles(data, k)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(x, seed) for x in parts], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def distances(fp: np.ndarray) -> np.ndarray:
    """The Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fp[:, None] ^ np.array(PIVOTS, np.uint64)[None, :])


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, pivots): fp is the 64-bit fingerprint as a signed long, pivots its distances to PIVOTS, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(x, k, seed) for x in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), pa.array([x.tobytes() for x in distances(fp)], pa.binary())], names=["doc_id", "fp", "pivots"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long, pivots binary")


def exact_masks(threshold: int = 2) -> list[int]:
    """Masks that keep two of threshold + 2 blocks: a pair within the threshold agrees under one of them."""
    edges = np.linspace(0, 64, threshold + 3).astype(int).tolist()
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, the smallest place that the pairs connect it to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            return root


def _survivors(key: np.ndarray, fp: np.ndarray, pivots: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of verified pairs among rows sorted by key and first coordinate."""
    pivots = pivots.astype(np.int8)
    run = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    near = run * 256 + (pivots[:, 0] if len(key) else 0)
    ahead = np.searchsorted(near, near + threshold, side="right") - np.arange(len(key))  # candidates end there
    first, second, at, d = [], [], np.arange(len(key)), 1
    while len(at := at[ahead[at] > d]):
        for part in np.array_split(at, max(1, len(at) >> 17)):
            part = part[np.abs(pivots[part] - pivots[part + d]).max(1) <= threshold]
            part = part[np.bitwise_count(fp[part] ^ fp[part + d]) <= threshold]
            first.append(part)
            second.append(part + d)
        d += 1
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64),) * 2


def _paired(threshold: int, run: int):
    """Arrow batches of (key, fp, pivots) sorted by key and first coordinate -> (a, b) a forest of the links under each key, b null for each member of a crowded key."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b], names=["a", "b"])

    def pairs(key: np.ndarray, fp: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
        a, b = _survivors(key, fp, pivots, threshold)
        used = np.unique(np.concatenate((a, b)))
        root = _forest(np.searchsorted(used, a), np.searchsorted(used, b), len(used))
        own = root != np.arange(len(used))
        return out(fp[used[own]], fp[used[root[own]]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, len(PIVOTS)), np.uint8)
        held, crowded = none, None
        for batch in batches:
            own = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, len(PIVOTS))
            key, fp, pivots = (np.concatenate(x) for x in zip(held, own))
            if not len(key):
                continue
            if crowded is not None:  # the batch before ended within a crowded key
                n = np.searchsorted(key, crowded, side="right") if key[0] == crowded else 0
                yield out(fp[:n], None)
                key, fp, pivots = key[n:], fp[n:], pivots[n:]
                crowded = crowded if not len(key) else None
            if not len(key):
                held = none
                continue
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(key)])))
            many = np.repeat(sizes > run, sizes)
            if many.any():
                yield out(fp[many], None)
            last = starts[-1]
            if sizes[-1] > run:
                crowded, held = key[last], none
            else:
                held = key[last:], fp[last:], pivots[last:]
            body = ~many[:last]
            yield pairs(key[:last][body], fp[:last][body], pivots[:last][body])
        yield pairs(*held)

    return work


def links(fps: DataFrame, threshold: int = 2, masks: list[int] | None = None, run: int = RUN) -> DataFrame:
    """(a, b): links between distinct fingerprints (columns fp, pivots) that connect all pairs within the threshold.

    Not all pairs: under each key a spanning forest of them, so a key's links are fewer than its members."""
    masks = exact_masks(threshold) if masks is None else masks
    fp = F.col("fp")
    keys: list[Column] = [F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    rows = fps.select(F.explode(F.array(*keys)).alias("key"), "fp", "pivots")
    met = cut(in_arrow(rows.repartition("key").sortWithinPartitions("key", F.substring("pivots", 1, 1)), _paired(threshold, run), "a long, b long"))
    crowd = met.filter("b is null").select("a").distinct()
    variants = crowd.select("a", F.explode(F.array(fp_self := F.col("a"), *[fp_self.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("v"))
    through = variants.groupBy("v").agg(F.min("a").alias("b"), F.max("a").alias("c")).filter("b <> c")
    by_variant = variants.join(through.select("v", "b"), "v").filter("a <> b").select("a", "b")
    return met.filter("b is not null").union(by_variant)


def near_duplicates(docs: DataFrame, k: int = 3, threshold: int = 2, run: int = RUN) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints differ in at most threshold bits are linked;
    component_id is the smallest doc_id that a document reaches, its own included."""
    if threshold > 2:
        raise ValueError("crowded keys are exact up to two bits; link wider thresholds with links()")
    docs = cut(fingerprints(docs, k))
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("pivots").alias("pivots"))
    roots = cut(components(links(fps, threshold, run=run)))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    return docs.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _set(data: bytes, k: int) -> np.ndarray:
    """The sorted XXH64 hashes of a text's shingles, each once."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, 42) for x in shingles(data, k)], "<u8"))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_set(t, k).tobytes() for t in texts(batch.column(1))], pa.binary())], names=["doc_id", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= least * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def frequent(docs: DataFrame, k: int, most: int = 200_000, held: int = 1 << 19) -> np.ndarray:
    """Hashes of shingles that many documents hold, the most frequent last. They set the order of shingles, on which the time depends and the result does not; so not every count is kept.

    All documents are counted. A task's table of hashes is cut to the more frequent half of them where it is full, and gives its most frequent tenth."""

    def top(times: np.ndarray, n: int) -> np.ndarray:
        return np.flatnonzero(times > 1) if n >= len(times) else np.sort(np.argpartition(times, len(times) - n)[len(times) - n :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = np.zeros(0, "<u8"), np.zeros(0, np.int64)
        for batch in batches:
            own, n = np.unique(np.concatenate([known[:0], *(_set(t, k) for t in texts(batch.column(0)))]), return_counts=True)
            known, which = np.unique(np.concatenate((known, own)), return_inverse=True)
            times = np.bincount(which, weights=np.concatenate((times, n)), minlength=len(known)).astype(np.int64)
            if len(known) > held:
                some = top(times, held // 2)
                known, times = known[some], times[some]
        some = top(times, held // 10)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(times[some])], names=["shingle", "n"])

    seen = in_arrow(docs.select("text"), run, "shingle long, n long").filter("n > 1").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = seen.orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    return found.column("shingle").to_numpy().view(np.uint64)[::-1]


def prefix(own: np.ndarray, known: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, in an order that all sets share: a set that is similar enough has one of its own first ones among them."""
    n = len(own)
    order = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        order = np.where(known[at] == own, rank[at] + 1, 0)
    return own[np.lexsort((own, order))[: n - math.ceil(similarity * n - 1e-9) + 1]]


PARTS = 256


def _sketch(own: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of PARTS parts, as a byte each, in units of a power of two (the first byte) and rounded up."""
    n = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=PARTS)
    unit = max(0, int(n.max()).bit_length() - 8)
    unit += int(-(-int(n.max()) >> unit) > 255) if unit else 0
    return bytes([unit]) + (-(-n >> unit)).astype(np.uint8).tobytes()


def _counts(sketches: list[bytes]) -> np.ndarray:
    """Of each part, no fewer than there are."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, PARTS + 1)
    return raw[:, 1:].astype(np.int32) << raw[:, :1].astype(np.int32)


def _shared(x: np.ndarray, y: np.ndarray, block: int = 4096) -> np.ndarray:
    """No fewer than two sets share, by the smaller count of each part; rows of x with rows of y, or with the one of y."""
    return np.concatenate([np.zeros(0, np.int64), *(np.minimum(x[i : i + block], y[i : i + block] if len(y) > 1 else y).sum(1) for i in range(0, len(x), block))])


def _bounded(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of sets (of sizes n and m) that can be similar."""
    for batch in batches:
        n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (4, 5))
        x, y = (_counts(batch.column(i).to_pylist()) for i in (2, 3))
        keep = (both := _shared(x, y)) >= least * (n + m - both) - 1e-6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _runs(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns sorted by the first one, dealt anew so that rows of one key come together."""
    held: list[list[np.ndarray]] = []
    for cols in parts:
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or (held and held[0][0][0] != cols[0][0]):
            held.append([c[:last] for c in cols])
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    return _runs([c.to_numpy() for c in batch.columns] for batch in batches)


def _keys(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """As _runs(), one key at a time."""
    for cols in _runs(parts):
        edges = [*np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1]))).tolist(), len(cols[0])]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield [c[a:b] for c in cols]


def _possible(size: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets i and j of these sizes can be similar if the shingle at these places is the first they share."""
    n, m = size[i].astype(np.int64), size[j].astype(np.int64)
    return np.minimum(n - at[i], m - at[j]) >= similarity / (1 + similarity) * (n + m) - 1e-6


def _neighbours(similarity: float):
    """Arrow batches of (key, size, at, id) sorted by key, size and id -> rows whose key others have too, with the one before and the key's first where those can be similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, at, own in _whole(batches):
            place = np.arange(len(key))
            first = np.concatenate(([True], key[1:] != key[:-1]))
            run = np.cumsum(first) - 1
            lead, before = place[first][run], np.maximum(place - 1, 0)
            many = np.bincount(run)[run] > 1
            columns = [pa.array(x[many]) for x in (key, size, at, own)]
            for other in (before, lead):
                bad = first | (own[other] == own) | ~_possible(size, at, other, place, similarity)
                columns.append(pa.array(own[other][many], mask=bad[many]))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "at", "id", "before", "lead"])

    return work


def _seekers(similarity: float, hubs: int = 2, reach: int = 2):
    """Arrow batches of (key, size, at, id, root, links) sorted by key, size and id -> (a, b): each row with the rows of its key that have most links already, and with the next ones of another root on both sides, where roots differ and sizes allow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, at, own, root, links in _whole(batches):
            place = np.arange(len(key))
            run = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
            times = np.bincount(run)
            first = np.cumsum(times) - times
            by = np.lexsort((own, -links, run))  # of each key, those with most links first
            same = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (root[1:] != root[:-1])))) - 1
            n = np.bincount(same)
            begin = np.cumsum(n) - n
            others = [by[np.minimum(first + d, len(by) - 1)][run] for d in range(hubs)]
            others += [x for d in range(reach) for x in (begin[same] - 1 - d, (begin + n)[same] + d)]
            found = []
            for j in others:
                j = np.clip(j, 0, len(key) - 1)
                ok = (run[j] == run) & (root[j] != root)
                i, j = place[ok], j[ok]
                ok = _possible(size, at, np.minimum(i, j), np.maximum(i, j), similarity)
                found.append((np.maximum(own[i[ok]], own[j[ok]]), np.minimum(own[i[ok]], own[j[ok]])))
            a, b = map(np.concatenate, zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return work


def _across(similarity: float):
    """Arrow batches of (key, size, at, id, root) sorted by key, size and id -> (a, b): all pairs of a key that have different roots and can be similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, at, own, root in _whole(batches):
            run = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
            left = np.bincount(run)[run] - (np.arange(len(key)) - np.searchsorted(run, run))  # rows of the key from here on
            d, i = 1, np.arange(len(key))
            while len(i := i[left[i] > d]):
                ok = i[(root[i] != root[i + d]) & _possible(size, at, i, i + d, similarity)]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(own[ok], own[ok + d])), pa.array(np.minimum(own[ok], own[ok + d]))], names=["a", "b"])
                d += 1

    return work


def _crowded(similarity: float, block: int = 1 << 16):
    """As _across(), of keys that many rows share, which have a column sketch too: only pairs that can be similar by their sketches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.empty(batch.num_rows, object)
            sketch[:] = batch.column(5).to_pylist()
            yield [*(c.to_numpy() for c in batch.columns[:5]), sketch]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, at, own, root, sketch in _keys(rows(batches)):
            counts = _counts(sketch.tolist())
            _, which, times = np.unique(root, return_inverse=True, return_counts=True)
            most, found, held = np.argmax(times), [], 0
            for i in np.flatnonzero(which != most):  # pairs within the key's largest group need no look
                j = np.arange(np.searchsorted(size, size[i] / similarity + 1e-6, side="right"))
                j = j[(which[j] == most) | (which[j] != which[i]) & (j > i)]
                j = j[_possible(size, at, np.full(len(j), i), j, similarity)]
                both = _shared(counts[j], counts[i : i + 1])
                j = j[both >= similarity * (size[i] + size[j].astype(np.int64) - both) - 1e-6]
                found.append((np.maximum(own[i], own[j]), np.minimum(own[i], own[j])))
                held += len(j)
                if held >= block or i == len(key) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

    return work


def duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, kept_id): each document that has a near duplicate with a smaller id, and the smallest id of its group.

    Two documents are linked if the Jaccard similarity of their sets of k-word shingles is `similarity` or more; groups are
    the components of all such links. Equal sets are joined by a 128-bit hash. The first candidates are pairs whose sets'
    fingerprints links() connects. Any two that are similar enough share one of the first shingles of each (prefix()),
    whatever the number of documents: rows of one such shingle are paired with the row before and the first. What of all
    these is similar is grouped, and then all pairs across groups that share such a shingle are looked at.

    Null ids are left out; repeated ids are one document; empty texts, and others without words, are equal sets."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    by_count = frequent(docs, k)
    known = np.argsort(by_count)
    sent = docs.sparkSession.sparkContext.broadcast((by_count[known], known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, sizes, firsts, counts, prints = [], [], [], [], []
            for x in texts(batch.column(1)):
                own = _set(x, k)
                marks.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                firsts.append(prefix(own, *sent.value, similarity).tobytes())
                counts.append(_sketch(own))
                prints.append(majority(own))
            fp = np.array(prints, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.binary()), pa.array(counts, pa.binary()), pa.array(fp.view(np.int64)), pa.array([x.tobytes() for x in distances(fp)], pa.binary())], names=["doc_id", "mark", "size", "first", "sketch", "fp", "pivots"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            parts = [np.frombuffer(x, np.int64) for x in some.column(2).to_pylist()]
            n = [len(x) for x in parts]
            at = np.concatenate([np.arange(x, dtype=np.int32) for x in n])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.repeat(some.column(1).to_numpy(), n)), pa.array(at), pa.array(np.repeat(some.column(0).to_numpy(), n))], names=["key", "size", "at", "id"])

    def ordered(a: Column, b: Column) -> tuple[Column, Column]:
        return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")

    def alike(pairs: DataFrame) -> DataFrame:
        first, second = rows.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("n")), rows.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("m"))
        pairs = cut(in_arrow(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y", "n", "m"), lambda x: _bounded(x, similarity), "a long, b long").distinct())
        named = pairs.select("a").union(pairs.select("b")).distinct()
        sets = stored(in_arrow(docs.join(named, docs.doc_id == named.a, "left_semi"), lambda x: _sets(x, k), "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "sets")
        first, second = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
        return cut(in_arrow(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y"), lambda x: _similar(x, similarity), "a long, b long"))

    rows = stored(in_arrow(docs, run, "doc_id long, mark binary, size int, first binary, sketch binary, fp long, pivots binary"), "shingles")
    distinct = rows.groupBy("mark").agg(F.min("doc_id").alias("rep"))
    copies = rows.select("doc_id", "mark").join(distinct, "mark").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    heads = rows.join(distinct.select("rep", F.col("mark").alias("_mark")), (F.col("doc_id") == F.col("rep")) & (F.col("mark") == F.col("_mark")))
    prints = cut(heads.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("pivots").alias("pivots")))
    firsts = prints.select("fp", "first")
    same = heads.select("doc_id", "fp").join(firsts, "fp").filter("doc_id <> first").select(*ordered(F.col("doc_id"), F.col("first")))
    linked_prints = links(prints).join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(*ordered(F.col("x"), F.col("y")))
    keys = in_arrow(heads.select("doc_id", "size", "first"), spread, "key long, size int, at int, id long").repartition("key").sortWithinPartitions("key", "size", "id")
    met = stored(in_arrow(keys, _neighbours(similarity), "key long, size int, at int, id long, before long, lead long"), "met")
    pairs = met.select("id", F.explode(F.array("before", "lead")).alias("o")).filter("o is not null").select(*ordered(F.col("id"), F.col("o")))
    near = cut(pairs.union(same).union(linked_prints).distinct())
    linked = alike(near)
    placed = met.select("key", "size", "at", "id")
    seen = near
    for _ in range(SEEK_ROUNDS):  # members of a large group find it by a few of its members
        degree = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        roots = components(linked).join(degree, "node")
        grouped = placed.join(roots, F.col("id") == F.col("node"), "left").select("key", "size", "at", "id", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
        pairs = in_arrow(grouped.repartition("key").sortWithinPartitions("key", "size", "id"), _seekers(similarity), "a long, b long").distinct()
        new = cut(pairs.join(seen, ["a", "b"], "left_anti"))
        seen, linked = cut(seen.union(new)), cut(linked.union(alike(new)))
    grouped = placed.join(components(linked), F.col("id") == F.col("node"), "left").select("key", "size", "at", "id", F.coalesce("root", "id").alias("root"))
    crowd = cut(grouped.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter((F.col("n") > FEW) & (F.col("lo") < F.col("hi"))).select("key"))
    few = in_arrow(grouped.join(crowd, "key", "left_anti").repartition("key").sortWithinPartitions("key", "size", "id"), _across(similarity), "a long, b long")
    many = grouped.join(crowd, "key", "left_semi").join(rows.select(F.col("doc_id").alias("id"), "sketch"), "id").select("key", "size", "at", "id", "root", "sketch")
    many = in_arrow(many.repartition("key").sortWithinPartitions("key", "size", "id"), _crowded(similarity), "a long, b long")
    rest = alike(cut(few.union(many).distinct().join(seen, ["a", "b"], "left_anti")))
    groups = components(copies.union(linked).union(rest))
    return groups.filter("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows and columns of docs, of each group of near duplicates only the document with the smallest id. Rows of one id stay or go together; rows without an id stay."""
    gone = duplicates(docs, **how).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs.doc_id == gone["_gone"], "left_anti")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
