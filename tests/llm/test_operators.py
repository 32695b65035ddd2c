"""Every operator against a brute-force version of its contract, on rows with nulls, empty and long texts, ties and copies."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import bpe, bwt, charlm, common, merkle, mixing, ngrams, quality, repeats, sharding, simhash, superkmers, toxicity, warc
from cairn.llm.common import new_folder
from cairn.llm.merkle import edited_next, edits, tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, rest int, text_hash long, score string, fp long, bucket int, place int, row int"
RANDOM = random.Random(5)
WORDS = ["".join(RANDOM.choice("abcdeéü") for _ in range(RANDOM.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ". ", ".\n", ", "]) for _ in range(n))


def texts():
    base = [prose(120, i) for i in range(12)]
    passage = prose(60, 99)
    near = base[0].split()
    near[50] = "changed"
    return base + [base[0], base[0], " ".join(near), base[1] + passage, passage + base[2], base[3][:200] + passage + base[4][:300], "Shti " * 200, "", None, "one", "two words", " \t\n", "ONE", prose(4000, 7), "a b \x1c c", "x" * 3000, "x" * 3000 + "y"]


ROWS = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "é", "B"][i % 5], len(t or ""), "s", 1, 2, "x", 3, 4, 5, 6) for i, t in enumerate(texts())]
ROWS += [ROWS[3], (None, ROWS[4][1], *ROWS[4][2:]), (None, None, *ROWS[4][2:]), (700, ROWS[5][1], *ROWS[5][2:])]
NAMED = [r for r in ROWS if r[0] is not None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


# SimHash


def fingerprint(t):
    w = words((t or "").encode().lower().decode())
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, bits):
    root = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                ri, rj = root[i], root[j]
                root = [min(ri, rj) if r in (ri, rj) else r for r in root]
    return root


@pytest.mark.parametrize("run", [2048, 2])
def test_simhash(docs, empty, run):
    got = simhash.near_duplicates(docs, run=run).collect()
    prints = [fingerprint(r[1]) for r in ROWS]
    root = linked(prints, 2)
    least = {}
    for r, k in zip(ROWS, root):
        if r[0] is not None:
            least[k] = min(r[0], least.get(k, r[0]))
    want = Counter((r[0], f"{p:016x}", least.get(k)) for r, p, k in zip(ROWS, prints, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    if run > 2:
        assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_miss_nothing(spark):
    r = random.Random(1)
    values = {r.getrandbits(64) for _ in range(200)}
    for v in list(values)[:60]:
        values.add(v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    crowd = r.getrandbits(64)
    values |= {crowd ^ (1 << i) for i in range(40)} | {crowd}
    values = sorted(values)
    pivots = simhash.distances(np.array(values, np.uint64))
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, bytes(p)) for v, p in zip(values, pivots)], "fp long, pivots binary")
    want = Counter(Counter(linked(values, 2)).values())
    for run in (2048, 8):
        got = simhash.components(simhash.links(fps, run=run)).groupBy("root").count().collect()
        sizes = Counter(x["count"] for x in got)
        assert sizes == Counter({k: v for k, v in want.items() if k > 1})


def test_near_duplicates_stage(docs, empty):
    kept = sorted(r.doc_id for r in simhash.without_near_duplicates(docs).collect() if r.doc_id is not None)
    sets = {r[0]: set(simhash.shingles((r[1] or "").encode(), 5)) for r in NAMED}
    assert 12 not in kept and 13 not in kept and 0 in kept and 700 not in kept  # copies
    for i in sets:
        if i not in kept:
            assert any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets), i
    assert simhash.without_near_duplicates(empty).count() == 0


def grouped(rows, k=5, least=0.8):
    """(doc_id, smallest id of its group) by brute force."""
    sets = {i: set(simhash.shingles(t.encode(), k)) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    return {(i, r) for i, r in root.items() if i != r}


def test_near_duplicates_far_apart_in_bits(spark):
    rows = []
    for i in range(150):
        w = [f"w{i}x{j}" for j in range(24)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(["another", *w[1:-1], "other"]))]
    assert sum((simhash.simhash(a[1].encode(), 5) ^ simhash.simhash(b[1].encode(), 5)).bit_count() > 12 for a, b in zip(rows[::2], rows[1::2])) > 0
    got = {tuple(r) for r in simhash.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == grouped(rows) and len(got) == 150


def test_near_duplicates_of_others_than_the_leader(spark, monkeypatch):
    r, rows = random.Random(3), []
    for i in range(25):  # one shingle decides all fingerprints
        w = [r.choice(WORDS) for _ in range(60)]
        for j in range(2):
            rows.append((len(rows), " ".join(["same"] * 200 + w)))
            w[r.randrange(60)] = f"changed{i}"
    line = " ".join(r.choice(WORDS) for _ in range(40))  # a template whose copies are alike in part only
    for i in range(120):
        w = line.split()
        for j in r.sample(range(40), r.choice([0, 1, 1, 2, 3])):
            w[j] = r.choice("pqrst")
        rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for few in (64, 1):  # with and without a look at the sketches
        monkeypatch.setattr(simhash, "FEW", few)
        assert {tuple(x) for x in simhash.duplicates(docs).collect()} == grouped(rows)
    sets = [simhash._set(t.encode(), 5) for _, t in rows]
    batch = [np.zeros(len(rows), np.int64), np.array(list(map(len, sets)), np.int32), np.zeros(len(rows), np.int32), np.arange(len(rows)), np.arange(len(rows)) // 30]
    by = np.argsort(batch[1], kind="stable")
    columns = [simhash.pa.array(x[by]) for x in batch] + [simhash.pa.array([simhash._sketch(sets[i]) for i in by], simhash.pa.binary())]
    table = simhash.pa.RecordBatch.from_arrays(columns, names=["key", "size", "at", "id", "root", "sketch"])
    pairs = lambda work, t: {tuple(p.values()) for b in work(0.8)(iter([t.slice(0, 7), t.slice(7)])) for p in b.to_pylist()}
    every, bounded = pairs(simhash._across, table.drop_columns(["sketch"])), pairs(simhash._crowded, table)
    similar = {(a, b) for a, b in every if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert similar and similar <= bounded < every


def test_sketches_bound_what_is_shared():
    r = np.random.default_rng(1)
    for n in (0, 1, 300, 70_000, 200_000):
        own = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(int(n == 70_000)))
        counts = simhash._counts([simhash._sketch(own)])[0]
        assert (counts >= np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=simhash.PARTS)).all()


# Merkle trees


def test_merkle(docs, empty):
    got = edited_next(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = Counter()
    for i, r in enumerate(order):
        t, nx = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        want[r[0], len(t), hashlib.sha256((t[: len(t) - k] + nx[:k]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {}
    for r in got:
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0) and 0 <= r.near_next <= 1
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[0] == by[12] and by[0] != by[1]
    assert edited_next(empty).count() == 0


def brute_tree(t):
    """The sections of a text, each a list of paragraphs of leaves."""
    cut = lambda pattern, x: [m.group() for m in re.finditer(pattern, x)] or [""]
    clause = merkle.CLAUSE.replace(r"\z", r"\Z").replace(r"\x{4e00}-\x{5fff}", "\u4e00-\u5fff")
    return [[cut(clause, p) for p in cut(merkle.PARAGRAPH, s)] for s in cut(merkle.SECTION.replace(r"\z", r"\Z"), t)]


def brute_likeness(x, y):
    """Twice what is equal by what both have, descending into what the other lacks."""
    flat = lambda s: tuple(tuple(p) for p in s)
    a, b = ({flat(s) for s in brute_tree(t)} for t in (x, y))
    same = sum(len(p) for s in a & b for p in s)
    a, b = ({p for s in u - v for p in s} for u, v in ((a, b), (b, a)))
    same += sum(map(len, a & b))
    a, b = ({leaf for p in u - v for leaf in p} for u, v in ((a, b), (b, a)))
    return 1.0 if x == y else 2 * (same + len(a & b)) / (2 * same + len(a) + len(b))


def test_merkle_likeness(spark):
    body = [prose(60, i) + "\n" + prose(30, i + 50) + "\n \t          \n" for i in range(6)]
    texts_ = ["".join(body), "".join(body[1:]), "".join(body[:3]) + "new. " + "".join(body[3:]), "no marks " * 90 + "here", "no marks " * 60 + "other " + "no marks " * 30, "文字" * 90, "a\n", "b\n", "a\n\n\nb\r\n\r\nc", ""]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(3)
    for r in edited_next(docs).collect():
        t, nx = texts_[r.doc_id], texts_[(r.doc_id + 1) % len(texts_)]
        k = len(t) // 4
        edited = t[: len(t) - k] + nx[:k]
        assert r.near_edited == pytest.approx(brute_likeness(t, edited)), r.doc_id
        assert r.near_next == pytest.approx(brute_likeness(t, nx)), r.doc_id
        assert (r.n_edits == 0) == (t == edited)
        assert "".join(leaf for s in brute_tree(t) for p in s for leaf in p) == t
    got = {r.doc_id: r for r in edited_next(docs).collect()}
    assert got[6].near_next == 0 and got[0].near_next > 0.7 and got[3].near_edited > 0.5


def test_merkle_edits(spark):
    row = spark.createDataFrame([("a\nb\n\nc\nd. e", "a\nb\n\nc\nd. f")], "a string, b string").select(tree(F.col("a")).alias("a"), tree(F.col("b")).alias("b"))
    assert [tuple(x) for x in row.select(edits(F.col("a"), F.col("b")).alias("e")).first().e] == [(1, 1)]


# WARC


def test_warc(spark):
    rows = [(i, f"http://x/{i}", [None, "", "<p>é</p>", "long " * 5000, f"page {i}"][i % 5], 1) for i in range(40)] + [(2, "http://x/2", "<p>é</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    listed = warc.write_archives(warc.deduplicated(pages), new_folder(spark, "warc"), archive_bytes=20_000, sample_bytes=4_000)
    got = warc.read_archives(listed, with_payload=True).collect()
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(i, last.get(h or "", -1))
    want = Counter()
    for i, _, h, _ in rows:
        b, of = (h or "").encode(), last[h or ""]
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if of == i else "revisit", None if of == i else of, b if of == i else b""] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    assert listed.count() > 1
    none = warc.write_archives(warc.deduplicated(pages.limit(0)), new_folder(spark, "warc"))
    assert warc.read_archives(none).count() == 0


def test_warc_reader_refuses(tmp_path):
    import io

    out = io.BytesIO()
    writer = warc.Writer(out, warc.train([f"some text {i} of pages".encode() * 9 for i in range(400)], 2048))
    good = warc.record({"WARC-Type": "response", "WARC-Record-ID": "x", "WARC-Date": "d"}, b"body")
    writer.write(good)
    data = out.getvalue()
    assert [warc.parse_record(r)[1] for r in warc.read_frames(io.BytesIO(data))] == [b"body"]
    assert [warc.parse_record(r)[1] for r in warc.read_frames(io.BytesIO(data), chunk=1)] == [b"body"]
    for bad in (data[8:], data[:-3], data + b"junk"):
        with pytest.raises(ValueError):
            list(warc.read_frames(io.BytesIO(bad)))
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), good.replace(b"WARC-Date: d\r\n", b"")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# mixing


def mix_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            rest -= out[s]
            free.discard(s)
    return out


def test_mixing(docs, empty):
    got = mixing.mix(docs, block_words=16).collect()
    again = mixing.mix(docs.repartition(2), block_words=16).collect()
    key = lambda r: (r.doc_id, r.text, r.size, r.taken)
    assert Counter(map(key, got)) == Counter(map(key, again)) and len(got) == len(ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    target, taken = mix_targets(dict(sizes)), Counter()
    for r in got:
        assert r["size"] == len(words(r.text)) and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        assert sum(s.words for s in r.spans or ()) == r.taken
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    out = {r.doc_id: r for r in mixing.mixed_texts(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), block_words=16).collect()}
    assert all(r.n_chars == len(r.text) and r.text for r in out.values())
    assert mixing.mix(empty).count() == 0


def test_mixing_draws_by_weight(spark):
    rows = [(i, "w " * 640, "abc"[i % 3]) for i in range(600)]  # 384,000 words
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.shard_counts(docs, block_words=16, shards=8, seed=3).collect()
    target = mix_targets({s: 128_000 for s in "abc"})
    of = {(r.shard, r.source): r.blocks for r in got}
    for s in "abc":
        counts = [of[k, s] for k in range(8)]
        assert sum(counts) == -(-round(target[s]) // 16)
        p = target[s] / sum(target.values())
        spread = np.std(counts) / np.sqrt(4500 * p * (1 - p))
        assert 0.3 < spread < 2.5, (s, counts)  # a draw, neither dealt evenly nor lumped
    assert sorted(sum(of[k, s] for s in "abc") for k in range(8)) == [4494] + [4501] * 7  # as many slots each, the last what is left
    other = {(r.shard, r.source): r.blocks for r in mixing.shard_counts(docs, block_words=16, shards=8, seed=4).collect()}
    assert other != of


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        seen = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("s")).alias("p")).collect()
        assert sorted(r.p for r in seen) == list(range(n))


# BPE


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    want = Counter()
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_digests(docs).collect())) == want
    assert bpe.encode(docs).select("ids", "decoded", "spans").count() == len(ROWS)
    assert bpe.encode_digests(empty).count() == bpe.encode(empty).count() == 0


@pytest.mark.parametrize("text", ["", "aaaa" * 500, "!" * 999, "Don't STOP 12'll", "<|endoftext|>a<|startoftext|>", "naïve ΑΣ Σας", "日本語 text́", "\x1c\x85x", "a<|b"])
def test_bpe_texts(text):
    from tokenizers import Tokenizer

    b = bpe.loaded(bpe.vocabulary())
    assert b.encode(text) == Tokenizer.from_file(bpe.vocabulary()).encode(text, add_special_tokens=False).ids


# sharding


def test_sharding(docs, empty):
    got = sharding.shuffle_into_shards(docs, 8, bucket_rows=4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in ROWS)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda r: (r.doc_id, r.text, r.shard, r.slot)
    assert {key(r) for r in got if r.doc_id != 3} == {key(r) for r in sharding.shuffle_into_shards(docs.repartition(5), 8, bucket_rows=4).collect() if r.doc_id != 3}
    assert sharding.shuffle_into_shards(empty).count() == 0 and len(sharding.shuffle_into_shards(docs.limit(3)).collect()) == 3


def test_sharding_rows_alike(spark):
    rows = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.col("id").alias("slot_of"))
    rows = rows.union(spark.range(3000).select(F.col("id") + 100, F.concat(F.lit("t"), F.col("id")), F.col("id"))).repartition(5)
    got = sharding.shuffle_into_shards(rows, 4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(8250)]
    assert len({(r.doc_id, r.slot_of) for r in got}) == 33_000
    by = Counter(r.shard for r in got if r.doc_id == 7)
    assert max(by.values()) - min(by.values()) < 700
    again = sharding.shuffle_into_shards(rows.repartition(3), 4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_write_shards(docs, tmp_path):
    sharding.write_shards(sharding.shuffle_into_shards(docs, 3), f"{tmp_path}/shards")
    got = docs.sparkSession.read.parquet(f"{tmp_path}/shards")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], r[1]) for r in ROWS)
    for shard in range(3):
        slots = [r.slot for r in got.filter(F.col("shard") == shard).select("slot", F.input_file_name().alias("f")).orderBy("f").collect()]
        assert sorted(slots) == list(range(len(slots)))


def test_fisher_yates(spark):
    rows = spark.range(1, 300).select(sharding.fisher_yates(F.lit(4), F.lit(1), F.col("id")).alias("p")).collect()
    assert all(sorted(r.p) == [0, 1, 2, 3] for r in rows) and len({tuple(r.p) for r in rows}) == 24


# quality


def test_quality(docs, empty):
    got = Counter(tuple(r)[:7] for r in quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in ROWS:
        t, w = r[1] or "", words(r[1])
        lines = [x for x in t.split("\n") if words(x)]
        times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        want[r[0], len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)] += 1
    assert got == want
    assert not any(r.kept and r.base_failed for r in quality.judged(docs).collect())
    assert quality.judged(empty).count() == 0


def brute_perplexities(texts):
    """log2 perplexity of each text of one language, by the definition."""
    plain = [" " * 4 + re.sub(r"[\t\n\v\f\r\xa0\u3000]", " ", re.sub("[1-9]", "0", t.lower())) for t in texts]
    counts = {5: Counter(t[i : i + 5] for t in plain for i in range(len(t) - 4))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    drop, total, left = {}, {}, {}
    for k, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        d = [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.05), i - 0.05) if of[i] else 0.5 for i in (1, 2, 3)]
        for g, n in c.items():
            drop[k, g] = n if n < 2 and k > 1 else d[min(n, 3) - 1]
            total[k, g[:-1]] = total.get((k, g[:-1]), 0) + n
            left[k, g[:-1]] = left.get((k, g[:-1]), 0) + drop[k, g]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 0x110000
        if (k, g[:-1]) not in total:
            return p(g[1:])
        return (counts[k][g] - drop.get((k, g), 0)) / total[k, g[:-1]] + left[k, g[:-1]] / total[k, g[:-1]] * p(g[1:])

    return [sum(-np.log2(p(t[i : i + 5])) for i in range(len(t) - 4)) / max(1, len(t) - 4) for t in plain]


@pytest.mark.parametrize("small", [False, True])
def test_perplexity(spark, monkeypatch, small):
    if small:  # many shards, none kept
        monkeypatch.setattr(ngrams, "SHARD", 500)
        monkeypatch.setattr(ngrams, "KEPT", 0)
    chinese = "".join(chr(0x4E00 + random.Random(9).randrange(9000)) for _ in range(9000))
    of = {"en": [prose(60, i) for i in range(8)] + ["", None, "x\t9\xa0\n1"], None: [prose(30, 50), prose(30, 51)], "": [prose(30, 52)], "zh": [chinese, chinese[:50], "𝒳 " * 5]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, some in of.items() for t in some)]
    got = {r.doc_id: r.log_perplexity for r in quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    want = [x for some in of.values() for x in brute_perplexities([t or "" for t in some])]
    assert [got[i] for i in range(len(rows))] == pytest.approx(want, abs=1e-4)


def test_every_language_and_script_has_a_band(spark):
    rows = []
    for j in range(36):  # more languages than any bound
        letters = [chr(c) for c in range(0x3B1 + (j % 2) * 0x7F, 0x3B1 + (j % 2) * 0x7F + 24)]  # Greek, Cyrillic
        r = random.Random(j)
        lexicon = ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60)]
        rows += [(len(rows) + i, " ".join(r.choice(lexicon) for _ in range(300)), f"l{j}") for i in range(12)]
        rows.append((len(rows), " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(300)), f"l{j}"))
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    assert not any(r.base_failed for r in got.values())
    noise = [i for i in got if i % 13 == 12]
    assert not any(got[i].kept for i in noise) and sum(r.kept for r in got.values()) >= 0.9 * 12 * 36


def test_kneser_ney_sums_to_one():
    code, _ = charlm.codes([prose(300, 3)])
    n = np.bincount(code, minlength=charlm.SIZE)
    seen = np.flatnonzero(n)
    model = charlm.kneser_ney(seen, n[seen])
    for context in (seen[:5] >> charlm.BITS).tolist() + [0, 12345]:
        every = (context << charlm.BITS) + np.arange(charlm.SYMBOLS)
        assert abs(model.probabilities(every).sum() - 1) < 1e-9


# repeats


def test_shared_prefixes():
    r = random.Random(3)
    for _ in range(200):
        least = r.choice([3, 5, 8])
        strings = [bytes(r.choice(b"ab\x00\xff"[: r.randint(1, 4)]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 8))]
        times = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        want = [i + least <= len(s) and times[s[i : i + least]] > 1 for s in strings for i in range(len(s) + 1)]
        assert bwt.shared_prefixes(strings, least).tolist() == want


def runs_of(mask):
    return sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))


def test_repeated_bytes(docs, empty):
    got = Counter()
    for r in repeats.byte_spans(docs, bucket_bytes=20_000).collect():
        runs = superkmers.covered(r.spans, 200)
        raw = r.text.encode()
        got[r.doc_id, len(raw), sum(b - a for a, b in runs), len(runs), repeats.kept_bytes(raw, runs)] += 1
        assert r.rest.source in ("a", "b", None, "é", "B")
    times = Counter(b[i : i + 200] for r in ROWS for b in [(r[1] or "").encode()] for i in range(len(b) - 199))
    want = Counter()
    for r in ROWS:
        b = (r[1] or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - 199):
            if times[b[i : i + 200]] > 1:
                mask[i : i + 200] = b"\1" * 200
        want[r[0], len(b), sum(mask), runs_of(mask), bytes(x for x, m in zip(b, mask) if not m)] += 1
    assert got == want
    assert sum(w[2] for w in want) > 0
    out = repeats.without_repeated_bytes(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert repeats.without_repeated_bytes(empty).count() == 0


def test_repeated_words(docs, empty):
    got = Counter()
    for r in repeats.word_spans(docs, bucket_bytes=20_000).collect():
        got[r.doc_id, len(words(r.text)), tuple(superkmers.covered(r.spans, 13))] += 1
    first = {}
    for r in ROWS:
        w = words(r[1])
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, 1 << 62), 1 << 62 if r[0] is None else r[0])
    want = Counter()
    for r in ROWS:
        w = words(r[1])
        mask = bytearray(len(w))
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (1 << 62 if r[0] is None else r[0]):
                mask[i : i + 13] = b"\1" * 13
        edges = [i for i in range(len(w) + 1) if (i < len(w) and mask[i]) != (i > 0 and mask[i - 1])]
        want[r[0], len(w), tuple(zip(edges[::2], edges[1::2]))] += 1
    assert got == want
    assert repeats.word_spans(empty).count() == 0


def test_parts_of_long_texts(docs, monkeypatch):
    raw = prose(3000, 1).encode()
    units = superkmers.byte_units([raw[i : i + 1000 + 199] for i in range(0, len(raw) - 199, 1000)])
    assert superkmers.runs(units, 200, 24)[1].sum() == len(raw) - 199


# toxicity


def test_channel():
    text = ["you are an idiot and a loser with stupid trash talk pathetic worthless moron clown", "it is up to us to be ok"] * 20 + [prose(50, i) for i in range(5)]
    code, _ = charlm.codes(text)
    n = np.bincount(code, minlength=charlm.SIZE)
    seen = np.flatnonzero(n)
    table = np.log2(np.maximum(charlm.kneser_ney(seen, n[seen]).probabilities(np.arange(charlm.SIZE)), 1e-12))
    channel = toxicity.Channel(table)
    for hidden, word in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("$tupid", "stupid"), ("st*pid", "stupid"), ("l0ser", "loser"), ("tr@sh", "trash"), ("pa-the-tic", "pathetic"), ("wor7hless!!", "worthless")):
        assert word in channel.words(hidden), hidden
    assert channel.words("loser") == ["loser"] and channel.words("12:30") == []
    runs = [x for x in toxicity.tokens("an I d I o t there") if " " in x]
    assert len(runs) == 1 and "idiot" in channel.words(runs[0])  # the lattice tells which blanks to close
    assert "idiot" in channel.words("i d 1 0 t") and "idiot" in channel.words("i d i 0 t")
    assert channel.decode("is up to us to be ok") == "is up to us to be ok"


def test_toxicity(spark, empty):
    r = random.Random(2)
    bad = ["idiot", "loser", "moron"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(40, i).split()
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    rows += [(1000, "", "x"), (1001, None, "x"), (None, "you 1d10t and l0ser", "x"), (1002, "m.o.r.o.n i d i o t idiot", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = lab.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = {x.doc_id: x.score for x in toxicity.scored(docs, wrong).collect()}  # labels of the held-out fold turned round change nothing
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000] < 0.5 and got[1001] == got[1000] and got[1002] >= 0.5
    assert toxicity.scored(empty, lab).count() == 0
    assert {x.score for x in toxicity.scored(docs.limit(5), lab.limit(0)).collect()} == {0.0}


def test_toxicity_of_a_sample(spark):
    rows, labels = [], []
    for i in range(800):  # the word is in all 100 toxic documents and in 200 others
        rows.append((i, " ".join(WORDS[i % 20 : i % 20 + 20] + ["wretch"] * (i < 300))))
        labels.append((i, int(i < 100)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    for sample in (6000, 70):
        got = [x.score for x in toxicity.scored(docs, lab, sample).collect() if x.doc_id < 300]
        assert 0.2 < np.median(got) < 0.45, sample
    assert toxicity.regression(np.ones((3, 1)), np.array([1.0, 0, 0]), np.array([2.0, 3, 1])) == pytest.approx(toxicity.regression(np.ones((6, 1)), np.array([1.0, 1, 0, 0, 0, 0])))


def test_permutation_undone(spark):
    there = mixing.permuted(F.col("id"), F.lit(50), F.lit("s"))
    back = spark.range(50).select("id", there.alias("p")).select("id", mixing.permuted(F.col("p"), F.lit(50), F.lit("s"), inverse=True).alias("q"))
    assert all(r.id == r.q for r in back.collect())
