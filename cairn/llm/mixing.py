"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents stand end to end, in an order drawn by a seeded hash, as one run of words, packed into blocks of
fixed length. A source's target, in words, is its share by weight, two times its size at most, what is above being shared
anew by weight. Its slots are numbered 0, 1, ...; the blocks they take come from pseudorandom permutations of the block
indices (swap-or-not shuffles, keyed by seed, source and round), one permutation for each round through the source: a
block is taken once more only when all have been taken.

Output shards have equally many slots. Each slot draws its source by weight, so that a shard's counts of the sources are a
multinomial draw; what the draws of all shards together give a source above its target goes to the sources below theirs.
The last slot is cut where the target is met, so a source's taken words are its target, rounded.

Slots and blocks are joined by source and block index; the index spreads a source that holds most rows. Running sums of
sizes are taken in hashed buckets of a source first, so no task orders a whole source.

Nulls: a null text has no words and is not taken; a null source is a source, last in order; null ids are kept. Repeated
rows are rows of their own. An empty table gives an empty result. Result columns of mix() replace columns of the same names;
mixed_texts() keeps all columns of docs, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, apart, joined, stored, table
from .sharding import prefix_sums

ROUNDS = 24


def permuted(index: Column, n: Column, *keys: Column, inverse: bool = False) -> Column:
    """Where the permutation of 0 .. n - 1 that belongs to the keys puts an index (swap-or-not), or which index it puts there: each round undoes itself."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), n) + n - x, n)
        bit = F.xxhash64(*keys, r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, index.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, place, source_size, weight, target) of (source, size), place being the source's in order. A source is capped at most times its size; with the sources in order of cap / weight those capped come first, so the level that the others reach follows from running sums."""
    whole = Window.orderBy(F.col("source").isNull(), "source")
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("place", (F.row_number().over(whole) - 1).cast("long"))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    cap, every = F.col("source_size") * most, Window.partitionBy()
    by = by.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(every) * share)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("free", F.col("cap") > F.col("weight") * F.col("level"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("source_size") / F.col("weight")).alias("at"), F.col("level").alias("value")))).over(every)["value"]
    return by.withColumn("reached", level).select("source", "place", "source_size", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("reached"), "cap")).alias("target"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(by: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """(place, shard, blocks): how many slots of each shard draw each source (columns place, want: the slots that it should get, total of all).

    A slot draws a whole number below the total, and with it the source whose range it falls into. Draws and ranges meet by
    slices of that scale; a range has a row for each slice that it lies in."""
    if not total:
        return by.select("place", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("blocks")).limit(0)
    ranges = prefix_sums(by.select("place", "want"), "place", "want", "low").filter("want > 0").withColumn("high", F.col("low") + F.col("want"))
    width, each = max(1, total // 4096), -(-total // shards)
    ranges = ranges.withColumn("slice", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    draws = by.sparkSession.range(total).select(F.floor(F.col("id") / each).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(total)).alias("draw"))
    draws = draws.withColumn("slice", F.floor(F.col("draw") / width))
    met = draws.join(ranges, "slice").filter((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")))
    return met.groupBy("place", "shard").agg(F.count("*").alias("blocks"))


def reconciled(by: DataFrame, draws: DataFrame, shards: int) -> DataFrame:
    """(place, shard, blocks) with as many blocks of each source as wanted: the last that are drawn beyond that go, in order, to the sources that lack some; a shard's sum stays."""
    inner = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = draws.join(by.select("place", "want"), "place").withColumn("before", F.coalesce(F.sum("blocks").over(inner), F.lit(0)))
    rows = rows.withColumn("kept", F.greatest(F.lit(0), F.least("blocks", F.col("want") - F.col("before"))))
    over = rows.select((F.col("place") * shards + F.col("shard")).alias("key"), "shard", (F.col("blocks") - F.col("kept")).alias("over")).filter("over > 0")
    got = draws.groupBy("place").agg(F.sum("blocks").alias("got"))
    short = by.select("place", "want").join(got, "place", "left").select("place", (F.col("want") - F.coalesce("got", F.lit(0))).alias("short")).filter("short > 0")

    def units(df: DataFrame, key: str, n: str) -> DataFrame:
        return prefix_sums(df, key, n, "first").withColumn("unit", F.explode(F.sequence(F.col("first"), F.col("first") + F.col(n) - 1)))

    dealt = units(over, "key", "over").select("unit", "shard").join(units(short, "place", "short").select("unit", "place"), "unit").groupBy("place", "shard").agg(F.count("*").alias("blocks"))
    kept = rows.select("place", "shard", F.col("kept").alias("blocks"))
    return kept.unionByName(dealt).groupBy("place", "shard").agg(F.sum("blocks").alias("blocks")).filter("blocks > 0")


def plan(docs: DataFrame, block_words: int = 512, shards: int = 16, seed: int = 0, bucket_rows: int = 5_000, **how) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, source and _mix_h, a hash of id and text) with size, source_size, target and at (the place of its first word in its source); and slots (source, block,
    round, words: how many of the block's words it takes, shard)."""
    docs = docs.select("doc_id", "source", _size(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_mix_h"))
    docs = stored(docs, "sized")  # texts are counted once and stay where they are
    by = targets(docs.select("source", "size"), **how)
    size, words = F.col("source_size"), F.round("target").cast("long")
    n = F.greatest(F.lit(1), F.ceil(size / block_words)).cast("long")
    by = by.withColumn("n", n).withColumn("words", F.when(size > 0, words).otherwise(0)).withColumn("whole", F.when(F.col("words") > 0, F.floor((F.col("words") - 1) / size)).otherwise(0))
    keys = lambda r: (F.lit(seed), F.col("source"), r)
    # of each round, the slot that gets the last block, which is shorter
    by = by.withColumn("tail", size - (F.col("n") - 1) * block_words).withColumn("shorts", F.transform(F.sequence(F.lit(0).cast("int"), F.col("whole").cast("int")), lambda r: permuted(F.col("n") - 1, F.col("n"), *keys(r), inverse=True)))
    left, short = F.col("words") - F.col("whole") * size, F.element_at("shorts", -1)
    last = F.least(F.col("n"), F.least(short + 1, F.ceil(left / block_words)) + F.greatest(F.lit(0), F.ceil((left + block_words - F.col("tail")) / block_words) - short - 1))
    by = stored(by.withColumn("want", F.when(F.col("words") > 0, F.col("whole") * F.col("n") + last).otherwise(0).cast("long")), "targets")
    docs = docs.withColumn("_mix_b", F.pmod("_mix_h", F.lit(max(64, docs.count() // bucket_rows))))
    sums = docs.groupBy("source", "_mix_b").agg(F.sum("size").alias("_mix_s"))
    sums = sums.withColumn("_mix_from", F.coalesce(F.sum("_mix_s").over(Window.partitionBy("source").orderBy("_mix_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = sums.join(by, sums.source.eqNullSafe(by.source)).select(sums.source.alias("_mix_source"), sums._mix_b.alias("_mix_bucket"), "_mix_from", "source_size", "target")
    inner = Window.partitionBy("source", "_mix_b").orderBy("_mix_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_mix_in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    docs = docs.join(starts, docs.source.eqNullSafe(F.col("_mix_source")) & (docs._mix_b == F.col("_mix_bucket"))).withColumn("at", F.col("_mix_from") + F.col("_mix_in")).drop("_mix_b", "_mix_in", "_mix_from", "_mix_source", "_mix_bucket")
    total = by.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
    counts = reconciled(by, stored(drawn(by, total, shards, seed), "drawn"), shards)
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))).join(by, "place")
    # in spans of a thousand slots, dealt out before they are written out, so that no task writes out a large source's alone
    spans = counts.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / 1000))))
    spans = spans.repartition(max(2, int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "place", "shard", "span")
    slots = spans.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("span") * 1000, F.col("first") + F.least("blocks", (F.col("span") + 1) * 1000) - 1)))
    slots = slots.withColumn("round", F.least(F.floor(F.col("slot") / F.col("n")), "whole").cast("int")).withColumn("j", F.col("slot") - F.col("round") * F.col("n"))
    slots = slots.withColumn("left", F.least(F.col("words") - F.col("round") * F.col("source_size"), "source_size")).withColumn("short", F.element_at("shorts", F.col("round") + 1))
    begins = F.col("j") * block_words - F.when(F.col("j") > F.col("short"), block_words - F.col("tail")).otherwise(0)
    length = F.when(F.col("j") == F.col("short"), F.col("tail")).otherwise(F.lit(block_words))
    slots = slots.withColumn("words", F.least(length, F.col("left") - begins)).withColumn("block", permuted(F.col("j"), F.col("n"), *keys(F.col("round"))))
    return docs, slots.select("source", "block", "round", "words", "shard")


def taken_spans(docs: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """(source, at, taken, spans): for each document that is taken, its words taken and the spans (round, shard, from, words) in it."""
    end = F.col("at") + F.col("size")
    pieces = docs.filter("size > 0").select("source", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    slots = slots.select(F.col("source").alias("_mix_source"), F.col("block").alias("_block"), "round", "words", "shard").hint("merge")  # they grow with the corpus: never broadcast
    met = pieces.join(slots, pieces.source.eqNullSafe(F.col("_mix_source")) & (pieces.block == F.col("_block")))
    first = F.greatest(F.col("at"), F.col("block") * block_words)
    last = F.least(end, F.col("block") * block_words + F.col("words"))
    met = met.withColumn("from", first - F.col("at")).withColumn("n", last - first).filter("n > 0")
    span = F.struct("round", "from", F.col("n").alias("words"), "shard")
    return met.groupBy("source", "at").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list(span)).alias("spans"))


def placed(docs: DataFrame, block_words: int = 512, shards: int = 16, seed: int = 0, **how) -> DataFrame:
    """(doc_id, source, _mix_h, size, source_size, target, taken, spans) for every row of docs; no text moves."""
    rows, slots = plan(docs, block_words, shards, seed, **how)
    spans = taken_spans(rows, slots, block_words).select(F.col("source").alias("_mix_source"), F.col("at").alias("_mix_at"), "taken", "spans")
    out = rows.join(spans, rows.source.eqNullSafe(F.col("_mix_source")) & (rows.at == F.col("_mix_at")) & (rows["size"] > 0), "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("_mix_source", "_mix_at", "at")


def mix(docs: DataFrame, block_words: int = 512, shards: int = 16, seed: int = 0, **how) -> DataFrame:
    """All columns of docs (every row), and size, source_size, target, taken, spans. Texts are shuffled once, to meet what is taken of them."""
    results = ["size", "source_size", "target", "taken", "spans"]
    found = placed(docs, block_words, shards, seed, **how).groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("_mix_h").alias("_mix_k"))
    found = found.agg(F.collect_list(F.struct(*results)).alias("_mix_found"))  # rows alike have one entry each
    docs = docs.drop(*results).withColumn("_mix_h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    met = docs.join(found, docs.doc_id.eqNullSafe(F.col("_mix_id")) & docs.source.eqNullSafe(F.col("_mix_source")) & (docs._mix_h == F.col("_mix_k")), "left")
    several = F.size("_mix_found") > 1
    alike = met.filter(several).withColumn("_mix_n", F.row_number().over(Window.partitionBy("doc_id", "source", "_mix_h").orderBy("_mix_h")))
    met = met.filter(~several).withColumn("_mix_n", F.lit(1)).unionByName(alike)
    met = met.withColumn("_mix_own", F.element_at("_mix_found", F.col("_mix_n")))
    return met.select(*(c for c in docs.columns if c != "_mix_h"), *(F.col("_mix_own")[c].alias(c) for c in results))


def shard_counts(docs: DataFrame, block_words: int = 512, shards: int = 16, seed: int = 0, **how) -> DataFrame:
    """(shard, source, blocks): the multinomial draw."""
    return plan(docs, block_words, shards, seed, **how)[1].groupBy("shard", "source").agg(F.count("*").alias("blocks"))


def mixed_texts(docs: DataFrame, block_words: int = 512, shards: int = 16, seed: int = 0, **how) -> DataFrame:
    """The columns of docs for each document that the mix takes from, its text the words taken, round after round; a text taken once and whole stays as it is."""
    columns = docs.columns
    mixed = mix(apart(docs, "doc_id", "text", "source"), block_words, shards, seed, **how).filter("taken > 0")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    parts = F.flatten(F.transform("spans", lambda s: F.slice("_mix_words", (s["from"] + 1).cast("int"), s["words"].cast("int"))))
    once = (F.col("taken") == F.col("size")) & F.forall("spans", lambda s: s["round"] == F.element_at("spans", 1)["round"])
    mixed = mixed.withColumn("_mix_words", F.when(~once, words)).withColumn("text", F.when(once, F.col("text")).otherwise(F.array_join(parts, " ")))
    return joined(mixed.withColumn("n_chars", F.length("text").cast("long")), columns, "doc_id", "text", "source", "n_chars")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards: those that a document's words go to."""
    shards = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["shard"]))), ",")
    return placed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))
