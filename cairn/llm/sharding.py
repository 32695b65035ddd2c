"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records uniformly into buckets by a seeded hash; there are as many buckets as keep each near
bucket_bytes and bucket_rows, so that one fits in memory whatever the table's size. Pass two draws a Fisher-Yates
permutation for each bucket (each draw is a seeded hash of bucket and step, so that reruns and retried tasks agree) and
gives each record its place. Places run on from bucket to bucket and are cut into shards whose counts differ by one at most.

A bucket's permutation is drawn over its row numbers, and records are ranked by a sort that can spill: no task holds a
bucket's texts at once, and one very long text harms nothing.

Nulls are hashed like values. Rows that are alike in doc_id and text fall into one bucket, in no defined order among
themselves; where there are more than ALIKE of them, they are numbered, in every task that has read some, and each ALIKE of
them fall into a bucket of their own draw. An empty table gives an empty result. Columns named shard or slot are replaced,
all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import apart, stored, table

#: Rows alike that are scattered together.
ALIKE = 64


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """array<int>: a permutation of 0 .. n - 1, built inside out: item i takes a place drawn from 0 .. i, whose item moves to the end."""

    def step(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        return F.when(j == i, F.concat(a, F.array(i))).otherwise(F.concat(F.slice(a, F.lit(1), j), F.array(i), F.slice(a, j + 2, i - j - 1), F.array(F.element_at(a, j + 1))))

    return F.aggregate(F.sequence(F.lit(0), n.cast("int") - 1), F.array().cast("array<int>"), step)


def prefix_sums(df: DataFrame, key: str, value: str, out: str, group: int = 4096) -> DataFrame:
    """Adds the sum of value over all smaller keys (non-negative whole numbers, one row each), in two levels: no task sorts more than a group of keys, or one row for each group."""
    df = df.withColumn("_g", F.floor(F.col(key) / group))
    within = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    groups = df.groupBy("_g").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_g", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    return df.join(groups, "_g").withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_g", "_before")


def numbered_alike(held: DataFrame, most: int) -> DataFrame:
    """held with `copy`: 0, or for rows whose mark more than `most` rows have, their number among these by `most`. No task orders all rows of a mark."""
    many = stored(held.groupBy("mark").count().filter(F.col("count") > most).select("mark"), "alike")
    if many.isEmpty():
        return held.withColumn("copy", F.lit(0).cast("long"))
    rare = held.join(many, "mark", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    found = held.join(many, "mark", "left_semi").withColumn("read", F.monotonically_increasing_id()).withColumn("part", F.shiftright("read", 33))
    found = stored(found, "alike-rows")  # as numbered, whatever is read again
    before = Window.partitionBy("mark").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.groupBy("mark", "part").agg(F.count("*").alias("n")).select("mark", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = found.withColumn("n", F.row_number().over(Window.partitionBy("mark", "part").orderBy("read")) - 1)
    own = own.join(parts, ["mark", "part"]).withColumn("copy", F.floor((F.col("first") + F.col("n")) / most))
    return rare.unionByName(own.select(*rare.columns))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 0, bucket_bytes: int = 16 << 20, bucket_rows: int = 1024) -> DataFrame:
    """All columns of docs, and shard int, slot long (gapless from 0 in each shard)."""
    held = apart(docs.drop("shard", "slot")).select(F.col("rest").alias("row"), F.xxhash64(F.lit(seed), "rest.doc_id", "rest.text").alias("mark"))
    row_id, text = F.col("row.doc_id"), F.col("row.text")
    total = held.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-total.rows // bucket_rows), -(-total.bytes // bucket_bytes))
    copies = numbered_alike(held, ALIKE)
    scattered = copies.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "mark", "copy"), F.lit(buckets)))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    # dealt out again, as the draws take longer than their small rows let expect, and never broadcast: they grow with the table
    dealt = prefix_sums(counts, "bucket", "n", "start").repartition(max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket")
    drawn = dealt.select("bucket", "start", fisher_yates(F.col("n"), F.lit(seed + 2), F.col("bucket")).alias("order")).hint("merge")
    ranked = scattered.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("mark", row_id)))
    placed = ranked.join(drawn, "bucket").select("row", (F.col("start") + F.element_at("order", F.col("rank"))).alias("place"))
    each, longer = divmod(total.rows, shards)
    border, place = longer * (each + 1), F.col("place")
    shard = F.when(place < border, F.floor(place / (each + 1))).otherwise(longer + F.floor((place - border) / max(each, 1)))
    slot = F.when(place < border, place % (each + 1)).otherwise((place - border) % max(each, 1))
    return placed.select("row.*", shard.cast("int").alias("shard"), slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its files and their rows in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shuffle_into_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return sharded.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
