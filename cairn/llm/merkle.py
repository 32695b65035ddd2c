"""Merkle trees over a document's sections and paragraphs, with DataFrame functions only.

A section ends with its blank lines, a paragraph with its line, a clause with its mark; all keep what ends them, so the
leaves of a tree put together are the text. A clause of 64 characters without a mark ends with the next word that ends in a
frequent letter, so that an edit within a run of words leaves the clauses behind it as they are. A node's hash covers its
children's hashes and the root that of all sections: equal texts have equal roots, and where two roots differ the differing
branches lead to the edit.

The fingerprint is the tree written out: the root, and for each section its hash and its paragraphs, each with its hash and
its leaves' codes. Two fingerprints' likeness is 1 for equal roots. Else only branches that the other tree lacks are
descended into: equal sections count by their leaves, then equal paragraphs of the sections that differ, then equal leaves
of the paragraphs that differ; it is twice what is equal by what both have (Dice's coefficient).

Nulls: a null text counts as empty; an empty text is one empty section. Null ids come first in the order of ids, equal
ids in the order of their texts; rows of one id go to one range. An empty table gives an empty result. Other columns are not
read by edited_next().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

SECTION = r"(?s).+?(?:\n(?:[^\S\n]*\n)+|\z)"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
MARK = "[.!?,;:|] |[。！？，；：、]"
#: A clause: up to its mark, or if there is none for 64 characters up to one or to a word that ends in one of these letters.
CLAUSE = rf"(?s).{{1,64}}?(?:{MARK}|\z)|.{{64}}.*?(?:{MARK}|[aeinorstаеинотαεινοσ] |[\x{{4e00}}-\x{{5fff}}]|\z)"


def _parts(text: Column, pattern: str) -> Column:
    """What the pattern cuts a text into; of an empty one, itself."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _code(part: Column) -> Column:
    return F.lpad(F.hex(F.xxhash64(part).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")


def _joined(hashes: Column) -> Column:
    return F.substring(F.md5(F.array_join(hashes, ",")), 1, 16)


def tree(text: Column) -> Column:
    """struct<root, sections: array<struct<hash, paragraphs: array<struct<hash, leaves: array<string>>>>>>"""

    def paragraph(p: Column) -> Column:
        return F.transform(F.array(F.transform(_parts(p, CLAUSE), _code)), lambda own: F.struct(_joined(own).alias("hash"), own.alias("leaves")))[0]

    def section(s: Column) -> Column:
        return F.transform(F.array(F.transform(_parts(s, PARAGRAPH), paragraph)), lambda inner: F.struct(_joined(F.transform(inner, lambda p: p["hash"])).alias("hash"), inner.alias("paragraphs")))[0]

    sections = F.transform(_parts(F.coalesce(text, F.lit("")), SECTION), section)
    return F.transform(F.array(sections), lambda s: F.struct(F.substring(F.sha2(F.array_join(F.transform(s, lambda x: x["hash"]), ","), 256), 1, 32).alias("root"), s.alias("sections")))[0]


def edits(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>: places (from 0) where two trees differ; paragraphs are compared only within sections whose hashes differ."""

    def within(x: Column, y: Column) -> Column:
        n = F.greatest(F.coalesce(F.size(x), F.lit(0)), F.coalesce(F.size(y), F.lit(0)))
        return F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(x, i)["hash"].eqNullSafe(F.get(y, i)["hash"]))

    n_sections = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    differ = F.filter(F.sequence(F.lit(0), n_sections - 1), lambda i: ~F.get(a["sections"], i)["hash"].eqNullSafe(F.get(b["sections"], i)["hash"]))
    empty = F.array().cast("array<struct<section:int,paragraph:int>>")
    found = F.flatten(F.transform(differ, lambda i: F.transform(within(F.get(a["sections"], i)["paragraphs"], F.get(b["sections"], i)["paragraphs"]), lambda j: F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph")))))
    return F.when(a["root"] == b["root"], empty).otherwise(found)


def branches(a: Column) -> Column:
    """array<string>: the sections of a tree, each as hash(paragraph,...), a paragraph as hash:leaf.leaf..."""
    return F.transform(a["sections"], lambda s: F.concat(s["hash"], F.lit("("), F.array_join(F.transform(s["paragraphs"], lambda p: F.concat(p["hash"], F.lit(":"), F.array_join(p["leaves"], "."))), ","), F.lit(")")))


def fingerprint(root: Column, sections: Column) -> Column:
    return F.concat(root, F.array_join(sections, ""))


def likeness(root_a: Column, a: Column, root_b: Column, b: Column) -> Column:
    """a, b: branches() of two trees."""

    def inner(sections: Column) -> Column:
        return F.flatten(F.transform(sections, lambda s: F.split(F.substr(s, F.lit(18), F.length(s) - 18), ",")))

    def own_leaves(paragraphs: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.split(F.substr(p, F.lit(18)), r"\."))))

    def count(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit("[:.]")))

    first = F.struct(F.array_intersect(a, b).alias("same"), inner(F.array_except(a, b)).alias("a"), inner(F.array_except(b, a)).alias("b"))
    second = lambda x: F.struct((count(x["same"]) + count(F.array_intersect(x["a"], x["b"]))).alias("same"), own_leaves(F.array_except(x["a"], x["b"])).alias("a"), own_leaves(F.array_except(x["b"], x["a"])).alias("b"))
    third = lambda x: 2.0 * (x["same"] + F.size(F.array_intersect(x["a"], x["b"]))) / (2 * x["same"] + F.size(x["a"]) + F.size(x["b"]))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.transform(F.transform(F.array(first), second), third)[0])


def _range(bounds: list[int], doc_id: Column) -> Column:
    """How many bounds are smaller, by bisection: the cost grows with the logarithm of their number."""
    if not bounds:
        return F.lit(0)
    values = F.lit(bounds)

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.coalesce(F.get(values, middle) < doc_id, F.lit(False)) & (s["lo"] < s["hi"])
        return F.struct(F.when(right, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(bounds) + 1)) + 1)), start, step)["lo"]


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): each text with that of the next document by doc_id, after the last that of the first.

    Documents are dealt to ranges of ids, whose bounds come from approximate quantiles (as many as four for each shuffle
    partition). To each range goes a second copy of the first document of the next one, so that a window within a range sees every successor; texts are shuffled once."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = docs.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    bounds = sorted({int(x) for x in marks})
    own = docs.withColumn("part", _range(bounds, F.col("doc_id"))).withColumn("guest", F.lit(0))
    firsts = sorted((r.part, r.least) for r in own.groupBy("part").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).select("part", F.when(F.col("nulls") > 0, None).otherwise(F.col("least")).alias("least")).collect())
    after = [(part, firsts[(i + 1) % len(firsts)][1], int(i + 1 == len(firsts))) for i, (part, _) in enumerate(firsts)]
    guests = docs.join(F.broadcast(spark.createDataFrame(after, "part int, first long, wraps int")), docs.doc_id.eqNullSafe(F.col("first"))).select("doc_id", "text", "part", (1 + F.col("wraps")).alias("guest"))
    order = Window.partitionBy("part").orderBy(F.when(F.col("guest") == 2, 1).otherwise(0), "doc_id", "text")
    return own.union(guests).withColumn("next_text", F.lead("text").over(order)).filter("guest = 0").select("doc_id", "text", "next_text")


def edited_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text whose last quarter is replaced by the next one's start, how like they are, and in how many places (paragraphs) they differ."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - k), F.substr("next_text", F.lit(1), k)))
    for name, text in (("own", "text"), ("ed", "edited"), ("nx", "next_text")):
        rows = rows.withColumn(f"{name}_tree", tree(F.col(text)))
    own, ed, nx = (F.col(f"{x}_tree") for x in ("own", "ed", "nx"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(x["root"].alias(f"{n}_root") for n, x in (("own", own), ("ed", ed), ("nx", nx))), *(branches(x).alias(n) for n, x in (("own", own), ("ed", ed), ("nx", nx))), F.size(edits(own, ed)).cast("long").alias("n_edits"))
    near = lambda other: likeness(F.col("own_root"), F.col("own"), F.col(f"{other}_root"), F.col(other))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own_root"), F.col("own")).alias("fingerprint"), fingerprint(F.col("ed_root"), F.col("ed")).alias("edited_fingerprint"), near("ed").alias("near_edited"), near("nx").alias("near_next"), "n_edits")


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_next(table(spark, sf_dir, "documents"))
