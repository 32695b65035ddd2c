"""Lines into sections.

A header line `=kind[:key]` begins a section, which ends before the next header. The header is carried to its lines block by
block: windows run within a block, and what a block gets from those before it (headers and lines so far, the last header)
comes from one row for each block. No task orders a whole dump. Lines with a column `stretch`, some blocks that follow each
other, have these rows put in order stretch by stretch, and then one row for each stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

HEADER = r"(?s)^=([^:]*)(?::(.*))?$"
ADDRESS_KINDS = ("proc_heap", "binary", "literals")


def _before(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """Adds what stands before each row: lines_before, heads_before, filled_before and carry, the last header; `last` counts from the first row then."""
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("lines", "heads", "filled")})
    last = F.when(F.col("last").isNotNull(), F.col("last").withField("base", F.col("last.base") + F.col("filled_before")))
    return rows.withColumn("last", last).withColumn("carry", F.last("last", ignorenulls=True).over(before))


def _before_blocks(blocks: DataFrame, stretches: bool) -> DataFrame:
    if not stretches:
        return _before(blocks, ["dump_id"], "block")
    blocks = _before(blocks, ["dump_id", "stretch"], "block")
    whole = blocks.groupBy("dump_id", "stretch").agg(*(F.sum(c).alias(c) for c in ("lines", "heads", "filled")), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("block"))).alias("last"))
    whole = _before(whole, ["dump_id"], "stretch").select("dump_id", "stretch", *(F.col(f"{c}_before").alias(f"{c}_far") for c in ("lines", "heads", "filled")), F.col("carry").alias("carry_far"))
    both = blocks.join(F.broadcast(whole), ["dump_id", "stretch"])
    carry = F.when(F.col("carry").isNotNull(), F.col("carry").withField("base", F.col("carry.base") + F.col("filled_far"))).otherwise(F.col("carry_far"))
    return both.select("dump_id", "stretch", "block", *((F.col(f"{c}_before") + F.col(f"{c}_far")).alias(f"{c}_before") for c in ("lines", "heads", "filled")), carry.alias("carry"))


def section_lines(lines: DataFrame) -> DataFrame:
    """(dump_id, section_id, kind, key, line_no, n, is_header, value), headers included; without what stands before the first header, in sections of no kind, or behind =end. The key is null where there is none or it is empty; n is the place of a line among those of its section that aren't empty (from 0), null for others."""
    value = F.rtrim("value", F.lit("\r\n"))
    block = ["dump_id", *(["stretch"] if "stretch" in lines.columns else []), "block"]
    rows = lines.select(*block, "seq", value.alias("value"), value.startswith("=").alias("is_header"))
    rows = rows.withColumn("full", ~F.col("is_header") & (F.col("value") != ""))
    so_far = Window.partitionBy(*block).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("headers", F.count_if("is_header").over(so_far)).withColumn("at", F.count("*").over(so_far)).withColumn("filled", F.count_if("full").over(so_far))
    header = F.when(F.col("is_header"), F.struct(F.regexp_extract("value", HEADER, 1).alias("kind"), F.nullif(F.regexp_extract("value", HEADER, 2), F.lit("")).alias("key"), F.col("filled").alias("base")))
    marked = local.withColumn("header", header)
    own = marked.withColumn("own", F.last("header", ignorenulls=True).over(so_far))
    blocks = marked.groupBy(*block).agg(F.count("*").alias("lines"), F.count_if("is_header").alias("heads"), F.count_if("full").alias("filled"), F.max_by("header", F.when(F.col("is_header"), F.col("seq"))).alias("last"))
    carried = _before_blocks(blocks, "stretch" in block).select(*block, "lines_before", "heads_before", "filled_before", "carry")
    joined = own.join(carried, block).withColumn("of", F.coalesce(F.col("own").withField("base", F.col("own.base") + F.col("filled_before")), "carry"))
    n = F.when(F.col("full"), F.col("filled_before") + F.col("filled") - F.col("of.base") - 1)
    out = joined.select("dump_id", (F.col("heads_before") + F.col("headers")).alias("section_id"), "of.kind", "of.key", (F.col("lines_before") + F.col("at") - 1).alias("line_no"), n.alias("n"), "is_header", "value")
    return out.filter((F.col("section_id") > 0) & ~F.col("kind").isin("", "end") | (F.col("is_header") & (F.col("kind") == "end")))


def catalogue(sections: DataFrame) -> DataFrame:
    """(dump_id, section_id, kind, key, line_count, size_bytes) of text sections with lines, and the mark of an incomplete dump."""
    text = sections.filter(~F.col("is_header") & ~F.col("kind").isin(*ADDRESS_KINDS))
    out = text.groupBy("dump_id", "section_id", "kind", "key").agg(F.count_if(F.col("value") != "").alias("line_count"), F.sum(F.octet_length("value") + 1).alias("size_bytes"))
    open_ended = sections.groupBy("dump_id").agg(F.bool_or(F.col("kind") == "end").alias("ended")).filter(~F.col("ended"))
    mark = open_ended.select("dump_id", F.lit(0).cast("long").alias("section_id"), F.lit("_meta").alias("kind"), F.lit("incomplete").alias("key"), F.lit(1).cast("long").alias("line_count"), F.lit(1).cast("long").alias("size_bytes"))
    return out.unionByName(mark)
