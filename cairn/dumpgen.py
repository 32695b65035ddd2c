"""Tables rendered as dump lines, so that the engine can be asked about data whose answers SQL knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .operators.dump import Dump

#: Lines of a row that are put in order in one place, and rows of a stretch of blocks.
BLOCK, STRETCH = 1 << 16, 1 << 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str | int) -> Column:
    """Columns and literals as one string."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def lines(df: DataFrame, row: Column, values: Column, part: int = 0) -> DataFrame:
    """(dump_id, stretch, block, seq, value), the form of read_lines() with stretches of blocks: an array of lines for each row, in the order of a whole number; parts follow each other. A row may take any number of blocks."""
    n = F.col("_n").cast("long")
    block = F.struct(F.lit(part).alias("part"), F.col("_row").alias("row"), F.floor(n / BLOCK).alias("piece"))
    stretch = F.struct(F.lit(part).alias("part"), F.floor(F.col("_row") / STRETCH).alias("far"))
    return df.select(row.cast("long").alias("_row"), F.posexplode(values).alias("_n", "value")).select(F.lit("d").alias("dump_id"), stretch.alias("stretch"), block.alias("block"), n.alias("seq"), "value")


def dump(*parts: DataFrame, end: bool = True) -> Dump:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    if end:
        out = out.union(lines(out.sparkSession.range(1), F.lit(0), F.array(F.lit("=end")), 1 << 30))
    return Dump(out)


def pid(n: Column) -> Column:
    return text("<0.", n, ".0>")


def string_lines(value: Column) -> Column:
    """The lines of a text, a leading = kept from being read as a header."""
    return F.transform(F.split(value, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "^=", " ="), r"[\r]+$", ""))


def encoded(data: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data.cast("binary")), r"\s", "")


def atom(name: Column) -> Column:
    return text("A", F.lower(F.hex(F.octet_length(name).cast("long"))), ":", name)


def hexadecimal(n: Column) -> Column:
    return F.lower(F.hex(n.cast("long")))
