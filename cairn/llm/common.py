"""What several operators share: tables, the shared folder, lineage cuts and byte views of Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The word separators of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that an operator in Python takes at a time (or one longer text).
SLICE = 4 << 20

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where none is set, one of this machine if all of Spark runs in one process here, else an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    now = spark.sparkContext.getCheckpointDir()
    if now is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='cairn-')}")
        now = spark.sparkContext.getCheckpointDir()
    return now


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to any longer, which it does when the driver's memory is collected; between many small rounds that is seldom."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that nothing above them runs again."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    forget(spark)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), as a Parquet table: compressed, and read by column."""
    spark, schema, path = df.sparkSession, df.schema, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    del df
    forget(spark)
    return spark.read.schema(schema).parquet(path)


def release() -> None:
    """Gives memory that a worker has used back to the machine; workers go on with other operators' tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of so many bytes of text, or of one longer row. Empty batches go."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = max(at + 1, to)
            yield batch.slice(at, to - at)
            at = to


def in_arrow(df: DataFrame, work: Work, schema, most: int = SLICE) -> DataFrame:
    """df.mapInArrow(work, schema), in slices of bounded size, the worker's memory released when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(sliced(batches, most))
        finally:
            release()

    return df.mapInArrow(run, schema)


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def apart(docs: DataFrame, *own: str) -> DataFrame:
    """The columns named, and all others in a struct `rest`, where their names clash with nothing."""
    others = [c for c in docs.columns if c not in own]
    rest = F.struct(*map(_col, others)) if others else F.lit(None).cast("struct<none:int>")
    return docs.select(*(c for c in docs.columns if c in own), rest.alias("rest"))


def joined(rows: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """Of apart()'s columns, those of docs again, by their names."""
    return rows.select(*(F.col(c) if c in own else F.col("rest")[c].alias(c) for c in columns))


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts end to end, and n + 1 offsets; a null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Memo(dict):
    """Answers of a function in two generations; when the younger is full, the older one goes."""

    def __init__(self, look, most: int):
        self.look, self.most, self.old = look, most, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.look(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found
