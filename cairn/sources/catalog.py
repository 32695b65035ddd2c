"""Ingested dumps: a folder for each with its lines in order of kind and key, numbered, its catalogue of sections and its address store, and a row about it.

A dump's folder is named by the fingerprint of its file, so a moved or copied file is known again. The row is written last:
a folder without one is unfinished and is never listed or read; ingesting again replaces it.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import ENGINE_VERSION
from ..operators import heap
from ..operators.dump import SECTIONS, Dump
from ..plans import sections as plan
from .lines import read_at, read_lines

#: Fixed values of FNV-1a.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
ROW = "dump_id string, path string, filename string, size long, label string, ingested_at string, engine string"


def fnv1a(data: bytes, h: int = OFFSET) -> int:
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a file's size and up to eight bytes at five places."""
    _, size = read_at(spark, path, [])
    places = [p for p in (0, size // 4, size // 2, 3 * size // 4, max(0, size - 8)) if p < size]
    found, _ = read_at(spark, path, [(p, 8) for p in places])
    return f"{fnv1a(size.to_bytes(8, 'little') + b''.join(found)):016x}"


class StoredDump(Dump):
    """A dump that has been ingested: its sections and addresses are read from their tables."""

    stored = True

    def __init__(self, spark: SparkSession, folder: str, dump_id: str):
        self._spark, self._folder, self.dump_id = spark, folder, dump_id
        self.all_sections = spark.read.schema(SECTIONS).parquet(f"{folder}/sections")
        self.addresses = spark.read.parquet(f"{folder}/addresses")
        self.catalogue = spark.read.parquet(f"{folder}/catalogue")

    @property
    def spark(self) -> SparkSession:
        return self._spark


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def folder(self, dump_id: str) -> str:
        if not re.fullmatch(r"[0-9A-Fa-f-]+", dump_id):
            raise ValueError(f"bad dump id {dump_id!r}")
        return f"{self.root}/{dump_id}"

    def exists(self, dump_id: str) -> bool:
        fs, where = self._fs(f"{self.folder(dump_id)}/meta/_SUCCESS")
        return fs.exists(where)

    def drop(self, dump_id: str) -> bool:
        fs, where = self._fs(self.folder(dump_id))
        return fs.delete(where, True)

    def ingest(self, path: str, label: str | None = None, told: Callable[[str, dict], None] = lambda step, about: None) -> str:
        """Reads a dump file into its folder, if it isn't there yet, and returns its id. told() hears of each step when it is done."""
        dump_id = fingerprint(self.spark, path)
        told("fingerprint", {"dump_id": dump_id, "size": read_at(self.spark, path, [])[1]})
        if self.exists(dump_id):
            return dump_id
        self.drop(dump_id)
        folder = self.folder(dump_id)
        dump = Dump(read_lines(self.spark, {dump_id: path}))
        dump.all_sections.repartitionByRange("kind", "key", "line_no").sortWithinPartitions("kind", "key", "line_no").write.partitionBy("kind").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{folder}/sections")
        stored = self.spark.read.schema(SECTIONS).parquet(f"{folder}/sections")
        told("sections", {"lines": stored.count()})
        plan.catalogue(stored).coalesce(1).write.parquet(f"{folder}/catalogue")
        told("catalogue", {"sections": self.spark.read.parquet(f"{folder}/catalogue").count()})
        heap.write_store(heap.store(heap.entries(stored)), f"{folder}/addresses")
        told("addresses", {"entries": self.spark.read.parquet(f"{folder}/addresses").count()})
        name = os.path.basename(path)
        self._row(dump_id, path, name, read_at(self.spark, path, [])[1], label or name)
        return dump_id

    def _row(self, dump_id: str, path: str, name: str, size: int, label: str, at: str | None = None) -> None:
        at = at or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        self.spark.createDataFrame([(dump_id, path, name, size, label, at, ENGINE_VERSION)], ROW).coalesce(1).write.mode("overwrite").json(f"{self.folder(dump_id)}/meta")

    def list(self) -> DataFrame:
        """The rows of all finished dumps, the latest first."""
        fs, where = self._fs(self.root)
        if not fs.exists(where):
            return self.spark.createDataFrame([], ROW)
        ids = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
        done = [f"{self.root}/{i}/meta" for i in ids if re.fullmatch(r"[0-9A-Fa-f-]+", i) and self.exists(i)]
        rows = self.spark.read.schema(ROW).json(done) if done else self.spark.createDataFrame([], ROW)
        return rows.orderBy(F.desc("ingested_at"), "dump_id")

    def set_label(self, dump_id: str, label: str) -> None:
        """An empty label gives the file's name back."""
        row = self.list().filter(F.col("dump_id") == dump_id).first()
        if row is None:
            raise LookupError(f"no dump {dump_id}")
        self._row(row.dump_id, row.path, row.filename, row.size, label.strip() or row.filename, row.ingested_at)

    def resolve(self, wanted: str) -> str:
        """A dump id from a path, which is ingested if need be, or from the first four digits of an id or more."""
        fs, where = self._fs(wanted)
        if "/" in wanted or fs.exists(where):
            return self.ingest(wanted)
        if not re.fullmatch(r"[0-9A-Fa-f]{4,}", wanted):
            raise LookupError(f"{wanted!r} is neither a file nor four digits of an id")
        hits = [r.dump_id for r in self.list().collect() if r.dump_id.startswith(wanted.lower())]
        if len(hits) != 1:
            raise LookupError(f"{wanted!r} names {len(hits)} dumps: {hits}")
        return hits[0]

    def open(self, wanted: str) -> StoredDump:
        dump_id = self.resolve(wanted)
        row = self.list().filter(F.col("dump_id") == dump_id).first()
        if row.engine != ENGINE_VERSION:
            raise ValueError(f"dump {dump_id} was ingested by version {row.engine}; ingest it again")
        return StoredDump(self.spark, self.folder(dump_id), dump_id)


@dataclass
class Job:
    """An ingest in the background: status running, done or failed, and what happened."""

    path: str
    status: str = "running"
    dump_id: str | None = None
    events: list[dict] = field(default_factory=list)


class Jobs:
    """Ingests by number, each in a thread of its own."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.jobs = catalog, {}

    def submit(self, path: str, label: str | None = None) -> int:
        import threading

        number, job = len(self.jobs) + 1, Job(path)
        self.jobs[number] = job
        job.events.append({"event": "started", "path": path})

        def work() -> None:
            try:
                job.dump_id = self.catalog.ingest(path, label, lambda step, about: job.events.append({"event": step, **about}))
                job.events.append({"event": "done", "dump_id": job.dump_id})
                job.status = "done"
            except Exception as e:  # the job's record is where it is told
                job.events.append({"event": "error", "message": str(e)})
                job.status = "failed"

        job.thread = threading.Thread(target=work, daemon=True)
        job.thread.start()
        return number

    def get(self, number: int) -> Job:
        return self.jobs[number]
