"""Ingests every dump file that appears in a folder, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.catalog import Catalog

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_arriving(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A query over the folder's files; contents are not read by the stream, only by the ingest of each file. The checkpoint folder keeps what was seen, and a dump that is ingested already is known by its fingerprint, so a restarted query repeats nothing."""

    def ingest(batch: DataFrame, _: int) -> None:
        for row in batch.select("path").toLocalIterator():
            catalog.ingest(row.path)

    files = spark.readStream.format("binaryFile").schema(FILES).load(folder).select("path")
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(ingest)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
