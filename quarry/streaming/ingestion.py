"""Background ingestion of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Store, ingest


def file_stream(spark: SparkSession, folder: str, most: int = 100) -> DataFrame:
    """The files of a folder and those that come later, at most ``most`` to a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most).load(folder)


def ingest_stream(files: DataFrame, store: Store, to_chunks: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Ingests each micro-batch of files (path, content) into the store.

    Contents are known by their hash, so files that a restart reads again are skipped,
    as are copies under another name; of equal files of a batch the first by path is
    taken.  A batch adds its own chunks to the store and rewrites none.  Runs until what
    is there has been read."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        if rows.isEmpty():
            return
        ingest(rows, store, to_chunks, task_id=f"stream-{batch_id}", trigger="stream")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
