"""Incremental runs as streams: an extension, the batch operators do the same work.

Streams run with an available-now trigger: they take what is new since the last run's
checkpoint and end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import bronze
from corpuslake.operators.store import SnapshotTable
from corpuslake.session import cut


def dedup_stream(rows: DataFrame, out: str, checkpoint: str, key: str = "checksum", event_time: str | None = None, delay: str = "1 day") -> SnapshotTable:
    """Appends each key's first row to the table at ``out``, and returns it. Runs what is available, then returns.

    What has been seen is the table itself: a batch leaves out the keys that it holds, so no state grows in
    the executors, and a batch that runs again adds nothing. With ``event_time`` the stream forgets keys ``delay``
    behind the watermark before that.
    """
    table = SnapshotTable(rows.sparkSession, out, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes), key=None)
    stream = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else rows

    def add(batch: DataFrame) -> None:
        fresh = cut(batch.dropDuplicates([key]).join(table.read().select(key), key, "left_anti").select(*rows.columns))
        if fresh.limit(1).count():
            table.append(fresh)

    process_pending(stream, checkpoint, add)
    return table


def process_pending(rows: DataFrame, checkpoint: str, apply: Callable[[DataFrame], None]) -> None:
    """Hands each batch of new rows to ``apply`` (an idempotent upsert), then returns."""
    rows.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def staged_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files below ``folder`` with their checksum and size."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return bronze.with_checksum(rows)


def windowed_counts(rows: DataFrame, ts: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and key with a watermark for late rows; works on streams and batches."""
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")
