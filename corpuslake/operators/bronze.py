"""Bronze ingest: checksums, deduplication, ids, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import urls
from corpuslake.operators.skew import joined_by_key
from corpuslake.session import cut


def with_checksum(rows: DataFrame, content: str = "content") -> DataFrame:
    """``rows`` with checksum (SHA-256, hex) and file_size (bytes) of their content."""
    return rows.withColumns({"checksum": F.sha2(F.col(content).cast("binary"), 256), "file_size": F.length(F.col(content).cast("binary")).cast("long")})


def deduplicated(batch: DataFrame, known: DataFrame | None = None, order: Column | str = "discovery_order") -> DataFrame:
    """``batch`` with outcome: ingested, skipped (checksum known or seen earlier in the batch), failed (no checksum).

    Within the batch the first by ``order`` wins. That first is found by a partial aggregate and brought back to
    the rows by a join that deals out hot keys, so a content that fills half the batch is not one task's work.
    """
    o = F.col(order) if isinstance(order, str) else order
    batch = batch.withColumn("__order", o)
    counts = cut(batch.where("checksum is not null").groupBy("checksum").agg(F.min("__order").alias("__first"), F.count(F.lit(1)).alias("copies")))
    first = counts.select("checksum", "__first")
    if known is not None:
        first = first.join(known.select("checksum"), "checksum", "left_anti")
    out = joined_by_key(batch, first, counts.select("checksum", "copies"), ["checksum"], "__order", "left")
    outcome = F.when(F.col("checksum").isNull(), "failed").when(F.col("__order") == F.col("__first"), "ingested").otherwise("skipped")
    return out.withColumn("outcome", outcome).drop("__first", "__order")


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: ingested, skipped, failed (K4)."""
    n = lambda v: F.count_if(F.col("outcome") == v).alias(v)
    return outcomes.agg(n("ingested"), n("skipped"), n("failed"))


def with_ids(rows: DataFrame, last_id: int, order: str = "discovery_order") -> DataFrame:
    """``rows`` with doc_id from ``last_id`` + 1 on, ascending by ``order``.

    Row numbers come from range partitions: counts of earlier partitions plus the place inside one,
    so nothing is sorted in a single task.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    placed = ranged.withColumn("__row", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__row", 33)).withColumn("__at", F.col("__row").bitwiseAND((1 << 33) - 1))
    placed = cut(placed)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = placed.join(F.broadcast(before), "__part").withColumn("doc_id", F.lit(last_id) + F.col("__before") + F.col("__at") + 1)
    return out.drop("__row", "__part", "__at", "__before")


def storage_path() -> Column:
    """Where a content is kept: its checksum and its file's suffix."""
    return urls.object_key(F.col("checksum"), "file_name")


def fresh(staged: DataFrame, bronze: DataFrame) -> DataFrame:
    """Staged candidates that Bronze does not have yet, one for each checksum."""
    return deduplicated(staged, bronze).where("outcome = 'ingested'").drop("outcome")


def register(new: DataFrame, bronze: DataFrame) -> DataFrame:
    """New Bronze rows for fresh() candidates (checksum, file_size, discovery_order), with the next ids."""
    last = bronze.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("m")).first()["m"]
    rows = with_ids(new, last)
    return rows.select(
        "doc_id",
        "source_url",
        "source_type",
        "file_name",
        "file_size",
        "mime_type",
        F.lit(False).alias("excluded"),
        F.lit(None).cast("string").alias("exclusion_reason"),
        "checksum",
        storage_path().alias("storage_path"),
        "raw_metadata",
        F.current_timestamp().alias("ingestion_date"),
    )
