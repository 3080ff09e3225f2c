"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Rows are written in ascending document id: a range shuffle of the texts, then each
task encodes its range and writes one file. ORC encodes the integer columns by runs
(RLEv2), keeps minima and maxima for every ROW_STRIDE rows and a Bloom filter on
doc_id, so a reader that asks for some documents skips files, stripes and row
groups by their metadata, and stripes are read in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B
from corpuslake.llm.segments import encoder

ROW_STRIDE = 1000
STRIPE_BYTES = 64 << 20
#: Offsets of up to so many files (16 bytes each) are broadcast; beyond, a shuffled join brings them to the rows.
BROADCAST_PARTS = 100_000
#: Rows that a file holds, roughly, and files at most.
FILE_ROWS, MOST_FILES = 20_000, 65_536
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, *, spaced: bool = True, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write one row per row of ``docs`` to ``path``.

    Rows ascend by doc_id over the files' part numbers, null ids first, rows of one id by
    a hash of their texts. part is the file's place in that order and start_in_part the number
    of ids before the row in its file. An empty table leaves a readable empty folder. The number of ranges
    grows with the rows. Rows that repeat an id stand one after the other, in several files where they are many; other columns are
    ignored. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, before = encoder(tokenizer, spaced).encode, TaskContext.get().partitionId(), 0
        for batch in B.row_slices(batches, 1):
            ids, counts = encode(*B.text_buffer(batch.column(1)))
            if end_id is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + ends - counts), pa.array(counts), lists], ["doc_id", "part", "start_in_part", "n_tokens", "ids"]
            )
            before += int(ends[-1]) if len(ends) else 0

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), min(MOST_FILES, rows.select("doc_id").count() // FILE_ROWS))
    # behind the id, a hash of the text and the place in the input, so that no id, and no row that is repeated, is one range
    rows = rows.withColumns({"h": F.xxhash64("text"), "no": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "h", "no"]
    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("h", "no")
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", ROW_STRIDE)
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("compression", "zstd")
        .mode("overwrite")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids from the files at ``path``.

    With ``doc_ids`` only those documents, found by pushed-down filters on the files' metadata.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    # one row a file: the sum over parts and their prefix sums stay small
    parts = spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    if len(rows.inputFiles()) <= BROADCAST_PARTS:
        base = F.broadcast(base)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ids_crc32 in place of their ids: crc32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    columns = [c for c in rows.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(crc, pa.int64())], [*columns, "ids_crc32"])

    types = dict(rows.dtypes)
    return rows.select(ids_col, *columns).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in columns), "ids_crc32 long"]))
