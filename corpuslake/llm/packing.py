"""Best-fit-decreasing packing of token sequences.

Best fit decreasing puts pieces, longest first, into the open bin with the least
room that still holds them, or into a new bin. Bins with equal room are alike, and
so are pieces of equal length: the whole packing follows from how many pieces there
are of each length, which is at most ``capacity`` numbers whatever the input. The
driver runs best fit over those counts with a segment tree over remaining
capacities; a run of pieces of one length goes into a range of bins at once. The
result, a short list of runs, is sent to the tasks, where each piece finds its run by
its rank among the pieces of its length. Ranks are local row numbers plus the counts
of earlier partitions, so nothing is sorted as a whole and no length is a hot key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B
from corpuslake.llm._rows import without
from corpuslake.llm.segments import encoder
from corpuslake.session import cut

CAPACITY = 4096


class CapacityTree:
    """A segment tree over remaining capacities: which of them has an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1 - 1).bit_length() if capacity else 1
        while self.size <= capacity:
            self.size *= 2
        self.any = [False] * (2 * self.size)

    def set(self, room: int, open_: bool) -> None:
        k = room + self.size
        self.any[k] = open_
        while k > 1:
            k //= 2
            now = self.any[2 * k] or self.any[2 * k + 1]
            if self.any[k] == now:
                break
            self.any[k] = now

    def tightest(self, need: int) -> int | None:
        """The least room >= ``need`` with an open bin, in logarithmic time."""
        k = need + self.size
        if self.any[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


class Run(NamedTuple):
    """Pieces ``rank`` to ``rank_end`` of one length: ``each`` to a bin, from bin ``bin`` on, the first at ``offset``."""

    length: int
    rank: int
    rank_end: int
    bin: int
    each: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs and the number of bins for ``counts`` pieces of each length.

    The placement is the one that best fit decreasing gives piece by piece: after a
    piece, its bin stays the tightest for the next of that length until it is too
    full, so a bin takes room // length of them in a row.
    """
    tree, open_bins = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    runs: list[Run] = []
    bins = 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            open_bins[room].append((first, many))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        while left > 0:
            room = tree.tightest(length)
            if room is None:
                room, many = capacity, -(-left // (capacity // length))
                first, bins = bins, bins + many
            else:
                first, many = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            need = -(-left // each)
            if many > need:
                open_bins[room].appendleft((first + need, many - need))
                tree.set(room, True)
                many = need
            full = min(many, left // each)
            if full:
                runs.append(Run(length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < many:
                runs.append(Run(length, rank, rank + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left = rank + left, 0
    return runs, bins


def token_pieces(docs: DataFrame, tokenizer: str, *, spaced: bool = False, end_id: int | None = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids of every row: its tokens (null text: empty) and ``end_id``, cut only beyond ``capacity``.

    ids are little-endian unsigned 32-bit integers. A row without any token (no end id) gives no piece.
    Rows that repeat an id, or have none, are cut each for itself; texts are encoded whole, however long; other
    columns are ignored; an empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield pieces_of(batch.slice(at, 2000), encode)

    def pieces_of(batch: pa.RecordBatch, encode) -> pa.RecordBatch:  # noqa: ANN001
        ids, counts = encode(*B.text_buffer(batch.column(1)))
        n = len(counts)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
        pieces = -(-counts // capacity)
        row = np.repeat(np.arange(n), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = number * capacity
        length = np.minimum(counts[row] - start, capacity)
        ends = np.concatenate([[0], np.cumsum(length)]) * 4
        packed = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int64)), packed.cast(pa.binary())], ["doc_id", "piece", "start", "length", "ids"]
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset, by best fit decreasing over all rows.

    Every row is placed; a null length or one outside 1 to ``capacity`` is an error.
    Rows of one length are alike: which of them goes where follows their place in
    the input, so rows that repeat are placed each for itself. Columns of ``pieces`` that are called
    sequence_id or offset give way to the result's; an empty table gives no rows. ``pieces``
    is computed once; drop wide columns first.
    """
    columns = without(pieces.columns, "sequence_id", "offset")
    names = [f"c{k}" for k in range(len(columns))]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)]
    held = cut(pieces.select(*kept, F.col(f"`{length_col}`").cast("int").alias("len"), F.monotonically_increasing_id().alias("row")))
    held = held.withColumn("part", F.shiftright("row", 33))
    sums = cut(held.groupBy("part", "len").agg(F.count(F.lit(1)).alias("n")))
    bad = sums.where(f"len is null or len < 1 or len > {capacity}").select("len").limit(1).collect()
    if bad:
        raise ValueError(f"a piece has the length {bad[0]['len']}")
    counts = {r["len"]: r["n"] for r in sums.groupBy("len").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = best_fit_decreasing(counts, capacity)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "len", F.coalesce("before", F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("part", "len").orderBy("row"))
    ranked = held.withColumn("local", local).join(before, ["part", "len"])
    ranked = ranked.select("len", (F.col("before") + F.col("local") - 1).cast("long").alias("rank"), *names)
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 48) + t[:, 1] if len(t) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            k = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            within = rank - t[k, 1]
            each = t[k, 4]
            bins, offset = t[k, 3] + within // each, t[k, 5] + within % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(bins), pa.array(offset)], [*columns, "sequence_id", "offset"])

    types = dict(pieces.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), "sequence_id long", "offset long"])
    return ranked.mapInArrow(place, schema)
