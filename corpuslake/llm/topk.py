"""Exact top-k inner products by no-random-access aggregation (NRA).

Each dimension is a list of candidates sorted by their share of the score: descending
where the query's component is positive, ascending where it is negative. Lists are read
in sequence, a chunk at a time, those first whose ends differ most; one that has been begun
is read on, since its last chunks tell most, so at any time one list at most is read in part and
bounds cost one addition a candidate. A candidate's lower bound counts what has been read of it, and the least of a list
where nothing has; its upper bound counts the value read last there instead. A query stops
once so few candidates can still reach the k-th lower bound that they are scored in
full; nothing outside them can qualify then, read or not.

Queries (a stated set; all rows are candidates) are dealt into blocks of QUERY_BYTES, candidates into shares; each block meets
each share in a task, both sides shuffled there, nothing through the driver. A task takes its share in blocks of BLOCK candidates, whose lists are
sorted once for all its queries, and carries each query's best k from block to block, so
a later block starts with their least score as a bound. It hands on k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates whose lists are sorted together, and chunks that a list is read in.
BLOCK, CHUNKS = 8192, 4
#: Bytes of a block of queries; blocks of candidates that a share has, where there are more of them than tasks to run.
QUERY_BYTES, CARRIED = 32 << 20, 16
#: Scoring begins when so small a share of a block's candidates is still open.
RESOLVE = 0.02
SCALE = 1024


class Lists:
    """The sorted lists of a block: ``order`` and ``values`` by dimension, ascending."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(x.T, self.order, axis=1).astype(np.float64)
        self.largest = float(np.abs(self.values).max(initial=0))
        #: List entries read, bounds formed and dimensions of candidates scored in full, over all queries so far.
        self.read = self.bounds = self.scored = 0

    def open_after_reading(self, q: np.ndarray, k: int, own: np.ndarray, known: float = -np.inf) -> np.ndarray:
        """Candidates (but ``own``) that can be among the k best for ``q``; ``known`` is a score that k others reach."""
        n, d = self.x.shape
        q = q.astype(np.float64)
        high, low = np.maximum(q * self.values[:, 0], q * self.values[:, -1]), np.minimum(q * self.values[:, 0], q * self.values[:, -1])
        lists = np.argsort(low - high, kind="stable")
        rest = np.append(np.cumsum((high - low)[lists][::-1])[::-1], 0.0)  # what the lists from each on can still add
        slack = 0.0 if self.largest * np.abs(q).max(initial=0) * d < 2**53 else self.largest * np.abs(q).max() * d * 1e-12
        few = max(k, int(RESOLVE * n))
        lower = np.full(n, low.sum())
        lower[own] = -np.inf
        typical = float(low.sum())
        at = np.delete(np.arange(n), own)
        for turn, j in enumerate(lists):
            order, shares = self.order[j], q[j] * self.values[j]
            if q[j] > 0:
                order, shares = order[::-1], shares[::-1]
            for a in range(0, n, -(-n // CHUNKS)):
                b = min(n, a - (-n // CHUNKS))
                lower[order[a:b]] += shares[a:b] - low[j]
                self.read += b - a
                edge = (shares[b - 1] - low[j]) if b < n else 0.0  # what the list can still add to those that it has not shown
                typical += float((shares[a:b] - low[j]).sum()) / n
                if (edge and 4 * len(at) > n) or typical + rest[turn + 1] + edge * (n - b) / n >= max(known, lower.max()):
                    continue  # the greater part is open in any case, or this list is soon read
                floor = max(known, np.partition(lower, n - k)[n - k] if n > k else -np.inf) - slack
                upper = lower[at] + rest[turn + 1]
                if edge:
                    unread = np.zeros(n, bool)
                    unread[order[b:]] = True
                    upper += edge * unread[at]
                self.bounds += len(at)
                at = at[upper >= floor]
                if len(at) <= few:
                    return at
        return at


def nra(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best candidates with another id; ties to smaller ids."""
    best = Best(q, query_ids, k)
    best.meet(Lists(x), ids)
    return best.rows, best.cands, best.score


class Best:
    """The k best (candidate row, id, score) of each query over the blocks that it has met."""

    def __init__(self, q: np.ndarray, query_ids: np.ndarray, k: int):
        self.q, self.query_ids, self.k = q, query_ids, k
        none = np.zeros(0, np.int64)
        self.rows = self.cands = self.ids = self.score = self.marks = none

    def meet(self, lists: Lists, ids: np.ndarray, marks: np.ndarray | None = None) -> None:
        """Takes in the candidates of a block. ``marks`` tell rows of one id apart; equal ones count once."""
        marks = np.arange(len(ids)) if marks is None else marks
        rows, cands, score = [self.rows], [self.cands], [self.score]
        got, mark = [self.ids], [self.marks]
        ends = np.searchsorted(self.rows, np.arange(len(self.q) + 1))
        sort = np.argsort(ids, kind="stable")
        low, high = np.searchsorted(ids[sort], self.query_ids, "left"), np.searchsorted(ids[sort], self.query_ids, "right")
        for r, q in enumerate(self.q):
            held = self.score[ends[r] : ends[r + 1]]
            own = sort[low[r] : high[r]]
            at = lists.open_after_reading(q, self.k, own, float(held.min()) if len(held) >= self.k else -np.inf)
            lists.scored += len(at) * len(q)
            rows.append(np.full(len(at), r))
            cands.append(at)
            score.append(lists.x[at] @ q)
            got.append(ids[at])
            mark.append(marks[at])
        rows, cands, score, got, mark = (np.concatenate(p) for p in (rows, cands, score, got, mark))
        by = np.lexsort((mark, got, -score, rows))
        rows, cands, score, got, mark = (v[by] for v in (rows, cands, score, got, mark))
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (got[1:] != got[:-1]) | (mark[1:] != mark[:-1])
        rows, cands, score, got, mark = (v[new] for v in (rows, cands, score, got, mark))
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < self.k
        self.rows, self.cands, self.score, self.ids, self.marks = (v[keep] for v in (rows, cands, score, got, mark))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (integers floor(SCALE * x)) of rows whose id and vector are whole: no null, no non-finite component, not empty.

    A vector of d components of which one is beyond sqrt(2**63 / d) when scaled is left out too: its products may not fit a
    whole number of 64 bits, so it has no score to rank by (in 64 dimensions: components beyond 370,000). Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where("vec_id is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    rows = rows.where(f"forall(x, c -> abs(c) * {SCALE} <= sqrt(9.2e18D / size(x)) - 1)")
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _share(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (queries' block, candidates' share, side) to the best of each query in that share."""
    columns = ["query_id", "vec_id", "score", "mark"]
    best: dict[int, Best] = {}
    asked: list[pa.RecordBatch] = []
    held: list[pa.RecordBatch] = []
    now = None

    def by_width(rows: list[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(rows).combine_chunks()
        widths = table.column("width").to_numpy()
        for w in np.unique(widths):
            t = table.filter(pa.array(widths == w)).combine_chunks()
            yield int(w), t, t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), -1)

    def meet() -> None:
        if asked:  # all queries of the block come first
            best.update({w: Best(x, t.column("vec_id").to_numpy(), k) for w, t, x in by_width(asked)})
            asked.clear()
        for w, t, x in by_width(held):
            if w in best:
                for at in range(0, len(t), 2 * BLOCK):
                    s = slice(at, at + 2 * BLOCK)
                    best[w].meet(Lists(x[s]), t.column("vec_id").to_numpy()[s], t.column("mark").to_numpy()[s])
        held.clear()

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            meet()
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(b.query_ids[b.rows]), pa.array(b.ids), pa.array(b.score), pa.array(b.marks)], columns)
        best.clear()
        asked.clear()

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("block", "share", "side")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if now is not None and now != tuple(keys[a, :2]):
                yield from done()
            now = tuple(keys[a, :2])
            (held if keys[a, 2] else asked).append(batch.slice(a, b - a))
            if sum(x.num_rows for x in held) >= BLOCK:
                meet()
    yield from done()


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with rows of other ids, ties to smaller ids.

    Both sides have vec_id and v (whole numbers, as usable() gives them); vectors of different lengths do not meet, and an empty side
    gives no rows. Equal rows that repeat an id count once; different vectors of one query id have one list
    between them. Other columns are ignored.

    Candidates are shuffled once for each block of queries (QUERY_BYTES), queries once for each share of the candidates.
    """
    spark = candidates.sparkSession
    asked = queries.select("vec_id", "v").distinct()
    size = 8 * (asked.agg(F.sum(F.size("v") + 1).alias("n")).first()["n"] or 0)
    blocks = max(1, -(-size // QUERY_BYTES))
    pieces = max(1, -(-candidates.count() // BLOCK))
    shares = max(-(-pieces // CARRIED), min(pieces, 2 * spark.sparkContext.defaultParallelism))
    columns = ["vec_id", "v", F.size("v").alias("width"), F.xxhash64("v").alias("mark")]
    left = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("side"), *columns)
    dealt = candidates.select("vec_id", "v", F.pmod(F.monotonically_increasing_id(), F.lit(shares)).cast("int").alias("share"))
    right = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "share", F.lit(1).alias("side"), *columns)
    # by ranges, so that shares of like size get a task each; a hash would put several of so few keys in one
    rows = left.unionByName(right).repartitionByRange(blocks * shares, "block", "share").sortWithinPartitions("block", "share", "side")
    found = rows.mapInArrow(lambda b: _share(b, k), "query_id long, vec_id long, score long, mark long")
    found = found.dropDuplicates(["query_id", "vec_id", "mark"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
