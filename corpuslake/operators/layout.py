"""Reduction of vectors to a few dimensions that keeps neighbours together.

Exact nearest neighbours in pairs of blocks; a fuzzy graph in which each point has a bandwidth of its own; a start from the graph's
leading eigenvectors by power iteration; then rounds of sampled attraction along edges and repulsion from random points.
In each round a block moves its own points and takes those of all others from the round before, so a round is
one job over blocks. What all blocks see is the positions, a few numbers a point.
Every random number comes from the seed, the round and the block: the same rows give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators import density
from corpuslake.session import cut

#: Neighbours, dimensions, rounds of power iteration, rounds of layout, passes over the edges in a round, repelling points an edge.
NEIGHBOURS, DIMENSIONS, POWER, ROUNDS, PASSES, REPELLED = 15, 2, 12, 8, 25, 5
#: The curve 1 / (1 + A d^(2B)) that falls as a distance of 0.1 and a spread of 1 ask for; the longest step of one move.
A, B, CLIP = 1.577, 0.8951, 4.0
#: Points of a block in the layout at least, and blocks at most: each block sees all positions.
BLOCK, BLOCKS = 1024, 48


def neighbours(points: DataFrame, n: int, k: int = NEIGHBOURS) -> DataFrame:
    """node, near (nodes) and d (distances) of the ``k`` nearest other points, ascending; ``points`` has node, x. Ties go to the smaller node."""
    blocks = density.blocks_of(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("i")[row] == batch.column("j")[row]
                (a, x, _), (b, y, _) = (density._of(batch.column(c), row) for c in "ab")
                for node, other, got in list(zip((a, b), (b, a), density.nearest(x, y, k, same, itself=False), strict=True))[: 1 if same else 2]:
                    found = got.at >= 0
                    ends = pa.array(np.append(0, np.cumsum(found.sum(axis=1))).astype(np.int32))
                    near = pa.StructArray.from_arrays([pa.array(got.d[found]), pa.array(other[got.at[found]])], ["d", "other"])
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(ends, near)], ["node", "s"])

    packed = cut(density._packed(points, blocks))
    pairs = density._met(packed, packed, blocks).mapInArrow(run, "node long, s array<struct<d:double,other:long>>")
    lists = pairs.groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list("s"))), 1, k).alias("s"))
    return lists.select("node", F.col("s.other").alias("near"), F.col("s.d").alias("d"))


def bandwidths(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rho, sigma) of rows of ascending distances: the first above 0, and the width at which the strengths come to log2 of their number."""
    positive = np.where(d > 0, d, np.inf).min(axis=1)
    rho = np.where(np.isfinite(positive), positive, 0.0)
    target = np.log2(max(d.shape[1], 2))
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        total = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(axis=1)
        large = total > target
        high, low = np.where(large, sigma, high), np.where(large, low, sigma)
        sigma = np.where(np.isfinite(high), (low + high) / 2, sigma * 2)
    return rho, np.maximum(sigma, 1e-3 * np.maximum(d.mean(axis=1), 1e-12))


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """node, others, strengths: the symmetric graph, in which an edge is there if either end says so (a + b - a * b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("d")
            size = lists.value_lengths().to_numpy()
            d = np.full((len(size), int(size.max(initial=1))), np.inf)
            d[np.arange(d.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
            rho, sigma = bandwidths(np.where(np.isfinite(d), d, 1e300))
            strength = np.exp(-np.maximum(lists.flatten().to_numpy() - np.repeat(rho, size), 0) / np.repeat(sigma, size))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), size)), batch.column("near").flatten(), pa.array(strength)], ["a", "b", "s"])

    directed = near.select("node", "near", "d").mapInArrow(run, "a long, b long, s double")
    edges = directed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("t"), F.when(F.count(F.lit(1)) > 1, F.min("s") * F.max("s")).otherwise(F.lit(0.0)).alias("m"))
    edges = edges.select("a", "b", (F.col("t") - F.col("m")).alias("s"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    return both.groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_list(F.struct("b", "s"))).alias("e")).select("node", F.col("e.b").alias("others"), F.col("e.s").alias("strengths"))


class _Block:
    """A block's own nodes and their edges, flat."""

    def __init__(self, edges: pa.StructArray):
        self.node = edges.field("node").to_numpy()
        others = edges.field("others")
        self.size = others.value_lengths().to_numpy()
        self.at = np.repeat(np.arange(len(self.node)), self.size)
        self.other = others.flatten().to_numpy()
        self.strength = edges.field("strengths").flatten().to_numpy()


def _rounds(graph: DataFrame, state: DataFrame, step, seed: int) -> DataFrame:  # noqa: ANN001
    """One round: ``step`` (block, all positions, random numbers) gives the new positions of each block's nodes."""
    everything = state.agg(F.sort_array(F.collect_list(F.struct("node", "y"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = _Block(batch.column("edges").slice(k, 1).flatten())
                y = batch.column("all").slice(k, 1).flatten().field("y")
                y = y.flatten().to_numpy().reshape(len(y), -1)
                out = step(block, y, np.random.default_rng([seed, batch.column("block")[k].as_py()]))
                ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(block.node), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], ["node", "y"])

    return cut(graph.crossJoin(F.broadcast(everything)).mapInArrow(run, "node long, y array<double>"))  # one row


def reduced(points: DataFrame, n: int, dimensions: int = DIMENSIONS, seed: int = 42) -> DataFrame:
    """node, x: ``points`` (node from 0 to ``n`` - 1, x) in ``dimensions`` dimensions. Fewer than 3 * NEIGHBOURS points, or as few dimensions already, stay as they are."""
    first = points.first()
    if n < 3 * NEIGHBOURS or len(first["x"]) <= dimensions:
        return points.select("node", "x")
    near = neighbours(points, n)
    blocks = max(1, min(-(-n // BLOCK), BLOCKS))
    graph = fuzzy_graph(near).withColumn("block", F.pmod("node", F.lit(blocks)).cast("int"))
    graph = cut(graph.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("node", "others", "strengths"))).alias("edges")))

    def begin(block: _Block, y: np.ndarray, rnd: np.random.Generator) -> np.ndarray:
        weight = np.bincount(block.at, block.strength, len(block.node))
        return np.column_stack([np.sqrt(weight), rnd.normal(size=(len(block.node), dimensions + 1))])

    def power(block: _Block, y: np.ndarray, rnd: np.random.Generator) -> np.ndarray:
        """The first column stays the root of the degree, whose direction is the trivial eigenvector."""
        root, q = y[:, 0], y[:, 1:]
        trivial = root / np.linalg.norm(root)
        q = np.linalg.qr(q - np.outer(trivial, trivial @ q))[0]
        pulled = np.zeros((len(block.node), q.shape[1]))
        np.add.at(pulled, block.at, (block.strength / (root[block.node][block.at] * root[block.other]))[:, None] * q[block.other])
        return np.column_stack([root[block.node], (pulled + q[block.node]) / 2])

    def start(block: _Block, y: np.ndarray, rnd: np.random.Generator) -> np.ndarray:
        q = y[:, 1 : 1 + dimensions]
        q = 10 * q / np.abs(q).max()
        return q[block.node] + rnd.normal(0, 1e-4, (len(block.node), dimensions))

    state = cut(points.select("node", F.array(F.lit(0.0)).alias("y")))
    state = _rounds(graph, state, begin, seed)
    for _ in range(POWER):
        state = _rounds(graph, state, power, seed)
    state = _rounds(graph, state, start, seed)
    for r in range(ROUNDS):
        state = _rounds(graph, state, lambda block, y, rnd, r=r: moved(block, y, rnd, r), seed + 1000 * (r + 1))
    return state.select("node", F.col("y").alias("x"))


def moved(block: _Block, y: np.ndarray, rnd: np.random.Generator, turn: int) -> np.ndarray:
    """New positions of the block's nodes after PASSES over their edges; each node is moved by one edge at a time."""
    y = y.copy()
    turn_of = np.arange(len(block.at)) - np.repeat(np.cumsum(block.size) - block.size, block.size)
    by = np.argsort(turn_of, kind="stable")
    stops = np.searchsorted(turn_of[by], np.arange(int(block.size.max(initial=0)) + 1))
    share = block.strength / block.strength.max(initial=1e-12)
    for p in range(PASSES):
        rate = 1.0 - (turn * PASSES + p) / (ROUNDS * PASSES)
        active = rnd.random(len(share)) < share
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            e = by[a:b][active[by[a:b]]]
            if not len(e):
                continue
            i, j = block.node[block.at[e]], block.other[e]
            gap = y[i] - y[j]
            d2 = (gap * gap).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(d2 > 0, -2 * A * B * d2 ** (B - 1) / (1 + A * d2**B), 0.0)
            force = np.clip(pull[:, None] * gap, -CLIP, CLIP)
            y[i] += rate * force
            for _ in range(REPELLED):
                k = rnd.integers(0, len(y), len(i))
                gap = y[i] - y[k]
                d2 = (gap * gap).sum(axis=1)
                push = 2 * B / ((0.001 + d2) * (1 + A * d2**B))
                y[i] += rate * np.where((k != i)[:, None], np.clip(push[:, None] * gap, -CLIP, CLIP), 0.0)
    return y[block.node]
