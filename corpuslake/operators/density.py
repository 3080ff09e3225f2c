"""Density clustering of vectors without a number of clusters given: the hierarchy of density levels and its most stable clusters.

1. A point's core distance reaches its ``samples``-th nearest point (itself counts as the first). Points stand in packed
   blocks, and each pair of blocks meets in a task.
2. The mutual reachability of two points is the largest of their distance and both core distances. Each pair of blocks
   gives a minimum spanning forest of its own pairs; the tree of all points is part of the union of those forests, so
   distances are computed once more and nothing quadratic is kept.
3. The union is thinned to the tree of all points by Boruvka's rounds; cutting it from the heaviest edge down gives the hierarchy. Stretches where only groups of
   fewer than ``least`` points fall off are one cluster; those that keep most points over most levels (excess of mass) are selected.

Edges of one weight are cut together, so the outcome depends on the distances alone, not on the order of
rows nor on which of several minimum trees was found.

All vectors are fitted. Edges are thinned in a few tasks first; the hierarchy itself is one task over the edges of one tree (three numbers a point, no
vectors), memberships are computed by blocks again. Only where a caller asks for it (``most``), those with the smallest hashes of their ids
are fitted, and every other point gets the cluster of the fitted point that it reaches most easily.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut

#: Points of a block at least, rows of a block whose distances are held together, and distances to exemplars that are.
BLOCK, ROWS, HELD = 2048, 256, 2_000_000
#: Blocks at most, so that each point is sent to as many tasks at most; points of a block at most, which comes first; points of a block whose distances to as many are held together.
BLOCKS, LARGEST, PART = 24, 100_000, 2048
#: Rows whose distances to a block stay in a processor's cache while the components are summed.
TILE = 32
#: Tasks that thin the edges of all pairs of blocks before the last.
SHARES = 4
#: Pairs whose components are held together.
PAIRS = 65_536
OUTLIER = -1


def blocks_of(n: int) -> int:
    """The number of blocks for ``n`` points."""
    return max(1, min(-(-n // BLOCK), BLOCKS), -(-n // LARGEST))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the Euclidean distances, exactly 0 for equal points."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, len(a), TILE):
        part, mine = out[at : at + TILE], a[at : at + TILE]
        for k in range(a.shape[1]):
            x = np.subtract.outer(mine[:, k], b[:, k])
            x *= x
            part += x
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, exactly 0 for equal points."""
    out = _squares(a, b)
    return np.sqrt(out, out=out)


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of rows ``i`` of ``a`` to rows ``j`` of ``b``, pair by pair."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        gap = a[i[at : at + PAIRS]] - b[j[at : at + PAIRS]]
        out[at : at + PAIRS] = (gap * gap).sum(axis=1)
    return np.sqrt(out, out=out)


def near_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_squares() with a relative error of some 1e-10 at most, by a matrix product; those of close points, which that would blur, are computed directly."""
    middle = b.mean(axis=0) if len(b) else 0.0
    if a.shape[1] <= 8 or not len(a):
        return _squares(a, b)
    x, y = a - middle, b - middle
    u, v = (x * x).sum(axis=1), (y * y).sum(axis=1)
    largest = u.max() + v.max()
    if not largest < 1e300:
        return _squares(a, b)
    out = x @ y.T
    out *= -2
    out += u[:, None]
    out += v
    close = out <= 1e-6 * (a.shape[1] + 2) * largest
    n = np.count_nonzero(close)
    if 10 * n > out.size:
        return _squares(a, b)
    if n:
        i, j = np.nonzero(close)
        out[i, j] = pair_distances(a, b, i, j) ** 2
    return out


class _Nearest:
    """The ``k`` nearest others of each of ``n`` points so far: distances, ascending, and positions; equal distances by position."""

    def __init__(self, n: int, k: int):
        self.d, self.at = np.full((n, k), np.inf), np.full((n, k), -1)

    def take(self, x: np.ndarray, y: np.ndarray, row: int, column: int, squares: np.ndarray) -> None:
        """``squares``: near_squares() of the points of ``x`` from ``row`` on and of ``y`` from ``column`` on."""
        k = self.d.shape[1]
        bound = self.d[row : row + len(squares), -1] ** 2
        if np.isinf(bound).any():
            most = min(k, squares.shape[1]) - 1
            bound = np.minimum(bound, np.partition(squares, most, axis=1)[:, most] if squares.shape[1] > k else squares.max(axis=1))
        i, j = np.nonzero((squares <= (bound * (1 + 1e-9))[:, None]) & (squares < np.inf))
        if not len(i):
            return
        some, own = np.unique(i, return_inverse=True)
        d = np.concatenate([self.d[row + some].ravel(), pair_distances(x, y, row + i, column + j)])
        at = np.concatenate([self.at[row + some].ravel(), column + j])
        group = np.concatenate([np.repeat(np.arange(len(some)), k), own])
        by = np.lexsort((at, d, group))
        first = np.searchsorted(group[by], np.arange(len(some)))
        by = by[np.arange(len(by)) - first[group[by]] < k]
        self.d[row + some], self.at[row + some] = d[by].reshape(-1, k), at[by].reshape(-1, k)


def nearest(x: np.ndarray, y: np.ndarray, k: int, same: bool, itself: bool = True) -> tuple[_Nearest, _Nearest]:
    """The ``k`` nearest of ``y`` for each of ``x``, and the other way round; with ``same`` both are the same points, ``itself`` says whether a point counts as its own."""
    left = _Nearest(len(x), k)
    right = left if same else _Nearest(len(y), k)
    for p in range(0, len(x), PART):
        for q in range(p if same else 0, len(y), PART):
            squares = near_squares(x[p : p + PART], y[q : q + PART])
            if same and p == q and not itself:
                np.fill_diagonal(squares, np.inf)
            left.take(x, y, p, q, squares)
            if not (same and p == q):
                right.take(y, x, q, p, squares.T)
    return left, right


def core_distances(a: np.ndarray, b: np.ndarray, samples: int) -> np.ndarray:
    """The ``samples`` smallest distances of each point of ``a`` to points of ``b`` (fewer if ``b`` is smaller), ascending."""
    k = min(samples, len(b))
    out = [np.sort(np.partition(distances(a[at : at + ROWS], b), k - 1, axis=1)[:, :k], axis=1) for at in range(0, len(a), ROWS)]
    return np.concatenate(out) if out else np.zeros((0, k))


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one end, other end, weight) of a minimum spanning tree of mutual reachability, by Prim's method."""
    n = len(x)
    left, components, reach = np.arange(1, n), np.ascontiguousarray(x[1:].T), core[1:]
    best, near = np.full(n - 1, np.inf), np.zeros(n - 1, np.int64)
    a, b, w, now, taken = [], [], [], 0, 0
    while len(w) < n - 1:
        gap = components - x[now][:, None]
        gap *= gap
        d = np.maximum(np.sqrt(np.add.reduce(gap, axis=0)), np.maximum(core[now], reach))
        closer = (d < best) & (left >= 0)
        best[closer], near[closer] = d[closer], now
        k = int(best.argmin())
        now = int(left[k])
        a.append(int(near[k]))
        b.append(now)
        w.append(float(best[k]))
        best[k], left[k], taken = np.inf, -1, taken + 1
        if 4 * taken > len(left):  # those in the tree go in batches
            rest = left >= 0
            left, best, near, reach, components, taken = left[rest], best[rest], near[rest], reach[rest], np.ascontiguousarray(components[:, rest]), 0
    return np.array(a, np.int64), np.array(b, np.int64), np.array(w)


def crossing_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns): the edges of a minimum spanning tree of rows and columns, each row joined to each column with a weight of ``m``, by Prim's method."""
    n, across = len(m), np.ascontiguousarray(m.T)
    total = sum(m.shape)
    best, near, out = np.full(total, np.inf), np.zeros(total, np.int64), np.ones(total, bool)
    sides = [(best[s], near[s], out[s]) for s in (slice(n, None), slice(0, n))]
    ends, now = np.zeros((total - 1, 2), np.int64), 0
    out[0] = False
    for e in range(total - 1):
        w, (key, from_, left) = (m[now], sides[0]) if now < n else (across[now - n], sides[1])
        closer = w < key
        closer &= left
        np.copyto(key, w, where=closer)
        np.copyto(from_, now, where=closer)
        now = int(best.argmin())
        ends[e] = now, near[now]
        best[now], out[now] = np.inf, False
    ends.sort(axis=1)  # rows come before columns
    return ends[:, 0], ends[:, 1] - n


def crossing_edges(x: np.ndarray, near_x: np.ndarray, y: np.ndarray, near_y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in ``x``, in ``y``, weight): a minimum spanning forest of mutual reachability between ``x`` and ``y``, or within ``x`` if both are the same."""
    a, b, w = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    beyond = 0 if same else len(x)
    for p in range(0, len(x), PART):
        parts = [(a, b, w)]
        for q in range(p if same else 0, len(y), PART):
            if same and p == q:
                i, j, v = spanning_tree(x[p : p + PART], near_x[p : p + PART])
                parts.append((p + i, p + j, v))
                continue
            m = near_squares(x[p : p + PART], y[q : q + PART])
            np.sqrt(m, out=m)
            np.maximum(m, near_x[p : p + PART, None], out=m)
            np.maximum(m, near_y[q : q + PART], out=m)
            i, j = (k + at for k, at in zip(crossing_tree(m), (p, q), strict=True))
            parts.append((i, j, np.maximum(pair_distances(x, y, i, j), np.maximum(near_x[i], near_y[j]))))
        a, b, w = (np.concatenate(v) for v in zip(*parts, strict=True))
        if len(w):
            keep = forest_of(beyond + len(y), a, b + beyond, w)
            a, b, w = a[keep], b[keep], w[keep]
    return a, b, w


def forest_of(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the edges of a minimum spanning forest of ``n`` points, by Boruvka's rounds; ties go by position."""
    by = np.lexsort((np.maximum(a, b), np.minimum(a, b), w))
    order = np.empty(len(w), np.int64)
    order[by] = np.arange(len(w))  # a total order, so no round can close a cycle
    part, chosen = np.arange(n), []
    live = np.arange(len(w))
    while True:
        pa_, pb = part[a[live]], part[b[live]]
        live = live[pa_ != pb]
        if not len(live):
            return np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        pa_, pb = part[a[live]], part[b[live]]
        best = np.full(n, len(w))
        np.minimum.at(best, pa_, order[live])
        np.minimum.at(best, pb, order[live])
        pick = by[np.unique(best[best < len(w)])]
        chosen.append(pick)
        parent = np.arange(n)
        own = part[np.concatenate([a[pick], b[pick]])]
        other = part[np.concatenate([b[pick], a[pick]])]
        mine = best[own] == np.concatenate([order[pick], order[pick]])
        parent[own[mine]] = other[mine]
        each = np.arange(n)
        mutual = (parent[parent] == each) & (each < parent)
        parent[mutual] = each[mutual]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        part = parent[part]


class Tree(NamedTuple):
    """The condensed hierarchy. Clusters are numbered from 0, the root, parents first; points by position."""

    parent: list[int]
    birth: list[float]
    size: list[int]
    stability: list[float]
    selected: list[bool]
    point_cluster: np.ndarray  # the last cluster that each point is in
    point_level: np.ndarray  # the level at which it falls off


def _levels(w: np.ndarray) -> np.ndarray:
    """1 / weight; a weight of 0 stands at twice the largest level of the others."""
    positive = w[w > 0]
    top = 2.0 / positive.min() if len(positive) else 1.0
    return np.where(w > 0, 1.0 / np.where(w > 0, w, 1.0), top)


def condensed(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> Tree:
    """The hierarchy of a spanning tree: clusters of ``least`` points or more, with the selected ones marked. The root is never selected."""
    by = np.argsort(w, kind="stable")
    a, b, w = a[by], b[by], w[by]
    level = _levels(w)
    root, top = list(range(n)), list(range(n))  # union-find over points; the hierarchy's node of each set
    children: list[list[int]] = [[] for _ in range(n)]
    sizes, at_level = [1] * n, [np.inf] * n

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edge = 0
    while edge < len(w):
        stop = int(np.searchsorted(w, w[edge], side="right"))
        joined: dict[int, list[int]] = {}
        for k in range(edge, stop):
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                members = joined.pop(x, [top[x]]) + joined.pop(y, [top[y]])
                root[y] = x
                joined[x] = members
        for x, members in joined.items():
            children.append(members)
            sizes.append(sum(sizes[m] for m in members))
            at_level.append(float(level[edge]))
            top[x] = len(children) - 1
        edge = stop
    parent, birth, size, stability = [-1], [0.0], [n], [0.0]
    point_cluster, point_level = np.zeros(n, np.int64), np.zeros(n)

    def fall(node: int, cluster: int, at: float) -> None:
        stack = [node]
        while stack:
            x = stack.pop()
            if children[x]:
                stack.extend(children[x])
            else:
                point_cluster[x], point_level[x] = cluster, at
                stability[cluster] += at - birth[cluster]

    todo = [(len(children) - 1, 0)] if n > 1 else []
    while todo:
        node, cluster = todo.pop()
        if not children[node]:  # a single point that counts as a cluster
            fall(node, cluster, float(level[0]) if len(level) else 0.0)
            continue
        at, large = at_level[node], [c for c in children[node] if sizes[c] >= least]
        for c in children[node]:
            if sizes[c] < least:
                fall(c, cluster, at)
        if len(large) == 1:
            todo.append((large[0], cluster))
            continue
        for c in large:
            stability[cluster] += sizes[c] * (at - birth[cluster])
            parent.append(cluster)
            birth.append(at)
            size.append(sizes[c])
            stability.append(0.0)
            todo.append((c, len(parent) - 1))
    selected, best = [False] * len(parent), list(stability)
    below = [0.0] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        selected[c] = stability[c] >= below[c]
        best[c] = max(stability[c], below[c])
        below[parent[c]] += best[c]
    for c in range(1, len(parent)):  # parents come first
        if parent[c] and (selected[parent[c]] or best[parent[c]] < 0):
            selected[c] = False
            best[c] = -1.0  # below a selected one
    return Tree(parent, birth, size, stability, selected, point_cluster, point_level)


def labels_of(tree: Tree) -> np.ndarray:
    """The selected cluster that each point is in, -1 for none."""
    own = [-1] * len(tree.parent)
    for c in range(1, len(tree.parent)):
        own[c] = c if tree.selected[c] else own[tree.parent[c]]
    return np.array(own, np.int64)[tree.point_cluster]


class Shape(NamedTuple):
    """What memberships need of a hierarchy: by cluster, its parent, birth, last level without (``own``) and with those below (``last``), children, and the stretch of ``chosen`` (selected clusters, depth first) in it."""

    parent: np.ndarray
    birth: np.ndarray
    own: np.ndarray
    last: np.ndarray
    children: list[list[int]]
    chosen: np.ndarray
    place: np.ndarray  # of a cluster in ``chosen``, -1 for others
    low: np.ndarray
    high: np.ndarray


def shape_of(parent: np.ndarray, birth: np.ndarray, selected: np.ndarray, own: np.ndarray) -> Shape:
    """The Shape of clusters with parents first; ``own``: the highest level of the points that are last in each."""
    n = len(parent)
    last, children = own.copy(), [[] for _ in range(n)]
    for c in range(n - 1, 0, -1):
        last[parent[c]] = max(last[parent[c]], last[c])
        children[parent[c]].append(c)
    low, high, place, chosen, todo = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1), [], [(0, False)]
    while todo:
        c, over = todo.pop()
        if over:
            high[c] = len(chosen)
            continue
        low[c] = len(chosen)
        if c and selected[c]:
            place[c] = len(chosen)
            chosen.append(c)
        todo.append((c, True))
        todo.extend((k, False) for k in children[c])
    return Shape(parent, birth, own, last, children, np.array(chosen, np.int64), place, low, high)


def _meetings(s: Shape, d: int) -> tuple[np.ndarray, np.ndarray]:
    """For points last in cluster ``d`` and each chosen cluster: the level at which they meet, and whether a point that falls off before meets it where it does."""
    level, falls = np.zeros(len(s.chosen)), np.zeros(len(s.chosen), bool)
    a, below = d, -1
    while a >= 0:
        for c in s.children[a]:
            if c != below:
                level[s.low[c] : s.high[c]] = s.birth[c]
        if s.place[a] >= 0:
            level[s.place[a]] = np.inf if a == d else s.last[a]
        if a == d:
            falls[s.low[d] : s.high[d]] = True
        a, below = (int(s.parent[a]) if a else -1), a
    return level, falls


def belonging(s: Shape, exemplars: np.ndarray, starts: np.ndarray, x: np.ndarray, cluster: np.ndarray, level: np.ndarray) -> np.ndarray:
    """points x chosen clusters: how far each point (``cluster`` and ``level`` are its last) belongs to each; ``starts``: where each chosen cluster's exemplars begin.

    The root of the share by distance to a cluster's exemplars (the points that stay in its leaves to the end) times the square of the
    share by the level at which point and cluster meet, scaled by the level of the best meeting relative to that cluster's last.
    """
    near = np.minimum.reduceat(distances(x, exemplars), starts, axis=1)
    meet = np.zeros(near.shape)
    for d in np.unique(cluster):
        rows = cluster == d
        at, falls = _meetings(s, int(d))
        meet[rows] = np.where(falls, np.minimum(level[rows, None], at), at)
    by_distance = np.where(near.min(axis=1, keepdims=True) > 0, 1 / np.maximum(near, 1e-300), near == 0)
    by_distance = by_distance / by_distance.sum(axis=1, keepdims=True)
    z = 1 / (1.01 - meet / np.maximum(s.own[cluster], meet.max(axis=1))[:, None])
    by_level = np.exp(z - z.max(axis=1, keepdims=True))
    by_level = by_level / by_level.sum(axis=1, keepdims=True)
    both = np.sqrt(by_distance) * by_level**2
    both = both / both.sum(axis=1, keepdims=True)
    top = meet.max(axis=1)
    first = np.where(meet == top[:, None], s.chosen, len(s.parent)).min(axis=1)  # of several, the first cluster
    return both * (top / np.maximum(s.last[first], level))[:, None]


def _last_levels(tree: Tree) -> np.ndarray:
    """By cluster, the highest level of the points that are last in it."""
    out = np.zeros(len(tree.parent))
    np.maximum.at(out, tree.point_cluster, tree.point_level)
    return out


def exemplars_of(tree: Tree, label: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each point stays in a leaf of a selected cluster to the end."""
    leaf = np.ones(len(tree.parent), bool)
    leaf[tree.parent[1:]] = False
    return (label >= 0) & leaf[tree.point_cluster] & (tree.point_level >= last[tree.point_cluster])


def _pieces(points: int, exemplars: int) -> range:
    """Where stretches of points begin whose distances to all exemplars are held together."""
    return range(0, points, max(1, min(ROWS, HELD // max(1, exemplars))))


def memberships(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(selected clusters, points x clusters): how far each point belongs to each selected cluster; a row comes to 1 at most."""
    last, label = _last_levels(tree), labels_of(tree)
    s = shape_of(np.array(tree.parent), np.array(tree.birth), np.array(tree.selected), last)
    if not len(s.chosen):
        return np.zeros(0, np.int64), np.zeros((len(x), 0))
    some = np.flatnonzero(exemplars_of(tree, label, last))
    some = some[np.argsort(s.place[label[some]], kind="stable")]
    starts = np.searchsorted(s.place[label[some]], np.arange(len(s.chosen)))
    step = _pieces(len(x), len(some)).step
    rows = [belonging(s, x[some], starts, x[at : at + step], tree.point_cluster[at : at + step], tree.point_level[at : at + step]) for at in range(0, len(x), step)]
    return s.chosen, np.concatenate(rows)


# -- as Spark jobs ---------------------------------------------------------
def _packed(points: DataFrame, blocks: int) -> DataFrame:
    """block, rows: the points (node, x and whatever else they have) of each block, by node."""
    rows = points.withColumn("block", F.pmod(F.col("node"), F.lit(blocks)).cast("int"))
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*points.columns))).alias("rows"))


def _met(left: DataFrame, right: DataFrame, blocks: int) -> DataFrame:
    """i, j, a, b: the packed rows of each pair of blocks with i <= j, each pair in a task of its own, as far as their hashes differ."""
    pairs = left.select(F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"), F.col("rows").alias("a"))
    return pairs.join(right.select(F.col("block").alias("j"), F.col("rows").alias("b")), "j").repartition(blocks * blocks, "i", "j").select("i", "j", "a", "b")


def _of(row: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    s = row.slice(k, 1).flatten()
    x = s.field("x")
    return s.field("node").to_numpy(), x.flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1), s


def with_core(points: DataFrame, blocks: int, samples: int) -> DataFrame:
    """``points`` (node, x) with core, the distance to the ``samples``-th nearest of them. Each pair of blocks meets once, for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("i")[k] == batch.column("j")[k]
                (a, x, _), (b, y, _) = (_of(batch.column(c), k) for c in "ab")
                for node, got in list(zip((a, b), nearest(x, y, samples, same), strict=True))[: 1 if same else 2]:
                    ends = np.arange(len(node) + 1, dtype=np.int32) * samples
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(ends), pa.array(got.d.ravel()))], ["node", "d"])

    packed = cut(_packed(points, blocks))
    near = _met(packed, packed, blocks).mapInArrow(run, "node long, d array<double>")
    core = near.groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("d"))).alias("d"))
    core = core.select("node", F.filter("d", lambda v: v < float("inf")).alias("d"))
    return points.join(core.select("node", F.element_at("d", F.least(F.lit(samples), F.size("d"))).alias("core")), "node")


def reachability_edges(points: DataFrame, blocks: int) -> DataFrame:
    """g, a, b, w: edges of mutual reachability among which there is a minimum spanning tree of all ``points`` (node, x, core); g is the pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = (batch.column(c)[k].as_py() for c in "ij")
                (left, x, p), (right, y, q) = (_of(batch.column(c), k) for c in "ab")
                a, b, w = crossing_edges(x, p.field("core").to_numpy(), y, q.field("core").to_numpy(), i == j)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), i * blocks + j)), *map(pa.array, (np.minimum(left[a], right[b]), np.maximum(left[a], right[b]), w))], ["g", "a", "b", "w"])

    packed = cut(_packed(points, blocks))
    return _met(packed, packed, blocks).mapInArrow(run, "g long, a long, b long, w double")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (id, x) with node, from 0 by id: the rows of the partitions before, and the place within one."""
    kept = cut(rows.select("id", "x").orderBy("id", "x").withColumn("row", F.monotonically_increasing_id()))
    kept = kept.withColumns({"part": F.shiftright("row", 33), "at": F.col("row").bitwiseAND((1 << 33) - 1)})
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return kept.join(F.broadcast(before), "part").select((F.col("before") + F.col("at")).alias("node"), "id", "x")


def fitted_points(vectors: DataFrame, id_col: str, vector: str, most: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(node, id, x of the rows that are fitted: all of them, or with ``most`` about so many of the smallest hashes; id, x of the others; the number of fitted ones). Rows with null or non-finite parts, or of another length than most, are left out."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where("size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.select(F.lit(0).cast("long").alias("node"), "id", "x").limit(0), rows, 0
    rows = rows.where(F.size("x") == sizes["d"])
    if most is not None and sizes["count"] > most:
        rows = cut(rows.withColumn("h", F.xxhash64("id", "x")))
        last = rows.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
        some, rest = rows.where(F.col("h") <= last), rows.where(F.col("h") > last)
        if some.count() > 2 * most:
            raise ValueError(f"more than {most} rows are equal; take equal rows together first")
    else:
        some, rest = rows, rows.limit(0)
    some = cut(_numbered(some))
    return some, rest.select("id", "x"), some.count()


def tree_edges(points: DataFrame, n: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """(points with core; a, b, w of their minimum spanning tree) for ``n`` points (node, x)."""
    blocks = blocks_of(n)
    points = cut(with_core(points, blocks, samples))
    edges = reachability_edges(points, blocks)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]))
        a, b, w = (table.column(c).to_numpy() for c in "abw")
        keep = forest_of(n, a, b, w) if len(w) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (a, b, w)], ["a", "b", "w"])

    if blocks > SHARES:  # the tree of all is part of the union of the shares' trees
        edges = cut(edges.repartition(SHARES, "g").select("a", "b", "w").mapInArrow(thin, "a long, b long, w double"))
    edges = edges.select("a", "b", "w")
    return points, cut(edges.coalesce(1).mapInArrow(thin, "a long, b long, w double") if blocks > 1 else edges)


def density_clusters(vectors: DataFrame, id_col: str = "id", vector: str = "x", least: int = 10, samples: int | None = None, most: int | None = None) -> DataFrame:
    """id, cluster, strength, probability for every usable vector: clusters numbered by size (ties: the smaller id), -1 for outliers.

    ``strength`` is how long a point stays in its cluster, relative to the point that stays longest;
    ``probability`` is its membership in the cluster; both are 0 for outliers. Vectors that are null, empty, hold a null or non-finite number or differ in
    length from the others give no row. Fewer points than twice ``least`` are all outliers; an empty table gives no rows.
    """
    samples = samples or least
    fitted, rest, n = fitted_points(vectors, id_col, vector, most)
    if n < 2:
        return fitted.select("id", F.lit(OUTLIER).alias("cluster"), F.lit(0.0).alias("strength"), F.lit(0.0).alias("probability"))
    points, edges = tree_edges(fitted.select("node", "x"), n, samples)
    names = ["node", "cluster", "label", "last", "level", "strength", "marked", "block"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each point (marked: exemplars), and with no node one for each cluster (cluster: its parent, level: its birth, strength: its last level, marked: selected)."""
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]))
        tree = condensed(n, *(table.column(c).to_numpy() for c in "abw"), least)
        label, last = labels_of(tree), _last_levels(tree)
        best = np.zeros(len(tree.parent))
        np.maximum.at(best, np.maximum(label, 0), np.where(label >= 0, tree.point_level, 0))
        strength = np.where(label >= 0, tree.point_level / np.maximum(best[np.maximum(label, 0)], 1e-300), 0.0)
        chosen, first, size = np.unique(label[label >= 0], return_index=True, return_counts=True)
        number = np.full(len(tree.parent), OUTLIER, np.int32)
        number[chosen[np.lexsort((np.flatnonzero(label >= 0)[first], -size))]] = np.arange(len(chosen))
        block = np.zeros(n, np.int32)  # those of one cluster stand together
        block[np.lexsort((tree.point_cluster, label < 0))] = np.arange(n) // BLOCK
        own = np.where(label >= 0, number[np.maximum(label, 0)], OUTLIER).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(own), *map(pa.array, (label, tree.point_cluster, tree.point_level, strength, exemplars_of(tree, label, last), block))], names)
        of = len(tree.parent)
        yield pa.RecordBatch.from_arrays([pa.nulls(of, pa.int64()), pa.array(tree.parent, pa.int32()), pa.array(np.full(of, -1)), pa.array(np.arange(of)), pa.array(tree.birth), pa.array(last), pa.array(tree.selected), pa.array(np.zeros(of, np.int32))], names)

    found = cut(edges.select("a", "b", "w").coalesce(1).mapInArrow(fit, "node long, cluster int, label long, last long, level double, strength double, marked boolean, block int"))
    found, clusters = found.where("node is not null"), found.where("node is null")
    found = found.select("node", "cluster", "strength").join(_probabilities(points.select("node", "x").join(found.where(F.col("cluster") != OUTLIER), "node"), clusters), "node", "left").fillna(0.0, ["probability"])
    out = fitted.select("node", "id").join(found, "node").drop("node")
    if most is None or n < most:
        return out
    return out.unionByName(assigned(rest, points.join(found, "node"), n))


def _probabilities(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """node, probability: how far each of ``points`` belongs to its cluster, by blocks; each block sees the hierarchy and the exemplars (one row)."""
    tree = clusters.agg(F.sort_array(F.collect_list(F.struct("last", "cluster", "level", "strength", "marked"))).alias("tree"))
    known = tree.crossJoin(points.where("marked").agg(F.collect_list(F.struct("label", "x")).alias("exemplars")))
    blocks = points.groupBy("block").agg(F.collect_list(F.struct("node", "x", "label", "last", "level")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t, e, rows = (batch.column(c).slice(k, 1).flatten() for c in ("tree", "exemplars", "rows"))
                s = shape_of(t.field("cluster").to_numpy(), t.field("level").to_numpy(), t.field("marked").to_numpy(zero_copy_only=False), t.field("strength").to_numpy())
                x, y = (v.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for v in (rows, e))
                place = s.place[e.field("label").to_numpy()]
                by = np.argsort(place, kind="stable")
                starts, y = np.searchsorted(place[by], np.arange(len(s.chosen))), y[by]
                label, last, level = (rows.field(c).to_numpy() for c in ("label", "last", "level"))
                pieces = _pieces(len(x), len(y))
                for at in pieces:
                    part = slice(at, at + pieces.step)
                    share = belonging(s, y, starts, x[part], last[part], level[part])
                    yield pa.RecordBatch.from_arrays([rows.field("node").slice(at, len(share)), pa.array(share[np.arange(len(share)), s.place[label[part]]])], ["node", "probability"])

    return blocks.crossJoin(F.broadcast(known)).select("tree", "exemplars", "rows").mapInArrow(run, "node long, probability double")  # one row


def assigned(rest: DataFrame, fitted: DataFrame, n: int) -> DataFrame:
    """id, cluster, strength, probability of further rows: those of the fitted point (of ``n``) that each reaches most easily."""
    blocks = blocks_of(n)
    packed = cut(_packed(fitted.select("node", "x", "core", "cluster", "strength", "probability"), blocks))
    shares = rest.withColumn("row", F.monotonically_increasing_id())
    shares = cut(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "reach", "node", "cluster", "strength", "probability"]
        for batch in batches:
            for k in range(batch.num_rows):
                mine = batch.column("a").slice(k, 1).flatten()
                x = mine.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
                node, y, s = _of(batch.column("b"), k)
                core = s.field("core").to_numpy()
                for at in range(0, len(x), ROWS):
                    d = np.maximum(distances(x[at : at + ROWS], y), core)
                    best = pa.array(d.argmin(axis=1))
                    yield pa.RecordBatch.from_arrays([mine.field("row").slice(at, len(best)), pa.array(d.min(axis=1)), pa.array(node).take(best), *(s.field(c).take(best) for c in names[3:])], names)

    dealt = shares.withColumn("block", F.expr(f"row div {BLOCK}")).groupBy("block").agg(F.collect_list(F.struct("row", "x")).alias("a"))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed.select(F.col("block").alias("j"), F.col("rows").alias("b")), "j").select("a", "b")
    near = met.mapInArrow(run, "row long, reach double, node long, cluster int, strength double, probability double")
    best = near.groupBy("row").agg(F.min(F.struct("reach", "node", "cluster", "strength", "probability")).alias("s"))
    return shares.select("row", "id").join(best, "row").select("id", "s.cluster", "s.strength", "s.probability")
