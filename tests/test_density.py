"""Density clusters and the reduction before them against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.operators import density, layout, topics


def plain_clusters(x, least, samples):
    """Selected clusters as sets of rows: all pairs sorted, a tree by union-find, then cut level by level with the parts found by search."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(samples, n) - 1]
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    a, b = np.triu_indices(n, 1)
    group, links = list(range(n)), {k: [] for k in range(n)}

    def find(k):
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    weights = []
    for e in np.argsort(m[a, b], kind="stable"):
        i, j = int(a[e]), int(b[e])
        if find(i) != find(j):
            group[find(i)] = find(j)
            links[i].append((j, m[i, j]))
            links[j].append((i, m[i, j]))
            weights.append(m[i, j])
            if len(weights) == n - 1:
                break
    positive = [w for w in weights if w > 0]
    level = lambda w: 1 / w if w > 0 else (2 / min(positive) if positive else 1.0)

    def parts(points, w):
        left, out = set(points), []
        while left:
            found, todo = set(), [left.pop()]
            while todo:
                i = todo.pop()
                found.add(i)
                for j, wj in links[i]:
                    if wj < w and j in left:
                        left.discard(j)
                        todo.append(j)
            out.append(found)
        return out

    def walk(points, birth):
        kept, now = 0.0, set(points)
        while len(now) > 1:
            w = max(w for i in now for j, w in links[i] if j in now)
            split = parts(now, w)
            large = [p for p in split if len(p) >= least]
            kept += sum(len(p) for p in split if len(p) < least) * (level(w) - birth)
            if len(large) == 1:
                now = large[0]
                continue
            kept += sum(len(p) for p in large) * (level(w) - birth)
            below = [walk(p, level(w)) for p in large]
            total = sum(k for k, _, _ in below)
            chosen = [c for _, _, cs in below for c in cs]
            return (kept, chosen, [set(points)]) if kept >= total or not below else (total, chosen, chosen)
        return kept + (level(min(weights)) - birth if weights else 0.0), [], [set(points)]

    return sorted(sorted(c) for c in walk(range(n), 0.0)[1])


def grouped(labels):
    return sorted(sorted(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist()) - {-1})


@pytest.mark.parametrize("grid", [False, True])
def test_labels_equal_a_plain_version(grid):
    rng = np.random.default_rng(7)
    for _ in range(40):
        n, k = int(rng.integers(4, 90)), int(rng.integers(1, 5))
        x = rng.normal(0, 6, (k, 2))[rng.integers(0, k, n)] + rng.normal(0, 1, (n, 2))
        x = np.round(x) if grid else x  # many equal distances and equal points
        least, samples = int(rng.integers(2, 6)), int(rng.integers(1, 6))
        core = density.core_distances(x, x, samples)[:, -1]
        tree = density.condensed(n, *density.spanning_tree(x, core), least)
        assert grouped(density.labels_of(tree)) == plain_clusters(x, least, samples)
        _, share = density.memberships(tree, x)
        assert (share >= 0).all() and (share.sum(axis=1) <= 1 + 1e-9).all()


def blobs(n, d, k, seed, spread=6.0):
    rng = np.random.default_rng(seed)
    return rng.normal(0, spread, (k, d))[rng.integers(0, k, n)] + rng.normal(0, 1, (n, d))


def frame(spark, x):
    return spark.createDataFrame([(k, v.tolist(), "c") for k, v in enumerate(x)], "vec_id long, embedding array<double>, node string")


def test_two_thousand_vectors_in_many_blocks(spark, monkeypatch):
    x = np.concatenate([blobs(1900, 3, 7, 3, 5.0), np.random.default_rng(5).uniform(-15, 15, (100, 3))])
    want = plain_clusters(x, 10, 10)
    monkeypatch.setattr(density, "BLOCK", 700)
    got = density.density_clusters(frame(spark, x), "vec_id", "embedding").toPandas().sort_values("id")
    assert grouped(got.cluster.to_numpy()) == want and len(want) > 2
    sizes = got[got.cluster >= 0].cluster.value_counts()
    assert sizes.sort_index().is_monotonic_decreasing and (got.cluster == -1).any()
    assert (got.probability[got.cluster == -1] == 0).all() and got.strength.max() == 1 and got.probability.between(0, 1).all()


def test_forest_of_a_union_is_the_tree():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        a, b = np.triu_indices(n, 1)
        w = rng.integers(1, 9, len(a)).astype(float)
        keep = density.forest_of(n, a, b, w)
        assert len(keep) == n - 1
        group, total = list(range(n)), 0.0
        for e in np.argsort(w, kind="stable"):
            i, j = group[a[e]], group[b[e]]
            if i != j:
                total += w[e]
                group = [j if g == i else g for g in group]
        assert w[keep].sum() == total


def test_beyond_the_fit_all_rows_get_a_cluster(spark):
    x = blobs(600, 2, 3, 1, 20.0)
    got = density.density_clusters(frame(spark, x), "vec_id", "embedding", most=200).toPandas()
    assert sorted(got.id) == list(range(600)) and set(got.cluster) - {-1} == {0, 1, 2}
    whole = density.density_clusters(frame(spark, x), "vec_id", "embedding").toPandas()
    both = got.merge(whole, on="id")
    both = both[(both.cluster_x >= 0) & (both.cluster_y >= 0)]
    assert len(both) > 400 and both.groupby("cluster_x").cluster_y.nunique().max() == 1


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [0.0, 0.0])] + [(6, [0.0, 0.0])] * 12 + [(k, [9.0, 9.0 + k % 3]) for k in range(20, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = density.density_clusters(df, "vec_id", "embedding", least=5).collect()
    assert len(got) == 33 and {r.cluster for r in got if r.id in (None, 6)} != {r.cluster for r in got if r.id == 20}
    assert density.density_clusters(df.limit(0), "vec_id", "embedding").count() == 0
    assert [r.cluster for r in density.density_clusters(df.where("vec_id = 20"), "vec_id", "embedding").collect()] == [-1]


def kept_neighbours(x, y, k=10):
    near = [np.argsort(density.distances(v, v) + np.diag(np.full(len(v), 1e9)), axis=1)[:, :k] for v in (x, y)]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(*near, strict=True)])


def test_reduction_keeps_neighbours_and_repeats(spark, sf, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK", 200)
    points, _, n = density.fitted_points(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    small = [np.array([r.x for r in layout.reduced(points.select("node", "x"), n).orderBy("node").collect()]) for _ in range(2)]
    assert np.array_equal(*small) and small[0].shape == (n, 2)
    x = np.array([r.x for r in points.orderBy("node").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert kept_neighbours(x, small[0]) > 1.5 * kept_neighbours(x, (u * s)[:, :2])


def test_neighbours_and_bandwidths(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 40)
    x = np.round(blobs(120, 2, 2, 4), 1)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, x array<double>")
    d = density.distances(x, x)
    for r in layout.neighbours(points, 120, 6).collect():
        want = sorted((d[r.node, j], j) for j in range(120) if j != r.node)[:6]
        assert list(zip(r.d, r.near, strict=True)) == want
    near = np.sort(np.random.default_rng(1).uniform(0.1, 3, (50, 15)), axis=1)
    rho, sigma = layout.bandwidths(near)
    assert np.allclose(np.exp(-np.maximum(near - rho[:, None], 0) / sigma[:, None]).sum(axis=1), np.log2(15), atol=1e-6)


def test_topics_of_groups_and_by_number(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(6)[:3] * 10
    x = np.concatenate([c + rng.normal(0, 0.3, (40, 6)) for c in centres] + [centres[:1] + 4.0])
    for reduce in (True, False):
        got = {r.id: (r.topic_id, r.probability) for r in topics.clusters(frame(spark, x), reduce=reduce).collect()}
        groups = [{got[k][0] for k in range(40 * g, 40 * g + 40)} - {-1} for g in range(3)]
        assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
        assert reduce or got[120][1] < 0.1  # falls off first
    numbered = {r.id: r.topic_id for r in topics.clusters(frame(spark, x), k=3).collect()}
    assert len({numbered[k] for k in range(120)} - {-1}) == 3 and numbered[120] == -1


def test_spanning_tree_of_equal_and_of_few_points():
    assert [len(v) for v in density.spanning_tree(np.zeros((1, 3)), np.zeros(1))] == [0, 0, 0]
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(301, 5)).round(1)
    x[200:] = x[:101]
    core = rnd.random(301)
    a, b, w = density.spanning_tree(x, core)
    m = np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.maximum.outer(core, core))
    i, j = np.triu_indices(301, 1)
    assert np.sort(w) == pytest.approx(np.sort(m[i, j][density.forest_of(301, i, j, m[i, j])]))
    assert np.allclose(w, m[a, b]) and len(set(b.tolist())) == 300


def test_spanning_tree_takes_its_points_without_a_copy_for_each():
    calls, kept = [], np.delete
    try:
        np.delete = lambda *args, **k: calls.append(1) or kept(*args, **k)
        density.spanning_tree(np.random.default_rng(1).normal(size=(200, 4)), np.ones(200))
    finally:
        np.delete = kept
    assert len(calls) < 20


def test_all_vectors_are_fitted(spark):
    rows = spark.range(50_200).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0)).alias("embedding"))
    points, rest, n = density.fitted_points(rows, "vec_id", "embedding")
    assert n == 50_200 and rest.count() == 0
    assert points.where("node = id").count() == n  # numbered by id


@pytest.mark.parametrize("part", [7, 2048])
def test_blocks_meet_once_and_give_what_all_pairs_give(spark, monkeypatch, part):
    monkeypatch.setattr(density, "BLOCK", 20)
    monkeypatch.setattr(density, "BLOCKS", 6)
    monkeypatch.setattr(density, "PART", part)
    x = blobs(150, 12, 3, 8) + 1000.0
    x[100:] = x[:50]  # equal points
    points, _, n = density.fitted_points(frame(spark, x), "vec_id", "embedding")
    assert density.blocks_of(n) == 6 > density.SHARES
    with_core, edges = density.tree_edges(points.select("node", "x"), n, 4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 3]
    assert np.allclose([r.core for r in with_core.orderBy("node").collect()], core, rtol=1e-12)
    m = np.maximum(d, np.maximum.outer(core, core))
    i, j = np.triu_indices(n, 1)
    assert np.allclose(sorted(r.w for r in edges.collect()), np.sort(m[i, j][density.forest_of(n, i, j, m[i, j])]), rtol=1e-9)


def test_clusters_are_fitted_on_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(topics, "FIT_ROWS", 100, raising=False)
    monkeypatch.setattr(density, "assigned", lambda *args: pytest.fail("vectors that are not fitted"))
    monkeypatch.setattr(density, "BLOCK", 64)
    x = np.concatenate([c + np.random.default_rng(1).normal(0, 0.3, (50, 6)) for c in np.eye(6)[:3] * 10])
    got = topics.clusters(frame(spark, x), reduce=False).toPandas().sort_values("id")
    core = density.core_distances(x, x, 10)[:, -1]
    tree = density.condensed(len(x), *density.spanning_tree(x, core), 10)
    label, (chosen, share) = density.labels_of(tree), density.memberships(tree, x)
    own = [share[k, np.flatnonzero(chosen == c)[0]] if c >= 0 else 0.0 for k, c in enumerate(label)]
    assert len(got) == 150 and np.allclose(got.probability, own, atol=1e-4)
