"""Ranked search against a plain scorer, and block cuts against every cut."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpuslake.llm import queries as Q
from corpuslake.llm import ranked
from corpuslake.session import scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """(item, rank, doc_id, score) by scoring every document."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    N, L = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        scores = []
        for i, c, n in counts:
            m = 100 - 75 + (75 * n * N) // L
            s = sum(q * w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    path = scratch(spark, "ranked")
    ranked.build(spark.createDataFrame(docs, "doc_id long, text string, shard int, term string"), path)
    got = ranked.search(spark, path, spark.createDataFrame(items, "item_id long, text string, weight int, df string"), k)
    return sorted(map(tuple, got.collect()), key=str)


def test_op13_equals_scoring_every_document(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    assert sorted(map(tuple, Q.op13_ranked_search(spark, sf).collect()), key=str) == plain(docs, items)


@pytest.mark.parametrize("small", [False, True])
def test_nulls_ties_repeats_and_many_shards(spark, monkeypatch, small):
    if small:  # shards of a few texts, items in groups, lists that meet the weights in a shuffle
        monkeypatch.setattr(ranked, "SHARD_BYTES", 300)
        monkeypatch.setattr(ranked, "ITEMS", 2)
        monkeypatch.setattr(ranked, "BROADCAST", 0)
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["ÉCOLE", "é", "a_b", "x-y", "The", "the", "中文"]
    docs = [(r.randrange(150), " ".join(r.choices(vocabulary, weights=[1 / (1 + k) for k in range(67)], k=r.choice([0, 1, 4, 30])))) for _ in range(400)]
    docs += [(None, "w1 w2 w3"), (1000, None), (1001, ""), (1002, "... --- \n"), (1003, "w0 " * 30_000), (7, "w5 w6"), (7, "w5 w6"), (-5, "w5 w6")]
    items = [(1, "w1 w5 w5 The"), (2, None), (3, ""), (4, "nowhere"), (5, "w0"), (5, "w9 w9 É"), (6, "中文 a_b x-y"), (7, "w1 w5 w5 The"), (8, " ".join(vocabulary)), (None, "w6")]
    want = plain(docs, items)
    rows = [(*d, 1, "x") for d in docs]
    assert found(spark, rows, [(*x, 1, "y") for x in [*items, items[0]]]) == want
    assert found(spark, rows, [(*x, 1, "y") for x in items], k=3) == plain(docs, items, 3)
    assert found(spark, rows[:0], [(1, "w1", 1, "y")]) == [] and found(spark, rows, []) == []


def cost_of(impacts, cuts, price):
    return sum((b - a) * max(impacts[a:b]) + price for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def test_blocks_are_the_cheapest_cut():
    r = random.Random(8)
    lists = [[r.choice([1, 2, 50, 60, 900]) for _ in range(r.randrange(1, 11))] for _ in range(60)]
    flat = np.array([x for y in lists for x in y])
    first = np.cumsum([0, *map(len, lists)])[:-1]
    starts = ranked.block_starts(flat, first)
    for f, x in zip(first, lists, strict=True):
        mine = [s - f for s in starts.tolist() if f <= s < f + len(x)] + [len(x)]
        price = ranked.PRICE * sum(x) / len(x)
        every = (cost_of(x, [0, *c, len(x)], price) for n in range(len(x)) for c in itertools.combinations(range(1, len(x)), n))
        assert mine[0] == 0 and cost_of(x, mine, price) == pytest.approx(min(every))


def test_long_lists_are_cut_whole():
    rnd = np.random.default_rng(1)
    impacts = rnd.integers(1, 1000, 5000)
    starts = ranked.block_starts(impacts, np.array([0, 3, 1700, 1701]))
    assert {0, 3, 1700, 1701} <= set(starts.tolist()) and np.diff(np.append(starts, 5000)).max() <= ranked.LONGEST


def test_search_skips_blocks():
    """Where few documents have a rare term, blocks of a common term without any of them are not read."""
    n = 20_000
    rare = np.arange(0, n, 1500)
    common = np.arange(n)
    impacts = np.full(n, 500_000)
    blocks = ranked.block_starts(impacts, np.array([0]))
    shard = ranked.Shard([rare, common], [np.full(len(rare), 500_000), impacts], [np.arange(len(rare)), blocks], [np.full(len(rare), 500_000), np.maximum.reduceat(impacts, blocks)], n)
    docs, score = shard.search(np.array([0, 1]), np.array([9000, 10]), 1, 10)
    assert set(docs.tolist()) == set(rare.tolist()) and set(score.tolist()) == {9010 * 500_000}
    assert shard.read < shard.asked / 10


def test_terms_stop_at_text_ends():
    data, offsets = np.frombuffer(b"abcd ef", np.uint8), np.array([0, 2, 2, 5, 7])
    starts, ends, row = ranked.term_spans(data, offsets)
    assert (starts.tolist(), ends.tolist(), row.tolist()) == ([0, 2, 5], [2, 4, 7], [0, 2, 3])
