"""Runs from the suffix tree against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpuslake.llm import periodic
from corpuslake.llm import queries as Q


def plain_runs(words, min_length=6, min_exponent=4):
    """(start, period, end) of all runs: each period from 1 up, each stretch once."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(min_length, min_exponent * q):
                out.setdefault((s, i + q), q)
    return sorted((s, q, e) for (s, e), q in out.items())


def some_texts(r):
    for _ in range(r.choice([1, 2, 5])):
        k, n = r.choice([1, 2, 3, 8]), r.choice([0, 1, 5, 12, 40, 120])
        w = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.6:
            a = r.randrange(n)
            p = r.randrange(1, n - a + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w


@pytest.mark.parametrize("pairs", [periodic.PAIRS, 37])
def test_runs_equal_a_search_of_every_period(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    r = random.Random(2)
    for _ in range(500):
        docs = list(some_texts(r))
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        symbols = np.array([1000 * k + x for k, d in enumerate(docs) for x in d], np.int64)
        for least, exponent in ((6, 4), (2, 2), (3, 3)):
            s, e, p = periodic.runs_of(symbols, offsets, least, exponent)
            want = sorted((offsets[k] + a, q, offsets[k] + b) for k, d in enumerate(docs) for a, q, b in plain_runs(d, least, exponent))
            assert list(zip(s.tolist(), p.tolist(), e.tolist(), strict=True)) == want


def test_suffixes_and_common_lengths():
    r = random.Random(4)
    for _ in range(100):
        w = np.array([r.randrange(3) for _ in range(r.choice([1, 2, 30, 90]))])
        s = periodic.sorted_suffixes(w, np.full(len(w), len(w)))
        want = sorted(range(len(w)), key=lambda i: w[i:].tolist())
        assert s.order.tolist() == want and s.place[s.order].tolist() == list(range(len(w)))
        lcp = periodic.common_lengths(s)
        for k in range(1, len(w)):
            a, b = w[want[k - 1] :].tolist(), w[want[k] :].tolist()
            assert lcp[k] == next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))


def test_a_thousand_repeats_of_a_long_passage_and_one_word():
    many = np.tile(np.arange(300), 1000)
    assert [x.tolist() for x in periodic.runs_of(many, np.array([0, len(many)]))] == [[0], [300_000], [300]]
    one = np.zeros(200_000, np.int64)
    assert [x.tolist() for x in periodic.runs_of(one, np.array([0, len(one)]))] == [[0], [200_000], [1]]


def test_rows(spark):
    rows = [(None, "a a a a a a a b"), (1, None), (2, ""), (3, " \n\t "), (4, "x y " * 3), (4, "x y " * 4), (4, "x y " * 4), (5, "é é é é é é\x0bé\xa0é"), (6, "go go go go go"), (7, "a b " * 50_000 + "end")]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, runs int, collapsed string")
    got = sorted(([str(x.doc_id), x.n_words, [tuple(r) for r in x.runs], x.collapsed] for x in periodic.find_runs(df).collect()), key=str)
    want = [
        ["None", 8, [(0, 7, 1)], "a b"],
        *(["1", 0, [], ""], ["2", 0, [], ""], ["3", 0, [], ""]),
        *(["4", 6, [], "x y x y x y"], ["4", 8, [(0, 8, 2)], "x y"], ["4", 8, [(0, 8, 2)], "x y"]),
        ["5", 7, [(0, 6, 1)], "é é é"],
        ["6", 5, [], "go go go go go"],
        ["7", 100_001, [(0, 100_000, 2)], "a b end"],
    ]
    assert got == sorted(want, key=str)
    assert periodic.find_runs(df.limit(0)).count() == 0


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    # the plain search takes all periods of all texts: look only for those where some word repeats at that distance in a row
    runs = plain_runs(words) if n <= 400 else near_runs(words)
    dropped = {i for s, q, e in runs for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, q, e in runs), default=None)
    digest = hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, q, e in runs).encode()).hexdigest()
    left = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
    return (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), digest, left)


def near_runs(words):
    """As plain_runs(), by comparing the text with itself at each distance in numpy."""
    _, w = np.unique(words, return_inverse=True)
    out = {}
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e + q - s >= max(6, 4 * q):
                out.setdefault((s, e + q), q)
    return sorted((s, q, e) for (s, e), q in out.items())


def test_op12(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in Q.op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        assert got[d["doc_id"]] == expected(d["doc_id"], d["text"]), d["doc_id"]
    assert sum(x[0] > 0 for x in got.values()) > len(docs) / 20
