"""Word vectors against dense algebra, pooling and label scores."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpuslake.operators import scores, wordvectors


def dense(rows, n):
    m = np.zeros((n, n))
    for r in rows:
        m[r.i, r.j] = r.v
    return m


def test_factors_equal_a_dense_svd(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = [r.word for r in wordvectors.vocabulary(docs, most=300).collect()]
    entries = wordvectors.positive_information(wordvectors.pair_counts(docs, words))
    m = dense(entries.collect(), len(words))
    assert np.allclose(m, m.T) and (m >= 0).all() and m.any()
    s, u = wordvectors.leading_factors(entries, len(words), 6, extra=40, rounds=12)
    du, ds, _ = np.linalg.svd(m)
    assert np.allclose(s, ds[:6], rtol=1e-4)
    for k in range(6):
        if min(abs(ds[k] - np.delete(ds, k))) > 0.02 * ds[k]:  # a vector of its own
            assert abs(u[:, k] @ du[:, k]) > 0.999
    assert np.allclose(u.T @ u, np.eye(6), atol=1e-8)


def themed(spark, n=300):
    rnd = random.Random(4)
    themes = {0: "jobs economy wages factory trade growth market".split(), 1: "doctor healthcare hospital patient medicine nurse clinic".split(), 2: "border immigration visa asylum migrant refugee passport".split()}
    common = "the of and to a in we it".split()
    rows = [(k, " ".join(rnd.choice(themes[k % 3]) if rnd.random() < 0.5 else rnd.choice(common) for _ in range(40)) + ".") for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "unknownword")], "doc_id long, text string")


def test_texts_of_one_theme_are_near(spark):
    docs = themed(spark)
    got = {r.doc_id: np.array(r.embedding) for r in wordvectors.document_vectors(docs, 8).collect()}
    assert not got[300].any() and not got[301].any() and not got[302].any()
    x = np.stack([got[k] / np.linalg.norm(got[k]) for k in range(300)])
    theme = np.arange(300) % 3
    cosine = x @ x.T
    same = theme[:, None] == theme[None, :]
    assert cosine[same].mean() > cosine[~same].mean() + 0.5
    again = {r.doc_id: np.array(r.embedding) for r in wordvectors.document_vectors(docs, 8).collect()}
    assert all(np.allclose(got[k], again[k]) for k in got)


def test_labels_by_similarity_reach_the_threshold(spark):
    """The scorer needs no words given for a label: other words of the theme are near to the label's own."""
    docs = themed(spark)
    model = wordvectors.fit(docs, 8)
    labels = {k: k for k in ("economy and jobs", "healthcare", "immigration")}
    chunks = scores.sentence_chunks(docs.withColumn("text", F.regexp_replace("text", "economy|jobs|healthcare|immigration", "the")))
    scored = wordvectors.similarity_scorer(model, labels)(chunks)
    best = {r.doc_id: (r.label, r.score) for r in scores.selected(scores.strongest(scored)).where("rank = 1").collect()}
    right = [best[k][0] == list(labels)[k % 3] and best[k][1] >= 0.5 for k in range(300)]
    assert np.mean(right) > 0.95
    assert best[302][1] == 0.0


def test_too_few_texts_make_no_model(spark):
    few = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert wordvectors.fit(few) is None and wordvectors.document_vectors(few).count() == 1
    assert wordvectors.document_vectors(few.limit(0)).count() == 0


def test_pairs_are_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([(0, 1, 4), (0, 2, 1), (1, 1, 2), (1, 2, 3)], "i long, j long, n long").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    assert wordvectors.positive_information(pairs).count() > 0 and seen.value == 4


def test_counts_of_parts_are_summed():
    key, n = wordvectors._summed([(np.array([3, 5]), np.array([1, 2])), (np.array([1, 5]), np.array([7, 1]))])
    assert key.tolist() == [1, 3, 5] and n.tolist() == [7, 1, 3]
    assert [len(x) for x in wordvectors._summed([(np.zeros(0, np.int64), np.zeros(0, np.int64))])] == [0, 0]
