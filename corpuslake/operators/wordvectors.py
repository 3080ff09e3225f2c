"""Word vectors from the corpus itself, and vectors of texts and labels made of them.

1. Pairs of words at most WINDOW tokens apart in a text are counted by batch and summed in one shuffle.
2. A pair's weight is its positive pointwise mutual information.
3. The leading factors of that symmetric sparse matrix come from randomised subspace iteration: each round multiplies it by a
   slim matrix, by partitions that hold whole rows. Only the slim matrix (words x factors) passes the driver; VOCABULARY bounds it.
4. A text's vector is the mean of its words', rare words weighing more, without the direction that all texts share, which comes from
   second moments summed by partition.

The vocabulary is the model's size, as in any encoder: the VOCABULARY commonest words of those that occur LEAST times. Counts are over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators.embeddings import Encoder, embedded, hashed_words
from corpuslake.operators.scores import Scorer
from corpuslake.session import stored

VOCABULARY, LEAST, WINDOW, DIMENSIONS = 20_000, 5, 5, 64
#: Pairs of words that a task holds before it hands their counts on.
HELD = 4_000_000
#: Factors beyond the asked ones, rounds of iteration; how fast the weight of a word falls with its share of all words.
EXTRA, ROUNDS, SMOOTH = 16, 5, 1e-3
#: A vocabulary of fewer words makes no model.
FEWEST = 20
_TOKEN = re.compile(r"[^\W_]+")


def vocabulary(docs: DataFrame, most: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """word, n: the commonest tokens of all texts, ties in alphabetical order."""
    words = docs.select(F.explode(T.tokens("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) of parts of (keys, counts)."""
    key, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by].astype(np.int64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(docs: DataFrame, words: list[str], window: int = WINDOW) -> DataFrame:
    """i, j, n: how often words i <= j (numbers in ``words``) stand at most ``window`` tokens apart in a text, in either order."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def rows_of(size: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 100_000):
            k = key[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k // size), pa.array(k % size), pa.array(n[at : at + 100_000])], ["i", "j", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        size = max(len(known), 1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                lists = batch.column(0).slice(at, 500)
                flat = lists.flatten()
                code = pc.fill_null(pc.index_in(flat, known), -1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                keys = [np.zeros(0, np.int64)]
                for gap in range(1, window + 1):
                    a, b = code[:-gap], code[gap:]
                    ok = (a >= 0) & (b >= 0) & (row[:-gap] == row[gap:])
                    a, b = a[ok], b[ok]
                    keys.append(np.minimum(a, b) * size + np.maximum(a, b))
                held.append(np.unique(np.concatenate(keys), return_counts=True))
                if sum(len(key) for key, _ in held) > HELD:
                    held = [_summed(held)]
                    if len(held[0][0]) > HELD // 2:  # little is gained by waiting
                        yield from rows_of(size, *held.pop())
        if held:
            yield from rows_of(size, *_summed(held))

    return docs.select(T.tokens("text").alias("t")).mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def positive_information(pairs: DataFrame) -> DataFrame:
    """i, j, v for both orders: ln(n * total / (n of i * n of j)) where that is above 0; a word next to itself counts twice."""
    pairs = stored(pairs)  # counted once; all below reads that table, which the vocabulary bounds
    other = pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n")
    both = pairs.select("i", "j", F.when(F.col("i") == F.col("j"), 2 * F.col("n")).otherwise(F.col("n")).alias("n")).unionByName(other)
    sums = both.groupBy("i").agg(F.sum("n").alias("s"))
    total = F.broadcast(sums.agg(F.sum("s").alias("total")))  # one row
    rows = both.join(F.broadcast(sums), "i").join(F.broadcast(sums.select(F.col("i").alias("j"), F.col("s").alias("s2"))), "j").crossJoin(total)  # sums: a row a word
    return rows.select("i", "j", F.log(F.col("n").cast("double") * F.col("total") / (F.col("s").cast("double") * F.col("s2"))).alias("v")).where("v > 0")


def leading_factors(entries: DataFrame, size: int, k: int, seed: int = 42, extra: int = EXTRA, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, vectors: size x k) of the symmetric matrix with ``entries`` (i, j, v), largest first, by subspace iteration.

    Each vector's largest component is positive.
    """
    sc = entries.sparkSession.sparkContext
    rows = stored(entries.repartition("i").sortWithinPartitions("i"))  # a word is in few batches then
    m = min(k + extra, size)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, m)))[0]

    def times(q: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i, j, v = (batch.column(c).to_numpy() for c in ("i", "j", "v"))
                if not len(i):
                    continue
                by = np.argsort(i, kind="stable")
                i, j, v = i[by], j[by], v[by]
                first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                part = np.add.reduceat(v[:, None] * shared.value[j], first)
                ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(i[first]), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["i", "y"])

        sums = rows.mapInArrow(run, "i long, y array<double>").toPandas()  # words x factors, for each batch that a word is in
        out = np.zeros((size, m))
        if len(sums):
            np.add.at(out, sums["i"].to_numpy(), np.stack(sums["y"]))
        shared.unpersist()
        return out

    for _ in range(rounds):
        q = np.linalg.qr(times(q))[0]
    small = q.T @ times(q)
    values, w = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-np.abs(values), kind="stable")[:k]
    u = q @ w[:, top]
    u *= np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return np.abs(values[top]), u


class WordVectors:
    """A vocabulary with a vector for each word, each word's weight in a text, and the direction that all texts share."""

    def __init__(self, words: list[str], vectors: np.ndarray, weights: np.ndarray, common: np.ndarray | None = None):
        self.words, self.vectors, self.weights = words, vectors, weights
        self.common = np.zeros(vectors.shape[1]) if common is None else common
        self.number = {w: k for k, w in enumerate(words)}

    @property
    def dimensions(self) -> int:
        return self.vectors.shape[1]

    def encode(self, texts: list[str]) -> np.ndarray:
        """A vector for each text; texts without a known word have the zero vector."""
        row, code = [], []
        for k, text in enumerate(texts):
            found = [c for c in (self.number.get(t) for t in _TOKEN.findall((text or "").lower()) if t.isalpha()) if c is not None]
            row += [k] * len(found)
            code += found
        out = np.zeros((len(texts), self.dimensions))
        np.add.at(out, np.array(row, int), self.vectors[np.array(code, int)] * self.weights[np.array(code, int), None])
        out /= np.maximum(np.bincount(np.array(row, int), minlength=len(texts)), 1)[:, None]
        return out - np.outer(out @ self.common, self.common)


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, most: int = VOCABULARY, least: int = LEAST, window: int = WINDOW, seed: int = 42) -> WordVectors | None:
    """Word vectors of ``docs`` (text); None where fewer than FEWEST words are common enough."""
    counted = vocabulary(docs, most, least).collect()  # at most ``most`` words
    if len(counted) < FEWEST:
        return None
    words, n = [r["word"] for r in counted], np.array([r["n"] for r in counted], float)
    values, u = leading_factors(positive_information(pair_counts(docs, words, window)), len(words), min(dimensions, len(words)), seed)
    weights = SMOOTH / (SMOOTH + n / n.sum())
    model = WordVectors(words, u * np.sqrt(values), weights)
    model.common = common_direction(docs, model)
    return model


def common_direction(docs: DataFrame, model: WordVectors) -> np.ndarray:
    """The leading direction of all texts' vectors, from second moments summed by partition."""
    d = model.dimensions
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                x = shared.value.encode(batch.column(0).slice(at, 500).to_pylist())
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["k", "s"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas()  # d * d numbers
    moments = np.zeros(d * d)
    moments[sums["k"].to_numpy(int)] = sums["s"].to_numpy(float)
    values, w = np.linalg.eigh(moments.reshape(d, d))
    u = w[:, -1] if values[-1] > 0 else np.zeros(d)
    return u * (np.sign(u[np.abs(u).argmax()]) if u.any() else 1.0)


def encoder_of(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[Encoder, int]:
    """(encoder, dimensions) fitted on ``docs``; hashed counts where the texts are too few for a model."""
    model = fit(docs, dimensions)
    return (model.encode, model.dimensions) if model else (lambda texts: hashed_words(texts, dimensions), dimensions)


def document_vectors(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, embedding: texts by word vectors of the same corpus, in chunks as embeddings.embedded() makes them."""
    encoder, d = encoder_of(docs, dimensions)
    return embedded(docs, encoder, d)


def similarity_scorer(model: WordVectors, phrases: dict[str, str]) -> Scorer:
    """Scores a chunk for each label by the angle between its vector and that of the label's phrase: (1 + cosine) / 2, 0 without known words."""
    names = list(phrases)
    target = model.encode([phrases[k] for k in names])
    size = np.linalg.norm(target, axis=1)

    def score(chunks: DataFrame) -> DataFrame:
        shared = chunks.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = shared.value.encode(batch.column("chunk").to_pylist())
                norm = np.linalg.norm(x, axis=1)[:, None] * size
                cosine = np.where(norm > 0, x @ target.T / np.where(norm > 0, norm, 1.0), -1.0)
                n = len(names)
                each = pa.array(np.repeat(np.arange(batch.num_rows), n))
                kept = [batch.column(c).take(each) for c in ("doc_id", "chunk_no", "n_words")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names * batch.num_rows), pa.array((1 + np.clip(cosine, -1, 1)).ravel() / 2)], ["doc_id", "chunk_no", "n_words", "label", "score"])

        rows = chunks.select(F.col("doc_id").cast("long"), F.col("chunk_no").cast("long"), "chunk", F.col("n_words").cast("long"))
        return rows.mapInArrow(run, "doc_id long, chunk_no long, n_words long, label string, score double")

    return score


