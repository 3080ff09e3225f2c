"""Dense vectors: means by dimension, weighted pooling, and texts to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.chunking import chunk_text, resolve_max_length, word_length

#: Texts to one vector each.
Encoder = Callable[[list[str]], np.ndarray]
#: Tokens of the stand-in's window, of which two are the model's own.
WINDOW, OWN_TOKENS = 384, 2
DIMENSIONS = 64


def dimension_means(vectors: DataFrame, by: str, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """by, dim (from 0), mean: the mean of each component in each group."""
    rows = vectors.select(by, F.posexplode(vector).alias("dim", "x"))
    return rows.groupBy(by, "dim").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("mean"))


def weighted_pool(chunks: DataFrame, by: str, vector: str, weight: Column | str) -> DataFrame:
    """by, dim, value: weighted mean vectors; groups whose weights come to 0 give zero vectors."""
    w = F.col(weight) if isinstance(weight, str) else weight
    rows = chunks.select(by, w.cast("double").alias("w"), F.posexplode(vector).alias("dim", "x"))
    sums = rows.groupBy(by, "dim").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    return sums.select(by, "dim", F.when(F.col("w") != 0, F.col("s") / F.col("w")).otherwise(F.lit(0.0)).alias("value"))


def as_arrays(pooled: DataFrame, by: str) -> DataFrame:
    """by, embedding: the components in order, as one array."""
    rows = pooled.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    return rows.select(by, F.transform("v", lambda x: x["value"]).alias("embedding"))


def hashed_words(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The stand-in for a model: signed counts of hashed words, of length 1; equal words give equal vectors everywhere."""
    import xxhash

    out = np.zeros((len(texts), dimensions))
    for k, text in enumerate(texts):
        for w in text.lower().split():
            h = xxhash.xxh64_intdigest(w.strip(".,;:!?\"'()"))
            out[k, h % dimensions] += 1.0 if h >> 63 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(docs: DataFrame, encoder: Encoder | None = None, dimensions: int = DIMENSIONS, window: int = WINDOW, length: Callable[[str], int] = word_length) -> DataFrame:
    """doc_id, embedding: each text cut into chunks of the model's window, their vectors averaged by length.

    A text without chunks has the zero vector. Chunks are encoded a batch of texts at a time; row by row, no shuffle.
    """
    encode, budget = encoder or (lambda texts: hashed_words(texts, dimensions)), resolve_max_length(window) - OWN_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                chunks = [chunk_text(t, budget, length) for t in batch.column(1).to_pylist()]
                flat = [c for cs in chunks for c in cs]
                row = np.repeat(np.arange(len(chunks)), [len(cs) for cs in chunks])
                weight = np.array([max(length(c), 1) for c in flat], float)
                out = np.zeros((len(chunks), dimensions))
                if flat:
                    np.add.at(out, row, np.asarray(encode(flat), float) * weight[:, None])
                total = np.bincount(row, weights=weight, minlength=len(chunks))
                out /= np.maximum(total, 1)[:, None]
                ends = pa.array(np.arange(len(chunks) + 1, dtype=np.int32) * dimensions)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["doc_id", "embedding"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, embedding array<double>")
