"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything else counts as one space; n-grams of 1 to 3
characters are hashed into BUCKETS. Fitting counts (language, bucket) over every
labelled row in one pass: tasks emit their own sums, which Spark adds up, so what
is shuffled is bounded by tasks x languages x BUCKETS small rows. The
log-probability matrix (languages x BUCKETS floats) is bounded by the number of
languages, at most MOST_LANGUAGES, and broadcast. Scoring takes a batch as a sparse matrix in
compressed rows (bucket numbers of all texts in a row, and where each text's begin)
and multiplies it by the log-probabilities at once in numpy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B
from corpuslake.llm._rows import without

BUCKETS = 1 << 14
ORDERS = 3
#: Additive smoothing of the n-gram counts.
ALPHA = 0.5
UNKNOWN = "und"
#: More distinct labels than this are taken for a mistake: counts of MOST_LANGUAGES x (BUCKETS + 1) are all that reaches the driver.
MOST_LANGUAGES = 1_000
#: Bytes of text that are worked on together, and code points of a longer text.
_CHUNK, _SLICE = 1 << 17, 1 << 17


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages, in order, and log P(bucket | language) + their log priors."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray


@lru_cache(None)
def _fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or 32 where it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of UTF-8 texts in one buffer: each between two spaces, letters in lower case, all else one space a run."""
    raw = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # in code points
    rows = len(offsets) - 1
    out = np.full(len(raw) + 2 * rows, 32, np.uint32)
    out[np.arange(len(raw)) + 2 * np.repeat(np.arange(rows), np.diff(starts)) + 1] = _fold_table()[raw]
    begins = starts[:-1] + 2 * np.arange(rows)
    space = out == 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[begins] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[np.append(begins, len(out))]


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket numbers of the n-grams that begin at each place but the last n - 1."""
    if n == 1:
        h = codes * np.uint32(0x9E3779B1) + np.uint32(1)
    else:
        many = max(len(codes) - n + 1, 0)
        h = np.full(many, n, np.uint32)
        for k in range(n):
            h = (h ^ codes[k : many + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - 14)).astype(np.int32)


def _grams(codes: np.ndarray, starts: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of each order that begin at the first ``starts`` places of one text; a lone space is none."""
    for n in range(1, ORDERS + 1):
        c = codes[: starts + n - 1]
        yield _hashed(c[c != 32] if n == 1 else c, n)


def sparse_rows(codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (bucket numbers, row offsets) of the n-grams of folded texts: a matrix of counts in compressed rows, repeats as repeats."""
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(len(codes))  # places up to the text's end
    for n in range(1, ORDERS + 1):
        h = _hashed(codes, n)
        ok = (left[: len(h)] >= n) if n > 1 else codes != 32
        before = np.concatenate([[0], np.cumsum(ok)])
        yield h[ok], before[np.minimum(offsets, len(h))]


def _pieces(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Slices and how many places of each begin n-grams, so that a very long text needs little memory at a time.

    Slices overlap by ORDERS - 1, so each n-gram is in the slice that it begins in.
    """
    for at in range(0, len(codes), _SLICE):
        yield codes[at : at + _SLICE + ORDERS - 1], _SLICE


def gram_counts(codes: np.ndarray) -> np.ndarray:
    """Counts of the n-grams of one folded text by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for part in _pieces(codes):
        for g in _grams(*part):
            out += np.bincount(g, minlength=BUCKETS)
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, folded code points, their offsets) for a column's texts, some at a time."""
    data, offsets = B.text_buffer(column)
    for i, j in B.chunks(offsets, _CHUNK):
        yield i, j, *folded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        labels = batch.column(1).dictionary_encode()
        names, number = labels.dictionary.to_pylist(), labels.indices.to_numpy()
        for name, n in zip(names, np.bincount(number, minlength=len(names)), strict=True):
            docs[name] = docs.get(name, 0) + int(n)
            sums.setdefault(name, np.zeros(BUCKETS, np.int64))
        for i, j, codes, offsets in _chunks(batch.column(0)):
            if j == i + 1:
                sums[names[number[i]]] += gram_counts(codes)
                continue
            here, local = np.unique(number[i:j], return_inverse=True)
            for idx, at in sparse_rows(codes, offsets):
                got = np.bincount(np.repeat(local, np.diff(at)) * BUCKETS + idx, minlength=len(here) * BUCKETS).reshape(len(here), BUCKETS)
                for k, n in zip(here, got, strict=True):
                    sums[names[k]] += n
    for lang, n in docs.items():
        at = np.flatnonzero(sums[lang])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(sums[lang][at], n))], ["lang", "bucket", "n"]
        )


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from every row whose text and language are not null. Without such rows the model knows no language.

    Rows that repeat count as often as they are there; other columns are ignored. More than
    MOST_LANGUAGES distinct labels are an error, before any text is read.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct languages")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # languages x (BUCKETS + 1) rows at most
    langs = tuple(sorted(got["lang"].unique()))
    counts = np.zeros((len(langs), BUCKETS))
    prior = np.zeros(len(langs))
    number = {x: k for k, x in enumerate(langs)}
    rows_of = got["lang"].map(number).to_numpy(dtype=int) if len(got) else np.zeros(0, int)
    bucket, n = got["bucket"].to_numpy(dtype=int), got["n"].to_numpy(dtype=float)
    gram = bucket >= 0
    counts[rows_of[gram], bucket[gram]] = n[gram]
    prior[rows_of[~gram]] = n[~gram]
    log_prob = np.log(counts + ALPHA) - np.log(counts.sum(axis=1, keepdims=True) + ALPHA * BUCKETS)
    return LanguageModel(langs, log_prob.astype(np.float32), np.log(prior / prior.sum()) if len(langs) else prior)


def _log_likelihood(column: pa.Array, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood by language, number of n-grams, whether there is a letter) of each text."""
    n, k = len(column), columns.shape[1]
    total, grams, letters = np.zeros((n, k)), np.zeros(n), np.zeros(n, bool)
    for i, j, codes, offsets in _chunks(column):
        letters[i:j] = np.bincount(np.repeat(np.arange(j - i), np.diff(offsets)), weights=codes != 32, minlength=j - i) > 0
        if j == i + 1:  # a text as long as a chunk
            counts = gram_counts(codes)
            at = np.flatnonzero(counts)
            total[i], grams[i] = counts[at] @ columns[at].astype(np.float64), counts.sum()
            continue
        for idx, at in sparse_rows(codes, offsets):
            many = np.diff(at)
            grams[i:j] += many
            some = np.flatnonzero(many)
            if len(some):
                total[i + some] += np.add.reduceat(np.take(columns, idx, axis=0), at[some], axis=0, dtype=np.float64)
    return total, grams, letters


def _score(model_of, text_at: int, keep: int, out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = model_of()
        columns = np.ascontiguousarray(model.log_prob.T)
        for batch in batches:
            n = batch.num_rows
            if not len(model.languages) or not n:
                names, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            else:
                total, grams, letters = _log_likelihood(batch.column(text_at), columns)
                # n-grams of one text depend on each other: the evidence is spread over them by a root
                post = total / np.sqrt(np.maximum(grams, 1))[:, None] + model.log_prior
                post = np.exp(post - post.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                best = post.argmax(axis=1)
                names = np.where(letters, np.array(model.languages, dtype=object)[best], UNKNOWN)
                score = np.where(letters, post[np.arange(n), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names[:keep], *out])

    return run


def predict(
    spark: SparkSession, docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The columns ``keep`` of every row with the prediction and its score, named by ``out``.

    The prediction is ``und`` and the score 0 where the text is null or has no letter, or where
    nothing was learned. The score is the winner's share of the posterior, in which the
    log likelihood is divided by the root of the number of n-grams. Ties go to the
    language that sorts first. Each row is judged by itself, so repeated rows get equal results and an
    empty table none. A kept column that is called as one of ``out`` gives way to it.
    """
    shared = spark.sparkContext.broadcast(model)
    types = dict(docs.dtypes)
    keep = without(keep, *out)
    # a text that is kept anyway is sent to the workers once
    again = text_col not in keep or types[text_col] != "string"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([F.col(text_col).cast("string").alias("__text")] if again else []))
    at = len(keep) if again else keep.index(text_col)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out[0]}` string", f"`{out[1]}` double"])
    return rows.mapInArrow(_score(lambda: shared.value, at, len(keep), list(out)), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out of learning: crc32 of its id's text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
