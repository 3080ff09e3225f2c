"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a vector of STATISTICS (shares of character classes, word lengths,
repetition). Standardised, it is mapped to WAVES cosines whose inner products
approximate a Gaussian kernel. Tasks sum the normal equations of their labelled
rows by fold; the sums are added in a tree and solved on the driver, where they
take FOLDS x WAVES x WAVES numbers whatever the input. Each fold is scored by the
ridge fit of the other folds; those scores are counted in bins with their labels,
and pooling adjacent violators over the bins gives the monotone calibration.

The texts are read once. What is shuffled are statistics rows (about 100 bytes a
document), to meet their labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B
from corpuslake.llm._rows import without
from corpuslake.session import cut

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "letters", "upper", "digits", "spaces", "newlines", "points",
    "symbols", "words_with_symbol", "capital_words", "repeats_previous", "distinct_words", "top_word",
)
WAVES = 192
FOLDS = 3
#: Kernel exp(-GAMMA |x - y|^2) over standardised statistics, and the ridge penalty per row.
GAMMA, PENALTY = 0.02, 1e-3
BINS = 400
#: Rows that one task sums.
TASK_ROWS = 200_000
#: Up to so many labelled ids (16 bytes each) are broadcast to pick out texts; beyond, a shuffled join does it.
BROADCAST_IDS = 1_000_000

_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_POINT = np.zeros(256, np.uint8)
_POINT[[ord(c) for c in ".,;:'\"()-?"]] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[33:127] = 1
_SYMBOL[(_LETTER + _DIGIT + _POINT) > 0] = 0


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) float32; an empty text's are all 0."""
    out = np.zeros((len(offsets) - 1, len(STATISTICS)), np.float32)
    for i, j in B.chunks(offsets):
        part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = np.maximum(np.diff(offs), 1)

        def total(flags: np.ndarray, at: np.ndarray = offs) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return c[at[1:]] - c[at[:-1]]

        starts, ends, first = B.words_of(part, offs)
        words = np.diff(first)
        w = np.maximum(words, 1)
        length = ends - starts
        symbol = _SYMBOL[part]
        cs = np.concatenate([[0], np.cumsum(symbol, dtype=np.int64)])
        has = (cs[ends] - cs[starts]) > 0
        up = _UPPER[part]
        cu = np.concatenate([[0], np.cumsum(up, dtype=np.int64)])
        shout = (cu[ends] - cu[starts]) * 2 > length
        h = B.spans_hash(part, starts, ends)
        owner = np.repeat(np.arange(j - i), words)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        mean = total(length, first) / w
        spread = np.sqrt(np.maximum(total(length * length, first) / w - mean * mean, 0))
        order = np.lexsort((h, owner))
        hs, os = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])
        distinct = np.bincount(os[new], minlength=j - i) if len(h) else np.zeros(j - i, np.int64)
        top = np.zeros(j - i)
        if len(h):
            run_at = np.flatnonzero(new)
            np.maximum.at(top, os[run_at], np.diff(np.append(run_at, len(h))))
        cols = (
            np.log1p(np.diff(offs)), np.log1p(words), mean, spread, total(_LETTER[part]) / n, total(up) / n, total(_DIGIT[part]) / n, total(B.ASCII_SPACE[part]) / n,
            total(part == 10) / n, total(_POINT[part]) / n, total(symbol) / n, total(has, first) / w, total(shout, first) / w, total(again, first) / w, np.log(np.maximum(distinct, 1)) / np.log(w + 1.0), top / w,
        )
        block = np.stack([np.asarray(c, np.float64) for c in cols], axis=1)
        block[np.diff(offs) == 0] = 0
        out[i:j] = block
    return out


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, waves, weights, and the calibration's steps (score bin edges and values)."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    low: float
    high: float

    def waves(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics rows, with a constant in front."""
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / WAVES)
        return np.concatenate([np.ones((len(f), 1)), f], axis=1)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """The calibrated score of raw ridge scores."""
        if not len(self.steps):
            return np.full(len(raw), 0.5)
        return self.steps[_bin(raw, self.low, self.high)]


def _bin(raw: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)


def pool_adjacent_violators(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` under squared error; entries of weight 0 take on their neighbours' values."""
    blocks: list[list[float]] = []
    for k, (v, w) in enumerate(zip(value, weight, strict=True)):
        if w <= 0:
            continue
        blocks.append([v * w, w, k])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w2, k2]
    if not blocks:
        return np.zeros(0)
    out = np.empty(len(value))
    at = 0
    for s, w, k in blocks:
        out[at : k + 1] = s / w
        at = k + 1
    out[at:] = out[at - 1]
    return out


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats (STATISTICS as packed float32) of every row.

    A null text counts as an empty one; texts of any length are read whole; rows that repeat an id are described each for
    itself; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffer(batch.column(1))
            stats = statistics(data, offsets)
            width = 4 * len(STATISTICS)
            raw = pa.Array.from_buffers(pa.binary(width), batch.num_rows, [None, pa.py_buffer(stats.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], ["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, stats binary")


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id and y of the ids that ``labels`` marks 0 or 1; labels of one id that differ are averaged, null ids and labels are none."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    return y.where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))


def describe_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """describe() of the rows whose id is labelled; texts of the others are not looked at. The ids are broadcast while they are few."""
    ids = cut(labelled(labels, id_col, label_col).select(F.col("doc_id").alias("__labelled")))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return describe(docs.join(ids, docs[id_col].cast("long") == F.col("__labelled"), "left_semi"), id_col, text_col)


def _unpack(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(-1, len(STATISTICS)).astype(np.float64)


def _tree_sum(parts: DataFrame, n: int, width: int = 32) -> np.ndarray | None:
    """Elementwise sum of the packed float64 arrays of (part, packed), parts numbered below ``n``.

    Each level adds up to ``width`` arrays in a task, until ``width`` rows are left for the driver.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("packed"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "packed": pa.array([total.tobytes()], pa.binary())})

    while n > width:
        n = -(-n // width)
        parts = parts.withColumn("part", F.col("part") % n).groupBy("part").applyInArrow(add, "part long, packed binary")
    rows = parts.collect()
    return sum(np.frombuffer(bytes(r["packed"]), np.float64) for r in rows) if rows else None


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", seed: int = 11) -> QualityModel:
    """Fit on the rows of ``described`` that ``labels`` marks 0 or 1 (a null label is none).

    Labels of one id that differ are averaged. With no labelled row every score is
    0.5. A row's fold is a hash of its id; rows that repeat an id all count.
    """
    rng = np.random.default_rng(seed)
    k = len(STATISTICS)
    directions, phases = rng.normal(0, np.sqrt(2 * GAMMA), (k, WAVES)), rng.uniform(0, 2 * np.pi, WAVES)
    train = cut(described.join(labelled(labels, id_col, label_col), "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")))
    rows = train.count()
    if not rows:
        return QualityModel(np.zeros(k), np.ones(k), directions, phases, np.zeros(WAVES + 1), np.zeros(0), 0.0, 1.0)
    tasks = max(1, -(-rows // TASK_ROWS))
    train = train.repartition(tasks)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(2 * k + 1), _task()
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column(0))
                total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        yield _packed(part, total)

    m = _tree_sum(train.mapInArrow(moments, "part long, packed binary"), tasks)
    mean = m[1 : k + 1] / m[0]
    scale = np.sqrt(np.maximum(m[k + 1 :] / m[0] - mean**2, 0))
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), directions, phases, np.zeros(WAVES + 1), np.zeros(0), 0.0, 1.0)
    d = WAVES + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((FOLDS, d, d + 1)), _task()
        for batch in batches:
            if batch.num_rows:
                f, t, fold = model.waves(_unpack(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for q in range(FOLDS):
                    g = f[fold == q]
                    total[q, :, :d] += g.T @ g
                    total[q, :, d] += g.T @ t[fold == q]
        yield _packed(part, total.ravel())

    sums = _tree_sum(train.mapInArrow(normal, "part long, packed binary"), tasks).reshape(FOLDS, d, d + 1)

    def solve(s: np.ndarray) -> np.ndarray:
        ridge = PENALTY * max(s[0, 0], 1.0) * np.eye(d)
        ridge[0, 0] = 1e-9
        return np.linalg.solve(s[:, :d] + ridge, s[:, d])

    every = sums.sum(axis=0)
    without = [solve(every - sums[q]) for q in range(FOLDS)]
    low, high = -0.5, 1.5

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((2, BINS)), _task()
        for batch in batches:
            if batch.num_rows:
                f, t, fold = model.waves(_unpack(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for q in range(FOLDS):
                    at = _bin(f[fold == q] @ without[q], low, high)
                    total[0] += np.bincount(at, minlength=BINS)
                    total[1] += np.bincount(at, weights=t[fold == q], minlength=BINS)
        yield _packed(part, total.ravel())

    n, ones = _tree_sum(train.mapInArrow(histogram, "part long, packed binary"), tasks).reshape(2, BINS)
    steps = pool_adjacent_violators(np.divide(ones, n, out=np.zeros(BINS), where=n > 0), n)
    return QualityModel(model.mean, model.scale, directions, phases, solve(every), steps, low, high)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _packed(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "packed"])


def score(spark: SparkSession, described: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 where score >= threshold) of every described row.

    Rows that repeat an id are scored each for itself; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw = m.waves(_unpack(batch.column(1))) @ m.weights if batch.num_rows else np.zeros(0)
            s = m.calibrated(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return described.mapInArrow(run, "doc_id long, score double, predicted int")


def score_texts(spark: SparkSession, docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.7, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score and predicted, named by ``out``, straight from the texts and with all columns kept: no shuffle brings the scores back.

    Columns of ``docs`` that are called as one of ``out`` give way to them. A null text is scored as an
    empty one, rows that repeat each for itself; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(model)
    columns = without(docs.columns, *out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                data, offsets = B.text_buffer(batch.column(columns.index(text_col)))
                s = m.calibrated(m.waves(statistics(data, offsets).astype(np.float64)) @ m.weights)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*columns, *out])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), f"`{out[0]}` double", f"`{out[1]}` int"])
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
