"""Chunk scores of pluggable scorers, brought together by document.

A scorer turns rows of (doc_id, chunk_no, chunk, n_words) into (doc_id, chunk_no, n_words,
label, score), which are brought together by document: sums by document and label are partial
aggregates, so what is shuffled is one row a document and label, whatever the number of chunks. The
word lists are a stand-in for a model: exact and fast, so the rules of aggregation can be held against SQL. They
need no shuffle: ``by_document`` scores, averages and takes maxima within the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as T

Scorer = Callable[[DataFrame], DataFrame]
#: Sentences that are scored together, at most, unless one text has more.
SENTENCES = 100_000

# The labels of topics that documents are classified by.
TOPIC_LABELS = (
    "economy and jobs", "healthcare", "immigration", "foreign policy and national security", "education", "climate and environment", "taxation and government spending",
    "crime and justice", "civil rights and social issues", "elections and democracy", "energy policy and production", "technology and innovation",
)

SENTIMENT = {
    "positive": ("good", "great", "best", "love", "win", "hope", "peace", "strong", "proud", "success"),
    "negative": ("bad", "worst", "hate", "fear", "war", "fail", "weak", "disgusting", "terrible", "crime"),
    "neutral": ("is", "was", "are", "were", "has", "have"),
}
EMOTION = {
    "anger": ("angry", "hate", "attack", "fight"),
    "disgust": ("disgusting", "filthy", "gross"),
    "fear": ("fear", "danger", "threat", "afraid"),
    "joy": ("happy", "joy", "love", "great"),
    "neutral": ("is", "was", "are", "were"),
    "sadness": ("sad", "loss", "grief", "mourn"),
    "surprise": ("surprise", "sudden", "unexpected"),
}
#: Words that stand for the topic labels: the labels' own, but for those that say little.
TOPIC_WORDS = {label: tuple(w for w in label.split() if w not in ("and", "policy", "national")) for label in TOPIC_LABELS}


def word_list_scorer(lists: dict[str, tuple[str, ...]], smoothing: float = 1.0) -> Scorer:
    """score = (hits of the label's words + smoothing) / (all hits + smoothing x labels); the scores of a chunk add up to 1."""

    def score(chunks: DataFrame) -> DataFrame:
        every = tuple({w for ws in lists.values() for w in ws})
        rows = chunks.select("doc_id", "chunk_no", "n_words", F.filter(T.tokens("chunk"), lambda w: w.isin(*every)).alias("t"))
        hits = [T.count_in("t", ws) for ws in lists.values()]
        total = sum(hits[1:], hits[0]) + smoothing * len(lists)
        each = F.array(*[F.struct(F.lit(k).alias("label"), ((h + smoothing) / total).alias("score")) for k, h in zip(lists, hits, strict=True)])
        return rows.select("doc_id", "chunk_no", "n_words", F.inline(each))

    return score


def sentence_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_no, chunk, n_words with each sentence as a chunk."""
    rows = docs.select("doc_id", F.posexplode(T.sentences("text")).alias("chunk_no", "chunk"))
    return rows.withColumn("n_words", F.regexp_count("chunk", F.lit(r"\S+")).cast("long"))


def weighted(scored: DataFrame) -> DataFrame:
    """doc_id, label, score: means over chunks, weighted by words (A18). A document of no words has no rows."""
    rows = scored.groupBy("doc_id", "label").agg(F.sum(F.col("score") * F.col("n_words")).alias("s"), F.sum("n_words").alias("w"))
    return rows.where("w > 0").select("doc_id", "label", (F.col("s") / F.col("w")).alias("score"))


def strongest(scored: DataFrame) -> DataFrame:
    """doc_id, label, score: maxima over chunks, at least 0."""
    return scored.groupBy("doc_id", "label").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def gathered(scores: DataFrame) -> DataFrame:
    """doc_id, entries: a document's labels and scores in one array, as many as there are labels."""
    return scores.groupBy("doc_id").agg(F.collect_list(F.struct("label", "score")).alias("entries"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of SENTENCES entries of the second column at most, or of one row."""
    for batch in batches:
        ends, at = np.cumsum(batch.column(1).value_lengths().to_numpy()), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SENTENCES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def by_document(docs: DataFrame, named: dict[str, dict[str, tuple[str, ...]]], smoothing: float = 1.0) -> DataFrame:
    """doc_id and, for each set of word lists in ``named``, <name>_mean and <name>_most: entries as weighted() and strongest() have them.

    Sentences are scored as by word_list_scorer(), for all sets in one pass and without a shuffle: sentences and the words of the lists in them are
    found in the JVM, a batch's counts, means and maxima are numpy sums. Each row is judged for itself; means are null for
    a text of no words, maxima for one of no sentences.
    """
    every = tuple(sorted({w for lists in named.values() for ws in lists.values() for w in ws}))
    kind = "array<struct<label:string,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pa.array(every)
        member = {name: np.array([[w in ws for ws in lists.values()] for w in every], float).reshape(len(every), -1) for name, lists in named.items()}
        for batch in _pieces(batches):
            words, hits = batch.column(1), batch.column(2)
            n = words.flatten().to_numpy(zero_copy_only=False).astype(float)
            row = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy())
            inner = hits.flatten()
            sentence = np.repeat(np.arange(len(inner)), inner.value_lengths().to_numpy())
            code = pc.index_in(inner.flatten(), number).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.bincount(row, n, batch.num_rows)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            out, names = [batch.column(0)], ["doc_id"]
            for name, lists in named.items():
                found = np.zeros((len(row), len(lists)))
                np.add.at(found, sentence, member[name][code])
                score = (found + smoothing) / (found.sum(axis=1, keepdims=True) + smoothing * len(lists))
                mean, most = np.zeros((2, batch.num_rows, len(lists)))
                np.add.at(mean, row, score * n[:, None])
                mean /= np.where(total > 0, total, 1.0)[:, None]
                if len(first):
                    most[row[first]] = np.maximum.reduceat(score, first)
                some = np.zeros(batch.num_rows, bool)
                some[row] = True
                for values, present in ((mean, total > 0), (most, some)):
                    items = pa.StructArray.from_arrays([pa.array(list(lists) * batch.num_rows), pa.array(values.ravel())], ["label", "score"])
                    ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(lists), mask=np.append(~present, False))
                    out.append(pa.ListArray.from_arrays(ends, items))
                names += [f"{name}_mean", f"{name}_most"]
            yield pa.RecordBatch.from_arrays(out, names)

    token = F.lit(r"[\p{L}\p{N}]+")  # the lists hold letters only
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.sentences("text").alias("s"))
    rows = rows.select(
        "doc_id",
        F.transform("s", lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("n"),
        F.transform("s", lambda x: F.filter(F.regexp_extract_all(F.lower(x), token, F.lit(0)), lambda w: w.isin(*every))).alias("hits"),
    )
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{name}_{what} {kind}" for name in named for what in ("mean", "most")))


def _in_order(entries: str, digits: int) -> Column:
    """An entry's place: higher score after rounding, then the shorter, then the alphabetically first label."""
    return F.transform(entries, lambda x: F.struct((-F.round(x["score"], digits)).alias("minus"), F.length(x["label"]).alias("n"), x["label"].alias("label")))


def dominant_entry(rows: DataFrame, entries: str = "entries", digits: int = 6) -> DataFrame:
    """doc_id, label, score: the best entry of each row; rows without entries have none.

    Scores are compared after rounding, so that ties are ties; ties go to the shorter, then the
    alphabetically first label.
    """
    best = rows.where(F.size(entries) > 0).select("doc_id", F.array_min(_in_order(entries, digits)).alias("b"))
    return best.select("doc_id", F.col("b.label").alias("label"), (-F.col("b.minus")).alias("score"))


def selected_entries(rows: DataFrame, entries: str = "entries", threshold: float = 0.5, digits: int = 6) -> DataFrame:
    """doc_id, rank, label, score: entries of at least ``threshold``, and the best one in any case."""
    ranked = rows.where(F.size(entries) > 0).select("doc_id", F.posexplode(F.array_sort(_in_order(entries, digits))).alias("k", "b"))
    ranked = ranked.select("doc_id", (F.col("k") + 1).alias("rank"), F.col("b.label").alias("label"), (-F.col("b.minus")).alias("score"))
    return ranked.where((F.col("score") >= threshold) | (F.col("rank") == 1))


def dominant(scores: DataFrame, digits: int = 6) -> DataFrame:
    """doc_id, label, score: the best label of each document, as dominant_entry()."""
    return dominant_entry(gathered(scores), digits=digits)


def selected(scores: DataFrame, threshold: float = 0.5, digits: int = 6) -> DataFrame:
    """doc_id, rank, label, score: the chosen labels of each document, as selected_entries()."""
    return selected_entries(gathered(scores), threshold=threshold, digits=digits)


def _score_map(entries: str) -> Column:
    rounded = F.transform(entries, lambda x: F.struct(x["label"], F.round(x["score"], 4).alias("score")))
    return F.coalesce(F.map_from_entries(rounded), F.expr("cast(map() as map<string, double>)")).alias("scores")


def score_struct(entries: str, top_name: str) -> Column:
    """A struct of the dominant label and the map of scores (4 decimals); null label and empty map without entries."""
    return F.struct(F.array_min(_in_order(entries, 6))["label"].alias(top_name), _score_map(entries))


def label_struct(entries: str, threshold: float = 0.5) -> Column:
    """A struct of the map of scores, the chosen labels in rank order, and the threshold."""
    ranked = F.array_sort(_in_order(entries, 6))
    chosen = F.transform(F.filter(ranked, lambda x, k: (k == 0) | (-x["minus"] >= threshold)), lambda x: x["label"])
    return F.struct(_score_map(entries), F.coalesce(chosen, F.expr("cast(array() as array<string>)")).alias("labels"), F.lit(threshold).alias("threshold"))


def score_payload(docs: DataFrame, scores: DataFrame, name: str, top_name: str) -> DataFrame:
    """doc_id and score_struct() of every document, from a scorer's scores."""
    return docs.select("doc_id").join(gathered(scores), "doc_id", "left").select("doc_id", score_struct("entries", top_name).alias(name))


def label_payload(docs: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and label_struct() of every document, from a scorer's scores."""
    return docs.select("doc_id").join(gathered(scores), "doc_id", "left").select("doc_id", label_struct("entries", threshold).alias("labels"))
