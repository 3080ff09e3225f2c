"""Gold modules: what each computes from Silver texts, by name.

A module is the Gold columns that it fills and a function from (doc_id, text) to (doc_id,
those columns). Models come in as scorers; the word lists are their stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from corpuslake.operators import entities, lexical, scores, syntactic
from corpuslake.operators.pending import GOLD_COLUMNS


class Module(NamedTuple):
    """Gold columns and the function that makes them."""

    columns: tuple[str, ...]
    compute: Callable[[DataFrame], DataFrame]


def linguistic(docs: DataFrame) -> DataFrame:
    """Lexical, syntactic and entity payloads."""
    return lexical.payload(docs).join(syntactic.payload(docs), "doc_id").join(entities.payload(docs), "doc_id")


def sentiment(docs: DataFrame, by: scores.Scorer | None = None, emotions_by: scores.Scorer | None = None) -> DataFrame:
    """Sentiment and emotion payloads from chunk scores weighted by words; both word lists in one pass."""
    if by is None and emotions_by is None:
        rows = scores.by_document(docs, {"s": scores.SENTIMENT, "e": scores.EMOTION})
        return rows.select("doc_id", scores.score_struct("s_mean", "label").alias("sentiment"), scores.score_struct("e_mean", "dominant_emotion").alias("emotions"))
    chunks = scores.sentence_chunks(docs)

    def scored(scorer: scores.Scorer, name: str, top_name: str) -> DataFrame:
        return scores.score_payload(docs, scores.weighted(scorer(chunks)), name, top_name)

    s = scored(by or scores.word_list_scorer(scores.SENTIMENT), "sentiment", "label")
    return s.join(scored(emotions_by or scores.word_list_scorer(scores.EMOTION), "emotions", "dominant_emotion"), "doc_id")


def scored(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, sentiment, emotions, labels as sentiment() and labels() have them, by the word lists: one pass over the texts, no join. Each row is judged for itself."""
    rows = scores.by_document(docs, {"s": scores.SENTIMENT, "e": scores.EMOTION, "t": scores.TOPIC_WORDS})
    return rows.select("doc_id", scores.score_struct("s_mean", "label").alias("sentiment"), scores.score_struct("e_mean", "dominant_emotion").alias("emotions"), scores.label_struct("t_most", threshold).alias("labels"))


def labels(docs: DataFrame, by: scores.Scorer | None = None, threshold: float = 0.5) -> DataFrame:
    """Label payload: maxima over chunks, labels from the threshold on and the best one in any case."""
    if by is None:
        rows = scores.by_document(docs, {"t": scores.TOPIC_WORDS})
        return rows.select("doc_id", scores.label_struct("t_most", threshold).alias("labels"))
    return scores.label_payload(docs, scores.strongest(by(scores.sentence_chunks(docs))), threshold)


MODULES: dict[str, Module] = {"linguistic": Module(GOLD_COLUMNS["linguistic"], linguistic), "sentiment": Module(GOLD_COLUMNS["sentiment"], sentiment), "labels": Module(GOLD_COLUMNS["labels"], labels)}


def register_gold_module(name: str, columns: tuple[str, ...], compute: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a module, or replaces one; its columns must be Gold columns."""
    MODULES[name] = Module(columns, compute)
    GOLD_COLUMNS[name] = columns
