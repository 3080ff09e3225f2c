"""Sentence-bounded chunks within a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def word_length(text: str) -> int:
    """The default length function: number of words."""
    return len(text.split())


def chunk_text(text: str | None, budget: int, length: Callable[[str], int] = word_length) -> list[str]:
    """Chunks of whole sentences of at most ``budget``; a longer sentence stands alone, split by words.

    A word above the budget is a chunk of its own. Empty or blank text gives no chunk.
    """
    if budget <= 0:
        raise ValueError(f"a budget of {budget} leaves no room for text")
    chunks: list[str] = []
    held: list[str] = []
    used = 0

    def add(piece: str, n: int) -> None:
        nonlocal held, used
        if held and used + n > budget:
            end()
        held.append(piece)
        used += n

    def end() -> None:
        nonlocal held, used
        if held:
            chunks.append(" ".join(held))
        held, used = [], 0

    for sentence in _SENTENCE.split((text or "").strip()):
        if not sentence.strip():
            continue
        n = length(sentence)
        if n <= budget:
            add(sentence, n)
            continue
        end()
        for w in sentence.split():
            add(w, length(w))
        end()
    end()
    return chunks


def resolve_max_length(tokenizer_max: int | None, model_positions: int | None = None, model_type: str = "") -> int:
    """The window in tokens: the tokenizer's own if it is a real one, else the model's positions less its offset."""
    if tokenizer_max is not None and tokenizer_max < 1_000_000:
        return tokenizer_max
    if model_positions:
        return model_positions - (2 if model_type in ("roberta", "xlm-roberta", "camembert") else 0)
    raise ValueError("neither the tokenizer nor the model says how long a text may be")


def chunks(docs: DataFrame, budget: int, length: Callable[[str], int] = word_length) -> DataFrame:
    """doc_id, chunk_no (from 0), chunk, n_words, over Arrow batches; row by row, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c, word_length(c)) for i, t in zip(b["doc_id"], b["text"], strict=True) for k, c in enumerate(chunk_text(t, budget, length))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk", "n_words"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, chunk_no int, chunk string, n_words long")
