"""Which documents each stage still has to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut, few

GOLD_COLUMNS = {"linguistic": ("lex_metrics", "syntactic_metrics", "entities"), "sentiment": ("sentiment", "emotions"), "labels": ("labels",)}


def select(rows: DataFrame, limit: int | None = None, doc_ids: list[int] | DataFrame | None = None) -> DataFrame:
    """A list (or a table, doc_id) of ids beats a limit; None means all, an empty list or 0 means none. A limit takes the smallest ids."""
    if isinstance(doc_ids, DataFrame):
        return rows.join(few(cut(doc_ids.select("doc_id").distinct())), "doc_id", "left_semi")
    if doc_ids is not None:
        return rows.where(F.col("doc_id").isin(doc_ids))
    return rows.orderBy("doc_id").limit(limit) if limit is not None else rows


def silver(bronze: DataFrame, silver_text: DataFrame, limit: int | None = None, doc_ids: list[int] | DataFrame | None = None) -> DataFrame:
    """Bronze rows that are not excluded and have no successful Silver row."""
    done = silver_text.where("status_processing = 'success'").select("doc_id")
    return select(bronze.where(~F.coalesce("excluded", F.lit(False))).join(done, "doc_id", "left_anti"), limit, doc_ids)


def gold(module: str, silver_text: DataFrame, gold_rows: DataFrame, limit: int | None = None, doc_ids: list[int] | DataFrame | None = None) -> DataFrame:
    """Successful Silver rows with a transcript whose Gold columns of ``module`` are not all there."""
    whole: Column = F.lit(True)
    for c in GOLD_COLUMNS[module]:
        whole = whole & F.col(c).isNotNull()
    done = gold_rows.where(whole).select("doc_id")
    return select(eligible(silver_text).join(done, "doc_id", "left_anti"), limit, doc_ids)


def eligible(silver_text: DataFrame) -> DataFrame:
    """Successful Silver rows with a transcript: the topics' input, whole at every run (P5, T5)."""
    return silver_text.where("status_processing = 'success' and transcript is not null")
