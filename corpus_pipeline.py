"""The corpus pipeline: quality, language, near-duplicates, secrets, packing, one after the other.

Each stage gets what its predecessor kept as a table with the columns of documents and
returns a DataFrame, which is written as Parquet to the shared folder and read again
as the next stage's input.

Every stage judges each row by itself, whether its doc_id is null, repeated or its own; null texts count
as empty; further columns are kept whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import langid, neardup, quality, queries, secrets
from corpuslake.llm._rows import free_name
from corpuslake.session import scratch

#: A language is rejected where nothing was recognised or its share of the posterior is below this.
LANGUAGE_SCORE = 0.4


def _names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    return tuple(free_name(docs.columns, n) for n in names)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, fitted on all labelled ones, scores below its threshold.

    A row without an id is scored like any other; it takes no part in fitting.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.describe_labelled(docs, labels), labels)
    score, predicted = _names(docs, "score", "predicted")
    return quality.score_texts(spark, docs, model, out=(score, predicted)).where(F.col(predicted) == 1).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language (null and empty texts too); the others keep their columns as they are."""
    model = langid.fit(docs)
    lang, score = _names(docs, "lang_pred", "score")
    rows = langid.predict(spark, docs, model, keep=tuple(docs.columns), out=(lang, score))
    return rows.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id.

    Rows that repeat an id are judged by their own texts, and of exact repeats one stays. Rows
    without an id are kept.
    """
    return neardup.without_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials that look live, row by row whatever the ids; widely copied examples and all other text stay."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents that are left into sequences of 4096 tokens."""
    return queries.packed_pieces(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The classifiers cannot be put in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
