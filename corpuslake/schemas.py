"""Schemas of the layers, and checks of their constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = "struct<idx:int,start_sec:int,end_sec:int,caption_text:string>"
CANDIDATE = "source_url string, source_type string, file_name string, is_local boolean, mime_type string, raw_metadata string, local_path string"
BRONZE = (
    "doc_id long, source_url string, source_type string, file_name string, file_size long, mime_type string, excluded boolean, exclusion_reason string, "
    "checksum string, storage_path string, raw_metadata string, ingestion_date timestamp"
)
SILVER = "doc_id long, title string, speaker string, publication_date date, transcript string, word_count int, status_processing string, processing_date timestamp, error_message string"
_SCORES = "scores:map<string,double>"
_COUNTED = "array<struct<{0}:string,count:bigint>>"
GOLD_MODULES = {
    "lexical": "lex_metrics",
    "syntactic": "syntactic_metrics",
    "entities": "entities",
    "sentiment": "sentiment",
    "emotions": "emotions",
    "labels": "labels",
    "topics": "topics",
    "keywords": "keywords",
}
GOLD = (
    "doc_id long, topics struct<corpus:string,topic_id:int,topic_keywords:array<string>,probability:double>, "
    f"labels struct<{_SCORES},labels:array<string>,threshold:double>, sentiment struct<label:string,{_SCORES}>, emotions struct<dominant_emotion:string,{_SCORES}>, "
    "entities struct<groups:map<string,array<struct<text:string,count:bigint>>>,by_label:map<string,bigint>,total_entities:bigint>, "
    f"lex_metrics struct<pronoun_ratios:map<string,double>,top_content_words:{_COUNTED.format('word')},repetitions:{_COUNTED.format('phrase')},"
    f"oppositions:array<struct<pair:array<string>,counts:array<bigint>>>,bigrams:{_COUNTED.format('phrase')},trigrams:{_COUNTED.format('phrase')},"
    "lexical_diversity:struct<ttr:double,mtld:double>,total_words:bigint>, "
    "syntactic_metrics struct<speech_stats:struct<sentence_count:bigint,avg_sentence_length:double,avg_word_length:double,question_count:bigint,exclamation_count:bigint>,"
    "modality:map<string,double>,pos_distribution:map<string,double>,verb_tense:map<string,double>,total_tagged_tokens:bigint>, keywords array<string>, analysis_date timestamp"
)
EXPECTED_TABLES = ("bronze_documents", "gold_analytics", "silver_text")


def bronze_violations() -> Column:
    """The first broken rule of a Bronze row, else null."""
    return (
        F.when(F.col("source_type").isNull() | ~F.col("source_type").isin("video", "audio", "text"), "source_type")
        .when(F.col("checksum").isNull(), "checksum")
        .when(F.col("storage_path").isNull(), "storage_path")
    )


def silver_violations() -> Column:
    """The first broken rule of a Silver row, else null."""
    return F.when(F.col("status_processing").isNull() | ~F.col("status_processing").isin("pending", "success", "failed"), "status_processing").when(F.length("speaker") > 255, "speaker")


def orphans(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Rows of ``child`` whose doc_id has no row in ``parent``."""
    return child.join(parent.select("doc_id"), "doc_id", "left_anti")


def missing_tables(found: DataFrame, name: str = "table_name") -> DataFrame:
    """Expected tables that are not among ``found``."""
    spark = found.sparkSession
    return spark.createDataFrame([(t,) for t in EXPECTED_TABLES], f"{name} string").join(found.select(name), name, "left_anti")


def migrate(df: DataFrame, renames: dict[str, str], additions: dict[str, str]) -> DataFrame:
    """Columns renamed where they are still there, missing ones added as nulls."""
    for old, new in renames.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    for name, kind in additions.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
