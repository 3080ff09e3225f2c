"""Layers derived from the test tables, in Spark and, the same, in SQL.

The tables hold no dates, statuses or model results; those below follow from doc_id by
fixed arithmetic, so that every dashboard rule meets all its cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators.topics import with_corpus


def half_up(num: str, den: str, digits: int) -> str:
    """SQL: num / den rounded half up to ``digits`` places, by whole numbers, so that ties do not hang on binary fractions."""
    return f"CAST((2 * {10**digits} * ({num}) + ({den})) // (2 * ({den})) AS DOUBLE) / {10**digits}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        e("case when doc_id % 4 = 0 then '' else concat('https://', source, '.org/', doc_id) end").alias("source_url"),
        e("case doc_id % 3 when 0 then 'video' when 1 then 'audio' else 'text' end").alias("source_type"),
        e("concat('f', doc_id, '.html')").alias("file_name"),
        e("doc_id % 50 = 7").alias("excluded"),
        e("case when doc_id % 10 = 3 then '{}' else concat('{\"source_name\":\"', source, '\"}') end").alias("raw_metadata"),
        e("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 365 as int))").alias("ingestion_date"),
    )


BRONZE = """bronze AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://' || source || '.org/' || doc_id END AS source_url,
    CASE doc_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'text' END AS source_type, 'f' || doc_id || '.html' AS file_name, doc_id % 50 = 7 AS excluded,
    CASE WHEN doc_id % 10 = 3 THEN NULL ELSE source END AS source_name, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS ingestion_date FROM documents)"""


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    rows = table(spark, sf_dir, "documents").where("doc_id % 7 <> 5")
    return rows.select(
        "doc_id",
        e("concat('T', doc_id)").alias("title"),
        e("case when doc_id % 9 = 2 then null else date_add(date'2015-06-16', cast(doc_id % 900 as int)) end").alias("publication_date"),
        e("case when doc_id % 11 = 4 then null else text end").alias("transcript"),
        F.when(e("doc_id % 11 <> 4"), T.word_count("text")).alias("word_count"),
        e("case when doc_id % 11 = 4 then 'failed' when doc_id % 13 = 6 then 'pending' else 'success' end").alias("status_processing"),
    )


SILVER = r"""silver AS (SELECT doc_id, 'T' || doc_id AS title, CASE WHEN doc_id % 9 = 2 THEN NULL ELSE DATE '2015-06-16' + CAST(doc_id % 900 AS INTEGER) END AS publication_date,
    CASE WHEN doc_id % 11 = 4 THEN NULL ELSE text END AS transcript,
    CASE WHEN doc_id % 11 <> 4 AND text <> '' THEN CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) END AS word_count,
    CASE WHEN doc_id % 11 = 4 THEN 'failed' WHEN doc_id % 13 = 6 THEN 'pending' ELSE 'success' END AS status_processing FROM documents WHERE doc_id % 7 <> 5)"""

_LABELS = ("economy and jobs", "healthcare", "education")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    rows = with_corpus(silver(spark, sf_dir).where("status_processing = 'success' and doc_id % 3 <> 2"))
    topic = "cast(case when doc_id % 9 = 0 then -1 else doc_id % 5 end as int)"
    scores = f"map('{_LABELS[0]}', (doc_id * 7 % 100) / 100D, '{_LABELS[1]}', (doc_id * 13 % 100) / 100D, '{_LABELS[2]}', (doc_id * 29 % 100) / 100D)"
    return rows.select(
        "doc_id",
        e(f"case when doc_id % 19 <> 1 then named_struct('corpus', corpus, 'topic_id', {topic}, 'topic_keywords', case when {topic} = -1 then cast(array() as array<string>) else array(concat('k', {topic}), concat('d', doc_id % 5)) end) end").alias("topics"),
        e(f"case when doc_id % 17 <> 1 then named_struct('scores', {scores}) end").alias("labels"),
        e("case when doc_id % 23 <> 1 then named_struct('label', case when doc_id % 29 = 0 then null else element_at(array('negative', 'neutral', 'positive', 'mixed'), cast(doc_id % 4 + 1 as int)) end) end").alias("sentiment"),
        e("case when doc_id % 31 <> 1 then named_struct('dominant_emotion', element_at(array('anger', 'fear', 'joy', 'neutral', 'sadness'), cast(doc_id * doc_id % 5 + 1 as int))) end").alias("emotions"),
        e(
            "case when doc_id % 37 <> 1 then named_struct('groups', map('persons', array(named_struct('text', concat('P', doc_id % 23), 'count', doc_id % 4 + 1)), "
            "'locations', array(named_struct('text', concat('L', doc_id % 31), 'count', doc_id % 3 + 1)), 'dates', array(named_struct('text', 'D', 'count', 1L)))) end"
        ).alias("entities"),
        e("case when doc_id % 2 = 0 then 1 end").alias("lex_metrics"),
        e("case when doc_id % 5 <> 0 then 1 end").alias("syntactic_metrics"),
        e("case when doc_id % 19 <> 1 then array(concat('k', doc_id % 5)) end").alias("keywords"),
    )


GOLD = f"""gold AS (SELECT doc_id, CASE WHEN doc_id % 19 <> 1 THEN CASE WHEN coalesce(word_count, 0) >= 500 THEN 'long_form' ELSE 'short_form' END END AS corpus,
    CASE WHEN doc_id % 19 <> 1 THEN CAST(CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id % 5 END AS INTEGER) END AS topic_id,
    CASE WHEN doc_id % 17 <> 1 THEN (SELECT arg_min(l, (-s, length(l), l)) FROM (VALUES ('{_LABELS[0]}', doc_id * 7 % 100), ('{_LABELS[1]}', doc_id * 13 % 100), ('{_LABELS[2]}', doc_id * 29 % 100)) v(l, s)) END AS label,
    doc_id % 23 <> 1 AS has_sentiment,
    CASE WHEN doc_id % 23 <> 1 AND doc_id % 29 <> 0 THEN ['negative', 'neutral', 'positive', 'mixed'][doc_id % 4 + 1] END AS sentiment,
    CASE WHEN doc_id % 31 <> 1 THEN ['anger', 'fear', 'joy', 'neutral', 'sadness'][doc_id * doc_id % 5 + 1] END AS emotion,
    doc_id % 37 <> 1 AS has_entities, doc_id % 2 = 0 AS has_lex, doc_id % 5 <> 0 AS has_syn FROM silver WHERE status_processing = 'success' AND doc_id % 3 <> 2)"""
