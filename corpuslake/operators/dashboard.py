"""Dashboard queries over the layers (A1-A15, J1, J4-J9, P7-P9, O2, O3, W7, W8): one plan each, no Python.

``bronze``, ``silver`` and ``gold`` are DataFrames with the columns of ``schemas``. Totals come from
an aggregate over the groups, not from the rows, so each query shuffles partial sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.topics import OUTLIER
from corpuslake.schemas import GOLD_MODULES


def full_view(bronze: DataFrame, silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Every document with its Silver and Gold columns, nulls where there are none yet."""
    return bronze.join(silver, "doc_id", "left").join(gold, "doc_id", "left")


def total_documents(bronze: DataFrame) -> DataFrame:
    """total: all documents, excluded ones too (A1)."""
    return bronze.agg(F.count(F.lit(1)).alias("total"))


def by_source_type(bronze: DataFrame) -> DataFrame:
    """source_type, count, most frequent first (A2)."""
    return bronze.groupBy("source_type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "source_type")


def by_origin(bronze: DataFrame) -> DataFrame:
    """origin, count: by the metadata's source name, "unknown" without one."""
    origin = F.coalesce(F.get_json_object("raw_metadata", "$.source_name"), F.lit("unknown"))
    return bronze.groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "origin")


def date_range(silver: DataFrame) -> DataFrame:
    """first_date, last_date (A4)."""
    return silver.agg(F.min("publication_date").alias("first_date"), F.max("publication_date").alias("last_date"))


def status_counts(silver: DataFrame) -> DataFrame:
    """success, failed (A5)."""
    return silver.agg(F.count_if(F.col("status_processing") == "success").alias("success"), F.count_if(F.col("status_processing") == "failed").alias("failed"))


def word_count_stats(silver: DataFrame) -> DataFrame:
    """min, max, avg, median, stddev of word counts, one decimal; nulls where undefined."""
    w = F.col("word_count")
    one = lambda c: F.round(c, 1)
    return silver.where(w.isNotNull()).agg(F.min(w).cast("long").alias("min_words"), F.max(w).cast("long").alias("max_words"), one(F.avg(w)).alias("avg_words"), one(F.median(w)).alias("median_words"), one(F.stddev_samp(w)).alias("stddev_words"))


def documents_by_month(silver: DataFrame) -> DataFrame:
    """month, count."""
    rows = silver.where("publication_date is not null")
    return rows.groupBy(F.date_format("publication_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("count")).orderBy("month")


def dominant_label(scores: Column | str) -> Column:
    """Key of the highest value of a map: ties to the shorter, then the alphabetically first key; null for an empty or null map."""
    s = F.col(scores) if isinstance(scores, str) else scores
    entries = F.filter(F.map_entries(s), lambda e: e["value"].isNotNull())
    order = lambda a, b: (
        F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(F.length(a["key"]) < F.length(b["key"]), -1).when(F.length(a["key"]) > F.length(b["key"]), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    )
    return F.get(F.array_sort(entries, order), F.lit(0))["key"]


def topics_summary(gold: DataFrame) -> DataFrame:
    """corpus, topic_id, n_docs, keywords (those of the first document that has any), is_outlier."""
    t = gold.where("topics is not null").select("doc_id", "topics.*")
    words = F.min_by("topic_keywords", F.when(F.size("topic_keywords") > 0, F.col("doc_id")))
    rows = t.groupBy("corpus", "topic_id").agg(F.count(F.lit(1)).alias("n_docs"), words.alias("keywords"))
    rows = rows.withColumn("keywords", F.coalesce("keywords", F.expr("cast(array() as array<string>)"))).withColumn("is_outlier", F.coalesce(F.col("topic_id") == OUTLIER, F.lit(False)))
    return rows.orderBy("corpus", F.coalesce("topic_id", F.lit(-99)))


def topics_validation(gold: DataFrame) -> DataFrame:
    """corpus, topic_id, n_labeled, top_label, purity, lift of each topic.

    purity: share of the commonest label among the topic's labelled documents; lift: purity
    over that label's share in the corpus. Ties go to the alphabetically first label.
    """
    rows = gold.where("topics is not null and labels is not null").select("topics.corpus", "topics.topic_id", dominant_label("labels.scores").alias("label")).where("label is not null")
    cell = rows.groupBy("corpus", "topic_id", "label").agg(F.count(F.lit(1)).alias("n"))
    topic = Window.partitionBy("corpus", "topic_id")
    top = cell.withColumn("n_labeled", F.sum("n").over(topic)).withColumn("r", F.row_number().over(topic.orderBy(F.desc("n"), "label"))).where("r = 1")
    base = cell.groupBy("corpus", "label").agg(F.sum("n").alias("in_corpus")).withColumn("corpus_n", F.sum("in_corpus").over(Window.partitionBy("corpus")))
    purity = F.col("n") / F.col("n_labeled")
    out = top.join(base, ["corpus", "label"])
    return out.select("corpus", "topic_id", "n_labeled", F.col("label").alias("top_label"), F.round(purity, 3).alias("purity"), F.round(F.col("n") * F.col("corpus_n") / (F.col("n_labeled") * F.col("in_corpus")), 2).alias("lift"))


def _with_share(counts: DataFrame, *by: str) -> DataFrame:
    """``counts`` with pct, the count's percentage of its group's total, one decimal."""
    if by:
        total = F.sum("count").over(Window.partitionBy(*by))
        return counts.withColumn("pct", F.round(F.col("count") * 100 / total, 1))
    total = counts.agg(F.sum("count").alias("__total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(F.col("count") * 100 / F.col("__total"), 1)).drop("__total")


def labels_by_corpus(gold: DataFrame) -> DataFrame:
    """corpus, label, count, pct of dominant labels in the long and the short corpus (A10)."""
    rows = gold.where("topics is not null and labels is not null").select("topics.corpus", dominant_label("labels.scores").alias("label"))
    rows = rows.where("label is not null and corpus in ('long_form', 'short_form')")
    return _with_share(rows.groupBy("corpus", "label").agg(F.count(F.lit(1)).alias("count")), "corpus")


def sentiment_distribution(gold: DataFrame) -> DataFrame:
    """label, count, pct; a null label is a group of its own."""
    rows = gold.where("sentiment is not null")
    return _with_share(rows.groupBy(F.col("sentiment.label").alias("label")).agg(F.count(F.lit(1)).alias("count")))


def sentiment_by_month(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """month, positive, negative, neutral: counts, 0 where none; other labels are left out."""
    rows = gold.where("sentiment is not null").select("doc_id", F.col("sentiment.label").alias("label")).join(silver.where("publication_date is not null").select("doc_id", "publication_date"), "doc_id")
    count = lambda v: F.count_if(F.col("label") == v).alias(v)
    return rows.groupBy(F.date_format("publication_date", "yyyy-MM").alias("month")).agg(count("positive"), count("negative"), count("neutral")).orderBy("month")


def emotions_distribution(gold: DataFrame) -> DataFrame:
    """emotion, count, pct, most frequent first."""
    rows = gold.where("emotions is not null").groupBy(F.col("emotions.dominant_emotion").alias("emotion")).agg(F.count(F.lit(1)).alias("count"))
    return _with_share(rows).orderBy(F.desc("count"), "emotion")


def entities_top(gold: DataFrame, top: int = 15) -> DataFrame:
    """grp, rank, text, cnt: the most frequent persons, locations and groups of the corpus."""
    from corpuslake.operators.entities import corpus_top

    rows = gold.where("entities is not null").select(F.explode("entities.groups").alias("grp", "entries"))
    return corpus_top(rows.select("grp", F.inline("entries")).withColumnRenamed("count", "cnt"), top)


def history(bronze: DataFrame, silver: DataFrame, source_type: str | None = None) -> DataFrame:
    """Documents that are not excluded, latest first, with their status, "not_started" without a Silver row."""
    rows = bronze.where(~F.coalesce("excluded", F.lit(False)))
    if source_type:
        rows = rows.where(F.col("source_type") == source_type)
    rows = rows.join(silver.select("doc_id", "title", "status_processing"), "doc_id", "left")
    name = F.coalesce(F.when(F.col("source_url") != "", F.col("source_url")), F.when(F.col("file_name") != "", F.col("file_name")), F.lit(""))
    out = rows.select("doc_id", "source_type", "title", name.alias("source"), F.coalesce(F.when(F.col("status_processing") != "", F.col("status_processing")), F.lit("not_started")).alias("status"), "ingestion_date")
    return out.orderBy(F.desc("ingestion_date"), "doc_id")


def document(bronze: DataFrame, silver: DataFrame, doc_id: int) -> DataFrame:
    """One document that is not excluded with its Silver columns; no row if there is none."""
    rows = bronze.where((F.col("doc_id") == doc_id) & ~F.coalesce("excluded", F.lit(False)))
    return rows.join(silver.where(F.col("doc_id") == doc_id), "doc_id", "left")


def gold_status() -> Column:
    """not_started, partial or success, by how many Gold columns are there."""
    done = sum((F.col(c).isNotNull().cast("int") for c in GOLD_MODULES.values()), F.lit(0))
    return F.when(done == 0, "not_started").when(done == len(GOLD_MODULES), "success").otherwise("partial")


def statuses(bronze: DataFrame, silver: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, bronze, silver, gold status of every document that is not excluded."""
    rows = bronze.where(~F.coalesce("excluded", F.lit(False))).select("doc_id", "ingestion_date")
    rows = rows.join(silver.select("doc_id", "status_processing"), "doc_id", "left").join(gold.select("doc_id", gold_status().alias("g")), "doc_id", "left")
    out = rows.select("doc_id", F.lit("success").alias("bronze"), F.coalesce("status_processing", F.lit("not_started")).alias("silver"), F.coalesce("g", F.lit("not_started")).alias("gold"), "ingestion_date")
    return out.orderBy(F.desc("ingestion_date"), "doc_id").drop("ingestion_date")


def overview(bronze: DataFrame, silver: DataFrame) -> dict[str, DataFrame]:
    """The overview's parts by name."""
    return {
        "totals": total_documents(bronze),
        "by_type": by_source_type(bronze),
        "by_origin": by_origin(bronze),
        "date_range": date_range(silver),
        "status": status_counts(silver),
        "word_counts": word_count_stats(silver),
        "months": documents_by_month(silver),
    }
