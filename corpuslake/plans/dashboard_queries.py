"""Dashboard, pending and store queries over the derived layers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import dashboard as D
from corpuslake.operators import pending as P
from corpuslake.operators import repair, store
from corpuslake.plans.derived import BRONZE, GOLD, SILVER, bronze, gold, half_up, silver, table

B, S, BS, ALL = f"WITH {BRONZE} ", f"WITH {SILVER} ", f"WITH {BRONZE}, {SILVER} ", f"WITH {BRONZE}, {SILVER}, {GOLD} "
SG = f"WITH {SILVER}, {GOLD} "
_STATUS = """CASE WHEN g.doc_id IS NULL THEN 'not_started' ELSE (SELECT CASE WHEN n = 0 THEN 'not_started' WHEN n = 8 THEN 'success' ELSE 'partial' END FROM
    (SELECT CAST(g.has_lex AS INT) + CAST(g.has_syn AS INT) + CAST(g.has_entities AS INT) + CAST(g.has_sentiment AS INT) + CAST(g.emotion IS NOT NULL AS INT) + CAST(g.label IS NOT NULL AS INT) + 2 * CAST(g.corpus IS NOT NULL AS INT) AS n)) END"""


def _view(spark, d):  # noqa: ANN001, ANN202
    rows = D.full_view(bronze(spark, d), silver(spark, d), gold(spark, d))
    return rows.select("doc_id", "source_type", "title", "word_count", F.col("topics.topic_id").alias("topic_id"), F.col("sentiment.label").alias("sentiment"))


def _labels(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "labels").select("doc_id", "quality", "toxic")


def _upsert_rows(spark, d):  # noqa: ANN001, ANN202
    new = table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return store.upsert_rows(_labels(spark, d), new)


def _upsert_columns(spark, d):  # noqa: ANN001, ANN202
    new = table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(9).alias("toxic"))
    return store.upsert_columns(_labels(spark, d), new)


#: name: (function of (spark, sf_dir), SQL)
ENTRIES = {
    "overview_totals": (lambda s, d: D.total_documents(bronze(s, d)), "SELECT count(*) AS total FROM documents"),
    "overview_by_type": (lambda s, d: D.by_source_type(bronze(s, d)), B + 'SELECT source_type, count(*) AS "count" FROM bronze GROUP BY 1'),
    "overview_by_origin": (lambda s, d: D.by_origin(bronze(s, d)), B + "SELECT coalesce(source_name, 'unknown') AS origin, count(*) AS \"count\" FROM bronze GROUP BY 1"),
    "overview_date_range": (lambda s, d: D.date_range(silver(s, d)), S + "SELECT min(publication_date) AS first_date, max(publication_date) AS last_date FROM silver"),
    "overview_status_filter": (lambda s, d: D.status_counts(silver(s, d)), S + "SELECT count(*) FILTER (WHERE status_processing = 'success') AS success, count(*) FILTER (WHERE status_processing = 'failed') AS failed FROM silver"),
    "overview_wordcount_stats": (
        lambda s, d: D.word_count_stats(silver(s, d)),
        S + "SELECT CAST(min(word_count) AS BIGINT) AS min_words, CAST(max(word_count) AS BIGINT) AS max_words, " + half_up("sum(word_count)", "count(word_count)", 1) + " AS avg_words, round(quantile_cont(word_count, 0.5), 1) AS median_words, round(stddev_samp(word_count), 1) AS stddev_words FROM silver",
    ),
    "overview_months": (lambda s, d: D.documents_by_month(silver(s, d)), S + "SELECT strftime(publication_date, '%Y-%m') AS month, count(*) AS \"count\" FROM silver WHERE publication_date IS NOT NULL GROUP BY 1"),
    "topics_summary": (
        lambda s, d: D.topics_summary(gold(s, d)).withColumn("keywords", F.array_join("keywords", ",")),
        SG + "SELECT corpus, topic_id, count(*) AS n_docs, CASE WHEN topic_id = -1 THEN '' ELSE 'k' || topic_id || ',d' || topic_id END AS keywords, topic_id = -1 AS is_outlier FROM gold WHERE corpus IS NOT NULL GROUP BY 1, 2",
    ),
    "topics_purity_lift": (
        lambda s, d: D.topics_validation(gold(s, d)),
        SG + f""", cell AS (SELECT corpus, topic_id, label, count(*) AS n FROM gold WHERE corpus IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
        t AS (SELECT *, sum(n) OVER (PARTITION BY corpus, topic_id) AS nl, row_number() OVER (PARTITION BY corpus, topic_id ORDER BY n DESC, label) AS r FROM cell),
        b AS (SELECT corpus, label, sum(n) AS ic, sum(sum(n)) OVER (PARTITION BY corpus) AS cn FROM cell GROUP BY corpus, label)
        SELECT t.corpus, t.topic_id, CAST(t.nl AS BIGINT) AS n_labeled, t.label AS top_label, {half_up("t.n", "t.nl", 3)} AS purity, {half_up("t.n * b.cn", "t.nl * b.ic", 2)} AS lift
        FROM t JOIN b ON t.corpus = b.corpus AND t.label = b.label WHERE r = 1""",
    ),
    "labels_by_corpus": (
        lambda s, d: D.labels_by_corpus(gold(s, d)),
        SG + f"""SELECT corpus, label, count(*) AS "count", {half_up("100 * count(*)", "sum(count(*)) OVER (PARTITION BY corpus)", 1)} AS pct FROM gold WHERE corpus IS NOT NULL AND label IS NOT NULL GROUP BY corpus, label""",
    ),
    "sentiment_distribution": (lambda s, d: D.sentiment_distribution(gold(s, d)), SG + f'SELECT sentiment AS label, count(*) AS "count", {half_up("100 * count(*)", "sum(count(*)) OVER ()", 1)} AS pct FROM gold WHERE has_sentiment GROUP BY 1'),
    "sentiment_over_time_pivot": (
        lambda s, d: D.sentiment_by_month(gold(s, d), silver(s, d)),
        SG + """SELECT strftime(publication_date, '%Y-%m') AS month, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral
        FROM gold JOIN silver USING (doc_id) WHERE has_sentiment AND publication_date IS NOT NULL GROUP BY 1""",
    ),
    "emotions_distribution": (lambda s, d: D.emotions_distribution(gold(s, d)), SG + f'SELECT emotion, count(*) AS "count", {half_up("100 * count(*)", "sum(count(*)) OVER ()", 1)} AS pct FROM gold WHERE emotion IS NOT NULL GROUP BY 1'),
    "entities_topn": (
        lambda s, d: D.entities_top(gold(s, d)),
        SG + """, e AS (SELECT 'persons' AS grp, 'P' || (doc_id % 23) AS text, doc_id % 4 + 1 AS c FROM gold WHERE has_entities UNION ALL SELECT 'locations', 'L' || (doc_id % 31), doc_id % 3 + 1 FROM gold WHERE has_entities),
        s AS (SELECT grp, text, CAST(sum(c) AS BIGINT) AS cnt FROM e GROUP BY 1, 2)
        SELECT grp, CAST(r AS INTEGER) AS rank, text, cnt FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cnt DESC, text) AS r FROM s) WHERE r <= 15""",
    ),
    "v_documents_full": (
        _view,
        ALL + "SELECT b.doc_id, b.source_type, s.title, s.word_count, g.topic_id, g.sentiment FROM bronze b LEFT JOIN silver s ON b.doc_id = s.doc_id LEFT JOIN gold g ON b.doc_id = g.doc_id",
    ),
    "history_filtered": (
        lambda s, d: D.history(bronze(s, d), silver(s, d), "video"),
        BS + """SELECT b.doc_id, source_type, title, coalesce(nullif(source_url, ''), nullif(file_name, ''), '') AS source, coalesce(nullif(status_processing, ''), 'not_started') AS status, ingestion_date
        FROM bronze b LEFT JOIN silver s ON b.doc_id = s.doc_id WHERE NOT excluded AND source_type = 'video'""",
    ),
    "document_by_id": (
        lambda s, d: D.document(bronze(s, d), silver(s, d), 42).select("doc_id", "source_type", "title", "transcript"),
        BS + "SELECT b.doc_id, source_type, title, transcript FROM bronze b LEFT JOIN silver s ON b.doc_id = s.doc_id WHERE b.doc_id = 42 AND NOT excluded",
    ),
    "status_all": (
        lambda s, d: D.statuses(bronze(s, d), silver(s, d), gold(s, d)),
        ALL + f"SELECT b.doc_id, 'success' AS bronze, coalesce(s.status_processing, 'not_started') AS silver, {_STATUS} AS gold FROM bronze b LEFT JOIN silver s ON b.doc_id = s.doc_id LEFT JOIN gold g ON b.doc_id = g.doc_id WHERE NOT b.excluded",
    ),
    "silver_pending": (
        lambda s, d: P.silver(bronze(s, d), silver(s, d)).select("doc_id", "source_type"),
        BS + "SELECT b.doc_id, source_type FROM bronze b LEFT JOIN silver s ON b.doc_id = s.doc_id WHERE NOT excluded AND (s.doc_id IS NULL OR status_processing <> 'success')",
    ),
    "gold_pending_linguistic": (
        lambda s, d: P.gold("linguistic", silver(s, d), gold(s, d)).select("doc_id"),
        SG + "SELECT s.doc_id FROM silver s LEFT JOIN gold g ON s.doc_id = g.doc_id WHERE s.status_processing = 'success' AND transcript IS NOT NULL AND (g.doc_id IS NULL OR NOT has_lex OR NOT has_syn OR NOT has_entities)",
    ),
    "gold_pending_sentiment": (
        lambda s, d: P.gold("sentiment", silver(s, d), gold(s, d)).select("doc_id"),
        SG + "SELECT s.doc_id FROM silver s LEFT JOIN gold g ON s.doc_id = g.doc_id WHERE s.status_processing = 'success' AND transcript IS NOT NULL AND (g.doc_id IS NULL OR NOT has_sentiment OR emotion IS NULL)",
    ),
    "gold_pending_labels": (
        lambda s, d: P.gold("labels", silver(s, d), gold(s, d), limit=100).select("doc_id"),
        SG + "SELECT s.doc_id FROM silver s LEFT JOIN gold g ON s.doc_id = g.doc_id WHERE s.status_processing = 'success' AND transcript IS NOT NULL AND (g.doc_id IS NULL OR label IS NULL) ORDER BY s.doc_id LIMIT 100",
    ),
    "gold_pending_labels_all": (
        lambda s, d: P.gold("labels", silver(s, d), gold(s, d)).select("doc_id"),
        SG + "SELECT s.doc_id FROM silver s LEFT JOIN gold g ON s.doc_id = g.doc_id WHERE s.status_processing = 'success' AND transcript IS NOT NULL AND (g.doc_id IS NULL OR label IS NULL)",
    ),
    "pending_by_ids": (
        lambda s, d: P.silver(bronze(s, d), silver(s, d), doc_ids=table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"))).select("doc_id"),
        BS + "SELECT doc_id FROM bronze WHERE NOT excluded AND doc_id IN (SELECT conv_id FROM conversations) AND doc_id NOT IN (SELECT doc_id FROM silver WHERE status_processing = 'success')",
    ),
    "topics_eligible": (lambda s, d: P.eligible(silver(s, d)).select("doc_id"), S + "SELECT doc_id FROM silver WHERE status_processing = 'success' AND transcript IS NOT NULL"),
    "upsert_rows": (_upsert_rows, "SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 9, 9 FROM documents WHERE doc_id % 5 = 0"),
    "upsert_columns": (
        _upsert_columns,
        "SELECT coalesce(l.doc_id, u.doc_id) AS doc_id, quality, CASE WHEN u.doc_id IS NOT NULL THEN 9 ELSE toxic END AS toxic FROM labels l FULL OUTER JOIN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0) u ON l.doc_id = u.doc_id",
    ),
    "export_join": (
        lambda s, d: repair.export_rows(bronze(s, d), silver(s, d)),
        BS + "SELECT b.doc_id, title, CASE WHEN trim(coalesce(transcript, '')) = '' THEN '' ELSE transcript END AS transcript, CASE WHEN trim(coalesce(transcript, '')) = '' THEN 'no' ELSE 'yes' END AS has_transcript FROM bronze b LEFT JOIN silver s ON b.doc_id = s.doc_id",
    ),
    "revenue_by_month": (
        lambda s, d: table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 0).alias("revenue")),
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders, round(sum(o_totalprice), 0) AS revenue FROM orders GROUP BY 1",
    ),
}
