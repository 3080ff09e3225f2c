"""The layers as tables, and the transitions between them: each run does what is pending and can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake import gold as G
from corpuslake import schemas, sources
from corpuslake.operators import bronze, dashboard, embeddings, extract, pending, repair, topics, wordvectors
from corpuslake.operators.store import SnapshotTable
from corpuslake.session import cut, few
from corpuslake.sources.fetching import Policy
from corpuslake.sources.files import object_contents

OBJECTS = "storage_path string, content binary"


def _typed(rows: DataFrame, schema: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` in the types that ``schema`` gives them."""
    types = {f.name: f.dataType for f in rows.sparkSession.createDataFrame([], schema).schema}
    return rows.select(*[F.col(c).cast(types[c]).alias(c) for c in columns])


class Lake:
    """Bronze, Silver and Gold below one folder. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        root = root.rstrip("/")
        self.bronze = SnapshotTable(spark, f"{root}/bronze_documents", schemas.BRONZE, violation=schemas.bronze_violations)
        self.objects = SnapshotTable(spark, f"{root}/objects", OBJECTS, key=None)
        self.silver = SnapshotTable(spark, f"{root}/silver_text", schemas.SILVER, violation=schemas.silver_violations)
        self.gold = SnapshotTable(spark, f"{root}/gold_analytics", schemas.GOLD)

    def ingest_bronze(self, source: str, fetch: Callable[[DataFrame], DataFrame] | None = None, **options) -> dict[str, int]:  # noqa: ANN003
        """Candidates of a source into Bronze; ``fetch`` adds their content where the source has none.

        Content is stored before the rows that name it, so that a run that breaks off leaves no
        row without its object; the next run finds what is missing.
        """
        found = sources.read(self.spark, source, **options)
        if fetch is not None:
            found = fetch(found)
        if "content" not in found.columns:
            raise ValueError(f"{source} gives no content; pass fetch")
        staged = cut(bronze.with_checksum(found))
        known, light = self.bronze.read(), staged.drop("content")
        counts = bronze.counters(bronze.deduplicated(light, known)).first().asDict()
        if counts["ingested"]:
            fresh = cut(bronze.fresh(light, known))
            # contents are neither shuffled nor read again but for those that are new
            new = staged.join(few(fresh.select("checksum", "discovery_order")), ["checksum", "discovery_order"], "left_semi")
            self.objects.append(new.select(bronze.storage_path().alias("storage_path"), "content"))
            self.bronze.append(bronze.register(fresh, known))
        return counts

    def ingest_silver(self, limit: int | None = None, doc_ids: list[int] | None = None, transcriber: extract.Transcriber | None = None, prompt: str = "") -> dict[str, int]:
        """Extracts what Silver does not have; failures are rows and are tried again by the next run. Media go to ``transcriber``."""
        todo = pending.silver(self.bronze.read(), self.silver.read(), limit, doc_ids)
        given = object_contents(cut(todo), self.objects.read())
        rows = cut(extract.silver(given, transcriber=transcriber, prompt=prompt))
        counts = dashboard.status_counts(rows).first().asDict()
        if counts["success"] or counts["failed"]:
            self.silver.upsert_rows(_typed(rows, schemas.SILVER, self.silver.read().columns))
        return counts

    def run_gold(self, module: str, limit: int | None = None, doc_ids: list[int] | None = None) -> int:
        """Computes a module for the documents that lack it; only its columns change. Returns their number."""
        m = G.MODULES[module]
        todo = cut(pending.gold(module, self.silver.read(), self.gold.read(), limit, doc_ids).select("doc_id", F.col("transcript").alias("text")))
        n = todo.count()
        if n:
            rows = cut(_typed(m.compute(todo).withColumn("analysis_date", F.current_timestamp()), schemas.GOLD, ["doc_id", *m.columns, "analysis_date"]))
            self.gold.upsert_columns(rows)
        return n

    @staticmethod
    def _vectors(docs: DataFrame, encoder: embeddings.Encoder | None) -> DataFrame:
        return cut(embeddings.embedded(docs, encoder) if encoder else wordvectors.document_vectors(docs))

    def run_topics(self, vectors: DataFrame | None = None, k: int | None = None, encoder: embeddings.Encoder | None = None) -> dict[str, int]:
        """Fits the topics of both corpora anew over all eligible documents (T5); counts over both.

        Without ``vectors`` the documents are embedded by ``encoder``, or by word vectors of their own. ``k`` clusters, or as many as their density has.
        """
        docs = cut(pending.eligible(self.silver.read()).select("doc_id", F.col("transcript").alias("text"), "word_count"))
        rows = cut(topics.fit(docs, self._vectors(docs, encoder) if vectors is None else vectors, k))
        counts = rows.agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if(F.col("topics.topic_id") == topics.OUTLIER).alias("outliers"),
            F.count_distinct(F.when(F.col("topics.topic_id") != topics.OUTLIER, F.struct("topics.corpus", "topics.topic_id"))).alias("topics"),
        )
        out = counts.first().asDict()
        if out["documents"]:
            self.gold.upsert_columns(_typed(rows.withColumn("analysis_date", F.current_timestamp()), schemas.GOLD, ["doc_id", "topics", "keywords", "analysis_date"]))
        return out

    # -- reading ----------------------------------------------------------
    def overview(self) -> dict[str, DataFrame]:
        return dashboard.overview(self.bronze.read(), self.silver.read())

    def history(self, source_type: str | None = None) -> DataFrame:
        return dashboard.history(self.bronze.read(), self.silver.read(), source_type)

    def document(self, doc_id: int) -> DataFrame:
        return dashboard.document(self.bronze.read(), self.silver.read(), doc_id)

    def statuses(self) -> DataFrame:
        return dashboard.statuses(self.bronze.read(), self.silver.read(), self.gold.read())

    def status(self, doc_id: int) -> DataFrame:
        """One document's status; an id that nobody knows is reported as stored in Bronze and not started elsewhere."""
        known = self.spark.createDataFrame([(doc_id,)], "doc_id long")
        s = self.silver.read().where(F.col("doc_id") == doc_id).select("doc_id", "status_processing")
        g = self.gold.read().where(F.col("doc_id") == doc_id).select("doc_id", dashboard.gold_status().alias("g"))
        rows = known.join(s, "doc_id", "left").join(g, "doc_id", "left")
        return rows.select("doc_id", F.lit("success").alias("bronze"), F.coalesce("status_processing", F.lit("not_started")).alias("silver"), F.coalesce("g", F.lit("not_started")).alias("gold"))

    def topics(self) -> tuple[DataFrame, DataFrame]:
        """(summary, validation)."""
        g = self.gold.read()
        return dashboard.topics_summary(g), dashboard.topics_validation(g)

    def labels(self) -> DataFrame:
        return dashboard.labels_by_corpus(self.gold.read())

    def sentiment(self) -> tuple[DataFrame, DataFrame]:
        """(distribution, by month)."""
        return dashboard.sentiment_distribution(self.gold.read()), dashboard.sentiment_by_month(self.gold.read(), self.silver.read())

    def emotions(self) -> DataFrame:
        return dashboard.emotions_distribution(self.gold.read())

    def entities(self, top: int = 15) -> DataFrame:
        return dashboard.entities_top(self.gold.read(), top)

    def health(self, policy: Policy = Policy(retries=3, wait=0.0)) -> dict[str, str]:
        """Each layer's table and the object store: ok, or that nothing has been written yet (K14); a store that fails is asked again."""
        tables = {"bronze_documents": self.bronze, "silver_text": self.silver, "gold_analytics": self.gold, "objects": self.objects}
        return {name: "ok" if policy.tried(t.version) else "missing" for name, t in tables.items()}

    def merge_metadata(self, found: DataFrame, speaker: str) -> int:
        """Recovered metadata (doc_id, found map) over that of Bronze rows; new values win, the speaker is set (K10). Returns their number."""
        rows = self.bronze.read().join(found, "doc_id")
        kind = "map<string,string>"
        merged = F.to_json(repair.merged_metadata(F.coalesce(F.from_json("raw_metadata", kind), F.expr(f"cast(map() as {kind})")), F.col("found"), speaker), {"ignoreNullFields": "false"})
        rows = cut(rows.select("doc_id", merged.alias("raw_metadata")))
        n = rows.count()
        if n:
            self.bronze.upsert_columns(rows)
        return n
