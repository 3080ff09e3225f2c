"""The layers from files to dashboards, twice."""

import json
import zipfile

from pyspark.sql import functions as F

from corpuslake import gold, jobs
from corpuslake.lake import Lake
from corpuslake.operators import topics


def test_lake_from_files_to_dashboards(spark, tmp_path, capsys):
    src, root = tmp_path / "in", str(tmp_path / "lake")
    src.mkdir()
    for k in range(24):
        half = "great hope peace" if k % 2 else "war fear crime"
        (src / f"{k:02}.html").write_text(f"<title>Document number {k} of the collection</title><p>This is page {k}. It is {half} in Ohio. We will win. We will win.</p>")
    (src / "copy.html").write_bytes((src / "00.html").read_bytes())
    (src / "bad.html").write_text("<script>x</script>")
    lake = Lake(spark, root)
    assert set(lake.health().values()) == {"missing"} and set(lake.health()) == {"bronze_documents", "silver_text", "gold_analytics", "objects"}
    assert lake.ingest_bronze("local", folder=str(src)) == {"ingested": 25, "skipped": 1, "failed": 0}
    assert lake.ingest_bronze("local", folder=str(src)) == {"ingested": 0, "skipped": 26, "failed": 0}
    assert lake.ingest_silver(limit=3)["success"] + lake.ingest_silver()["success"] >= 22
    assert lake.ingest_silver() == {"success": 0, "failed": 1}
    assert lake.run_gold("linguistic", limit=2) == 2 and lake.run_gold("linguistic") == 22 and lake.run_gold("linguistic") == 0
    assert lake.run_gold("sentiment") == 24 and lake.run_gold("labels") == 24
    vectors = lake.silver.read().select("doc_id", F.when(F.contains("transcript", F.lit("peace")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    assert lake.run_topics(vectors, k=2) == {"documents": 24, "outliers": 0, "topics": 2}
    rows = lake.gold.read().collect()
    assert len(rows) == 24 and all(r.lex_metrics.total_words > 10 and r.sentiment.label and r.labels.labels and r.topics.corpus == "short_form" for r in rows)
    assert {r.sentiment.label for r in rows} == {"positive", "negative"}
    assert [(p.phrase, p["count"]) for p in rows[0].lex_metrics.repetitions] == [("we will win", 2)]
    assert {r.gold for r in lake.statuses().collect()} == {"success", "not_started"}
    assert lake.status(10**9).first().asDict() == {"doc_id": 10**9, "bronze": "success", "silver": "not_started", "gold": "not_started"}
    assert lake.overview()["totals"].first().total == 25 and lake.history("text").count() == 25
    assert lake.document(1).count() == 1 and lake.document(999).count() == 0
    summary, validation = lake.topics()
    assert summary.count() == 2 and validation.count() == 2
    assert lake.labels().count() >= 1 and lake.emotions().count() >= 1 and lake.sentiment()[0].count() == 2 and lake.entities(5).count() >= 1
    assert jobs.main([root, "export", str(tmp_path / "e.xlsx")]) == {"documents": 25, "with_transcript": 24}
    with zipfile.ZipFile(tmp_path / "e.xlsx") as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 26
    assert jobs.main([root, "repair-urls", "--dry-run"]) == {"repairs": 0}
    (tmp_path / "m.json").write_text('{"doc_id": 3, "found": {"a": "1", "b": null}}\n{"doc_id": 999, "found": {"a": "2"}}\n')
    assert jobs.main([root, "merge-metadata", str(tmp_path / "m.json"), "--speaker", "S"]) == {"merged": 1}
    merged = json.loads(lake.bronze.read().where("doc_id = 3").first().raw_metadata)
    assert merged["a"] == "1" and merged["speaker"] == "S" and merged["b"] is None and lake.bronze.read().count() == 25
    assert jobs.main([root, "statuses"]) == {"statuses": 25}
    assert jobs.main([root, "topics"])["documents"] == 24
    assert set(jobs.main([root, "health"]).values()) == {"ok"}


def test_a_gold_module_can_be_added(spark, tmp_path):
    saved = dict(gold.MODULES), dict(gold.GOLD_COLUMNS)
    try:
        gold.register_gold_module("flat", ("keywords",), lambda docs: docs.select("doc_id", F.array(F.lit("k")).alias("keywords")))
        lake = Lake(spark, str(tmp_path / "l"))
        s = spark.createDataFrame([(1, "success", "text")], "doc_id long, status_processing string, transcript string")
        lake.silver.append(s.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("speaker", "string"), ("publication_date", "date"))], "transcript", F.lit(1).alias("word_count"), "status_processing", F.current_timestamp().alias("processing_date"), F.lit(None).cast("string").alias("error_message")))
        assert lake.run_gold("flat") == 1 and lake.run_gold("flat") == 0
        assert lake.gold.read().first().keywords == ["k"]
    finally:
        gold.MODULES.clear()
        gold.MODULES.update(saved[0])
        gold.GOLD_COLUMNS.clear()
        gold.GOLD_COLUMNS.update(saved[1])
    assert topics.OUTLIER == -1


def test_fetched_pages_go_through_the_layers(spark, tmp_path):
    """Recorded responses in place of a network; a dead link is a failed candidate."""
    from corpuslake.sources import fetching

    pages = {f"http://s.t/{k}.html": f"<title>Page number {k} of the site</title><p>Text {k % 3} here." for k in range(6)}

    def get(url, policy):
        yield pages[url].encode()

    lake = Lake(spark, str(tmp_path / "l"))
    ask = {"urls_list": [*pages, "http://s.t/dead.html"], "source_type": "text"}
    fetch = lambda rows: fetching.fetched(rows, get, fetching.Policy(0, 0.0, 0.0))
    assert lake.ingest_bronze("urls", fetch, **ask) == {"ingested": 6, "skipped": 0, "failed": 1}
    assert lake.ingest_bronze("urls", fetch, **ask) == {"ingested": 0, "skipped": 6, "failed": 1}
    assert lake.ingest_silver() == {"success": 6, "failed": 0}
    assert {r.transcript for r in lake.silver.read().collect()} == {f"Text {k} here." for k in range(3)}
    assert lake.objects.read().count() == 6 and lake.bronze.version() == 1
