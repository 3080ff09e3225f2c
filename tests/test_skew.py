"""Joins on keys that hold most rows."""

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import skew
from corpuslake.session import stored


@pytest.mark.parametrize("few", [3, 2_000])
def test_joined_by_key_equals_a_plain_join(spark, monkeypatch, few):
    monkeypatch.setattr(skew, "FEW", few)
    rows = spark.range(500).select("id", F.when(F.col("id") < 300, 1).when(F.col("id") < 400, F.col("id")).cast("long").alias("k"))
    counts = stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("copies")))
    facts = rows.where("k is not null and k < 350").select("k").distinct().withColumn("v", F.col("k") * 2)
    for how in ("inner", "left"):
        got = skew.joined_by_key(rows, facts, counts, ["k"], "id", how)
        want = rows.join(facts, ["k"], how)
        assert got.columns == want.columns == ["k", "id", "v"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_key_with_most_rows_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 100)
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    counts = stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("copies")))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "10"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        got = skew.joined_by_key(rows, counts, counts, ["k"], "id")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and max(sizes) < 1200
