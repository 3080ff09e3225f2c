"""Session defaults and the shared folder for intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "corpuslake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; a cluster's own settings win."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, a single machine) a temporary folder is made
    and set, for a local master; on a cluster the missing setting is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at and sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc._jsc.sc().getCheckpointDir().get()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="corpuslake-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared folder, which is deleted when the application ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from then on.

    A reliable checkpoint: it survives lost executors and later plans start from it. Spark
    removes the files once nothing refers to them, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as build_session() does.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but a table of columns: later plans read those that they need."""
    at = scratch(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def few(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` (narrow ones, computed already) with the hint to broadcast them if they are at most ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows
