"""Files and plain lists as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import urls
from corpuslake.schemas import CANDIDATE
from corpuslake.session import few


def _candidates(rows: DataFrame) -> DataFrame:
    """The candidate columns, nulls where ``rows`` lacks them, and discovery_order and content if there."""
    out = []
    for field in CANDIDATE.split(", "):
        name, kind = field.split(" ", 1)
        out.append(F.col(name).cast(kind).alias(name) if name in rows.columns else F.lit(None).cast(kind).alias(name))
    return rows.select(*out, *[c for c in ("discovery_order", "content") if c in rows.columns])


def local_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder with a known extension, as candidates with content (S2); a missing folder is an error."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = urls.lookup(urls.extension(name), urls.SOURCE_TYPES)
    rows = rows.select(F.col("path").alias("source_url"), kind.alias("source_type"), name.alias("file_name"), F.lit(True).alias("is_local"), urls.lookup(urls.extension(name), urls.MIME_TYPES).alias("mime_type"), F.col("path").alias("local_path"), F.col("path").alias("discovery_order"), "content")
    return _candidates(rows.where("source_type is not null"))


def single_item(spark: SparkSession, location: str, source_type: str, is_local: bool = False, raw_metadata: str | None = None) -> DataFrame:
    """Exactly one candidate for a URL or a path (S3). A local file that is missing is an error."""
    row = spark.createDataFrame([(location, source_type, is_local, raw_metadata)], "source_url string, source_type string, is_local boolean, raw_metadata string")
    if is_local:
        content = spark.read.format("binaryFile").load(location).select("content")
        row = row.crossJoin(F.broadcast(content.limit(1)))  # one row each
    return single_items(row)


def single_items(rows: DataFrame) -> DataFrame:
    """As single_item(), for each row of source_url, source_type, is_local, raw_metadata."""
    name = urls.last_segment("source_url", "downloaded_file")
    row = rows.withColumns({"file_name": name, "mime_type": urls.lookup(urls.extension(name), urls.MIME_TYPES), "local_path": F.when(F.col("is_local"), F.col("source_url")), "discovery_order": F.lit("0")})
    return _candidates(row)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a text file, trimmed, blank ones and stray quotes at the ends dropped."""
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), r'^"+|"+$', "").alias("value")).where("value <> ''")


def url_list(spark: SparkSession, path: str | None = None, urls_list: list[str] | None = None, source_type: str = "video") -> DataFrame:
    """A candidate for each URL of a file or a list."""
    rows = lines(spark, path) if path else spark.createDataFrame([(u,) for u in urls_list or []], "value string")
    name = urls.last_segment("value", "unnamed_file")
    return _candidates(rows.select(F.col("value").alias("source_url"), F.lit(source_type).alias("source_type"), name.alias("file_name"), F.lit(False).alias("is_local"), urls.lookup(urls.extension(name), urls.MIME_TYPES).alias("mime_type"), F.col("value").alias("discovery_order")))


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """identifier, excluded_indices from a JSON file {identifier: [index, ...]}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("identifier", "excluded_indices"))


def object_contents(bronze: DataFrame, objects: DataFrame) -> DataFrame:
    """Bronze rows (computed already) with the content of their object by storage_path; null where it is missing.

    Objects that no row asks for are left out before anything is shuffled.
    """
    asked = few(bronze.select("storage_path").distinct())
    return bronze.join(objects.select("storage_path", "content").join(asked, "storage_path", "left_semi"), "storage_path", "left")


def transform_lines(spark: SparkSession, path: str, out: str) -> None:
    """Writes each line of a file without what stands before its URL."""
    spark.read.text(path).select(urls.from_http(F.trim("value")).alias("value")).write.mode("overwrite").text(out)
