"""Media listings as sources: video records and broadcast items."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions.dom import parse
from corpuslake.sources.files import _candidates

# What is kept of a video's record.
VIDEO_FIELDS = ("title", "description", "upload_date", "duration", "channel", "channel_id", "uploader_url", "view_count", "like_count", "tags", "categories", "webpage_url", "language")


def videos(spark: SparkSession, path: str, playlist_mode: bool = False, max_downloads: int | None = None, audio_only: bool = False) -> DataFrame:
    """Candidates from JSON records of videos, one a line; a playlist's record holds them as entries.

    Of a playlist the first ``max_downloads`` entries count. Records without a URL are skipped.
    """
    rows = spark.read.text(path).select(F.parse_json("value").alias("v"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("o"))
    if playlist_mode:
        entries = F.expr("cast(try_variant_get(v, '$.entries', 'array<variant>') as array<variant>)")
        if max_downloads:
            entries = F.slice(entries, 1, max_downloads)
        rows = rows.select("f", "o", F.posexplode(entries).alias("k", "v"))
    else:
        rows = rows.withColumn("k", F.lit(0))
        if max_downloads:
            rows = rows.orderBy("o").limit(max_downloads)
    get = lambda name: F.expr(f"try_variant_get(v, '$.{name}', 'string')")
    meta = F.to_json(F.struct(F.lit("youtube").alias("source_name"), *[get(name).alias(name) for name in VIDEO_FIELDS]))
    url = F.coalesce(get("webpage_url"), get("url"))
    kind, mime, ext = ("audio", "audio/mp4", ".m4a") if audio_only else ("video", "video/mp4", ".mp4")
    rows = rows.select(
        url.alias("source_url"), F.lit(kind).alias("source_type"), F.concat(F.coalesce(get("id"), F.md5(url)), F.lit(ext)).alias("file_name"), F.lit(False).alias("is_local"), F.lit(mime).alias("mime_type"), meta.alias("raw_metadata"), F.format_string("%020d-%06d", "o", "k").alias("discovery_order")
    )
    return _candidates(rows.where("source_url is not null"))


def segments_of(html: str) -> tuple[str | None, str | None, str | None, list[dict]]:
    """(identifier, title, date text, segments) of a broadcast item's page; missing parts are null or empty."""
    page = parse(html)
    init = page.first("input", cls="js-tv3-init")
    try:
        identifier = json.loads(init.attrs.get("value", "")).get("TV3.identifier") if init else None
    except (ValueError, AttributeError):
        identifier = None
    out = []
    for col in page.all("div", cls="tvcol"):
        link, caption = col.first("a", cls="js-tv2-col_clicked"), col.first("div", cls="snipin")
        m = re.search(r"/start/(\d+)/end/(\d+)", link.attrs.get("href", "")) if link else None
        if re.fullmatch(r"\d{1,9}", col.attrs.get("data-idx", "")):
            out.append({"idx": int(col.attrs["data-idx"]), "start_sec": int(m[1]) if m else None, "end_sec": int(m[2]) if m else None, "caption_text": caption.text(" ") if caption else ""})
    title, box = page.first("h1", cls="item-title"), page.first("div", cls="tv-ttl")
    date = re.search(r"[A-Z][a-z]+ \d{1,2}, \d{4}", box.text(" ")) if box else None
    return identifier, title.text() if title else None, date[0] if date else None, sorted(out, key=lambda s: s["idx"])


def archive_items(spark: SparkSession, pages: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Candidates from item pages (url, html) with their segments and excluded indices in the metadata.

    ``excluded`` (identifier, excluded_indices) comes from a file of settings; identifiers
    without an entry exclude nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(u, *segments_of(h)) for u, h in zip(b["url"], b["html"], strict=True)]
            yield pd.DataFrame([(u, i or u.split("?")[0].rstrip("/").rsplit("/", 1)[-1], t, d, json.dumps(s)) for u, i, t, d, s in got], columns=["url", "identifier", "title", "date", "segments"])

    rows = pages.select("url", "html").where("url is not null").mapInPandas(run, "url string, identifier string, title string, date string, segments string")
    if excluded is not None:
        rows = rows.join(excluded, "identifier", "left")
    else:
        rows = rows.withColumn("excluded_indices", F.lit(None).cast("array<int>"))
    segment = "array<struct<idx:int,start_sec:int,end_sec:int,caption_text:string>>"
    meta = F.to_json(F.struct(F.lit("internet_archive").alias("source_name"), "identifier", "title", "date", F.coalesce("excluded_indices", F.expr("cast(array() as array<int>)")).alias("excluded_indices"), F.from_json("segments", segment).alias("segments")))
    rows = rows.select(F.col("url").alias("source_url"), F.lit("video").alias("source_type"), F.concat("identifier", F.lit(".mp4")).alias("file_name"), F.lit(False).alias("is_local"), F.lit("video/mp4").alias("mime_type"), meta.alias("raw_metadata"), F.col("url").alias("discovery_order"))
    return _candidates(rows)


def user_fields(given: dict[str, str | None]) -> str:
    """Metadata JSON with the fields that a user gave, nulls left out (P20)."""
    return json.dumps({"user_provided": {k: v for k, v in given.items() if v is not None}})
