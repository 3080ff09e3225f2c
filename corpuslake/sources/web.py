"""Web pages as sources: link chains, listings, crawls over pages that are already there."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import urls
from corpuslake.functions.dom import parse
from corpuslake.operators import crawl as C
from corpuslake.session import cut, few, stored
from corpuslake.sources.files import _candidates


def _links(pages: DataFrame) -> DataFrame:
    """url, next_url (of li.next or div.next), anchors (href, text), read from each page once."""

    def read(url: str, html: str | None) -> tuple[str | None, list[dict[str, str]]]:
        tree = parse(html)
        box = tree.first("li", cls="next") or tree.first("div", cls="next")
        nxt = box.first("a", where=lambda e: "href" in e.attrs) if box else None
        anchors = [{"href": urljoin(url, a.attrs["href"]), "text": a.text(" ")} for a in tree.matching("a", where=lambda e: "href" in e.attrs)]
        return urljoin(url, nxt.attrs["href"]) if nxt else None, anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))
        for batch in batches:
            found = [read(u, h) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], ["url", "next_url", "anchors"])

    rows = pages.select("url", F.col("html").cast("string").alias("html")).where("url is not null")
    return rows.mapInArrow(run, "url string, next_url string, anchors array<struct<href:string,text:string>>")


def _page(rows: DataFrame, source_name: str, *fields: str) -> DataFrame:
    meta = F.to_json(F.struct(F.lit(source_name).alias("source_name"), *fields))
    name = urls.crawl_file_name("source_url")
    return _candidates(rows.select("source_url", F.lit("text").alias("source_type"), name.alias("file_name"), F.lit(False).alias("is_local"), F.lit("text/html").alias("mime_type"), meta.alias("raw_metadata"), "discovery_order"))


def chain(spark: SparkSession, pages: DataFrame, start_url: str | None = None, urls_list: list[str] | None = None, max_depth: int = 100) -> DataFrame:
    """A list of pages, or those along the "next" links from a start."""
    if urls_list is not None:
        rows = spark.createDataFrame([(u, k) for k, u in enumerate(urls_list)], "url string, depth int")
    else:
        rows = C.follow_chain(_links(pages).select("url", "next_url"), start_url, max_depth)
    return _page(rows.select(F.col("url").alias("source_url"), F.format_string("%08d", "depth").alias("discovery_order")), "miller_center")


def listing(spark: SparkSession, pages: DataFrame, listing_url: str, link_text_filter: tuple[str, ...] = ("tweets of", "truth social posts of"), max_documents: int | None = 1, max_pages: int = 1000) -> DataFrame:
    """Links of a paginated listing whose text holds one of the filters; the first that does names the content type.

    Distinct by URL without fragment, numbered in the order of pages and links, the first ``max_documents``; None is all.
    """
    links = stored(_links(pages))
    order = cut(C.follow_chain(links.select("url", "next_url"), listing_url, max_pages))
    rows = links.join(few(order), "url").select("depth", F.posexplode("anchors").alias("k", "a"))
    kind = F.coalesce(*[F.when(F.contains(F.lower("a.text"), F.lit(f.lower())), F.lit(f)) for f in link_text_filter])
    rows = rows.select("depth", "k", urls.without_fragment("a.href").alias("source_url"), kind.alias("content_type")).where("content_type is not null")
    first = rows.groupBy("source_url").agg(F.min(F.struct("depth", "k", "content_type")).alias("m"))
    out = first if max_documents is None else first.orderBy("m.depth", "m.k").limit(max_documents)
    return _page(out.select("source_url", F.col("m.content_type").alias("content_type"), F.format_string("%08d-%08d", "m.depth", "m.k").alias("discovery_order")), "ucsb", "content_type")


def crawl(spark: SparkSession, pages: DataFrame, seed_urls: list[str], keywords: list[str], **bounds) -> DataFrame:  # noqa: ANN003
    """Pages of a bounded crawl that hold enough keywords."""
    rows = C.crawl(pages, seed_urls, keywords, **bounds)
    return _page(rows.withColumns({"source_url": F.col("url"), "discovery_order": F.format_string("%08d-%s", "crawl_depth", "url")}), "crawl", "discovered_via", "crawl_depth", "matched_keywords", "page_title")


def probe(rows: DataFrame) -> DataFrame:
    """location and what can be told without ingesting it: adapter, file name, media type, title in the first 8 KiB, size.

    ``rows`` has location, is_local and, where fetched, content.
    """
    raw = F.col("content").cast("binary")
    head = F.make_valid_utf8(F.substring(raw, 1, 8192).cast("string"))  # 8 KiB may end within a character
    name = urls.last_segment("location", "downloaded_file")
    title = F.trim(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return rows.select(
        "location",
        urls.classify("location", F.col("is_local")).alias("source_kind"),
        name.alias("detected_file_name"),
        urls.lookup(urls.extension(name), urls.MIME_TYPES).alias("detected_mime_type"),
        F.when(title != "", title).alias("detected_title"),
        F.length(raw).cast("long").alias("detected_size_bytes"),
        F.when(F.col("is_local") & F.col("content").isNull(), F.array(F.concat(F.lit("File not found: "), "location"))).otherwise(F.expr("cast(array() as array<string>)")).alias("warnings"),
    )
