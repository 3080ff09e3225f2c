"""Bounded breadth-first crawl over a table of pages and one of links.

The frontier is a DataFrame; each round joins it with the links and leaves out what was
visited. Nothing is fetched: pages come as rows (url, html, content_type).
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import urls
from corpuslake.functions.dom import parse
from corpuslake.operators.skew import joined_by_key
from corpuslake.session import cut, few, scratch, stored


def page_rows(pages: DataFrame) -> DataFrame:
    """url, title, page_text, links (absolute, without fragments, http and https only) of every page, parsed once."""

    def read(url: str, html: str | None) -> tuple[str, str, list[str]]:
        tree = parse(html)
        title, links = tree.first("title"), []
        for a in tree.matching("a", where=lambda e: "href" in e.attrs):
            try:
                links.append(urljoin(url, a.attrs["href"]).split("#")[0])
            except ValueError:
                continue  # no URL at all
        return title.text() if title else "", tree.text(" "), [x for x in links if x.startswith(("http://", "https://"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
        for batch in batches:
            found = [read(u, h) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], ["url", "title", "page_text", "links"])

    rows = pages.select("url", F.col("html").cast("string").alias("html")).where("url is not null")
    return rows.mapInArrow(run, "url string, title string, page_text string, links array<string>")


def matched_keywords(title: Column, text: Column, url: Column, keywords: list[str]) -> Column:
    """The configured keywords that occur in title, text or URL, in their order."""
    haystack = F.lower(F.concat_ws(" ", title, text, url))
    return F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(haystack, k))


def allowed(url: Column, domains: list[str] | None) -> Column:
    """Whether a URL's domain is on the list; no list allows all."""
    if not domains:
        return F.lit(True)
    return urls.domain(url).isin(*[d.strip().lower().removeprefix("www.") for d in domains])


def by_robots(rows: DataFrame, robots: DataFrame | None, on_missing: bool = False, url: str = "url") -> DataFrame:
    """``rows`` whose path no rule of (domain, disallowed_prefix) forbids, or no file of (domain, content); without either nothing is checked.

    A domain that the table does not know is refused, or allowed with ``on_missing``; one that
    forbids nothing has a row with an empty prefix.
    """
    if robots is None:
        return rows
    if "content" in robots.columns:  # files as fetched
        from corpuslake.sources import robots as files_of_robots  # sources read this module

        return files_of_robots.allowed(rows, robots, on_missing=on_missing, url=url).drop("crawl_delay")
    keyed = rows.withColumns({"__domain": urls.domain(url), "__path": urls.path(url)})
    # rules are few where they fit a broadcast, and then a domain with very many pages is no hot key
    bad = cut(robots.select(F.col("domain").alias("__domain"), F.col("disallowed_prefix").alias("__rule")).distinct())
    out = keyed.join(few(bad.where("__rule <> ''")), (keyed["__domain"] == bad["__domain"]) & F.startswith(keyed["__path"], bad["__rule"]), "left_anti")
    if not on_missing:
        out = out.join(few(bad.select("__domain").distinct()), "__domain", "left_semi")
    return out.drop("__domain", "__path")


_VISITED = "url string, depth int, hops int, via string"
#: Pages of a frontier that is broadcast to the links, at most.
FRONTIER = 10_000


def crawl(pages: DataFrame, seeds: list[str], keywords: list[str], *, domains: list[str] | None = None, max_depth: int = 2, max_pages: int | None = 50, threshold: int = 1, robots: DataFrame | None = None, on_missing: bool = False) -> DataFrame:
    """url, crawl_depth, discovered_via, matched_keywords, page_title of up to ``max_pages`` pages with enough keywords.

    A page is visited once, at the smallest depth at which it is found (by the fewest links, then from the first page by URL). A pagination link keeps its
    page's depth, others add one; links are followed below ``max_depth`` only. The cap counts
    yielded pages, the shallowest first and then by URL; None is no cap.

    Depth by depth: the pagination links within a depth are followed round by round, then all other links lead to the next. Each round appends the pages
    that it visits to a table, so what is written is linear in the pages. The crawl ends with the depth that fills the cap.
    Only a frontier of at most FRONTIER pages is broadcast; tables that grow with the pages are never sent to the driver.
    """
    spark = pages.sparkSession
    rows = pages.where("url is not null")
    if "content_type" in rows.columns:
        rows = rows.where(F.coalesce(F.contains(F.lower("content_type"), F.lit("text/html")), F.lit(False)))
    read = page_rows(by_robots(rows.where(allowed(F.col("url"), domains)), robots, on_missing)).dropDuplicates(["url"])
    parsed = stored(read.select("url", "title", "links", matched_keywords(F.col("title"), F.col("page_text"), F.col("url"), keywords).alias("matched_keywords")))
    known, hits = parsed.select("url"), parsed.where(F.size("matched_keywords") >= threshold).drop("links")
    links = parsed.select("url", F.explode(F.array_distinct("links")).alias("next")).where(F.col("next") != F.col("url"))
    links = links.join(known.select(F.col("url").alias("next")).hint("merge"), "next", "left_semi")  # the others lead nowhere
    edges = stored(links.select("url", "next", urls.is_pagination("url", "next").alias("same_depth")))
    folder = scratch(spark, "crawl")

    def visited() -> DataFrame:
        return spark.read.schema(_VISITED).parquet(folder)

    def visit(found: DataFrame, begun: bool = True) -> DataFrame | None:
        """Appends the pages among ``found`` that are new; those pages, or None."""
        best = found.groupBy("url").agg(F.min(F.struct("depth", "hops", "via")).alias("b")).select("url", "b.depth", "b.hops", "b.via")
        new = cut(best.join(visited().select("url").hint("merge"), "url", "left_anti") if begun else best.join(known.hint("merge"), "url", "left_semi"))
        new.write.mode("append").parquet(folder)
        return new if new.limit(1).count() else None

    def along(frontier: DataFrame, same_depth: bool) -> DataFrame:
        step = edges.where(F.col("same_depth") == same_depth)
        return few(frontier, FRONTIER).join(step.hint("merge"), "url").select(F.col("next").alias("url"), (F.col("depth") + (0 if same_depth else 1)).alias("depth"), (F.col("hops") + 1).alias("hops"), F.col("url").alias("via"))

    frontier = visit(spark.createDataFrame([(s, 0, 0, None) for s in seeds], _VISITED), begun=False)
    for depth in range(max_depth + 1):
        while frontier is not None and depth < max_depth:
            frontier = visit(along(frontier, True))
        if depth == max_depth or (max_pages is not None and visited().join(hits.select("url"), "url", "left_semi").limit(max_pages).count() >= max_pages):
            break
        frontier = visit(along(visited().where(F.col("depth") == depth), False))
        if frontier is None:
            break
    out = visited().join(hits.hint("merge"), "url").select("url", F.col("depth").alias("crawl_depth"), F.col("via").alias("discovered_via"), "matched_keywords", F.col("title").alias("page_title"))
    return out if max_pages is None else out.orderBy("crawl_depth", "url").limit(max_pages)


def follow_chain(links: DataFrame, start: str, max_depth: int = 100) -> DataFrame:
    """url, depth along a chain of (url, next_url) from ``start``: stops at a repeated page, a dead end or the cap.

    Links are doubled round by round, so a chain takes a number of joins logarithmic in its length; a page's
    first visit counts. Of several next links of a page the first by name counts.
    """
    step = cut(links.where("url is not null and next_url is not null").groupBy("url").agg(F.min("next_url").alias("next")))
    seen, span = links.sparkSession.createDataFrame([(start, 0)], "url string, depth int"), 1
    while span < max_depth:
        ahead = seen.join(step, "url").select(F.col("next").alias("url"), (F.col("depth") + span).alias("depth"))
        seen = cut(seen.unionByName(ahead).groupBy("url").agg(F.min("depth").alias("depth")))
        onward = step.select(F.col("url").alias("next"), F.col("next").alias("onward"))
        copies = cut(step.groupBy("next").agg(F.count(F.lit(1)).alias("copies")))  # very many pages may lead to one
        step = cut(joined_by_key(step, onward, copies, ["next"], "url").select("url", F.col("onward").alias("next")))
        span *= 2
    return seen.where(F.col("depth") < max_depth)
