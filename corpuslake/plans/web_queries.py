"""Pages, URLs, segments, posts, dates and streams, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslake.functions import dates, urls
from corpuslake.functions import text as T
from corpuslake.operators import crawl, extract
from corpuslake.sources import web
from corpuslake.plans.derived import table
from corpuslake.session import scratch


def pages(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages")


_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_HOST = r"regexp_extract(lower({0}), '^[a-z][a-z0-9+.\-]*://([^/?#:]+)', 1)"
_PATH = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
KEYWORDS = ["the", "about", "und", "que", "page7"]


def _keyword_match(spark, d):  # noqa: ANN001, ANN202
    rows = pages(spark, d).withColumn("m", crawl.matched_keywords(F.lit(""), F.col("html"), F.col("url"), KEYWORDS)).where(F.size("m") >= 2)
    return rows.select("page_id", F.array_join("m", ",").alias("matched"))


def _site(spark, d):  # noqa: ANN001, ANN202
    """The pages as one site, each with its own links: named by its first link, its namesakes numbered and linked as pages of a listing."""
    rows = pages(spark, d).select("page_id", "html", F.lower(F.split(F.replace(F.regexp_extract("html", 'href="([^"]*)"', 1), F.lit("&amp;"), F.lit("&")), "#")[0]).alias("name"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("page_id")))
    more = lambda step: F.concat(F.lit('<a href="?page='), F.col("k") * 2 + step, F.lit('">more</a>'))
    url = F.concat(F.lit("http://site.test"), "name", F.when(F.col("k") > 1, F.concat(F.lit("?page="), "k")).otherwise(""))
    return rows.select("page_id", url.alias("url"), F.concat("html", more(0), more(1)).alias("html"))


def _crawl(depth: int):  # noqa: ANN202
    """A crawl of the site over its pages' own links, from the first five pages, without a cap on pages."""

    def run(spark, d):  # noqa: ANN001, ANN202
        site = _site(spark, d)
        seeds = [r["url"] for r in site.where("page_id < 5").select("url").collect()]
        return crawl.crawl(site.drop("page_id"), seeds, ["site.test"], max_depth=depth, max_pages=None).select("url", "crawl_depth")

    return run


def _crawl_sql(depth: int) -> str:
    name = r"""lower(regexp_replace(replace(regexp_extract(html, 'href="([^"]*)"', 1), '&amp;', '&'), '#.*$', ''))"""
    link = r"""regexp_replace(replace(h, '&amp;', '&'), '#.*$', '')"""
    return rf"""WITH RECURSIVE p AS (SELECT page_id, html, name, row_number() OVER (PARTITION BY name ORDER BY page_id) AS k FROM (SELECT page_id, html, {name} AS name FROM pages)),
    s AS (SELECT page_id, html, name, k, 'http://site.test' || name || CASE WHEN k > 1 THEN '?page=' || k ELSE '' END AS url FROM p),
    e AS (SELECT url AS a, 'http://site.test' || {link} AS b, 1 AS step FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM s)
        UNION ALL SELECT url, 'http://site.test' || name || '?page=' || (2 * k + j), 0 FROM s, (VALUES (0), (1)) v(j)),
    w(url, depth) AS (SELECT url, 0 FROM s WHERE page_id < 5 UNION SELECT s.url, w.depth + e.step FROM w JOIN e ON e.a = w.url JOIN s ON s.url = e.b WHERE w.depth < {depth} AND e.a <> e.b)
    SELECT url, CAST(min(depth) AS INTEGER) AS crawl_depth FROM w GROUP BY url"""


def _segments(spark, d):  # noqa: ANN001, ANN202
    """Turns of conversations as the segments of archive items, some excluded, some without bounds, through the extractor."""
    rows = table(spark, d, "conversations")
    segment = F.struct(F.col("turn").alias("idx"), F.when(~((F.col("turn") == 1) & (F.col("conv_id") % 5 == 1)), F.col("turn")).alias("start_sec"), (F.col("turn") + 1).alias("end_sec"), F.col("text").alias("caption_text"))
    items = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    excluded = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)"))
    meta = F.to_json(F.struct(F.lit("internet_archive").alias("source_name"), "segments", excluded.alias("excluded_indices")))
    bronze = items.select(F.col("conv_id").alias("doc_id"), F.lit("u").alias("source_url"), F.lit("video").alias("source_type"), meta.alias("raw_metadata"), F.lit(None).cast("binary").alias("content"))
    return extract.silver(bronze).select(F.col("doc_id").alias("conv_id"), "transcript", "status_processing")


def _titles(spark, d):  # noqa: ANN001, ANN202
    """Whole texts with their source before or behind them, in several separators."""
    by = lambda *choices: F.element_at(F.array(*choices), (F.col("doc_id") % len(choices) + 1).cast("int"))
    text, site = F.trim(F.regexp_replace("text", r"\s+", " ")), F.col("source")
    title = by(F.concat(text, F.lit(" | "), site), F.concat(site, F.lit(" — "), text, F.lit(" - "), text), F.concat(site, F.lit("  ·  "), text), F.concat(text, F.lit("-"), site))
    return table(spark, d, "documents").select("doc_id", title.alias("title"))


_TITLES = r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN t || ' | ' || source WHEN 1 THEN source || ' — ' || t || ' - ' || t WHEN 2 THEN source || '  ·  ' || t ELSE t || '-' || source END AS title
    FROM (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)"""


def _cleaned(src: str, key: str) -> str:
    """SQL: key and title of ``src`` without the site's name."""
    near = "length({0}) < 20 OR length({0}) / length(t) < 0.25"
    return rf"""SELECT {key}, CASE WHEN len(p) > 1 AND ({near.format('p[len(p)]')}) THEN array_to_string(p[1:len(p) - 1], ' - ') WHEN len(p) > 1 AND ({near.format('p[1]')}) THEN array_to_string(p[2:], ' - ') ELSE t END AS title
        FROM (SELECT {key}, t, [trim(x) FOR x IN string_split_regex(t, '\s+[|\-—·•]\s+')] AS p FROM (SELECT {key}, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t FROM ({src})))"""


_DAY = "DATE '2015-06-16' + CAST(doc_id % 900 AS INTEGER)"


def _written_dates(spark, d):  # noqa: ANN001, ANN202
    """A date of each document, written in several ways, some of them no dates."""
    day = F.expr("date_add(date'2015-06-16', cast(doc_id % 900 as int))")
    forms = [F.date_format(day, f) for f in ("MMMM d, yyyy", "yyyyMMdd", "yyyy-M-d", "yyyy-MM-dd'T'00:00:00'Z'")]
    junk = [F.lit("junk"), F.date_format(day, "yyyy-'13'-dd"), F.lit(None).cast("string")]
    text = F.element_at(F.array(*forms, F.concat(F.lit(" "), F.lower(forms[0]), F.lit(" ")), *junk), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.alias("written"))


def _downloads(spark, d):  # noqa: ANN001, ANN202
    """Locations of documents: temporary downloads of videos, in several spellings, and others."""
    name = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 11)
    forms = [F.concat(F.lit("C:\\T\\youtube_dl_9uv\\"), name, F.lit(".webm")), F.concat(F.lit("/tmp/youtube_dl_x1/"), name, F.lit(".MP4")), F.concat(F.lit("https://a.org/"), name, F.lit(".mp4")), F.lit(None).cast("string"), F.concat(F.lit("/tmp/youtubexdl_/"), name, F.lit(".mp4"))]
    return table(spark, d, "documents").select("doc_id", F.element_at(F.array(*forms), (F.col("doc_id") % 5 + 1).cast("int")).alias("u"))


def _pagination(spark, d):  # noqa: ANN001, ANN202
    p = pages(spark, d).select("page_id", "url", F.pmod("page_id", F.lit(4)).alias("k"))
    base = F.regexp_replace("url", "[?#].*$", "")
    to = F.when(F.col("k") == 0, F.concat(base, F.lit("?page=2"))).when(F.col("k") == 1, F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/page/3/"))).when(F.col("k") == 2, F.concat(base, F.lit("/other?page=2"))).otherwise(F.lit("http://elsewhere.test/page/2"))
    return p.withColumn("to", to).select("page_id", urls.is_pagination("url", "to").alias("is_pagination"))


def _stream(spark, d):  # noqa: ANN001, ANN202
    from corpuslake.streaming import dedup_stream

    folder = scratch(spark, "stream")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return dedup_stream(source.select("user_id"), f"{folder}/out", f"{folder}/checkpoint", key="user_id").read()


_WWW = "regexp_replace({0}, '^www\\.', '')"

def _domains_allowed(spark, d):  # noqa: ANN001, ANN202
    """Pages of a list of domains, which are written with and without "www."."""
    chosen = pages(spark, d).where("page_id % 5 = 0").select(urls.domain("url").alias("domain")).distinct().where("domain <> ''")
    listed = [("www." if k % 2 else " ") + r["domain"].upper() for k, r in enumerate(chosen.collect())]  # a setting, as a user writes it
    return pages(spark, d).where(crawl.allowed(F.col("url"), listed)).select("page_id")


#: The pages of the test tables have one article each, beside navigation, an advertisement and a footer.
_MAIN_TEXT = r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
    b AS (SELECT page_id, [trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g')) FOR x IN string_split_regex(a, '</?(?:p|h1|h2|h3|li|ul|div)(?:\s[^>]*)?>')] AS bs FROM a)
    SELECT page_id, nullif(array_to_string([x FOR x IN bs IF x <> ''], chr(10) || chr(10)), '') AS content FROM b"""

ENTRIES = {
    "html_title": (
        lambda s, d: web.probe(pages(s, d).select(F.col("url").alias("location"), F.lit(False).alias("is_local"), F.col("html").alias("content"))).select("location", "source_kind", "detected_title", "detected_size_bytes"),
        f"SELECT url AS location, 'single' AS source_kind, nullif(trim({_TITLE.replace('html,', 'substr(html, 1, 8192),')}), '') AS detected_title, octet_length(encode(html)) AS detected_size_bytes FROM pages",
    ),
    "html_title_guess": (lambda s, d: extract.titles(pages(s, d)), _cleaned(f"SELECT page_id, replace({_TITLE}, '&amp;', '&') AS title FROM pages", "page_id")),
    "html_main_text": (lambda s, d: extract.main_texts(pages(s, d)), _MAIN_TEXT),
    "title_clean": (lambda s, d: _titles(s, d).select("doc_id", T.clean_title("title").alias("title")), _cleaned(_TITLES, "doc_id")),
    "url_host": (lambda s, d: pages(s, d).select("page_id", urls.host("url").alias("host"), urls.domain("url").alias("domain")), f"SELECT page_id, nullif({_HOST.format('url')}, '') AS host, {_WWW.format(_HOST.format('url'))} AS domain FROM pages"),
    "url_classify": (
        lambda s, d: pages(s, d).withColumn("u", F.when(F.col("page_id") % 5 == 0, "https://youtu.be/x").when(F.col("page_id") % 5 == 1, "https://www.archive.org/d").when(F.col("page_id") % 5 == 2, "http://millercenter.org/a").otherwise(F.col("url"))).select("page_id", urls.classify("u").alias("kind")),
        "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'youtube' WHEN 1 THEN 'internet_archive' WHEN 2 THEN 'miller_center' ELSE 'single' END AS kind FROM pages",
    ),
    "crawl_filename": (
        lambda s, d: pages(s, d).select("page_id", urls.crawl_file_name("url").alias("file_name")),
        f"WITH p AS (SELECT page_id, url, replace(regexp_replace({_PATH.format('url')}, '^/+|/+$', '', 'g'), '/', '_') AS slug FROM pages) SELECT page_id, substr(CASE WHEN slug = '' THEN 'index' ELSE slug END, 1, 60) || '_' || substr(md5(url), 1, 8) || '.html' AS file_name FROM p",
    ),
    "domains_allowed": (
        _domains_allowed,
        f"WITH p AS (SELECT page_id, {_WWW.format(_HOST.format('url'))} AS domain FROM pages) SELECT page_id FROM p WHERE domain IN (SELECT domain FROM p WHERE page_id % 5 = 0 AND domain <> '')",
    ),
    "page_links": (
        lambda s, d: crawl.page_rows(pages(s, d)).select("url", F.explode(F.array_distinct("links")).alias("link")).distinct(),  # pages may share a URL
        r"""WITH a AS (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
        SELECT DISTINCT url, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || replace(split_part(h, '#', 1), '&amp;', '&') AS link FROM a""",
    ),
    "iso_dates": (
        lambda s, d: table(s, d, "events").select("event_id", dates.iso_prefix(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day")),
        "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events",
    ),
    "pagination_links": (_pagination, "SELECT page_id, page_id % 4 IN (0, 1) AS is_pagination FROM pages"),
    "keyword_match": (
        _keyword_match,
        "WITH m AS (SELECT page_id, [k FOR k IN [" + ", ".join(f"'{k}'" for k in KEYWORDS) + "] IF contains(lower(' ' || html || ' ' || url), k)] AS m FROM pages) SELECT page_id, array_to_string(m, ',') AS matched FROM m WHERE len(m) >= 2",
    ),
    "crawl_bfs": (_crawl(2), _crawl_sql(2)),
    "crawl_bfs_whole": (_crawl(40), _crawl_sql(40)),
    "segments_included_join": (
        _segments,
        r"""WITH s AS (SELECT conv_id, turn, text FROM conversations WHERE NOT (turn = 0 AND conv_id % 4 = 0) AND NOT (turn = 1 AND conv_id % 5 = 1)),
        j AS (SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> '') AS transcript FROM s GROUP BY conv_id)
        SELECT conv_id, transcript, CASE WHEN transcript IS NULL THEN 'failed' ELSE 'success' END AS status_processing FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN j USING (conv_id)""",
    ),
    "post_clean": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.clean_post(F.concat(F.lit("Jobs! https://a.b/c @me #tag  "), "text")).alias("clean")),
        r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Jobs! https://a.b/c @me #tag  ' || text, 'https?://\S+', '', 'g'), '@\w+', '', 'g'), '#\w+', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents",
    ),
    "retweet_filter": (
        lambda s, d: table(s, d, "documents").withColumn("p", F.concat(F.element_at(F.array(F.lit("RT @u: "), F.lit('"@user: '), F.lit("hello @u "), F.lit("http://x.y/")), (F.col("doc_id") % 4 + 1).cast("int")), "text")).select("doc_id", T.is_repost("p").alias("is_repost"), T.is_substantive("p").alias("is_substantive")),
        r"""WITH p AS (SELECT doc_id, ['RT @u: ', '"@user: ', 'hello @u ', 'http://x.y/'][doc_id % 4 + 1] || text AS p FROM documents)
        SELECT doc_id, regexp_matches(p, '^["“]?(RT\s+)?@\w+[:\-]?\s*') AS is_repost, length(trim(regexp_replace(p, 'https?://\S+', '', 'g'))) >= 3 AS is_substantive FROM p""",
    ),
    "retweet_filter_whole": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.is_repost("text").alias("is_repost"), T.is_substantive("text").alias("is_substantive")),
        r"""SELECT doc_id, regexp_matches(text, '^["“]?(RT\s+)?@\w+[:\-]?\s*') AS is_repost, length(trim(regexp_replace(text, 'https?://\S+', '', 'g'))) >= 3 AS is_substantive FROM documents""",
    ),
    "parse_date_multi": (
        lambda s, d: _written_dates(s, d).select("doc_id", dates.parse_date("written").alias("date"), dates.first_long_date(F.concat(F.lit("on "), "written", F.lit(", noon"))).alias("inside")),
        f"SELECT doc_id, CASE WHEN doc_id % 8 < 5 THEN {_DAY} END AS date, CASE WHEN doc_id % 8 = 0 THEN {_DAY} END AS inside FROM documents",
    ),
    "youtube_url_repair": (
        lambda s, d: _downloads(s, d).select("doc_id", urls.video_url("u").alias("url")),
        "SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'https://www.youtube.com/watch?v=' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 11) END AS url FROM documents",
    ),
    "url_prefix_strip": (
        lambda s, d: table(s, d, "documents").select("doc_id", urls.from_http(F.concat(F.regexp_replace("text", r"\s+", " "), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(' 12. "https://a.b/'), "doc_id")).otherwise(""))).alias("line")),
        r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g') || CASE WHEN doc_id % 3 > 0 THEN ' 12. \"https://a.b/' || doc_id ELSE '' END, '^.*?(http.*)$', '\1') AS line FROM documents",
    ),
    "event_months": (
        lambda s, d: table(s, d, "events").groupBy(dates.month("ts").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")),
        "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1, 2",
    ),
    "stream_dedup_available_now": (_stream, "SELECT DISTINCT user_id FROM events"),
}
