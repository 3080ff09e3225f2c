"""Sources, extraction, tables and modules over inputs made from the test tables, each with its SQL.

The test tables hold no listings, items or posts; pages of those kinds are written from their texts here, whole, and
go through the sources and extractors as any page would.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslake import gold, schemas, sources
from corpuslake.functions import urls
from corpuslake.operators import bronze as B
from corpuslake.operators import crawl, dashboard, embeddings, extract, repair, scores, store
from corpuslake.plans import derived, text_queries, web_queries
from corpuslake.plans.derived import table
from corpuslake.session import cut, scratch
from corpuslake.sources import files, robots

_ESCAPED = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://\S+', '', 'g'), '@\w+', '', 'g'), '#\w+', '', 'g'), '\s+', ' ', 'g'))"


def docs(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents")


def _written(rows, name: str) -> str:  # noqa: ANN001
    """The folder of a text file with one line a row of ``value``."""
    at = scratch(rows.sparkSession, name)
    rows.select("value").write.text(at)
    return at


# -- files and lists ---------------------------------------------------------
def _url_list(spark, d):  # noqa: ANN001, ANN202
    line = F.expr("case when doc_id % 5 = 0 then '  ' else concat(' https://', source, '.org/a/', doc_id, case doc_id % 3 when 0 then '.mp4\"' when 1 then '/' else '?q=1' end) end")
    return sources.read(spark, "urls", path=_written(docs(spark, d).select(line.alias("value")), "urls")).select("source_url", "source_type", "file_name", "mime_type")


_URL_LIST = """SELECT u || CASE doc_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '/' ELSE '?q=1' END AS source_url, 'video' AS source_type, doc_id || CASE doc_id % 3 WHEN 0 THEN '.mp4' ELSE '' END AS file_name, CASE doc_id % 3 WHEN 0 THEN 'video/mp4' END AS mime_type
    FROM (SELECT doc_id, 'https://' || source || '.org/a/' || doc_id AS u FROM documents WHERE doc_id % 5 <> 0)"""


def _lines_out(spark, d):  # noqa: ANN001, ANN202
    line = F.expr("concat(doc_id, '. ', case when doc_id % 4 = 0 then 'no link' else concat('\"http://', source, '/http://', doc_id) end)")
    out = scratch(spark, "lines-out")
    files.transform_lines(spark, _written(docs(spark, d).select(line.alias("value")), "lines-in"), out)
    return spark.read.text(out).select(F.col("value").alias("line"))


def _local_files(spark, d):  # noqa: ANN001, ANN202
    """Texts written to files, found by the folder source: bytes and kinds over all files."""
    at = _written(docs(spark, d).select(F.regexp_replace("text", r"\n", " ").alias("value")), "files")
    found = sources.read(spark, "local", folder=at)
    return found.groupBy("source_type", "mime_type", "is_local").agg(F.sum(F.length("content")).alias("bytes"))


def _records(spark, d):  # noqa: ANN001, ANN202
    entry = lambda k: F.struct(F.concat(F.lit("https://v/e"), "doc_id", F.lit(k)).alias("url"), F.lit(f"E{k}").alias("title"))
    record = F.struct(
        F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("v"), "doc_id")).alias("id"), F.col("text").alias("description"), F.concat(F.lit("T"), "doc_id").alias("title"), F.col("doc_id").alias("duration"),
        F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("https://v/"), "doc_id")).alias("webpage_url"), F.array(*[entry(k) for k in range(4)]).alias("entries"),
    )
    return _written(docs(spark, d).select(F.to_json(record).alias("value")), "records")


def _videos(playlist: bool):  # noqa: ANN202
    def run(spark, d):  # noqa: ANN001, ANN202
        options = {"playlist_mode": True, "max_downloads": 3, "audio_only": True} if playlist else {}
        rows = sources.read(spark, "youtube", path=_records(spark, d), **options)
        meta = lambda k: F.get_json_object("raw_metadata", f"$.{k}").alias(k)
        return rows.select("source_url", "source_type", "file_name", "mime_type", meta("title"), meta("duration"), F.length(meta("description")).alias("described"))

    return run


_VIDEOS = """SELECT 'https://v/' || doc_id AS source_url, 'video' AS source_type, CASE WHEN doc_id % 4 > 0 THEN 'v' || doc_id ELSE md5('https://v/' || doc_id) END || '.mp4' AS file_name, 'video/mp4' AS mime_type,
    'T' || doc_id AS title, CAST(doc_id AS VARCHAR) AS duration, length(text) AS described FROM documents WHERE doc_id % 7 > 0"""
_PLAYLIST = """SELECT 'https://v/e' || doc_id || k AS source_url, 'audio' AS source_type, md5('https://v/e' || doc_id || k) || '.m4a' AS file_name, 'audio/mp4' AS mime_type, 'E' || k AS title, CAST(NULL AS VARCHAR) AS duration, CAST(NULL AS INTEGER) AS described
    FROM documents, (VALUES (0), (1), (2)) v(k)"""


# -- pages of items, chains and listings -------------------------------------
def _bronze_of(pages, kind: str, source_type: str = "text"):  # noqa: ANN001, ANN202
    meta = F.to_json(F.struct(F.lit(kind).alias("source_name")))
    return pages.select(F.col("id").alias("doc_id"), F.lit("http://x.y/").alias("source_url"), F.lit(source_type).alias("source_type"), meta.alias("raw_metadata"), F.col("html").alias("content"))


def _per_conversation(spark, d, piece: str, head: str, tail: str):  # noqa: ANN001, ANN202
    """A page for each conversation: ``head``, a piece for each turn in order, ``tail`` (SQL over its rows)."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(piece).alias("piece"))
    rows = rows.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "").alias("body"))
    return rows.select("id", F.concat(F.expr(head), "body", F.expr(tail)).alias("html"))


def _archive_items(spark, d):  # noqa: ANN001, ANN202
    """Broadcast items with their captions, indices of a settings file left out, through source and extractor."""
    piece = f"""concat('<div class="tvcol" data-idx="', turn, '">', case when turn % 5 = 3 then '' else concat('<a class="js-tv2-col_clicked" href="/x/start/', turn * 60, '/end/', turn * 60 + 60, '">x</a>') end, '<div class="snipin">', {_ESCAPED}, '</div></div>')"""
    head = """concat('<input class="js-tv3-init" value=\\'{"TV3.identifier": "c', id, '"}\\'><h1 class="item-title">News ', id, '</h1><div class="tv-ttl"><div>June 16, 2015 noon</div></div>')"""
    pages = _per_conversation(spark, d, piece, head, "''").select(F.concat(F.lit("https://archive.org/details/c"), "id").alias("url"), "html")
    ids = table(spark, d, "conversations").select("conv_id").distinct().where("conv_id % 4 = 0")
    settings = ids.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("c"), "conv_id"), F.array(F.lit(0), F.lit(2)))))).alias("value"))  # one file, as a user writes it
    excluded = files.exclusions(spark, _written(settings.coalesce(1), "excluded"))
    found = sources.read(spark, "internet_archive", pages=pages, excluded=excluded)
    rows = found.select(F.regexp_extract("source_url", r"c(\d+)$", 1).cast("long").alias("doc_id"), "source_url", "source_type", "raw_metadata", F.lit(None).cast("binary").alias("content"))
    return extract.silver(rows).select("doc_id", "title", "publication_date", "transcript", "word_count")


_ARCHIVE = r"""SELECT conv_id AS doc_id, 'News ' || conv_id AS title, DATE '2015-06-16' AS publication_date, t AS transcript, CAST(len(regexp_extract_all(t, '\S+')) AS INTEGER) AS word_count
    FROM (SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE turn % 5 <> 3 AND NOT (conv_id % 4 = 0 AND turn IN (0, 2)) AND trim(text) <> '') AS t FROM conversations GROUP BY conv_id) WHERE t IS NOT NULL
    UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE turn % 5 <> 3 AND NOT (conv_id % 4 = 0 AND turn IN (0, 2)) AND trim(text) <> '') = 0"""


def _speeches(spark, d):  # noqa: ANN001, ANN202
    head = """concat('<div id="block-mainpagecontent"><h2 class="presidential-speeches--title"><span>Speech ', id, '</span></h2><p class="episode-date">May ', id % 28 + 1, ', 2016</p><div id="dp-expandable-text"><div class="transcript-inner">')"""
    pages = _per_conversation(spark, d, f"concat('<p>', {_ESCAPED}, '</p><p> </p>')", head, "'</div></div><p>outside</p></div>'")
    return extract.silver(_bronze_of(pages, "miller_center")).select("doc_id", "title", "publication_date", "transcript")


_SPEECHES = """SELECT conv_id AS doc_id, 'Speech ' || conv_id AS title, CAST('2016-05-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS publication_date, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> '') AS transcript
    FROM conversations GROUP BY conv_id"""

_POSTS_HEAD = """concat('<div class="field-ds-doc-title"><h1>Posts ', id, '</h1></div><div class="field-docs-start-date-time"><span property="dc:date" content="2016-05-', lpad(id % 28 + 1, 2, '0'), 'T00:00:00+00:00"></span></div><div class="field-docs-content"><table><tbody>')"""


def _flat_posts(spark, d):  # noqa: ANN001, ANN202
    said = f"case turn % 4 when 1 then concat('RT @u: ', {_ESCAPED}) when 2 then 'https://a.b/c' else concat('#tag ', {_ESCAPED}, ' https://a.b/c') end"
    pages = _per_conversation(spark, d, f"concat('<tr><td>', turn, '</td><td>', {said}, '<br>Retweets: 5<br>Favorites: 1</td></tr>')", _POSTS_HEAD, """'<tr><td colspan="2">data as of today</td></tr></tbody></table></div>'""")
    return extract.silver(_bronze_of(pages, "ucsb")).select("doc_id", "title", "publication_date", "transcript")


def _paired_posts(spark, d):  # noqa: ANN001, ANN202
    handle = "case turn % 3 when 0 then 'realDonaldTrump' when 1 then 'other' else 'REALDONALDTRUMP' end"
    pair = f"""concat('<tr><td>', turn, '</td><td><p>', {_ESCAPED}, '</p><p>@me more</p></td></tr><tr><td><a href="https://truthsocial.com/@', {handle}, '/posts/', turn, '">l</a></td></tr>')"""
    pages = _per_conversation(spark, d, pair, _POSTS_HEAD, "'</tbody></table></div>'")
    return extract.silver(_bronze_of(pages, "ucsb")).select("doc_id", "title", "publication_date", "transcript")


def _posts_sql(kept: str, said: str) -> str:
    return f"""SELECT conv_id AS doc_id, 'Posts ' || conv_id AS title, CAST('2016-05-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS publication_date, t AS transcript
    FROM (SELECT conv_id, string_agg({_CLEAN.format(said)}, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE {kept}) AS t FROM conversations GROUP BY conv_id)"""


def _link_chain(spark, d, most: int | None = 60):  # noqa: ANN001, ANN202
    rows = table(spark, d, "pages")
    size = rows.count()
    n = F.lit(size)
    link = F.concat(F.lit('<li class="next"><a href="'), F.pmod(F.col("page_id") * 7 + 1, n), F.lit('">n</a></li>'))
    pages = rows.select(F.concat(F.lit("http://l.t/"), "page_id").alias("url"), F.concat("html", link).alias("html"))
    return sources.read(spark, "miller_center", pages=pages, start_url="http://l.t/0", max_depth=most or size + 1).select("source_url", "mime_type", F.col("discovery_order").cast("int").alias("place"))


#: The whole chain: it comes back to its start, or into itself, after as many steps as there are pages at most.
_CHAIN_WHOLE = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), w(p, place) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT (p * 7 + 1) % (SELECT n FROM n), place + 1 FROM w WHERE place < (SELECT n FROM n))
    SELECT 'http://l.t/' || p AS source_url, 'text/html' AS mime_type, min(place) AS place FROM w GROUP BY p"""

_CHAIN = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), w(p, place) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT (p * 7 + 1) % (SELECT n FROM n), place + 1 FROM w WHERE place < 59)
    SELECT 'http://l.t/' || p AS source_url, 'text/html' AS mime_type, min(place) AS place FROM w GROUP BY p"""


def _listing(spark, d):  # noqa: ANN001, ANN202
    """Twenty documents to a page of a listing, each page leading to the next."""
    says = "case doc_id % 3 when 0 then 'Tweets of May' when 1 then 'other' else 'Truth Social Posts of June' end"
    rows = docs(spark, d).select((F.col("doc_id") / 20).cast("long").alias("p"), "doc_id", F.expr(f"concat('<a href=\"/d/', doc_id, '#x\">', {says}, '</a><a href=\"/d/', doc_id, '\">tweets of it</a>')").alias("a"))
    rows = rows.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "a"))), lambda x: x["a"]), " ").alias("body"))
    pages = rows.select(F.concat(F.lit("http://l.t/"), "p").alias("url"), F.concat("body", F.lit('<li class="next"><a href="'), F.col("p") + 1, F.lit('">n</a></li>')).alias("html"))
    found = sources.read(spark, "ucsb", pages=pages, listing_url="http://l.t/0", max_documents=None, max_pages=10**6)
    return found.select("source_url", F.get_json_object("raw_metadata", "$.content_type").alias("content_type"))


_LISTING = "SELECT 'http://l.t/d/' || doc_id AS source_url, CASE doc_id % 3 WHEN 2 THEN 'truth social posts of' ELSE 'tweets of' END AS content_type FROM documents"


def _robots(spark, d):  # noqa: ANN001, ANN202
    rows = table(spark, d, "pages").select("page_id", "url")
    rules = rows.where("page_id % 5 < 3").select(urls.domain("url").alias("domain"), F.when(F.col("page_id") % 5 == 0, F.substring(urls.path("url"), 1, 4)).otherwise("").alias("disallowed_prefix"))
    return crawl.by_robots(rows.where(crawl.allowed(F.col("url"), None)), rules).select("page_id")


_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_DOMAIN = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://([^/?#:]+)', 1), '^www\.', '')"
_ROBOTS = f"""WITH p AS (SELECT page_id, {_DOMAIN} AS domain, {_PATH} AS path FROM pages), r AS (SELECT domain, CASE page_id % 5 WHEN 0 THEN substr(path, 1, 4) ELSE '' END AS rule FROM p WHERE page_id % 5 < 3)
    SELECT page_id FROM p WHERE EXISTS (SELECT 1 FROM r WHERE r.domain = p.domain) AND NOT EXISTS (SELECT 1 FROM r WHERE r.domain = p.domain AND rule <> '' AND starts_with(path, rule))"""


def _robots_files(spark, d):  # noqa: ANN001, ANN202
    """Each domain of pages with a file made of its first page's path: what is forbidden has a wild card and an end, a longer prefix is allowed."""
    rows = table(spark, d, "pages").select("page_id", "url")
    first = rows.groupBy(urls.domain("url").alias("domain")).agg(F.min(F.struct("page_id", urls.path("url").alias("p"))).alias("m"))
    lines = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-Agent: *  # all\nDisallow: "), F.substring("m.p", 1, 2), F.lit("*\nCrawl-delay: 2\nAllow: "), F.substring("m.p", 1, 3), F.lit("\nDisallow: /*"), F.expr("right(m.p, 1)"), F.lit("$\n"))
    files_ = first.where("m.page_id % 7 < 6").select("domain", lines.alias("content"))
    return robots.allowed(rows, files_).select("page_id", "crawl_delay")


_ROBOTS_FILES = rf"""WITH p AS (SELECT page_id, {_DOMAIN} AS domain, {_PATH} AS path, CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) LIKE '/%' THEN regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) ELSE '/' || regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) END AS full_path FROM pages),
    f AS (SELECT domain, arg_min(path, page_id) AS first FROM p GROUP BY domain HAVING min(page_id) % 7 < 6),
    r AS (SELECT domain, unnest([{{'allow': false, 'p': substr(first, 1, 2) || '*'}}, {{'allow': true, 'p': substr(first, 1, 3)}}, {{'allow': false, 'p': '/*' || right(first, 1) || '$'}}]) AS r FROM f),
    x AS (SELECT domain, r.allow AS allow, length(r.p) AS n, '^' || replace(regexp_escape(CASE WHEN r.p LIKE '%$' THEN left(r.p, -1) ELSE r.p END), '\*', '.*') || CASE WHEN r.p LIKE '%$' THEN '$' ELSE '' END AS rx FROM r WHERE r.p <> ''),
    m AS (SELECT page_id, arg_max(allow, n * 2 + CAST(allow AS INT)) AS allow FROM p JOIN x ON x.domain = p.domain AND regexp_matches(full_path, x.rx) GROUP BY page_id)
    SELECT page_id, 2.0::DOUBLE AS crawl_delay FROM p JOIN f USING (domain) LEFT JOIN m USING (page_id) WHERE coalesce(allow, true)"""


def _prompts(spark, d):  # noqa: ANN001, ANN202
    meta = F.struct(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("T"), "doc_id")).alias("title"), F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("doc_id") % 4 == 1, F.col("text")).alias("description"), F.struct(F.when(F.col("doc_id") % 4 == 2, F.col("text")).alias("about")).alias("extra"))
    return docs(spark, d).select("doc_id", F.to_json(meta).alias("m")).select("doc_id", extract.prompt_of("m", "Base.").alias("prompt"))


_PROMPTS = """SELECT doc_id, 'Base.' || CASE WHEN doc_id % 3 > 0 THEN ' Title: T' || doc_id || '.' ELSE '' END || CASE WHEN doc_id % 4 IN (1, 2) AND trim(text) <> '' THEN ' Context: ' || substr(trim(text), 1, 300) ELSE '' END AS prompt FROM documents"""


# -- tables ------------------------------------------------------------------
def _objects(spark, d):  # noqa: ANN001, ANN202
    rows = B.with_checksum(docs(spark, d), "text").withColumn("file_name", F.expr("concat('f', doc_id, case when doc_id % 3 = 0 then '' else '.html' end)"))
    rows = rows.select("doc_id", "text", B.storage_path().alias("storage_path"))
    held = rows.where("doc_id % 6 <> 5").select("storage_path", F.col("text").cast("binary").alias("content")).dropDuplicates(["storage_path"])
    return files.object_contents(rows.select("doc_id", "storage_path"), held).select("doc_id", "storage_path", F.length("content").alias("bytes"))


_OBJECTS = """WITH p AS (SELECT doc_id, sha256(text) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.html' END AS storage_path, octet_length(encode(text)) AS n FROM documents)
    SELECT doc_id, storage_path, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.storage_path = p.storage_path AND q.doc_id % 6 <> 5) THEN n END AS bytes FROM p"""


def _appended(spark, d):  # noqa: ANN001, ANN202
    """Three appends and an upsert of columns on one table."""
    t = store.SnapshotTable(spark, scratch(spark, "appended"), "doc_id long, text string, n int", width=64)
    for k in range(3):
        t.append(docs(spark, d).where(F.col("doc_id") % 3 == k).select("doc_id", "text", F.lit(k).alias("n")))
    t.upsert_columns(docs(spark, d).where("doc_id % 100 < 10").select("doc_id", F.lit(9).alias("n")))
    return t.read()


def _violations(spark, d):  # noqa: ANN001, ANN202
    rows = docs(spark, d).select("doc_id", F.expr("case doc_id % 5 when 0 then 'pdf' when 1 then null else 'text' end").alias("source_type"), F.expr("case when doc_id % 7 > 0 then sha2(text, 256) end").alias("checksum"), F.expr("case when doc_id % 3 > 0 then 'p' end").alias("storage_path"))
    rows = rows.select("doc_id", schemas.bronze_violations().alias("bronze"), F.expr("case when doc_id % 4 = 0 then 'done' else 'success' end").alias("status_processing"), F.repeat(F.lit("s"), F.expr("cast(250 + doc_id % 9 as int)")).alias("speaker"))
    return rows.select("doc_id", "bronze", schemas.silver_violations().alias("silver"))


_VIOLATIONS = """SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'source_type' WHEN doc_id % 7 = 0 THEN 'checksum' WHEN doc_id % 3 = 0 THEN 'storage_path' END AS bronze,
    CASE WHEN doc_id % 4 = 0 THEN 'status_processing' WHEN doc_id % 9 > 5 THEN 'speaker' END AS silver FROM documents"""


def _missing(spark, d):  # noqa: ANN001, ANN202
    """Expected tables that are not among the sources' names, and documents without a Silver row."""
    named = docs(spark, d).select(F.expr("case doc_id % 2 when 0 then 'silver_text' else source end").alias("table_name"))
    lost = schemas.orphans(docs(spark, d), derived.silver(spark, d)).select(F.col("doc_id").cast("string").alias("table_name"))
    return schemas.missing_tables(named).unionByName(lost)


def _merged(spark, d):  # noqa: ANN001, ANN202
    old = F.when(F.col("doc_id") % 4 > 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("source"), F.lit("speaker"), F.lit("x")))
    new = F.create_map(F.lit("b"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.lit("c"), F.col("text"))
    rows = docs(spark, d).select("doc_id", repair.merged_metadata(old, new, "S").alias("m"))
    return rows.select("doc_id", *[F.col("m")[k].alias(k) for k in ("a", "b", "c", "speaker")], F.size("m").alias("entries"))


_MERGED = """SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN '1' END AS a, CASE WHEN doc_id % 3 > 0 THEN lang END AS b, text AS c, 'S' AS speaker, CASE WHEN doc_id % 4 > 0 THEN 4 ELSE 3 END AS entries FROM documents"""


# -- modules, vectors, order -------------------------------------------------
def _modules(spark, d):  # noqa: ANN001, ANN202
    return gold.scored(docs(spark, d).select("doc_id", "text")).select("doc_id", F.col("sentiment.label").alias("sentiment"), F.col("emotions.dominant_emotion").alias("emotion"), F.array_join("labels.labels", ",").alias("labels"), F.col("labels.threshold").alias("threshold"), F.size("labels.scores").alias("scores"))


def _ranked_sql(lists: dict, kind: str, chosen: str) -> str:
    return f"(SELECT doc_id, string_agg(label, ',' ORDER BY rank) AS x FROM ({text_queries._scored_sql(lists, kind)} SELECT doc_id, label, rank FROM rk WHERE {chosen}) GROUP BY doc_id)"


_MODULES = f"""SELECT doc_id, s.x AS sentiment, e.x AS emotion, coalesce(l.x, '') AS labels, 0.5::DOUBLE AS threshold, CASE WHEN l.x IS NULL THEN 0 ELSE {len(scores.TOPIC_LABELS)} END AS scores FROM documents
    LEFT JOIN {_ranked_sql(scores.SENTIMENT, 'weighted', 'rank = 1')} s USING (doc_id) LEFT JOIN {_ranked_sql(scores.EMOTION, 'weighted', 'rank = 1')} e USING (doc_id)
    LEFT JOIN {_ranked_sql(scores.TOPIC_WORDS, 'max', 'score >= 0.5 OR rank = 1')} l USING (doc_id)"""


def _embedded(spark, d):  # noqa: ANN001, ANN202
    """Vectors of a plain encoder (words and characters of a chunk), averaged over chunks of sixty words."""
    encode = lambda texts: np.array([[len(t.split()), len(t)] for t in texts], float)
    rows = embeddings.embedded(docs(spark, d), encode, dimensions=2, window=60 + embeddings.OWN_TOKENS)
    return rows.select("doc_id", F.round(F.col("embedding")[0], 6).alias("words"), F.round(F.col("embedding")[1], 6).alias("characters"))


_EMBEDDED = f"""SELECT doc_id, coalesce(round(sum(n_words * n_words) / sum(n_words), 6), 0.0) AS words, coalesce(round(sum(n_words * length(chunk)) / sum(n_words), 6), 0.0) AS characters
    FROM documents LEFT JOIN ({text_queries._CHUNKS}) USING (doc_id) GROUP BY doc_id"""


def _capped(spark, d):  # noqa: ANN001, ANN202
    site = web_queries._site(spark, d)
    seeds = [r["url"] for r in site.where("page_id < 5").select("url").collect()]
    return crawl.crawl(site.drop("page_id"), seeds, ["site.test", "nowhere"], max_depth=2, max_pages=9).select("url", "crawl_depth")


def _placed(rows):  # noqa: ANN001, ANN202
    """An ordered result with the place of each row: the rows of the partitions before, and the place within one."""
    kept = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    kept = kept.withColumns({"__part": F.shiftright("__row", 33), "__at": F.col("__row").bitwiseAND((1 << 33) - 1)})
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return kept.join(F.broadcast(before), "__part").select((F.col("__before") + F.col("__at")).cast("int").alias("place"), *rows.columns)


def _single_items(spark, d):  # noqa: ANN001, ANN202
    """Each page's URL as a single item's candidate."""
    rows = table(spark, d, "pages").where("url is not null").select(F.col("url").alias("source_url"), F.lit("text").alias("source_type"), F.lit(False).alias("is_local"), F.lit(None).cast("string").alias("raw_metadata"))
    return files.single_items(rows).select("source_url", "source_type", "file_name", "is_local")


_SINGLE = r"""SELECT url AS source_url, 'text' AS source_type, coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[^:]+://[^/]*/(?:.*/)?([^/]+)/*$', 1), ''), 'downloaded_file') AS file_name, false AS is_local FROM pages"""


ENTRIES = {
    "url_list": (_url_list, _URL_LIST),
    "transform_lines": (_lines_out, "SELECT CASE WHEN doc_id % 4 = 0 THEN doc_id || '. no link' ELSE 'http://' || source || '/http://' || doc_id END AS line FROM documents"),
    "local_files": (_local_files, "SELECT 'text' AS source_type, 'text/plain' AS mime_type, true AS is_local, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents"),
    "single_item": (_single_items, _SINGLE),
    "video_records": (_videos(False), _VIDEOS),
    "video_playlists": (_videos(True), _PLAYLIST),
    "archive_items": (_archive_items, _ARCHIVE),
    "speech_pages": (_speeches, _SPEECHES),
    "post_pages_flat": (_flat_posts, _posts_sql("turn % 4 IN (0, 3) AND length(trim(text)) > 0", "'#tag ' || text || ' https://a.b/c'")),
    "post_pages_paired": (_paired_posts, _posts_sql("turn % 3 <> 1", "text || ' @me more'")),
    "link_chain": (_link_chain, _CHAIN),
    "link_chain_whole": (lambda s, d: _link_chain(s, d, None), _CHAIN_WHOLE),
    "listing_links": (_listing, _LISTING),
    "robots_allowed": (_robots, _ROBOTS),
    "robots_files": (_robots_files, _ROBOTS_FILES),
    "transcription_prompts": (_prompts, _PROMPTS),
    "object_contents": (_objects, _OBJECTS),
    "table_appends": (_appended, "SELECT doc_id, text, CAST(CASE WHEN doc_id % 100 < 10 THEN 9 ELSE doc_id % 3 END AS INTEGER) AS n FROM documents"),
    "constraint_violations": (_violations, _VIOLATIONS),
    "missing_tables": (_missing, "SELECT * FROM (VALUES ('bronze_documents'), ('gold_analytics')) v(table_name) UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 7 = 5"),
    "metadata_merge": (_merged, _MERGED),
    "gold_modules": (_modules, _MODULES),
    "document_embeddings": (_embedded, _EMBEDDED),
    "crawl_capped": (_capped, f"SELECT * FROM ({web_queries._crawl_sql(2)}) ORDER BY crawl_depth, url LIMIT 9"),
    "overview_order": (
        lambda s, d: _placed(dashboard.by_origin(derived.bronze(s, d))),
        f"WITH {derived.BRONZE}, c AS (SELECT coalesce(source_name, 'unknown') AS origin, count(*) AS count FROM bronze GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY count DESC, origin) - 1 AS INTEGER) AS place, origin, count FROM c",
    ),
    "history_order": (
        lambda s, d: _placed(dashboard.history(derived.bronze(s, d), derived.silver(s, d)).select("doc_id").limit(50)),
        f"WITH {derived.BRONZE} SELECT CAST(row_number() OVER (ORDER BY ingestion_date DESC, doc_id) - 1 AS INTEGER) AS place, doc_id FROM bronze WHERE NOT excluded ORDER BY place LIMIT 50",
    ),
    "history_order_whole": (
        lambda s, d: _placed(dashboard.history(derived.bronze(s, d), derived.silver(s, d)).select("doc_id")),
        f"WITH {derived.BRONZE} SELECT CAST(row_number() OVER (ORDER BY ingestion_date DESC, doc_id) - 1 AS INTEGER) AS place, doc_id FROM bronze WHERE NOT excluded",
    ),
}
