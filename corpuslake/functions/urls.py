"""URL functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts by adapter, media types by extension.
HOSTS = {
    "youtube": ("youtube.com", "www.youtube.com", "youtu.be", "m.youtube.com"),
    "miller_center": ("millercenter.org", "www.millercenter.org"),
    "internet_archive": ("archive.org", "www.archive.org"),
}
SOURCE_TYPES = {
    "mp4": "video", "mov": "video", "mkv": "video", "avi": "video",
    "mp3": "audio", "wav": "audio", "m4a": "audio", "flac": "audio", "webm": "audio",
    "txt": "text", "html": "text", "pdf": "text",
}
MIME_TYPES = {
    "mp4": "video/mp4", "mov": "video/quicktime", "mkv": "video/x-matroska", "avi": "video/x-msvideo",
    "mp3": "audio/mpeg", "wav": "audio/x-wav", "m4a": "audio/mp4a-latm", "flac": "audio/x-flac", "webm": "video/webm",
    "txt": "text/plain", "html": "text/html", "pdf": "application/pdf",
}
# Fixed value: a temporary download's path, named by its video id.
DOWNLOAD_PATH = r"(?i)youtube_dl_[^\\/]+[\\/]([^\\/]+)\.(?:webm|mp4|mkv|mp3|m4a)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host(url: Column | str) -> Column:
    """Lower-case host of a URL, without credentials and port; null where there is none."""
    got = F.regexp_extract(F.lower(_col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(got != "", got)


def domain(value: Column | str) -> Column:
    """Host of a URL or of a bare name, without port and leading "www." (F13)."""
    v = F.lower(F.trim(_col(value)))
    bare = F.when(F.instr(v, "://") > 0, F.coalesce(host(v), F.lit(""))).otherwise(F.split(v, ":")[0])
    return F.regexp_replace(bare, r"^www\.", "")


def path(url: Column | str) -> Column:
    """Path of a URL, empty where there is none."""
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column | str) -> Column:
    """Query of a URL without its question mark."""
    return F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)


def scheme(url: Column | str) -> Column:
    """Lower-case scheme, empty where there is none."""
    return F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def without_fragment(url: Column | str) -> Column:
    """A URL up to its "#" (P15)."""
    return F.split(_col(url), "#")[0]


def classify(location: Column | str, is_local: Column | None = None) -> Column:
    """Adapter of a location by its host; local ones and all others are "single" (S11)."""
    h = host(location)
    out = F.when(is_local if is_local is not None else F.lit(False), "single")
    for name, hosts in HOSTS.items():
        out = out.when(h.isin(*hosts), name)
    return out.otherwise("single")


def crawl_file_name(url: Column | str) -> Column:
    """Name for a crawled page: its path with "_" for "/", 60 characters, and 8 of the URL's MD5."""
    slug = F.replace(F.regexp_replace(path(url), r"^/+|/+$", ""), F.lit("/"), F.lit("_"))
    return F.concat(F.substring(F.when(slug == "", "index").otherwise(slug), 1, 60), F.lit("_"), F.substring(F.md5(_col(url)), 1, 8), F.lit(".html"))


def is_pagination(from_url: Column | str, to_url: Column | str) -> Column:
    """Whether a link leads to another page of the same listing."""
    strip = lambda p: F.regexp_replace(F.regexp_replace(p, r"/page/\d+/?$", ""), r"/+$", "")
    a, b = path(from_url), path(to_url)
    by_query = query(to_url).rlike(r"(^|&)page=[^&]")
    return (domain(from_url) == domain(to_url)) & F.when(by_query, a == b).when(b.rlike(r"/page/\d+/?$"), strip(a) == strip(b)).otherwise(F.lit(False))


def last_segment(location: Column | str, default: str) -> Column:
    """Last path segment of a URL or file path, or a default."""
    got = F.regexp_extract(F.split(_col(location), "[?#]")[0], r"([^/\\]+)[/\\]*$", 1)
    bare = _col(location).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?([?#].*)?$")
    return F.when((got == "") | bare, default).otherwise(got)


def extension(name: Column | str) -> Column:
    """Lower-case extension without its dot, empty where there is none."""
    return F.lower(F.regexp_extract(_col(name), r"\.([A-Za-z0-9]+)$", 1))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed map, null for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def video_url(location: Column | str) -> Column:
    """Watch page of a temporary download named by its video id, else null."""
    got = F.regexp_extract(_col(location), DOWNLOAD_PATH, 1)
    return F.when(got != "", F.concat(F.lit("https://www.youtube.com/watch?v="), got))


def from_http(line: Column | str) -> Column:
    """A line without what stands before its first "http"; other lines as they are."""
    return F.regexp_replace(_col(line), r"^.*?(http.*)$", "$1")


def object_key(checksum: Column, name: Column | str) -> Column:
    """Key of a stored object: its checksum and its file's suffix."""
    return F.concat(checksum, F.regexp_extract(_col(name), r"(\.[^./\\]+)$", 1))
