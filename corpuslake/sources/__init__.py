"""Sources of candidates: ``read(spark, name, **options)`` gives a DataFrame with the candidate columns.

Nothing here opens a connection: pages, listings and media records come as files or
DataFrames, so that a fetcher can be put in front and tests need no network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslake.sources import files, listings, web

READERS: dict[str, Callable[..., DataFrame]] = {
    "local": files.local_folder,
    "single": files.single_item,
    "urls": files.url_list,
    "youtube": listings.videos,
    "internet_archive": listings.archive_items,
    "miller_center": web.chain,
    "ucsb": web.listing,
    "crawl": web.crawl,
}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    """Adds a source, or replaces one."""
    READERS[name] = reader


def read(spark: SparkSession, name: str, **options) -> DataFrame:  # noqa: ANN003
    """Candidates of a source; an unknown name is an error."""
    if name not in READERS:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(sorted(READERS))}")
    return READERS[name](spark, **options)
