"""Fetching content for candidates: retries, delays, streamed reads.

What opens a connection is a plug-in, ``get(url) -> iterator of byte pieces``; http_get() is one on the
standard library. A domain's requests are dealt to one task, which waits between them: being polite to
a site is the one thing here that is not to be parallel. Failures are rows with a message, so that one dead link stops nothing.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import urls

#: Bytes that are read, hashed and handed on together.
CHUNK = 8 << 20
Got = TypeVar("Got")


class Policy(NamedTuple):
    """How often a request is tried again, after how many seconds, how long a domain is left alone between requests, and when to give up waiting."""

    retries: int = 2
    wait: float = 10.0
    delay: float = 1.0
    timeout: float = 30.0

    def tried(self, ask: Callable[[], Got]) -> Got:
        """What ``ask`` gives, after at most ``retries`` failures."""
        for left in range(self.retries, -1, -1):
            try:
                return ask()
            except Exception:
                if not left:
                    raise
                time.sleep(self.wait)
        raise AssertionError


Get = Callable[[str, Policy], Iterator[bytes]]


def http_get(url: str, policy: Policy = Policy()) -> Iterator[bytes]:
    """A URL's content in pieces of CHUNK bytes, by the standard library."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "corpuslake"}), timeout=policy.timeout) as response:  # noqa: S310 - schemes are checked
        while piece := response.read(CHUNK):
            yield piece


def http_head(url: str, policy: Policy = Policy()) -> dict[str, str]:
    """Headers of a URL, lower-case names."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, method="HEAD", headers={"User-Agent": "corpuslake"}), timeout=policy.timeout) as response:  # noqa: S310
        return {k.lower(): v for k, v in response.headers.items()}


def file_get(path: str, policy: Policy = Policy()) -> Iterator[bytes]:
    """A file's content in pieces, by any path that pyarrow's file systems read (a shared folder, hdfs://, s3://)."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with where.open_input_stream(name) as stream:
        while piece := stream.read(CHUNK):
            yield piece


def _by_domain(rows: DataFrame, url: str) -> DataFrame:
    domain = F.coalesce(urls.domain(url), F.lit(""))
    return rows.withColumn("__domain", domain).repartition("__domain").sortWithinPartitions("__domain", url)


def fetched(rows: DataFrame, get: Get = http_get, policy: Policy = Policy(), url: str = "source_url") -> DataFrame:
    """``rows`` with content (null where it failed) and fetch_error; null URLs fail.

    A column crawl_delay (seconds, as robots.allowed() gives it) lengthens the wait between requests to its domain.
    Give it to Lake.ingest_bronze as ``fetch``. A content has to fit a cell (2 GiB); staged() has no bound.
    """
    kept = [c for c in rows.columns if c not in ("content", "fetch_error")]
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            for k, (at, domain, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                time.sleep(max(0.0, last.get(domain, -1e9) + max(policy.delay, own or 0.0) - time.monotonic()))
                content, error = None, None
                try:
                    if at is None:
                        raise ValueError("no URL")
                    content = policy.tried(lambda: b"".join(get(at, policy)))  # noqa: B023 - called at once
                except Exception as e:  # noqa: BLE001 - each row's failure is recorded with it
                    error = f"{type(e).__name__}: {e}"
                last[domain] = time.monotonic()
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns[3:], pa.array([content], pa.binary()), pa.array([error], pa.string())], [*kept, "content", "fetch_error"])

    own = F.col("crawl_delay").cast("double") if "crawl_delay" in rows.columns else F.lit(None).cast("double")
    dealt = _by_domain(rows, url).select(F.col(url).alias("__url"), "__domain", own.alias("__delay"), *kept)
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "content binary, fetch_error string"]))


def staged(rows: DataFrame, get: Get = file_get, policy: Policy = Policy(delay=0.0), location: str = "local_path", chunk: int = CHUNK) -> DataFrame:
    """location, chunk_no, content, checksum, file_size: each content in pieces of at most ``chunk`` bytes, hashed as it goes by (K1, T4).

    The last row of a location has no content but the SHA-256 and size of all pieces before it; a location that
    failed has neither. A task holds one piece at a time, whatever a file's size; a failure is tried again
    from the start before its first piece is handed on, and after that fails the location.
    """
    schema = pa.schema([("location", pa.string()), ("chunk_no", pa.int32()), ("content", pa.binary()), ("checksum", pa.string()), ("file_size", pa.int64())])

    def pieces(at: str) -> Iterator[bytes]:
        def start() -> tuple[bytes, Iterator[bytes]]:
            stream = iter(get(at, policy))
            return next(stream, b""), stream

        first, stream = policy.tried(start)
        held = bytearray(first)
        for piece in stream:
            held += piece
            while len(held) >= chunk:
                yield bytes(held[:chunk])
                del held[:chunk]
        while held:
            yield bytes(held[:chunk])
            del held[:chunk]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                digest, size, n = hashlib.sha256(), 0, 0
                checksum = None
                try:
                    for piece in pieces(at):
                        digest.update(piece)
                        size += len(piece)
                        yield pa.RecordBatch.from_pylist([{"location": at, "chunk_no": n, "content": piece}], schema=schema)
                        n += 1
                    checksum = digest.hexdigest()
                except Exception:  # noqa: BLE001 - a location without a checksum has failed
                    size = None
                yield pa.RecordBatch.from_pylist([{"location": at, "chunk_no": n, "checksum": checksum, "file_size": size}], schema=schema)

    return rows.select(F.col(location).alias("location")).where("location is not null").mapInArrow(run, "location string, chunk_no int, content binary, checksum string, file_size long")
