"""Tables with appends and upserts on Parquet (K3, K5, K6).

A table is a folder of writes and numbered manifests. A manifest names the parts that make up the
table: which write holds which range of keys. The highest manifest is the table, so readers see a write
as a whole or not at all. An append adds parts and touches none; an upsert writes anew only
the ranges that its keys fall into, so its cost goes with what is new as long as keys ascend with time, as
document ids do. A write over more than PARTS ranges stores neighbours together, so that its files do not grow in
number with its rows; an upsert writes anew the whole parts that its keys fall into. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.session import cut

#: Keys of a range. At so many documents a part is some hundred MB of rows, and a billion documents are ten thousand parts.
RANGE = 100_000
#: Parts of a write at most, but for one at the end: over more ranges a part holds 2, 4, 8, ... neighbours.
PARTS = 1024


def upsert_rows(existing: DataFrame, updates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``updates`` in place of those with their key, the others as they were (K5)."""
    return existing.join(updates.select(key), key, "left_anti").select(*existing.columns).unionByName(updates.select(*existing.columns))


def upsert_columns(existing: DataFrame, updates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only the columns that ``updates`` has change, for its keys; new keys get nulls elsewhere (K6).

    Without columns besides the key nothing changes.
    """
    given = [c for c in updates.columns if c != key and c in existing.columns]
    if not given:
        return existing
    u = updates.select(key, F.lit(True).alias("__given"), *[F.col(c).alias(f"__{c}") for c in given])
    rows = existing.join(u, key, "full_outer")
    return rows.select(*[F.when(F.col("__given"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in existing.columns])


class Part(NamedTuple):
    """``span`` neighbouring ranges of keys (-1: rows without one, too) within a write: those whose number divided by ``span`` is ``range``."""

    write: str
    range: int
    span: int = 1

    @property
    def path(self) -> str:
        return f"{self.write}/__range={self.range}"


class SnapshotTable:
    """A Parquet table at ``path``. ``key`` orders it in ranges; without one it takes appends only.

    ``violation`` is a column that names a row's broken rule, or null: no row that breaks one is written (K12).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = "doc_id", violation: Callable[[], Column] | None = None, width: int = RANGE):
        self.spark, self.path, self.schema, self.key, self.violation, self.width = spark, path.rstrip("/"), schema, key, violation, width
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests --------------------------------------------------------
    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n[9:]) for n in names if n.startswith("MANIFEST-"))

    def version(self) -> int:
        """Number of the current manifest, 0 before the first."""
        return max(self._versions(), default=0)

    def parts(self, version: int | None = None) -> list[Part]:
        """The parts of the table, or of an earlier version that is still there."""
        v = self.version() if version is None else version
        if not v:
            return []
        stream = self._fs.open(self._at(f"MANIFEST-{v}"))
        try:
            return [Part(*p) for p in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))]
        finally:
            stream.close()

    def _publish(self, parts: list[Part]) -> None:
        """Makes ``parts`` the table, by a rename; drops manifests before the last two and parts that neither names."""
        versions = self._versions()
        v = max(versions, default=0) + 1
        held = self._at(f".manifest-{uuid.uuid4().hex}")
        out = self._fs.create(held, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not self._fs.rename(held, self._at(f"MANIFEST-{v}")):
            raise RuntimeError(f"version {v} of {self.path} was written by another writer")
        old = [u for u in versions if u < v - 1]
        if old:
            gone = {p for u in old for p in self.parts(u)} - set(parts) - set(self.parts(v - 1))
            for p in gone:
                self._fs.delete(self._at(p.path), True)
            for u in old:
                self._fs.delete(self._at(f"MANIFEST-{u}"), False)

    # -- reading and writing ----------------------------------------------
    def _rows(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p.path}" for p in parts])

    def read(self) -> DataFrame:
        """The table as it is now, empty before the first write."""
        return self._rows(self.parts())

    def _range(self) -> Column:
        return F.coalesce(F.floor(F.col(self.key) / self.width).cast("long"), F.lit(-1)) if self.key else F.lit(-1).cast("long")

    def _bounds(self, rows: DataFrame) -> list[int]:
        """The first and the last range of the keys of ``rows``; none without keys. Reads no other column."""
        if not self.key:
            return []
        r = F.when(F.col(self.key).isNotNull(), self._range())
        return [x for x in rows.agg(F.min(r), F.max(r)).first() if x is not None]

    def _write(self, rows: DataFrame, ranges: Iterable[int]) -> list[Part]:
        """``rows``, whose keys are within the least and the greatest of ``ranges``, as parts."""
        if self.violation is not None:
            bad = rows.select(self.violation().alias("rule")).where("rule is not null").limit(1).collect()
            if bad:
                raise ValueError(f"{self.path}: a row breaks the rule of {bad[0]['rule']}")
        write = f"w-{uuid.uuid4().hex}"
        ranges, span = list(ranges) or [0], 1
        while max(ranges) - min(ranges) >= span * PARTS:
            span *= 2
        rows = rows.withColumn("__range", F.floor(self._range() / span).cast("long"))
        if self.key:  # one task a part, several for a large one
            rows = rows.hint("rebalance", F.col("__range"))
        rows.write.partitionBy("__range").parquet(f"{self.path}/{write}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(write)) if s.isDirectory()]
        return sorted(Part(write, int(n.split("=")[1]), span) for n in names if n.startswith("__range="))

    def replace(self, rows: DataFrame) -> None:
        """Makes ``rows`` the table."""
        self._publish(self._write(rows, self._bounds(rows)))

    def append(self, rows: DataFrame) -> None:
        """Adds rows; nothing that is there is read or written."""
        self._publish(self.parts() + self._write(rows, self._bounds(rows)))

    def _upsert(self, merge: Callable[[DataFrame, DataFrame, str], DataFrame], updates: DataFrame) -> None:
        if not self.key:
            raise ValueError(f"{self.path} has no key")
        updates = cut(updates)
        touched = {r["r"] for r in updates.select(self._range().alias("r")).distinct().collect()}  # ranges, not keys
        parts = self.parts()
        within = {span: {r // span for r in touched} for span in {p.span for p in parts}}
        old = [p for p in parts if p.range in within[p.span]]
        left = [p for p in parts if p.range not in within[p.span]]
        ranges = touched | {r for p in old for r in (p.range * p.span, (p.range + 1) * p.span - 1)}
        self._publish(left + self._write(merge(self._rows(old), updates, self.key), ranges))

    def upsert_rows(self, updates: DataFrame) -> None:
        """Rows of ``updates`` in place of those with their key; only the parts of their keys are written."""
        self._upsert(upsert_rows, updates)

    def upsert_columns(self, updates: DataFrame) -> None:
        """The columns of ``updates`` for its keys; only the parts of those keys are written."""
        self._upsert(upsert_columns, updates)
