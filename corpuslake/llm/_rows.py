"""Keys of rows, and names that no column has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it until none of ``columns`` is called so, in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(columns: Iterable[str], *names: str) -> list[str]:
    """``columns`` but those that are called as one of ``names``, in either case."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str, bool]:
    """``docs`` with one more column, its name, and whether it is the id: a number that tells rows apart and stays the same.

    Where every row has an id of its own, that is the id. Else rows are numbered and the
    table is written to the shared folder, so that the numbers hold for all who read it.
    """
    name = free_name(docs.columns, "__row")
    ids = docs.select(F.col(id_col).cast("long").alias("id")) if id_col in docs.columns else None
    if ids is not None and not ids.groupBy("id").count().where("id is null or count > 1").limit(1).count():
        return docs.withColumn(name, F.col(id_col).cast("long")), name, True
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name, False
