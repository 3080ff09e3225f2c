"""Joins that stay balanced whatever share of the rows a key holds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is dealt out beyond 1/SHARE of all rows, or FEW rows if that is more. So fewer than SHARE keys are.
SHARE, FEW = 10_000, 2_000


class Sizes(NamedTuple):
    """Of a table of keys and their ``copies``: the number of keys, of all copies, and the most that one key has."""

    keys: int
    copies: int
    most: int


def sizes_of(counts: DataFrame) -> Sizes:
    """One small job over ``counts`` (keys and ``copies``, computed already)."""
    got = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    return Sizes(*got)


def joined_by_key(rows: DataFrame, facts: DataFrame, counts: DataFrame, keys: list[str], spread: str, how: str = "inner", sizes: Sizes | None = None) -> DataFrame:
    """``rows`` joined on ``keys`` with ``facts``, which has one row a key.

    ``counts`` (keys and ``copies``, computed already; ``sizes`` of it if known) says how many of ``rows`` a key has. A key with very
    many is cut into slices of bounded size by a hash of ``spread``, and its row of ``facts``
    goes to each of them. Keys that are cut are fewer than SHARE, since their copies add up to
    the rows; that bounds what is broadcast. ``how`` is inner or left. Null keys meet nothing.
    """
    got = sizes or sizes_of(counts)
    most = max(FEW, got.copies // SHARE)
    if got.most <= most:
        return rows.join(facts, keys, how)
    heavy = F.broadcast(counts.where(F.col("copies") > most).select(*keys, F.ceil(F.col("copies") / most).cast("int").alias("__slices")))
    dealt = rows.join(heavy, keys, "left").withColumn("__slice", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__slices")).cast("int"), F.lit(0))).drop("__slices")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__slices"), F.lit(1)) - 1))
    copied = facts.join(heavy, keys, "left").withColumn("__slice", every).drop("__slices")
    return dealt.join(copied, [*keys, "__slice"], how).drop("__slice")
