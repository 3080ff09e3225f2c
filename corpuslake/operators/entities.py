"""Entities: grouping, case folding, top mentions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.urls import lookup

# Groups of entity labels.
GROUPS = {"PERSON": "persons", "ORG": "organizations", "NORP": "groups", "GPE": "locations", "LOC": "locations", "FAC": "locations", "DATE": "dates", "TIME": "dates"}
OTHER = "other"


#: A run of capitalised words behind a lower-case letter or a comma; a word of letters, digits and underscores.
NAMED, WORD = r"[a-z,] [A-Z][A-Za-z0-9_'’]+(?: [A-Z][A-Za-z0-9_'’]+)*", r"[\p{L}\p{N}_]+"
YEAR, PEOPLE = r"^(19|20)[0-9]{2}$", r"(ans|ists|crats)$"


def mentions_by_rule(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text, label: runs of capitalised words inside sentences and years, a stand-in for a model.

    pos counts a text's names, or its years, in order. Row by row, inside the JVM.
    """
    names = F.transform(F.regexp_extract_all("text", F.lit(NAMED), F.lit(0)), lambda m: m.substr(F.lit(3), F.length(m)))
    label = lambda m: F.when(m.contains(" "), "PERSON").when(m.rlike(PEOPLE), "NORP").otherwise("GPE")
    years = F.filter(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda m: m.rlike(YEAR))

    def entries(found: Column, label_of: Callable[[Column], Column]) -> Column:
        return F.transform(found, lambda m, k: F.struct(k.cast("long").alias("pos"), m.alias("text"), label_of(m).alias("label")))

    return docs.select("doc_id", F.inline(F.concat(entries(names, label), entries(years, lambda m: F.lit("DATE")))))


def grouped(mentions: DataFrame, top: int = 25) -> DataFrame:
    """doc_id, grp, rank, text, cnt: mentions by group, folded by case, the commonest spelling shown, the top ones kept.

    Ties go to what came first in the document.
    """
    m = mentions.withColumn("text", F.trim("text")).where("text <> ''").withColumn("grp", F.coalesce(lookup(F.col("label"), GROUPS), F.lit(OTHER))).withColumn("low", F.lower("text"))
    spelled = m.groupBy("doc_id", "grp", "low", "text").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
    folded = spelled.groupBy("doc_id", "grp", "low").agg(F.sum("n").alias("cnt"), F.min("at").alias("at"), F.max_by("text", F.struct("n", -F.col("at"))).alias("text"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "grp").orderBy(F.desc("cnt"), "at"))
    return folded.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "grp", "rank", "text", "cnt")


def by_label(mentions: DataFrame) -> DataFrame:
    """doc_id, label, cnt."""
    return mentions.where(F.trim("text") != "").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("cnt"))


def corpus_top(entries: DataFrame, top: int = 15, groups: tuple[str, ...] = ("persons", "locations", "groups")) -> DataFrame:
    """grp, rank, text, cnt over the corpus: sums of the documents' entries by exact spelling (A14); ties by spelling."""
    sums = entries.where(F.col("grp").isin(*groups)).groupBy("grp", "text").agg(F.sum("cnt").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("cnt"), "text"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= top).select("grp", "rank", "text", "cnt")


def payload(docs: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """doc_id, entities: map of groups to their entries, by_label and total_entities, of every document."""
    m = mentions_by_rule(docs) if mentions is None else mentions
    item = F.struct("rank", F.struct("text", F.col("cnt").alias("count")).alias("x"))
    groups = grouped(m).groupBy("doc_id", "grp").agg(F.transform(F.array_sort(F.collect_list(item)), lambda v: v["x"]).alias("entries"))
    groups = groups.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("grp", "entries"))).alias("groups"))
    labels = by_label(m).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "cnt"))).alias("by_label"), F.sum("cnt").alias("total_entities"))
    out = docs.select("doc_id").join(groups, "doc_id", "left").join(labels, "doc_id", "left")
    return out.select("doc_id", F.struct("groups", "by_label", F.coalesce("total_entities", F.lit(0)).alias("total_entities")).alias("entities"))
