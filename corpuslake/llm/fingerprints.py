"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, with SQL functions only.

A text is cut into lines (paragraphs) and each of them into pieces: up to a dozen words,
ending early with a sentence. Pieces, white space included, make up the whole text
again. A paragraph's hash is taken over its pieces' hashes, a section's over its
paragraphs', the root's over the sections'. A section ends after a blank line or
where a paragraph's own hash says so (one in eight), so an edit moves no boundary
but its own. Equal roots mean equal texts; where roots differ, the sections, then
paragraphs, whose hashes are missing on the other side hold the edits.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm._rows import free_name, without
from corpuslake.operators.skew import FEW, SHARE

_PIECES = r"(?:\S*[^\s.!?]\s+){0,11}\S+\s*|\s+"
_LOWEST = -(2**63)


def with_tree(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """``df`` with five columns: {prefix}root, {prefix}sections, {prefix}ends, {prefix}paragraphs, {prefix}pieces.

    root is a hex string; the others are arrays of hex strings in text order, but for ends: for each section, the number of
    paragraphs up to its end. A
    null text counts as empty: it has one paragraph without pieces. Row by row,
    no shuffle: repeated rows get equal trees, an empty table none, and a text of any length is hashed
    whole. Columns of ``df`` with those five names give way; all others stay.
    """
    p = prefix
    gone = [f"{p}{level}" for level in ("root", "sections", "ends", "paragraphs", "pieces")]
    columns = without(df.columns, *[g for g in gone if g != text_col])
    lines, end = free_name(df.columns, f"{p}lines"), f"{p}ends"
    pieces = f"""transform(split(coalesce(`{text_col}`, ''), '(?<=\\n)', -1), line -> transform(regexp_extract_all(line, r'{_PIECES}', 0), x -> sha2(x, 256)))"""
    out = df.select(*[F.col(f"`{c}`") for c in columns], F.expr(pieces).alias(lines))
    out = out.withColumns(
        {
            f"{p}paragraphs": F.expr(f"transform(`{lines}`, x -> sha2(concat('p', array_join(x, '')), 256))"),
            f"{p}pieces": F.expr(f"flatten(`{lines}`)"),
        }
    )
    # a line that is a line feed alone is a blank line
    ends = f"""filter(sequence(1, size(`{p}paragraphs`)), i -> i = size(`{p}paragraphs`) or element_at(`{p}paragraphs`, i) < '2' or element_at(`{lines}`, i) = array(sha2('\\n', 256)))"""
    out = out.withColumn(end, F.expr(ends)).drop(lines)
    starts = f"if(k = 0, 0, element_at(`{end}`, k))"
    sections = f"transform(`{end}`, (e, k) -> sha2(concat('s', array_join(slice(`{p}paragraphs`, {starts} + 1, e - {starts}), '')), 256))"
    out = out.withColumn(f"{p}sections", F.expr(sections))
    return out.withColumn(f"{p}root", F.expr(f"sha2(concat('r', array_join(`{p}sections`, '')), 256)"))


def likeness(one: str, other: str):  # noqa: ANN201
    """Share of distinct pieces that two trees have in common (Jaccard, 0 to 1); 1 where both have none.

    The arguments name the piece columns.
    """
    return F.expr(f"if(size(`{one}`) = 0 and size(`{other}`) = 0, 1.0D, size(array_intersect(`{one}`, `{other}`)) / cast(size(array_union(`{one}`, `{other}`)) as double))")


def differing_branches(df: DataFrame, one: str, other: str) -> DataFrame:
    """``df`` with sections_edited and paragraphs_edited: numbers (from 0) of ``one``'s branches that ``other`` lacks.

    From the root down: equal roots have no differing branches, and of the paragraphs only those within differing sections
    are looked at. ``one`` and ``other`` are prefixes of with_tree(). Columns of ``df`` with the two names give way.
    """
    missing = lambda level: f"filter(sequence(0, size(`{one}{level}`) - 1), i -> not array_contains(`{other}{level}`, `{one}{level}`[i]))"
    ends = free_name(df.columns, "__ends")
    df = df.select(*[F.col(f"`{c}`") for c in without(df.columns, "sections_edited", "paragraphs_edited")])
    df = df.withColumn("sections_edited", F.expr(f"if(`{one}root` = `{other}root`, array(), {missing('sections')})"))
    # the paragraphs of section k stand from the end of section k - 1 to its own
    df = df.withColumn(ends, F.expr(f"transform(sections_edited, k -> sequence(if(k = 0, 0, `{one}ends`[k - 1]), `{one}ends`[k] - 1))"))
    lacking = f"filter(flatten(`{ends}`), i -> not array_contains(`{other}paragraphs`, `{one}paragraphs`[i]))"
    return df.withColumn("paragraphs_edited", F.expr(lacking)).drop(ends)


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: the text of the next row by ascending id (after the last: the first).

    Null ids come first, rows of one id by a hash of their texts; null texts count as empty.
    Ids are cut into ranges at quantiles that occur among them. Each range is
    ordered by itself; the first row of a range is also sent to the range before, so
    one shuffle gives every row its neighbour. Only the cuts reach the driver.

    An id at several quantiles (or none at all, for many rows) is cut further by the hash. Of a row that is repeated very often, the
    next text is the same for all but one, so only that one is shuffled; rows are numbered as they are read to pick it, so
    an input whose order is not stable should be cut first.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("__key"))
    n = base.count()
    ranges = max(1, min(65_536, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), n // 20_000), n // 50 + 1))
    marks = [k / ranges for k in range(1, ranges)] or [0.5]
    got = base.agg(F.min("__key").alias("low"), F.percentile_approx("__key", marks, 100_000).alias("marks")).first()
    low = got["low"] if got["low"] is not None else 0
    often = {k: c for k, c in Counter(got["marks"] or []).items() if c > 1}  # at several quantiles
    cuts = sorted({low, *(got["marks"] or [])})
    step = max(1, int(len(cuts) ** 0.5))
    array = lambda xs: "array(" + ", ".join(_long(x) for x in xs) + ")"
    coarse = f"(size(filter({array(cuts[::step])}, c -> c <= __key)) - 1)"
    rows = base.withColumn("__coarse", F.expr(coarse))
    rows = rows.withColumn("__range", F.expr(f"__coarse * {step} + size(filter(slice({array(cuts)}, __coarse * {step} + 1, {step}), c -> c <= __key)) - 1")).drop("__coarse")
    rows = rows.withColumns({"__sub": F.lit(0), "__hash": F.xxhash64("text"), "__no": F.monotonically_increasing_id()})
    same = None
    if often:
        rows, same = _split(rows, often, n)
    firsts = _firsts(rows, cuts, often)
    dealt = rows.join(F.broadcast(firsts), ["__range", "__sub"])  # a row a range
    first = F.expr("__key = first_key and coalesce(__hash = first_hash and __no = first_no, true)")
    own, before = F.struct(F.col("__range").alias("r"), F.col("__sub").alias("s"), F.lit(False).alias("g")), F.struct(F.col("before").alias("r"), F.col("before_sub").alias("s"), F.lit(True).alias("g"))
    dealt = dealt.withColumn("__at", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "__key", "__hash", "__no", F.col("__at.r").alias("__range"), F.col("__at.s").alias("__sub"), F.col("__at.g").alias("__ghost"))
    w = Window.partitionBy("__range", "__sub").orderBy("__ghost", "__key", "__hash", "__no")
    out = dealt.withColumn("next_text", F.lead("text").over(w)).where("not __ghost").select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))
    return out if same is None else out.unionByName(same)


def _long(x: int) -> str:
    return f"{x}L" if x != _LOWEST else "(-9223372036854775807L - 1L)"


def _split(rows: DataFrame, often: dict[int, int], n: int) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with __sub by the hash for the ids of ``often``, the rows that are left out, with their next text).

    What is left out are all but the first of rows that are the same and more than a slice of bounded size.
    """
    parts = F.create_map(*[F.expr(x) for k, c in often.items() for x in (_long(k), str(min(c, 1 << 16)))])
    share = F.col("__parts")
    rows = rows.withColumn("__parts", F.try_element_at(parts, F.col("__key")))
    # the upper 32 bits of the hash, as a number from 0, deal the rows of an id to its parts in order; larger ids of the range come behind
    by_hash = F.floor((F.shiftright("__hash", 32) + F.lit(1 << 31)) * share / F.lit(1 << 32)).cast("int")
    starts = F.array_contains(F.array(*[F.expr(_long(k)) for k in often]), F.col("__key"))
    rows = rows.withColumn("__sub", F.when(starts, by_hash).otherwise(F.lit(1 << 20)))
    rows = rows.drop("__parts")
    most = max(FEW, n // SHARE)
    copies = rows.where(starts).groupBy("__key", "__hash").agg(F.count(F.lit(1)).alias("n"), F.min("__no").alias("__first"), F.count_distinct(F.sha2("text", 256)).alias("texts"))
    copies = F.broadcast(copies.where((F.col("n") > most) & (F.col("texts") == 1)).select("__key", "__hash", "__first"))  # fewer than SHARE rows
    marked = rows.join(copies, ["__key", "__hash"], "left")
    again = F.col("__first").isNotNull() & (F.col("__no") != F.col("__first"))
    return marked.where(~again).drop("__first"), marked.where(again).select("doc_id", "text", F.col("text").alias("next_text"))


def _firsts(rows: DataFrame, cuts: list[int], often: dict[int, int]) -> DataFrame:
    """For each range that has rows: its first row (hash and number are null where the cut tells it) and the range before it; a row a range."""
    found = {(r, 0): (key, None, None) for r, key in enumerate(cuts)}
    if often:
        whole = rows.groupBy("__range", "__sub").agg(F.min(F.struct("__key", "__hash", "__no")).alias("f"))
        found = {(r["__range"], r["__sub"]): tuple(r["f"]) for r in whole.collect()}  # as many as there are ranges
    order = sorted(found)
    table = [(*at, *found[at], *order[k - 1]) for k, at in enumerate(order)]
    return rows.sparkSession.createDataFrame(table, "__range int, __sub int, first_key long, first_hash long, first_no long, before int, before_sub int")
