"""Secret scans with corpus-wide ownership frequency, with DataFrame and SQL functions only.

Each text is matched row by row; what leaves the scan are spans and values, never
texts. Values are hashed and counted over the corpus by distinct repository and
distinct owner: a value that many owners have is a copied example, one that a
single owner has and that looks random is taken for live. The counts are partial
aggregates in three levels (repository, owner, value), so a value that a third of
all rows hold is no hot key, and the way back to the rows deals such values out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm._rows import keyed
from corpuslake.operators.skew import joined_by_key
from corpuslake.session import cut

#: (kind, pattern, group of the value, fewest characters of the value), in the order of kinds.
PATTERNS = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Patterns that find just the matches of PATTERNS that are long enough: those matches are whole runs of a class, so shorter ones need not be found first.
_LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Kinds that the ownership counts add, after those of PATTERNS.
ADDED = ("live", "copied")
#: A value of so many distinct owners or more is a copied example.
COPIED_OWNERS = 3
#: Rows and spans (16 bytes each) that are broadcast to mask texts at most; beyond, a shuffled join brings them there.
BROADCAST_ROWS, BROADCAST_SPANS = 200_000, 1_000_000
_PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[-_]?|xxxx|0000000|1234567|abcdef0|(.)\1{7}"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with(value: str, name: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(lengths: str, width: str) -> str:
    """SQL: for each of an array of bigints the sum of those before it.

    In blocks of ``width`` (the root of their number), so that the work is the number to the power 1.5.
    """
    block = f"slice({lengths}, k * {width} + 1, {width})"
    sums = f"""aggregate(sequence(0, size({lengths}) div {width}), cast(struct(0L as at, array() as out) as struct<at: bigint, out: array<bigint>>),
      (acc, k) -> cast(struct(aggregate({block}, acc.at, (n, x) -> n + x) as at, concat(acc.out, array(acc.at)) as out) as struct<at: bigint, out: array<bigint>>), acc -> acc.out)"""
    inner = f"""aggregate({block}, cast(struct(b as at, array() as out) as struct<at: bigint, out: array<bigint>>),
      (acc, x) -> cast(struct(acc.at + x as at, concat(acc.out, array(acc.at)) as out) as struct<at: bigint, out: array<bigint>>), acc -> acc.out)"""
    return f"flatten(transform({sums}, (b, k) -> {inner}))"


def _spans(kind: str, number: int, pattern: str, group: int, least: int, text: str = "text") -> str:
    """SQL: array of (s, k, e, kind, v) of a pattern's leftmost non-overlapping matches whose value is long enough.

    Places come from the lengths of what lies between matches and of the matches.
    """
    rx = _literal(_LONG.get(kind, pattern))
    parts = f"struct(split({text}, {rx}, -1) as g, regexp_extract_all({text}, {rx}, 0) as m, regexp_extract_all({text}, {rx}, {group}) as v)"
    sizes = "struct(transform(r.m, (x, i) -> cast(length(r.g[i]) + length(x) as bigint)) as l, cast(ceil(sqrt(size(r.m))) as int) as w)"
    start = "at[i] + length(r.g[i])"
    span = f"struct({start} as s, {number} as k, {start} + length(x) as e, '{kind}' as kind, r.v[i] as v)"
    found = _with(_before("t.l", "t.w"), "at", f"filter(transform(r.m, (x, i) -> {span}), f -> length(f.v) >= {least})")
    return f"if({text} rlike {rx}, {_with(parts, 'r', _with(sizes, 't', found))}, cast(array() as array<struct<s: bigint, k: int, e: bigint, kind: string, v: string>>))"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """row, doc_id, owner, repo, found (base spans by start, then kind) of every row; computed once.

    A null text counts as empty. The owner is what stands before the repository's
    first slash; a null repository is a repository of its own kind, named ''.
    """
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), repo.alias("repo"))
    found = ", ".join(_spans(kind, k, rx, group, least) for k, (kind, rx, group, least) in enumerate(PATTERNS))
    rows = rows.select("doc_id", F.substring_index("repo", "/", 1).alias("owner"), "repo", F.expr(f"array_sort(concat({found}))").alias("found"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def ownership(held: DataFrame) -> DataFrame:
    """value_hash, n_rows, n_repos, n_owners, kind of each distinct candidate value in the corpus.

    kind is ``copied`` from COPIED_OWNERS owners on; ``live`` for a value of one owner that
    looks random (letters and digits, no placeholder, 12 characters or more); null between.
    """
    values = held.select("owner", "repo", F.explode("found").alias("f")).select("owner", "repo", F.col("f.v").alias("v"), F.sha2("f.v", 256).alias("value_hash"))
    by_repo = values.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"), F.max("v").alias("v"))
    by_value = by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.max("v").alias("v"))
    random = F.col("v").rlike("[0-9]") & F.col("v").rlike("[A-Za-z]") & ~F.col("v").rlike(_PLACEHOLDER) & (F.length("v") >= 12)
    kind = F.when(F.col("n_owners") >= COPIED_OWNERS, "copied").when((F.col("n_owners") == 1) & random, "live")
    return by_value.select("value_hash", "n_rows", "n_repos", "n_owners", kind.alias("kind"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """doc_id, base, added of every row: arrays of (s, k, e, kind, v) with places in characters, ends exclusive.

    ``base`` are the pattern matches, ``added`` the values that ownership() calls live or copied.
    Rows that repeat an id, or have none, are scanned each for itself; spans that start at one place
    stand in the order of kinds. An empty table gives no rows. Whole texts are read whatever their length:
    the work for one is the number of its matches to the power 1.5. Other columns are ignored.
    """
    held = candidates(docs, id_col, text_col, repo_col)
    named = cut(ownership(held).where("kind is not null"))
    each = held.where("size(found) > 0").select("row", F.explode("found").alias("f")).withColumn("value_hash", F.sha2("f.v", 256))
    each = joined_by_key(each, named.select("value_hash", F.col("kind").alias("added_kind")), named.select("value_hash", F.col("n_rows").alias("copies")), ["value_hash"], "row")
    number = F.when(F.col("added_kind") == "live", len(PATTERNS)).otherwise(len(PATTERNS) + 1)
    span = F.struct((F.col("f.e") - F.length("f.v")).alias("s"), number.alias("k"), F.col("f.e").alias("e"), F.col("added_kind").alias("kind"), F.col("f.v").alias("v"))
    added = each.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("added"))
    out = held.join(added, "row", "left").select("doc_id", F.col("found").alias("base"), "added")
    return out.withColumn("added", F.expr("coalesce(added, filter(base, x -> false))"))


def joined(spans: str) -> str:
    """SQL: spans as kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def _masked(text: str, spans: str, mask: str) -> str:
    """SQL: ``text`` with ``mask`` in place of its ``spans`` (s and e, ascending by s); those that overlap become one.

    Blocks of spans (the root of their number) cut their own part of the text first, so that a text with very
    many spans is not gone through from its start for each of them.
    """
    one = "array<struct<s: bigint, e: bigint>>"
    join = f"""aggregate({spans}, cast(array() as {one}), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).e > x.s,
      concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).s as s, greatest(element_at(acc, -1).e, x.e) as e))), concat(acc, array(x))))"""
    merged = f"if(exists(sequence(1, size({spans})), i -> i > 1 and {spans}[i - 1].s < {spans}[i - 2].e), {join}, {spans})"
    part = f"substring(`{text}`, cast(b.at + 1 as int), cast(element_at(b.x, -1).e - b.at as int))"
    gap = "if(i = 0, b.at, b.x[i - 1].e)"
    pieces = f"transform(b.x, (x, i) -> concat(substring(p, cast({gap} - b.at + 1 as int), cast(x.s - {gap} as int)), '{mask}'))"
    blocks = "transform(sequence(0, (size(m) - 1) div w), k -> struct(if(k = 0, 0L, m[k * w - 1].e) as at, slice(m, k * w + 1, w) as x))"
    done = f"concat(array_join(flatten(transform({blocks}, b -> {_with(part, 'p', pieces)})), ''), substring(`{text}`, cast(element_at(m, -1).e + 1 as int)))"
    return _with(merged, "m", _with("cast(ceil(sqrt(size(m))) as int)", "w", done))


def redact(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """``docs`` with each live value in ``text_col`` replaced by ``mask``; copied examples and all other text stay.

    Each row is masked by its own spans; ``id_col`` may be null, repeated or absent, and further columns are kept
    whatever their names. A null text stays null, an empty table is empty. Few rows
    have live values: their spans are broadcast while they are few, else joined by a shuffle.
    """
    rows, key, _ = keyed(docs, id_col)
    live = "transform(filter(added, x -> x.kind = 'live'), x -> struct(x.s as s, x.e as e))"
    spans = scan(rows, key, text_col, repo_col).select(F.col("doc_id").alias(key), F.expr(live).alias("__live"))
    spans = cut(spans.where("size(__live) > 0"))
    size = spans.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("__live")).alias("spans")).first()
    if size["rows"] <= BROADCAST_ROWS and (size["spans"] or 0) <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    names = [f"c{k}" for k in range(len(docs.columns))]
    texts = names[docs.columns.index(text_col)]
    plain = rows.select(F.col(key).alias("__key"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    out = plain.join(spans.withColumnRenamed(key, "__key"), "__key", "left")
    masked = F.when(F.col("__live").isNull(), F.col(texts)).otherwise(F.expr(_masked(texts, "__live", mask)))
    return out.withColumn(texts, masked).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
