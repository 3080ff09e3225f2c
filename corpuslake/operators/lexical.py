"""Lexical metrics by document, without a shuffle.

Tokens are cut in the JVM. Counts without ranks (pronouns, ratios, pairs) are array expressions.
Counts with ranks and the order-dependent fold run over Arrow batches: a batch's tokens
become whole numbers once, and counting, ranking and cutting to the top are numpy sorts over
all texts of the batch, never a loop over tokens and never rows that have to meet. Rows are judged each for
itself, so a repeated doc_id has its metrics as often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as T

MTLD_LEAST, MTLD_TTR = 50, 0.720
TOP = 15
#: Texts that are counted together; a batch from Spark may hold many more.
_ROWS = 1000


class Words(NamedTuple):
    """The entries of lists of strings: which row each is in, and its number among the distinct strings."""

    rows: int
    row: np.ndarray
    code: np.ndarray
    distinct: pa.Array

    def flags(self, of: Callable[[pa.Array], pa.Array]) -> np.ndarray:
        """A property of the distinct strings, for each entry."""
        return of(self.distinct).to_numpy(zero_copy_only=False).astype(bool)[self.code]


class Ranked(NamedTuple):
    """Distinct entries of each row, best first: row, rank from 1, the entry's first place, how often it is there."""

    row: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def where(self, keep: np.ndarray) -> Ranked:
        return Ranked(*(v[keep] for v in self))


def _words(column: pa.Array) -> Words:
    flat = column.flatten().dictionary_encode()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return Words(len(column), np.repeat(np.arange(len(column)), sizes), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary)


def _ranked(row: np.ndarray, code: np.ndarray, at: np.ndarray, tie: np.ndarray | None = None) -> Ranked:
    """Entries counted by row and code, ranked by count; ties to what came first, or to the lower ``tie`` of a code.

    ``at`` are the entries' places among all of the batch, ascending.
    """
    if not len(row):
        none = np.zeros(0, np.int64)
        return Ranked(none, none, none, none)
    distinct = int(code.max()) + 1
    key, first, count = np.unique(row * distinct + code, return_index=True, return_counts=True)
    r = key // distinct
    order = np.lexsort((at[first] if tie is None else tie[key % distinct], -count, r))
    r = r[order]
    return Ranked(r, np.arange(len(r)) - np.searchsorted(r, r, side="left") + 1, at[first][order], count[order])


_SHORT = pa.array(T.STOPWORDS)


def _stop(words: pa.Array) -> pa.Array:
    return pc.is_in(words, value_set=_SHORT)


def _content(w: Words, top: int) -> tuple[Ranked, pa.Array]:
    at = np.flatnonzero(w.flags(lambda d: pc.greater(pc.utf8_length(d), 2)) & ~w.flags(_stop))
    got = _ranked(w.row[at], w.code[at], at)
    got = got.where(got.rank <= top)
    return got, w.distinct.take(pa.array(w.code[got.first]))


def _grams(w: Words, n: int, top: int, least: int) -> tuple[Ranked, pa.Array]:
    starts = max(len(w.code) - n + 1, 0)
    stop = w.flags(_stop)
    code, bare = w.code[:starts], stop[:starts].copy()
    for k in range(1, n):
        # pairs of what there is so far and the next word, numbered anew so that the numbers stay small
        code = np.unique(code * (len(w.distinct) + 1) + w.code[k : starts + k], return_inverse=True)[1]
        bare &= stop[k : starts + k]
    at = np.flatnonzero((w.row[:starts] == w.row[n - 1 : starts + n - 1]) & ~bare)
    got = _ranked(w.row[at], code[at], at)
    got = got.where((got.rank <= top) & (got.count >= least))
    parts = [w.distinct.take(pa.array(w.code[got.first + k])) for k in range(n)]
    return got, pc.binary_join_element_wise(*parts, " ")


def _openings(w: Words, least: int) -> tuple[Ranked, pa.Array]:
    names = np.argsort(pc.sort_indices(w.distinct).to_numpy()) if len(w.distinct) else np.zeros(0, np.int64)
    got = _ranked(w.row, w.code, np.arange(len(w.row)), names)
    got = got.where(got.count >= least)
    return got, w.distinct.take(pa.array(w.code[got.first]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            yield whole.slice(at, _ROWS)


def _counted(docs: DataFrame, words: Column, name: str, of: Callable[[Words], tuple[Ranked, pa.Array]]) -> DataFrame:
    """doc_id, rank, ``name``, cnt of what ``of`` finds among the ``words`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            got, texts = of(_words(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(got.row)), pa.array(got.rank.astype(np.int32)), texts.cast(pa.string()), pa.array(got.count)], ["doc_id", "rank", name, "cnt"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("w")).mapInArrow(run, f"doc_id long, rank int, {name} string, cnt long")


def _opening(text: str, length: int) -> Column:
    first = F.transform(T.sentences(text), lambda s: F.slice(T.tokens(s), 1, length))
    return F.transform(F.filter(first, lambda ws: F.size(ws) == length), lambda ws: F.array_join(ws, " "))


def top_content_words(docs: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, rank, word, cnt: most frequent tokens of over 2 letters that are no stop words (N4); ties to what came first."""
    return _counted(docs, T.tokens("text"), "word", lambda w: _content(w, top))


def top_ngrams(docs: DataFrame, n: int, top: int = TOP, least: int = 2) -> DataFrame:
    """doc_id, rank, phrase, cnt: most frequent n-grams that are not stop words only.

    The least count holds after the top ranks are taken.
    """
    return _counted(docs, T.tokens("text"), "phrase", lambda w: _grams(w, n, top, least))


def anaphora(docs: DataFrame, length: int = 3, least: int = 2) -> DataFrame:
    """doc_id, phrase, cnt: first words of sentences that repeat."""
    return _counted(docs, _opening("text", length), "phrase", lambda w: _openings(w, least)).select("doc_id", "phrase", "cnt")


_PRONOUNS = tuple(w for words in T.PRONOUNS.values() for w in words)
_PAIRED = tuple(w for pair in T.OPPOSITIONS for w in pair)


def _only(tokens: str, words: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda w: w.isin(*words))


def _pronoun_columns(tokens: str, said: str) -> dict[str, Column]:
    """A ratio per 1000 tokens for each pronoun category, from all tokens and the pronouns among them."""
    n = F.size(tokens)
    return {name: F.when(n > 0, F.round(T.count_in(said, words) * 1000 / n, 2)).otherwise(F.lit(0.0)) for name, words in T.PRONOUNS.items()}


def pronoun_ratios(docs: DataFrame) -> DataFrame:
    """doc_id and one ratio per 1000 tokens for each pronoun category, two decimals, 0 when empty."""
    rows = docs.select("doc_id", T.tokens("text").alias("t")).withColumn("said", _only("t", _PRONOUNS))
    return rows.select("doc_id", *[c.alias(k) for k, c in _pronoun_columns("t", "said").items()])


def _pairs(said: str) -> Column:
    """The pairs of which a word occurs among ``said`` (words of pairs only), with how often each does."""
    n = lambda word: F.size(F.filter(said, lambda w: w == word)).cast("long")
    each = F.array(*[F.struct(F.array(F.lit(a), F.lit(b)).alias("pair"), F.array(n(F.lit(a)), n(F.lit(b))).alias("counts")) for a, b in T.OPPOSITIONS])
    none = F.expr("cast(array() as array<struct<pair: array<string>, counts: array<bigint>>>)")
    return F.when(F.size(said) > 0, F.filter(each, lambda p: (p["counts"][0] > 0) | (p["counts"][1] > 0))).otherwise(none)


def oppositions(docs: DataFrame) -> DataFrame:
    """doc_id, left_word, right_word, left_count, right_count of each pair that occurs."""
    rows = docs.select("doc_id", T.tokens("text").alias("t")).select("doc_id", _only("t", _PAIRED).alias("said"))
    rows = rows.where(F.size("said") > 0).select("doc_id", F.explode(_pairs("said")).alias("p"))
    at = lambda field, k: F.col(f"p.{field}")[k]
    return rows.select("doc_id", at("pair", 0).alias("left_word"), at("pair", 1).alias("right_word"), at("counts", 0).alias("left_count"), at("counts", 1).alias("right_count"))


def _type_token_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(F.lit(0.0))


def type_token_ratio(docs: DataFrame) -> DataFrame:
    """doc_id, total_words, types, ttr."""
    rows = docs.select("doc_id", T.tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("total_words"), F.size(F.array_distinct("t")).cast("long").alias("types"), _type_token_ratio(F.col("t")).alias("ttr"))


def mtld_of(words: list, threshold: float = MTLD_TTR) -> float | None:
    """Measure of textual lexical diversity of tokens, or their numbers; None below MTLD_LEAST of them."""
    if len(words) < MTLD_LEAST:
        return None

    def one_way(ws) -> float:  # noqa: ANN001
        whole, seen, n = 0, set(), 0
        for w in ws:
            seen.add(w)
            n += 1
            if len(seen) / n < threshold:
                whole, seen, n = whole + 1, set(), 0
        part = (1 - len(seen) / n) / (1 - threshold) if n else 0.0
        return len(words) / (whole + part) if whole + part > 0 else float(len(words))

    return (one_way(words) + one_way(words[::-1])) / 2


def mtld(docs: DataFrame) -> DataFrame:
    """doc_id, mtld. An order-dependent fold, so it runs over Arrow batches; tokens are cut in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _diversity(_words(b.column(1)))], ["doc_id", "mtld"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.tokens("text").alias("t")).mapInArrow(run, "doc_id long, mtld double")


def _diversity(w: Words) -> pa.Array:
    ends = np.searchsorted(w.row, np.arange(w.rows + 1))
    return pa.array([mtld_of(w.code[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.float64())


_LISTS = ("top_content_words", "repetitions", "bigrams", "trigrams")


def payload(docs: DataFrame) -> DataFrame:
    """doc_id, lex_metrics: the lexical payload as one struct (N10), from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            w, openings = _words(b.column(1)), _words(b.column(2))
            found = (_content(w, TOP), _openings(openings, 2), _grams(w, 2, TOP, 2), _grams(w, 3, TOP, 2))
            lists = []
            for name, (got, texts) in zip(_LISTS, found, strict=True):
                items = pa.StructArray.from_arrays([texts.cast(pa.string()), pa.array(got.count)], ["word" if name == _LISTS[0] else "phrase", "count"])
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(got.row, np.arange(b.num_rows + 1)).astype(np.int32)), items))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3:], *lists, _diversity(w)], ["doc_id", *b.schema.names[3:], *_LISTS, "mtld"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _opening("text", 3).alias("openings"), T.tokens("text").alias("t"))
    base = base.withColumns({"pronouns": _only("t", _PRONOUNS), "paired": _only("t", _PAIRED)})
    ratios = F.create_map(*[x for k, c in _pronoun_columns("t", "pronouns").items() for x in (F.lit(k), c)])
    base = base.select("doc_id", "t", "openings", ratios.alias("pronoun_ratios"), F.array_sort(_pairs("paired")).alias("oppositions"), _type_token_ratio(F.col("t")).alias("ttr"), F.size("t").cast("long").alias("total_words"))
    kind = lambda word: f"array<struct<{word}:string,count:bigint>>"
    schema = (
        "doc_id long, pronoun_ratios map<string,double>, oppositions array<struct<pair:array<string>,counts:array<bigint>>>, ttr double, total_words long, "
        + ", ".join(f"{name} {kind('word' if name == _LISTS[0] else 'phrase')}" for name in _LISTS)
        + ", mtld double"
    )
    out = base.mapInArrow(run, schema)
    fields = ["pronoun_ratios", "top_content_words", "repetitions", "oppositions", "bigrams", "trigrams", F.struct("ttr", "mtld").alias("lexical_diversity"), "total_words"]
    return out.select("doc_id", F.struct(*fields).alias("lex_metrics"))
