"""Ranked lexical search over an index of shards, by variable-block-max WAND.

The index: each shard holds as many documents as a task reads in a row (up to SHARD_BYTES of text), and for each of its terms the
documents that hold it, in order, with each one's impact (the part of the score that does not depend on
the query). A list of postings is cut into blocks of varying length by dynamic programming: the
cuts minimise the sum over blocks of length times largest impact, which is the error of the
blocks' bounds but for a constant, plus a price for each block. Lists are cut a stretch of STRETCH
postings at a time, many stretches in step.

The search goes shard by shard. For a query, the largest impacts of the blocks that cover a document
bound its score; a document whose bound is below the k-th best score known is no pivot, and blocks without
pivots are skipped without reading their postings. Lists are read in tiers, the shortest first, which weigh most: after each
tier, what has been read of a document is a lower bound of its score, the k-th of these raises the
threshold, and what has been read plus the block maxima of the lists to come decides whether a document
is still a pivot. Scores and bounds are whole numbers, so nothing is lost by rounding. A task hands the
best scores on from shard to shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B
from corpuslake.operators.skew import joined_by_key
from corpuslake.session import cut, few

#: Bytes of text of a shard, postings that are cut at a time, the longest block, and a block's price in mean impacts.
SHARD_BYTES, STRETCH, LONGEST, PRICE = 8 << 20, 512, 64, 4
#: Items that are searched for together; more go in further groups, which read the lists again.
ITEMS = 4096
#: Weights of items' terms that are broadcast; more meet the lists in a shuffle.
BROADCAST = 1_000_000
#: Lists are read in tiers, the shortest first: shares of a query's postings where a tier ends.
TIERS = (0.02, 0.06, 0.15, 0.3, 0.5)

_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_BASE2 = 0xC2B2AE3D27D4EB4F


# -- terms ----------------------------------------------------------------
def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the terms of each text: runs of digits, ASCII letters and whatever is not ASCII."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _TERM[data]
    begins, stops = inside[1:] > inside[:-1], inside[1:] < inside[:-1]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    cut = edge[(inside[edge] == 1) & (inside[edge + 1] == 1)]  # one text ends in a term and the next begins with one
    begins[cut] = stops[cut] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def term_ids(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each term, for each number a place where its term stands)."""
    key, check = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 1 << 16):  # the hashes' temporaries are many times the text
        some = slice(a, a + (1 << 16))
        key[some], check[some] = B.spans_hash(lowered, starts[some], ends[some]), B.spans_hash(lowered, starts[some], ends[some], _BASE2)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    if (check[first][inverse] != check).any():  # two terms of one hash
        raw = lowered.tobytes()
        terms = np.empty(len(starts), object)
        terms[:] = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        _, first, inverse = np.unique(terms, return_index=True, return_inverse=True)
    return inverse, first


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    first = np.cumsum(size) - size
    out = data[np.repeat(starts - first, size) + np.arange(int(size.sum()))]
    stops = np.append(first, int(size.sum()))
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(stops.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


def counted_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(term number, row, occurrences) of each posting by term, then row; the terms; the terms of each row with repeats."""
    lowered = B.ASCII_LOWER[data]
    starts, ends, row = term_spans(lowered, offsets)
    n = len(offsets) - 1
    term, first = term_ids(lowered, starts, ends)
    pair, count = np.unique(term * n + row, return_counts=True)
    return pair // max(n, 1), pair % max(n, 1), count, _strings(lowered, starts[first], ends[first]), np.bincount(row, minlength=n)


# -- blocks ---------------------------------------------------------------
def _cut_in_step(impacts: np.ndarray, size: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Where blocks begin in each row of ``impacts`` (rows x width, ``size`` of them filled): the cheapest cut of each."""
    rows, width = impacts.shape
    w = min(LONGEST, width)
    cost = np.zeros((rows, width + 1))
    best = np.zeros((rows, width + 1), np.int16)
    peak = np.zeros((rows, w))  # largest impact of the block from position j (at j % w) up to here
    base = np.full((rows, w), np.inf)  # cost of all before position j
    begin = np.zeros(w)
    each = np.arange(rows)
    for i in range(width):
        np.maximum(peak, impacts[:, i : i + 1], out=peak)
        peak[:, i % w], base[:, i % w], begin[i % w] = impacts[:, i], cost[:, i] + price, i
        total = peak * (i + 1 - begin)
        total += base
        j = total.argmin(axis=1)
        cost[:, i + 1], best[:, i + 1] = total[each, j], begin[j]
    starts = np.zeros((rows, width), bool)
    at = size.copy()
    while (at > 0).any():
        at = np.where(at > 0, best[each, at], 0)
        starts[each, at] = True
    return starts


def block_starts(impacts: np.ndarray, list_starts: np.ndarray) -> np.ndarray:
    """Places where blocks begin, for consecutive lists of impacts that begin at ``list_starts``."""
    n = len(impacts)
    size = np.diff(np.append(list_starts, n))
    pieces = -(-size // STRETCH)
    of = np.repeat(np.arange(len(size)), pieces)
    within = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = list_starts[of] + within * STRETCH
    length = np.minimum(STRETCH, list_starts[of] + size[of] - start)
    sums = np.concatenate([[0], np.cumsum(impacts)])
    price = PRICE * (sums[list_starts + size] - sums[list_starts]) / np.maximum(size, 1)
    out = [start]
    width = 1
    while width < STRETCH:
        width *= 2
        some = np.flatnonzero((length > width // 2) & (length <= width))
        rows = max(1, (1 << 18) // width)
        for a in range(0, len(some), rows):
            k = some[a : a + rows]
            at = start[k][:, None] + np.arange(width)
            filled = np.arange(width) < length[k][:, None]
            cut = _cut_in_step(np.where(filled, impacts[np.minimum(at, n - 1)], 0), length[k], price[of[k]])
            out.append(at[cut & filled])
    return np.unique(np.concatenate(out))


# -- the index ------------------------------------------------------------
_INDEX = "shard long, term string, df int, docs array<int>, impacts array<int>, blocks array<int>, peaks array<int>, ids array<long>"


def _lists(values: np.ndarray, stops: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(values).cast(kind))


def impacts_of(count: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 8 * m) with m = 100 - 75 + (75 * n * docs) div terms, for postings of documents of n terms."""
    m = 25 + (75 * n * docs) // terms
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def _shard(shard: int, ids: pa.Array, texts: pa.Array, docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: first one that holds its documents' ids, then one a term."""
    names = [x.split()[0] for x in _INDEX.split(", ")]
    none = [pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.list_(pa.int32()))] * 4]
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *none, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names)
    data, offsets = B.text_buffer(texts)
    term, doc, count, words, n = counted_terms(data, offsets)
    if not len(term):
        return
    impact = impacts_of(count, n[doc], docs, terms)
    first = np.searchsorted(term, np.arange(len(words)))
    blocks = block_starts(impact, first)
    peaks = np.maximum.reduceat(impact, blocks)
    stops, block_stops = np.append(first, len(term)), np.searchsorted(blocks, np.append(first, len(term)))
    within = blocks - first[term[blocks]]
    for a in range(0, len(words), 20_000):
        b = min(len(words), a + 20_000)
        s, t = slice(stops[a], stops[b]), slice(block_stops[a], block_stops[b])
        arrays = [_lists(v, w - w[0], pa.int32()) for v, w in ((doc[s], stops[a : b + 1]), (impact[s], stops[a : b + 1]), (within[t], block_stops[a : b + 1]), (peaks[t], block_stops[a : b + 1]))]
        df = pa.array(np.diff(stops[a : b + 1]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard)), words.slice(a, b - a), df, *arrays, pa.nulls(b - a, pa.list_(pa.int64()))], names)


def _shards(batches: Iterator[pa.RecordBatch], docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    partition, number = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _shard((partition << 32) + number, table.column(0).combine_chunks(), table.column(1).combine_chunks(), docs, terms)

    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            some = whole.slice(at, 1000)
            held.append(some)
            size += some.column(1).nbytes
            if size >= SHARD_BYTES:
                yield from flush()
                held, size, number = [], 0, number + 1
    if held:
        yield from flush()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        data, offsets = B.text_buffer(batch.column(0))
        for i, j in B.chunks(offsets):
            row = term_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[2]
            docs += len(np.unique(row))
            terms += len(row)
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def build(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the index of all rows of ``docs`` to ``path``: two passes over the texts, no shuffle.

    A null text holds no term; such documents, and those without a term, count in nothing. Rows that repeat an id are documents of
    their own. Other columns are ignored; an empty table gives an empty index. Texts of any length are indexed whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = rows.select("text").mapInArrow(_counts, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("terms"), F.lit(0)).alias("t")).first()
    index = rows.mapInArrow(lambda b: _shards(b, n.d, n.t), _INDEX)
    index.select("*", F.lit(n.d).alias("n_docs")).write.parquet(path)


# -- the search -----------------------------------------------------------
class Best:
    """The k best (score, id) of an item over the shards that a task has met."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """A document below this is not among the best."""
        return int(self.score[-1]) if len(self.score) >= self.k else 1

    def take(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Takes in more documents; ``known`` is false where a document has no id, which comes last among equals."""
        score, ids, known = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.known, known)))
        by = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.ids, self.known = score[by], ids[by], known[by]


class Shard:
    """The lists of one shard that the items need, flat: postings, blocks and which list has which."""

    def __init__(self, docs: list[np.ndarray], impacts: list[np.ndarray], blocks: list[np.ndarray], peaks: list[np.ndarray], size: int):
        self.size = size
        self.docs, self.impacts = np.concatenate(docs), np.concatenate(impacts).astype(np.int64)
        self.list_start = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        self.block_list = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
        self.block_start = np.concatenate([b + s for b, s in zip(blocks, self.list_start, strict=False)])
        self.block_stop = np.append(self.block_start[1:], len(self.docs))
        self.peaks = np.concatenate(peaks).astype(np.int64)
        self.low, self.high = self.docs[self.block_start], self.docs[self.block_stop - 1]
        #: Postings of the lists that were asked for, and those that were read.
        self.asked = self.read = 0

    def search(self, lists: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of documents whose sum over ``lists`` of weight times impact can be among the k best, or reaches ``floor``."""
        postings = self.list_start[lists + 1] - self.list_start[lists]
        by = np.argsort(postings, kind="stable")
        lists, weights, postings = lists[by], weights[by], postings[by]
        self.asked += int(postings.sum())
        tier = np.searchsorted(np.array(TIERS) * postings.sum(), np.cumsum(postings) - postings / 2)
        n = self.block_list[lists + 1] - self.block_list[lists]
        block = np.repeat(self.block_list[lists] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        weight, tier = np.repeat(weights, n), np.repeat(tier, n)
        edge = np.zeros((len(TIERS) + 2, self.size + 1), np.int64)
        np.add.at(edge, (tier, self.low[block]), weight * self.peaks[block])
        np.add.at(edge, (tier, self.high[block] + 1), -weight * self.peaks[block])
        bounds = np.cumsum(edge[::-1, :-1].cumsum(axis=1), axis=0)[::-1]  # what the lists from each tier on can add
        starts = np.searchsorted(tier, np.arange(len(TIERS) + 2))
        some = np.flatnonzero(bounds[0] >= max(floor, 1))
        total = np.zeros(len(some), np.int64)
        slot = np.empty(self.size, np.int64)
        for t, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            if a == b or not len(some):
                continue
            first = np.searchsorted(some, self.low[block[a:b]])
            touched = a + np.flatnonzero((first < len(some)) & (some[np.minimum(first, len(some) - 1)] <= self.high[block[a:b]]))
            m = self.block_stop[block[touched]] - self.block_start[block[touched]]
            posting = np.repeat(self.block_start[block[touched]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            self.read += len(posting)
            slot[:] = -1
            slot[some] = np.arange(len(some))
            place = slot[self.docs[posting]]
            mine = np.flatnonzero(place >= 0)
            np.add.at(total, place[mine], np.repeat(weight[touched], m)[mine] * self.impacts[posting[mine]])
            if len(total) >= k:  # what has been read of a document is a lower bound of its score
                floor = max(floor, int(np.partition(total, len(total) - k)[len(total) - k]))
            may = total + bounds[t + 1][some] >= max(floor, 1)
            some, total = some[may], total[may]
        return some, total


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _found(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of shards, each shard's together, to the best documents of each item in this task."""
    best: dict[int, Best] = {}

    def search(rows: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(rows).combine_chunks()
        head = table.filter(table.column("term").is_null())
        lists = table.filter(table.column("term").is_valid()).combine_chunks()
        if not len(lists):
            return
        ids = head.column("ids").combine_chunks().flatten()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        docs, impacts, blocks, peaks, items, weights = (_arrays(lists.column(c).combine_chunks()) for c in ("docs", "impacts", "blocks", "peaks", "items", "weights"))
        shard = Shard(docs, impacts, blocks, peaks, len(ids))
        item, weight = np.concatenate(items), np.concatenate(weights)
        of = np.repeat(np.arange(len(lists)), [len(x) for x in items])
        by = np.argsort(item, kind="stable")
        item, weight, of = item[by], weight[by], of[by]
        starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        for a, b in zip(starts, [*starts[1:], len(item)], strict=True):
            held = best.setdefault(int(item[a]), Best(k))
            got, score = shard.search(of[a:b], weight[a:b], held.floor(), k)
            held.take(score, ids[got], known[got])

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        part, number = batch.column("part").to_numpy(), batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (number[1:] != number[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and now != (part[a], number[a]):
                search(held)
                held = []
            now = (part[a], number[a])
            held.append(batch.slice(a, b - a))
    if held:
        search(held)
    for item, x in best.items():
        n = len(x.score)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, item)), pa.array(x.ids, mask=~x.known), pa.array(x.score)], ["item", "doc_id", "score"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) batches to (item, term, n)."""
    for batch in batches:
        data, offsets = B.text_buffer(batch.column(1))
        for i, j in B.chunks(offsets):
            term, row, count, words, _ = counted_terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row)), words.take(pa.array(term)), pa.array(count.astype(np.int64))], ["item", "term", "n"])


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of the index, equal scores by ascending doc_id (none: last).

    Equal rows of ``items`` count once; rows of one id with different texts have a list each. Items without a term, or
    whose terms no document holds, have none. Other columns are ignored.
    """
    kind = items.schema[id_col].dataType
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    asked = asked.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    groups = max(1, -(-items.count() // ITEMS))
    terms = asked.select("item", "text").mapInArrow(_terms, "item long, term string, n long")
    by_term = cut(terms.groupBy(F.pmod("item", F.lit(groups)).cast("int").alias("part"), "term").agg(F.collect_list("item").alias("items"), F.collect_list("n").alias("ns")))
    index = spark.read.parquet(path)
    lists = index.where("term is not null")
    wanted = cut(by_term.select("term").distinct())
    df = cut(lists.select("term", "df", "n_docs").join(few(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.first("n_docs").alias("N"), F.count(F.lit(1)).alias("copies")))
    weight = F.floor(1000 * F.log((2 * F.col("N") + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = by_term.join(df.select("term", weight.alias("weight")), "term").where("weight > 0")
    weighted = cut(weighted.select("part", "term", "items", F.expr("transform(ns, n -> n * weight)").alias("weights")))
    columns = ["part", "shard", "term", "docs", "impacts", "blocks", "peaks", "ids", "items", "weights"]
    if (weighted.agg(F.sum(F.size("items"))).first()[0] or 0) <= BROADCAST:
        met = lists.join(F.broadcast(weighted), "term").select(columns)
    else:
        met = joined_by_key(lists, weighted, df.select("term", "copies"), ["term"], "shard").select(columns)
    heads = index.where("term is null").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    heads = heads.select(*columns[:-2], F.lit(None).cast("array<long>").alias("items"), F.lit(None).cast("array<long>").alias("weights"))
    rows = met.unionByName(heads).repartition("part", "shard").sortWithinPartitions("part", "shard")
    found = rows.mapInArrow(lambda b: _found(b, k), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("item", F.col("item_id").cast(kind)), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
