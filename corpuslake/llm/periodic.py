"""Runs of repeated words in texts, found in the suffix tree by Stoye and Gusfield's method.

The tree of a text's words is that of the intervals of its sorted suffixes: suffixes are ordered by prefix
doubling, the common lengths of neighbours come from the classes of each doubling, and an
inner node is an interval between two smaller lengths. For each node of depth d, the
leaves below all children but the largest are traversed: a leaf i and a leaf i + d (or
i - d) below different children are a branching tandem repeat of period d, two equal
blocks whose next words differ. A leaf is met once a light child above it, so n log n in
all. Each run has such a repeat at its right end: it is rotated to the left as long as words d apart are
equal, and repeats that give the same stretch are merged, the smallest period staying.

numpy does this for all texts of a chunk at once; classes tell texts apart, so no suffix reaches
into the next text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B

_BASE2 = 0xC2B2AE3D27D4EB4F
#: Pairs of a leaf and a node above it that are looked at together.
PAIRS = 1 << 20

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Suffixes(NamedTuple):
    """Sorted suffixes: ``order`` by place, ``place`` by position, and ``classes`` of the first 1, 2, 4, ... symbols by position."""

    order: np.ndarray
    place: np.ndarray
    classes: list[np.ndarray]


def sorted_suffixes(symbols: np.ndarray, end: np.ndarray) -> Suffixes:
    """Suffixes by prefix doubling; ``end`` is the end of each position's text, and no symbol is in two texts.

    Only suffixes that are not yet told apart are sorted again in a round; a class is the place of its first suffix.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.ones(n, bool)
    first[1:] = symbols[order[1:]] != symbols[order[:-1]]
    slot = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = slot
    classes, h = [rank], 1
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(open_):
        at = order[open_]
        after = at + h
        key = np.where(after < end[at], rank[np.minimum(after, n - 1)], -1) + 1 + rank[at].astype(np.int64) * (n + 1)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[open_] = at
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        classes.append(rank)
        open_ = open_[~(first & np.append(first[1:], True))]
        h *= 2
    return Suffixes(order, rank, classes)


def common_lengths(s: Suffixes) -> np.ndarray:
    """For each place, the number of first symbols that its suffix shares with the one before it (0 at place 0)."""
    out = np.zeros(len(s.order), np.int64)
    if not len(out):
        return out
    same = np.flatnonzero(s.classes[0][s.order[1:]] == s.classes[0][s.order[:-1]]) + 1
    i, j = s.order[same - 1].astype(np.int64), s.order[same].astype(np.int64)
    length, n = np.zeros(len(same), np.int64), len(out)
    for k in range(len(s.classes) - 2, -1, -1):
        a, b = i + length, j + length
        inside = (a < n) & (b < n)
        a[~inside] = b[~inside] = 0
        length += (inside & (s.classes[k][a] == s.classes[k][b])).astype(np.int64) << k
    out[same] = length
    return out


def _nearest_smaller(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``at`` the nearest places to the left and right with a smaller value; v[0] is 0, and the end counts as smaller."""
    zero = np.flatnonzero(v == 0)
    longest = int(np.diff(np.append(zero, len(v))).max(initial=1))
    tables, k = [v], 0
    while (2 << k) <= longest:
        t = tables[-1]
        t2 = t.copy()
        t2[: len(t) - (1 << k)] = np.minimum(t[: len(t) - (1 << k)], t[1 << k :])
        t2[len(t) - (1 << k) :] = 0  # reaches over the end
        tables.append(t2)
        k += 1
    value = v[at]
    right, left = at + 1, at - 1
    padded = len(v)
    for k in range(len(tables) - 1, -1, -1):
        fits = right + (1 << k) <= padded
        go = fits & (tables[k][np.minimum(right, padded - 1)] >= value)
        right += go.astype(np.int64) << k
        low = left - (1 << k) + 1
        go = (low >= 0) & (tables[k][np.maximum(low, 0)] >= value)
        left -= go.astype(np.int64) << k
    return left, right


class Children(NamedTuple):
    """All children of inner nodes but each node's largest: their places [start, end), and the node's depth and places [left, right)."""

    start: np.ndarray
    end: np.ndarray
    depth: np.ndarray
    left: np.ndarray
    right: np.ndarray


def light_children(lcp: np.ndarray) -> Children:
    """The children that the smaller-half traversal goes into."""
    at = np.flatnonzero(lcp > 0)
    left, right = _nearest_smaller(lcp, at)
    by = np.argsort(left * (len(lcp) + 1) + right, kind="stable")  # splits of one node together, in order
    at, left, right = at[by], left[by], right[by]
    new = np.ones(len(at), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    before = np.empty_like(at)  # each split ends a child; the last one also begins one
    before[1:] = at[:-1]
    before[first] = left[first]
    node = np.cumsum(new) - 1
    largest = np.maximum(np.maximum.reduceat(at - before, first), right[last] - at[last]) if len(at) else first
    keep = np.ones(len(at), bool)
    tail_largest = right[last] - at[last] == largest
    full = np.flatnonzero((at - before == largest[node]) & ~tail_largest[node])
    keep[full[np.unique(node[full], return_index=True)[1]]] = False
    t = last[~tail_largest]
    join = lambda a, b: np.concatenate([a[keep], b])
    return Children(join(before, at[t]), join(at, right[t]), join(lcp[at], lcp[at[t]]), join(left, left[t]), join(right, right[t]))


def branching_repeats(s: Suffixes, light: Children, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of the branching tandem repeats; one may come twice."""
    size = light.end - light.start
    found, period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = np.searchsorted(np.cumsum(size), np.arange(PAIRS, int(size.sum()) + PAIRS, PAIRS), side="left")
    for a, b in zip([0, *(cuts + 1)], [*(cuts + 1), len(size)], strict=False):
        n = size[a:b]
        if not len(n):
            continue
        child = np.repeat(np.arange(a, min(b, len(size))), n)
        leaf = s.order[np.repeat(light.start[a:b] - (np.cumsum(n) - n), n) + np.arange(len(child))]
        d = light.depth[child]
        for other, inside in ((leaf + d, leaf + d < end[leaf]), (leaf - d, leaf - d >= begin[leaf])):
            c = child[inside]
            place = s.place[other[inside]]
            hit = (place >= light.left[c]) & (place < light.right[c]) & ((place < light.start[c]) | (place >= light.end[c]))
            found.append(np.minimum(leaf[inside], other[inside])[hit])
            period.append(d[inside][hit])
    return np.concatenate(found), np.concatenate(period)


def runs_of(symbols: np.ndarray, offsets: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all maximal runs of ``symbols``, by start, then period.

    A run lies in one text (texts are between ``offsets``; no symbol is in two of them), has at least ``min_length``
    symbols and ``min_exponent`` (2 or more) periods.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    lengths = np.diff(offsets)
    begin, end = np.repeat(offsets[:-1], lengths), np.repeat(offsets[1:], lengths)
    s = sorted_suffixes(symbols, end)
    at, p = branching_repeats(s, light_children(common_lengths(s)), begin, end)
    may = at + 2 * p - begin[at] >= np.maximum(min_length, min_exponent * p)
    at, p = at[may], p[may]
    back = np.zeros(len(at), np.int64)
    for k in range(len(s.classes) - 2, -1, -1):  # rotate to the left: how far words p apart are equal
        a = at - back - (1 << k)
        inside = a >= begin[at]
        a[~inside] = 0
        back += (inside & (s.classes[k][a] == s.classes[k][a + p * inside])).astype(np.int64) << k
    start, stop = at - back, at + 2 * p
    long = stop - start >= np.maximum(min_length, min_exponent * p)
    start, stop, p = start[long], stop[long], p[long]
    by = np.lexsort((p, stop, start))
    start, stop, p = start[by], stop[by], p[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, p = start[new], stop[new], p[new]
    by = np.lexsort((p, start))
    return start[by], stop[by], p[by]


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number for each word: equal for equal words of one text, and for no others."""
    if not len(starts):
        return np.zeros(0, np.int64)
    key, check = B.spans_hash(data, starts, ends), B.spans_hash(data, starts, ends, _BASE2)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    if (check[first][inverse] != check).any():  # two words of one hash
        raw = data.tobytes()
        words = np.empty(len(starts), object)
        words[:] = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        _, inverse = np.unique(words, return_inverse=True)
    return row * len(starts) + inverse


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The given words of each of ``n`` texts, joined by one space."""
    if not len(starts):
        return pa.array([""] * n, pa.string())
    size = ends - starts + 1
    size[np.append(row[1:] != row[:-1], True)] -= 1
    first = np.cumsum(size) - size
    out = np.append(data, np.uint8(32))[np.repeat(starts - first, size) + np.arange(int(size.sum()))]
    out[(first + ends - starts)[size > ends - starts]] = 32
    stops = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(row, np.arange(n + 1))]
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(stops.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


def _scan(batches: Iterator[pa.RecordBatch], min_length: int, min_exponent: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) batches to SCHEMA."""
    fields = ["start", "length", "period"]
    for batch in batches:
        data, offsets = B.text_buffer(batch.column(1))
        for i, j in B.chunks(offsets):
            text, n = data[offsets[i] : offsets[j]], j - i
            starts, ends, first = B.words_of(text, offsets[i : j + 1] - offsets[i])
            words = np.diff(first)
            row = np.repeat(np.arange(n), words)
            start, stop, period = runs_of(word_symbols(text, starts, ends, row), first, min_length, min_exponent)
            of = row[start]
            dropped = np.zeros(len(starts) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, stop, -1)
            kept = np.cumsum(dropped[:-1]) == 0
            runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start - first[of], stop - start, period)], fields)
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(words.astype(np.int64)), runs, _collapsed(text, starts[kept], ends[kept], row[kept], n)], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, *, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs and collapsed of every whole text.

    Words are the maximal matches of ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q that no neighbouring
    word extends, of ``min_length`` words and ``min_exponent * q`` at least; ``runs`` has them by start, then period.
    ``collapsed`` has the words that are in no run or among its first q, joined by one space.

    A null text counts as empty: no words, no runs, an empty collapsed text. Each row is taken by itself, whether its id is null
    or repeated; other columns are ignored; an empty table gives no rows. A very long text is
    one task's work: numpy arrays of some 100 bytes a word, and 4 bytes a word for each doubling of the longest passage that repeats in it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _scan(b, min_length, min_exponent), SCHEMA)
