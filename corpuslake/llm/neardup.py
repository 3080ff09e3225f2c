"""MinHash near-duplicate detection with sequential Bayesian verification.

Texts become sets of 64-bit hashes of word shingles. A signature of 128 minima
is cut into 32 bands of 4; documents that agree on a band are candidates. The
candidates' signatures are compared in batches of 32 minima. With a uniform prior
and m agreements among n minima, the posterior chance that the similarity reaches
t is P(Bin(n + 1, t) <= m); a pair whose chance falls below ``miss`` is
dropped. Survivors are confirmed on the full sets, so every link is exact and the
only loss is a true link that shares no band (about 5e-6 at similarity 0.75) or
that the bound drops (at most ``miss`` a batch).

Scale. Equal sets are collapsed to one node before anything else, so copies cost
one row each. Candidates are verified in two rounds. First every member of a bucket
meets the bucket's smallest node only (each node one such leader): that is linear in a
bucket's size, and a large group of near copies becomes one component. Then buckets
that still hold several components are compared in full, across components only:
the largest component's members meet the others in blocks, the others meet each other, so
that no task gets a whole bucket and pairs are only ever numpy index arrays within a
task, never rows. Only documents with a surviving pair have their text read again, once
for the leader and once more for each block that they still have a survivor in. Links leave
a task as a spanning forest: fewer rows than documents. Joins on keys that
many rows share (equal sets, buckets, leaders) deal such keys out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B
from corpuslake.llm._rows import keyed
from corpuslake.llm.components import connected_components, rooted
from corpuslake.operators.skew import joined_by_key, sizes_of
from corpuslake.session import cut, stored

HASHES, BANDS, ROWS, BATCH = 128, 32, 4, 32
#: Members of a block, those that meet a leader together, and the shingles that either may have between them.
BLOCK_DOCS, FOLLOWERS, BLOCK_SHINGLES = 400, 128, 2_000_000
#: Index pairs that are worked on together.
PAIRS = 1 << 18
#: Up to so many document ids (16 bytes each) are broadcast to pick out texts; beyond, a shuffled join does it.
BROADCAST_IDS = 1_000_000
_BASE = 0xD1342543DE82EF95


@lru_cache(None)
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240817)
    a = (rng.integers(1, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    return a[:, None], rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles.

    Words are runs of bytes other than ASCII white space after lower-casing A-Z; a
    text of fewer words than ``size`` is one shingle as a whole, one without words
    has an empty set.
    """
    for i, j in B.chunks(offsets):
        part = B.ASCII_LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = B.words_of(part, offsets[i : j + 1] - offsets[i])
        words = B.spans_hash(part, starts, ends)
        c = B.powers(_BASE, size + 1)
        n = max(len(words) - size + 1, 0)
        windows = np.zeros(n, np.uint64)
        for k in range(size):
            windows += words[k : k + n] * c[k]
        windows = B.mix64(windows)
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if b == a:
                yield np.zeros(0, np.uint64)
            elif b - a < size:
                yield B.mix64((words[a:b] * c[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.unique(windows[a : b - size + 1])


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima (uint32) of a non-empty set of 64-bit shingle hashes."""
    a, b = _coefficients()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for q in range(0, len(x), 1024):
        y = a * x[None, q : q + 1024]
        y += b
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, BANDS) 64-bit bucket keys, different for each band."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2]).copy()
    for k in range(ROWS):
        out = B.mix64(out * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k] + np.uint64(1))
    return out


@lru_cache(None)
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For n = BATCH, 2 BATCH, ...: the fewest agreements whose posterior chance of reaching the threshold is ``miss`` or more."""
    from math import comb

    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss and m < n:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving_pairs(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) that pass every batch and first collide in ``band`` (-1: in any), with their agreements."""
    keep_i, keep_j, keep_m = [], [], []
    for at in range(0, len(i), 1 << 15):
        a, b, w = i[at : at + (1 << 15)], j[at : at + (1 << 15)], band[at : at + (1 << 15)]
        matches = np.zeros(len(a), np.int32)
        for k, least in enumerate(least_matches(threshold, miss)):
            cols = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (sigs[a, cols] == sigs[b, cols]).sum(axis=1, dtype=np.int32)
            ok = matches >= least
            a, b, w, matches = a[ok], b[ok], w[ok], matches[ok]
            if not len(a):
                break
        if len(a):
            hit = (sigs[a] == sigs[b]).reshape(len(a), BANDS, ROWS).all(axis=2)
            first = (hit.argmax(axis=1) == w) | (w < 0)
            keep_i.append(a[first])
            keep_j.append(b[first])
            keep_m.append(matches[first])
    if not keep_i:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(keep_i), np.concatenate(keep_j), np.concatenate(keep_m)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffer(batch.column(1))
            n = batch.num_rows
            count, k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sigs = np.zeros((n, HASHES), np.uint32)
            for r, s in enumerate(shingle_sets(data, offsets, size)):
                if len(s):
                    count[r] = len(s)
                    k1[r] = B.mix64(s * np.uint64(_BASE) + np.uint64(1)).sum()
                    k2[r] = B.mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum()
                    sigs[r] = signature(s)
            raw = pa.Array.from_buffers(pa.binary(4 * HASHES), n, [None, pa.py_buffer(sigs.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), raw], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if n:
            sigs = _matrix(batch.column(2))
            keys = band_keys(sigs).view(np.int64).ravel()
            nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
            sizes = np.repeat(batch.column(1).to_numpy(), BANDS)
            bands = np.tile(np.arange(BANDS, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bands), pa.array(nodes), pa.array(sizes)], ["bucket", "band", "node", "size"])


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = _binary(column)
    return data.view(np.uint32).reshape(len(column), HASHES)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy(), offsets - offsets[0]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys``; the rows arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            change[0] = any(c[0] != last.column(last.schema.get_field_index(k))[-1].as_py() for c, k in zip(cols, keys, strict=True))
        at = np.flatnonzero(change)
        if len(at):
            # all before the last change is complete
            done = [*held, batch.slice(0, at[-1])]
            table = pa.Table.from_batches([b for b in done if b.num_rows]) if any(b.num_rows for b in done) else None
            if table is not None:
                yield table
            held = [batch.slice(at[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


#: A task's key: a leader or bucket, what meets in it, and which blocks.
_TASK = ["group", "kind", "x", "y"]
_LEADER, _ACROSS, _AMONG = 0, 1, 2
_MEMBER = "group long, kind int, x int, y int, side int, component long, band int, node long"


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different components within each run of equal task; where both sides are there, across the sides only.

    The rows of a run are sorted by side.
    """
    side, component = table.column("side").to_numpy(), table.column("component").to_numpy()
    n = len(side)
    edge = np.zeros(n, bool)
    edge[0] = True
    for c in _TASK:
        v = table.column(c).to_numpy()
        edge[1:] |= v[1:] != v[:-1]
    run = np.cumsum(edge) - 1
    end = np.append(np.flatnonzero(edge)[1:], n)[run]
    other = end - np.bincount(run, weights=side).astype(np.int64)[run]  # where a run's second side begins
    low = np.where(other == end, np.arange(n) + 1, np.where(side == 0, other, end))
    many = end - low
    before = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, side="right")) - 1)
        m = many[at:upto]
        if total := int(m.sum()):
            i = np.repeat(np.arange(at, upto), m)
            j = np.arange(total) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[at:upto], m)
            ok = component[i] != component[j]
            yield i[ok], j[ok]
        at = upto


def _leaders(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _TASK):
            sigs = _matrix(table.column("sig").combine_chunks())
            node, band = table.column("node").to_numpy(), table.column("band").to_numpy()
            for a, b in _pairs(table):
                i, j, m = surviving_pairs(sigs, a, b, band[a], threshold, miss)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(node[j]), pa.array(node[i]), pa.array(m.astype(np.int32))], ["node", "leader", "matches"])

    return run


def _screen(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _TASK):
            sigs = _matrix(table.column("sig").combine_chunks())
            band = table.column("band").to_numpy()
            hit = np.zeros(len(table), bool)
            for a, b in _pairs(table):
                i, j, _ = surviving_pairs(sigs, a, b, band[a], threshold, miss)
                hit[i] = True
                hit[j] = True
            if hit.any():
                yield from table.filter(pa.array(hit)).drop_columns("sig").combine_chunks().to_batches()

    return run


def _confirm(threshold: float, miss: float, size: int):
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _TASK):
            data, offsets = B.text_buffer(table.column("text"))
            nodes = table.column("node").to_numpy()
            band = table.column("band").to_numpy()
            sets = list(shingle_sets(data, offsets, size))
            sigs = np.stack([signature(s) if len(s) else np.zeros(HASHES, np.uint32) for s in sets])
            # rows of one component are one from the start, whichever group of the table they are in
            _, first, back = np.unique(table.column("component").to_numpy(), return_index=True, return_inverse=True)
            parent = first[back]

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            links: list[tuple[int, int]] = []
            for a, b in _pairs(table):
                i, j, m = surviving_pairs(sigs, a, b, band[a], threshold, miss)
                for k in np.argsort(-m, kind="stable"):
                    p, q = int(i[k]), int(j[k])
                    if find(p) == find(q):
                        continue
                    s, t = (sets[p], sets[q]) if len(sets[p]) <= len(sets[q]) else (sets[q], sets[p])
                    if 100 * len(s) < percent * len(t):
                        continue
                    at = np.searchsorted(t, s)
                    at[at == len(t)] = 0
                    both = int((t[at] == s).sum())
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        parent[find(q)] = find(p)
                        links.append((p, q))
            if links:
                one = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[one[:, 0]]), pa.array(nodes[one[:, 1]])], ["src", "dst"])

    return run


def _following(pairs: DataFrame) -> DataFrame:
    """Tasks in which a leader (first side) meets a block of its followers, for (node, leader, size) pairs."""
    many = cut(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("total")))
    blocks = many.select("leader", "copies", _blocks("copies", "total", FOLLOWERS).alias("blocks"))
    followers = joined_by_key(pairs, blocks.select("leader", "blocks"), many.select("leader", "copies"), ["leader"], "node")
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = followers.select(F.col("leader").alias("group"), place.alias("x"), F.lit(1).alias("side"), "node")
    heads = blocks.select(F.col("leader").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.lit(0).alias("side"), F.col("leader").alias("node"))
    rows = rows.unionByName(heads)
    return rows.select("group", F.lit(_LEADER).alias("kind"), "x", F.lit(0).alias("y"), "side", F.col("node").alias("component"), F.lit(-1).alias("band"), "node")


def _blocks(members: str, total: str, most: int = BLOCK_DOCS):  # noqa: ANN202
    return F.ceil(F.greatest(F.lit(1.0), F.col(members) / most, F.col(total) / BLOCK_SHINGLES)).cast("int")


def _meeting(members: DataFrame) -> DataFrame:
    """Tasks in which the rows of each bucket with several components meet, for (bucket, band, node, size, component) rows."""
    parts = cut(members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")))
    largest = F.max(F.struct("n", "total", "component"))
    buckets = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("copies"), F.sum("total").alias("total"), largest.alias("big")).where("parts > 1")
    buckets = cut(
        buckets.withColumns({"rest": F.col("copies") - F.col("big.n"), "rest_total": F.col("total") - F.col("big.total")}).select(
            "bucket", "copies", F.col("big.component").alias("big"), _blocks("big.n", "big.total").alias("big_blocks"), _blocks("rest", "rest_total").alias("rest_blocks")
        )
    )
    rows = joined_by_key(members, buckets.drop("copies"), buckets.select("bucket", "copies"), ["bucket"], "node")
    rows = rows.withColumn("side", (F.col("component") != F.col("big")).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 1, F.col("rest_blocks")).otherwise(F.col("big_blocks"))).cast("int"))
    base = [F.col("bucket").alias("group"), F.col("component"), F.col("band"), F.col("node")]
    met = F.when(F.col("side") == 1, F.col("big_blocks")).otherwise(F.col("rest_blocks"))
    across = rows.withColumn("met", F.explode(F.sequence(F.lit(0), met - 1)))
    x, y = (F.when(F.col("side") == k, F.col("block")).otherwise(F.col("met")) for k in (0, 1))
    across = across.select(*base, F.lit(_ACROSS).alias("kind"), x.alias("x"), y.alias("y"), "side")
    among = rows.where("side = 1").withColumn("met", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)))
    x, y = F.least("block", "met"), F.greatest("block", "met")
    among = among.select(*base, F.lit(_AMONG).alias("kind"), x.alias("x"), y.alias("y"), ((x != y) & (F.col("block") == y)).cast("int").alias("side"))
    return across.unionByName(among).select(*_TASK, "side", "component", "band", "node")


def _dealt(tasks: DataFrame, rows: DataFrame, key: str, payload: str) -> DataFrame:
    """``tasks`` with the ``payload`` of their nodes from ``rows`` (named by ``key``), each task's rows in one partition, sorted by task and side."""
    needed = cut(tasks.groupBy("node").agg(F.count(F.lit(1)).alias("copies")))
    wanted, sizes = needed.select("node"), sizes_of(needed)
    if sizes.keys <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    held = rows.join(wanted, rows[key] == wanted.node).select("node", payload)
    columns = [*_TASK, "side", "component", "band", "node"]
    met = joined_by_key(tasks, held, needed, ["node"], "x", sizes=sizes).select(*columns, payload)
    return met.repartition(*_TASK).sortWithinPartitions(*_TASK, "side", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.75, shingle: int = 5, miss: float = 1e-6, own_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their shingle sets' Jaccard similarity is at least
    ``threshold`` (in whole percent); component_id is the smallest id reachable over links and ``kept`` marks
    the document with that id. A null or blank text has no shingles and no links.
    Rows that repeat an id count as one document, with the smallest of their texts,
    and each gets that document's result. A row without an id is linked with
    nothing: its component is null and it is kept. Other columns are ignored. An empty
    table gives no rows; texts of any length are read whole. ``own_ids`` says that no id is repeated, which is looked up else.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not own_ids and base.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        ids = base.where("doc_id is not null").select("doc_id", F.monotonically_increasing_id().alias("row"))
        copies = cut(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")))
        one = base.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        got = near_duplicates(one.unionByName(base.where("doc_id is null")), threshold=threshold, shingle=shingle, miss=miss, own_ids=True)
        again = joined_by_key(ids, got.where("doc_id is not null"), copies, ["doc_id"], "row").drop("row")
        return again.unionByName(got.where("doc_id is null"))
    signed = stored(base.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"))
    linked = signed.where("n_shingles > 0 and doc_id is not null")

    # Equal sets are one node, named by the smallest id among them.
    reps = cut(linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    nodes = cut(linked.join(reps.select("node"), linked.doc_id == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "sig"))
    sigs = nodes.select(F.col("node").alias("signed"), "sig")

    member = nodes.mapInArrow(_keys, "bucket long, band int, node long, size long")
    big = cut(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("copies"), F.min("node").alias("leader")).where("copies > 1"))
    shared = cut(joined_by_key(member, big.select("bucket", "leader"), big.select("bucket", "copies"), ["bucket"], "node"))

    def links_of(tasks: DataFrame) -> DataFrame:
        """Verified links of tasks; their nodes' texts are read."""
        return _dealt(tasks, base, "doc_id", "text").mapInArrow(_confirm(threshold, miss, shingle), "src long, dst long")

    # First round: every member of a bucket meets its leader.
    tasks = cut(_following(cut(shared.where("node <> leader").groupBy("node", "leader").agg(F.first("size").alias("size")))))
    stars = _dealt(tasks, sigs, "signed", "sig").mapInArrow(_leaders(threshold, miss), "node long, leader long, matches int")
    best = stars.groupBy("node").agg(F.max(F.struct("matches", -F.col("leader"))).alias("best")).select("node", (-F.col("best")["col2"]).alias("leader"))
    best = cut(best.join(nodes.select("node", "size"), "node"))
    # a leader is smaller than its followers, so their links make up trees
    found = rooted(links_of(cut(_following(best))).select(F.col("dst").alias("node"), F.col("src").alias("component")))

    # Second round: buckets in which several components are left.
    grouped = shared.join(found, "node", "left").select("bucket", "band", "node", "size", F.coalesce("component", "node").alias("component"))
    tasks = cut(_meeting(cut(grouped)))
    screened = cut(_dealt(tasks, sigs, "signed", "sig").mapInArrow(_screen(threshold, miss), _MEMBER))
    if screened.limit(1).count():
        found = connected_components(found.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(links_of(screened)))

    named = reps.join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    light = ["doc_id", "n_shingles", "component_id"]
    out = joined_by_key(linked.select("doc_id", "n_shingles", "k1", "k2"), named, reps.select("k1", "k2", "copies"), ["k1", "k2"], "doc_id", "left").select(*light)
    alone = signed.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select(*light, F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.75, shingle: int = 5, miss: float = 1e-6) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates left, the one with the smallest id.

    Each row is a document for itself: rows that repeat an id are judged by their own texts, and of
    exact repeats one stays. Rows without an id, or without words, stay. All columns are kept. What goes
    is broadcast while it is few rows, so that the texts that stay are not shuffled.
    """
    rows, key, by_id = keyed(docs, id_col)
    has_id = rows.where(F.col(id_col).isNotNull())
    groups = near_duplicates(has_id.select(key, text_col), key, text_col, threshold=threshold, shingle=shingle, miss=miss, own_ids=True)
    if by_id:
        gone = groups.where("not kept").select(F.col("doc_id").alias(key))
    else:
        groups = cut(groups.select(F.col("doc_id").alias(key), "component_id").join(has_id.select(key, F.col(id_col).cast("long").alias("__id")), key))
        first = groups.groupBy("component_id").agg(F.min(F.struct("__id", key)).alias("first")).select(F.col(f"first.{key}").alias(key))
        gone = groups.join(first, key, "left_anti").select(key)
    gone = cut(gone)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
