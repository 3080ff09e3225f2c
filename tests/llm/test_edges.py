"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import byte_bpe, components, fingerprints, html_layout, langid, neardup, orc_tokens, packing, quality, secrets, segments, topk
from corpuslake.llm import _buffers as B
from corpuslake.session import scratch

EXTRA = "row string, found string, size int, node int, part int, bucket int, label string, salt int, next_text string, component_id int, __row int, value_hash string, lang string, source string, ids string, score string"
SCHEMA = f"doc_id long, text string, {EXTRA}"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rows_of(*pairs):
    return [(i, t, "r", "f", 1, 2, 3, 4, "l", 5, "n", 6, 7, "h", "en", "src/x", "i", "s") for i, t in pairs]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k % 977}" for k in range(120_000))
    pairs = [(None, "no id here but text"), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "x" * 200_000), (6, "same text twice over and over"), (6, "same text twice over and over"), (7, "same text twice over and over"), (8, "\n\n\n"), (9, "Ünï cödé 中文 🙂\x1c.")]
    return spark.createDataFrame(rows_of(*pairs), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(spark, odd, empty):
    got = fingerprints.with_next_text(odd)
    assert got.count() == 11
    nxt = {r.doc_id: r.next_text for r in got.where("doc_id is not null and doc_id <> 6").collect()}
    assert nxt[1] == "" and nxt[2] == " \n\t " and nxt[9] == "no id here but text"
    t = fingerprints.with_tree(odd, "text", "t_")
    assert set(odd.columns) <= set(t.columns)
    roots = [(r.doc_id, r.t_root, r.n) for r in t.select("doc_id", "t_root", F.size("t_pieces").alias("n")).collect()]
    same = {r for i, r, _ in roots if i in (6, 7)}
    assert len(same) == 1
    assert len({r for _, r, _ in roots}) == 8  # null and empty are one text, 6 and 7 another
    assert fingerprints.with_next_text(empty).count() == 0
    one = spark.createDataFrame([(5, "alone")], "doc_id long, text string")
    assert fingerprints.with_next_text(one).first().next_text == "alone"


def test_fingerprint_pieces_make_up_the_text_and_locate_edits(spark):
    random.seed(3)
    lines = [" ".join(random.choice("alpha beta, gamma. delta!".split()) for _ in range(random.randint(0, 30))) for _ in range(60)]
    a = "\n".join(lines)
    b = "\n".join([*lines[:30], "changed line", *lines[31:]])
    df = spark.createDataFrame([(1, a, b)], "doc_id long, a string, b string")
    df = fingerprints.with_tree(fingerprints.with_tree(df, "a", "a_"), "b", "b_")
    r = fingerprints.differing_branches(df, "a_", "b_").select("*", fingerprints.likeness("a_pieces", "b_pieces").alias("like")).first()
    assert r.paragraphs_edited == [30] and 1 <= len(r.sections_edited) <= 2 and 0.8 < r.like < 1
    same = fingerprints.differing_branches(df, "a_", "a_").first()
    assert same.sections_edited == same.paragraphs_edited == []
    long = spark.createDataFrame([(1, a)], "doc_id long, a string").select(F.regexp_extract_all("a", F.lit(fingerprints._PIECES), F.lit(0)).alias("p")).first().p
    assert "".join(long) == a


def neighbours_are_in_order(rows):
    """Whether the next texts lead from the smallest id through all rows and back; ``rows``: (id, text, next text), texts all different."""
    by_text = {t: (i, n) for i, t, n in rows}
    assert len(by_text) == len(rows)
    at = start = min(rows, key=lambda r: (r[0] is not None, r[0] or 0))[1]
    ids = []
    for _ in rows:
        ids.append(by_text[at][0])
        at = by_text[at][1]
    assert at == start or ids[0] is None
    turn = next((k for k in range(1, len(ids)) if (ids[k] is not None, ids[k] or 0) < (ids[k - 1] is not None, ids[k - 1] or 0)), 0)
    ids = ids[turn:] + ids[:turn]  # rows of the first id may come before and after the place where the walk began
    return ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)


@pytest.mark.parametrize("hot", [None, 5, 2000])
def test_one_id_of_most_rows_is_many_ranges(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprints, "FEW", 40)
    rows = [(hot if k % 10 else k, f"text {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "text")
    got = [tuple(r) for r in fingerprints.with_next_text(df).collect()]
    assert sorted(t for _, t, _ in got) == sorted(t for _, t in rows) and neighbours_are_in_order(got)
    same = [(hot if k % 10 else k, "one text" if k % 3 else f"text {k}") for k in range(3000)]
    got = [tuple(r) for r in fingerprints.with_next_text(spark.createDataFrame(same, "doc_id long, text string")).collect()]
    assert len(got) == 3000 and Counter(t for _, t, _ in got) == Counter(n for _, _, n in got)
    assert sum(t != n for i, t, n in got if i == hot and t == "one text") <= 2  # the last of the id, and of those apart from it
    sizes = spark.createDataFrame(rows, "doc_id long, text string")
    plan = fingerprints.with_next_text(sizes)._jdf.queryExecution().toString()
    assert "__sub" in plan and "CartesianProduct" not in plan


def test_ranges_of_one_id_are_even(spark):
    """The largest partition of the files holds few times the rows of the median one."""
    docs = spark.createDataFrame([(None if k % 10 else k, f"text {k % 700}") for k in range(20_000)], "doc_id long, text string")
    path = scratch(spark, "even")
    orc_tokens.write_token_orc(docs, path, BYTE)
    sizes = sorted(r["count"] for r in spark.read.orc(path).groupBy("part").count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    back = orc_tokens.read_token_orc(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None] * 18_000 + list(range(0, 20_000, 10))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(back[:-1], back[1:], strict=True))


def test_near_duplicates(spark, odd, empty):
    got = neardup.near_duplicates(odd)
    assert got.count() == 11
    by = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert {(6, 2, 6, True), (7, 2, 6, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (None, 1, None, True)} <= by
    assert neardup.near_duplicates(empty).count() == 0
    unique = neardup.near_duplicates(odd.where("doc_id in (1, 4, 7)"))
    assert unique.where("kept").count() == 3


def test_near_duplicates_of_a_large_borderline_group(spark):
    """Hundreds of near copies around the threshold: components equal those of all pairs."""
    from tests.llm.test_contracts import near_components

    rnd = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(900):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(60)] = f"x{k}_{rnd.random()}"
        texts.append(" ".join(words))
    texts += [f"Short Text {k} and" for k in range(3)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    want = {i: (n, c) for i, n, c in near_components(list(range(len(texts))), texts)}
    assert got == want


def test_pruning_bounds():
    least = neardup.least_matches(0.75, 1e-6)
    assert list(least) == sorted(least) and all(0 < m < n * 0.75 for m, n in zip(least, (32, 64, 96, 128), strict=True))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (None, 5), (200, 201)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_secrets(spark, odd, empty):
    assert secrets.scan(odd).count() == 11 and secrets.scan(empty).count() == 0
    key = "AKIA" + "Q7" * 8
    pairs = [(k, f"use token = 'k3J9xQ2mZ7aB{k}' and {key} now. password=short secret=token: abcdefghijklmnop") for k in range(5)]
    rows = [(i, t, f"org{i}/repo") for i, t in pairs] + [(9, None, None), (10, "nothing", "org1/repo")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    kinds = [s.kind for s in got[0].base]
    assert kinds == ["assign", "access"]
    assert [(s.kind, s.v) for s in got[0].added] == [("live", "k3J9xQ2mZ7aB0"), ("copied", key)]
    assert got[9].base == [] and got[9].added == []
    masked = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert "k3J9" not in masked[0] and key in masked[0] and masked[0].startswith("use token = '[SECRET]' and ")
    assert masked[9] is None and masked[10] == "nothing"
    held = secrets.candidates(df)
    one = {r.n_owners: r for r in secrets.ownership(held).collect()}
    assert one[5].n_rows == 5 and one[5].n_repos == 5 and one[5].kind == "copied"


def test_spans_equal_python(spark):
    from tests.llm.test_contracts import base_spans

    rnd = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCD1234EFGH5678", "é", "/+-._", "\n", "x"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    for r in secrets.candidates(df).collect():
        assert [(s.s, s.k, s.e, s.kind) for s in r.found] == base_spans(texts[r.doc_id])


def test_top_k(spark):
    rows = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0]), (8, [-2.0, 3.0]), (None, [1.0, 1.0])]
    df = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    s = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 1, s), (0, 2, 100, s), (0, 3, 8, -2048 * 1024 + 3072 * 512), (100, 1, 0, s), (100, 2, 1, s), (100, 3, 8, -2048 * 1024 + 3072 * 512)]
    none = topk.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).count() == 0


def test_top_k_over_many_blocks_and_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BYTES", 2_000)
    rng = np.random.default_rng(9)
    x = rng.integers(-4, 4, (900, 5)) / 1024
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(k, x[k].tolist()) for k in range(0, 900, 7)] + [(3, [1.0, 2.0])]
    df = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 10).collect())
    want, y = [], np.rint(x * 1024).astype(np.int64)
    for q in range(0, 900, 20):
        s = y @ y[q]
        order = [c for c in np.lexsort((np.arange(900), -s)) if c != q][:10]
        want += [(q, r + 1, int(c), int(s[c])) for r, c in enumerate(order)]
    assert got == want


def test_vectors_whose_products_do_not_fit_have_no_score(spark):
    far = [float(2**40)] * 2
    edge = (9.2e18 / 2) ** 0.5 / 1024 - 1
    rows = [(0, [1.0, 1.0]), (100, far), (1, far), (2, [edge, edge]), (3, [-edge, -edge]), (200, [edge, edge])]
    df = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    big = int(edge * 1024 // 1)
    assert got == [(0, 1, 2, 2048 * big), (0, 2, 200, 2048 * big), (0, 3, 3, 2048 * int(-edge * 1024 // 1)), (200, 1, 2, 2 * big * big), (200, 2, 0, 2048 * big), (200, 3, 3, 2 * big * int(-edge * 1024 // 1))]


def test_nra_reads_less_than_the_product(sf):
    import pyarrow.parquet as pq

    v = pq.read_table(f"{sf.replace('sf0.01', 'sf0.1')}/embeddings.parquet").to_pandas()
    x = np.floor(np.stack(v.embedding).astype(np.float64) * 1024).astype(np.int64)
    at = np.flatnonzero(v.vec_id % 100 == 0)
    lists, best = topk.Lists(x), topk.Best(x[at], v.vec_id.to_numpy()[at], 10)
    best.meet(lists, v.vec_id.to_numpy())
    assert 0 < lists.read + lists.bounds + lists.scored < x.size * len(at)


def test_nra_equals_brute_force():
    rng = np.random.default_rng(5)
    for n, d, m in ((3000, 8, 20), (50, 3, 5), (5, 2, 3), (4000, 1, 6), (1, 4, 1)):
        x = rng.integers(-30, 30, (n, d))
        q = x[:m]
        rows, cands, score = topk.nra(x, np.arange(n), q, np.arange(m), 10)
        for k in range(m):
            s = x @ q[k]
            order = [c for c in np.lexsort((np.arange(n), -s)) if c != k][:10]
            assert cands[rows == k].tolist() == order and score[rows == k].tolist() == s[order].tolist()


def test_language(spark, odd, empty):
    none = langid.fit(empty)
    assert none.languages == ()
    assert {(r.lang_pred, r.score) for r in langid.predict(spark, odd, none).collect()} == {("und", 0.0)}
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model.languages == ("de", "en")
    got = langid.predict(spark, odd, model)
    assert got.count() == 11
    by = {r.doc_id: (r.lang_pred, r.score) for r in got.where("doc_id in (1, 2, 3, 8)").collect()}
    assert set(by.values()) == {("und", 0.0)}
    assert langid.predict(spark, empty, model).count() == 0


def folded(text):
    return langid.folded(*B.text_buffer(pa.array([text])))[0]


def test_language_slices_lose_no_grams(monkeypatch):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("abc de") for _ in range(n)) for n in (0, 1, 5, 6, 7, 12, 13, 50, 99)]
    want = [langid.gram_counts(folded(t)) for t in texts]
    for size in (1, 2, 7, 8):
        monkeypatch.setattr(langid, "_SLICE", size)
        assert all((langid.gram_counts(folded(t)) == w).all() for t, w in zip(texts, want, strict=True))


def test_language_beyond_the_first_plane(spark):
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de")], "text string, lang string"))
    df = spark.createDataFrame([(1, "🙂🙃 🚀"), (2, "𝟘𝟙 🎉!"), (3, "𐐀𐐁"), (4, "the🙂cat")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark, df, model).collect()}
    assert got[1] == got[2] == ("und", 0.0)
    assert got[3][0] != "und" and got[4][0] == "en"
    assert folded("the🙂cat").tolist() == folded("the cat").tolist()
    assert folded("𐐀").tolist() == folded("𐐨").tolist()


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    d = quality.describe(odd)
    flat = quality.fit(d, labels)
    assert {r.score for r in quality.score(spark, d, flat).collect()} == {0.5}
    marks = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (6, None), (None, 1), (2, 0)], "doc_id long, quality int")
    got = quality.score(spark, d, quality.fit(d, marks))
    assert got.count() == 11 and got.where("score between 0 and 1").count() == 11
    assert quality.score(spark, quality.describe(empty), flat).count() == 0
    v = quality.pool_adjacent_violators(np.array([0.1, 0.5, 0.3, 0.9, 0.2, 1.0]), np.array([1, 1, 1, 0, 2, 1.0]))
    assert (np.diff(v) >= 0).all() and v[0] == 0.1 and v[-1] == 1.0


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return room


def test_packing_equals_piecewise_best_fit():
    rnd = random.Random(6)
    for capacity in (1, 7, 50, 128):
        for n in (0, 1, 40, 400):
            lengths = [rnd.randint(1, capacity) for _ in range(n)]
            counts = {}
            for x in lengths:
                counts[x] = counts.get(x, 0) + 1
            runs, bins = packing.best_fit_decreasing(counts, capacity)
            used = {}
            for r in runs:
                for k in range(r.rank_end - r.rank):
                    b, at = r.bin + k // r.each, r.offset + k % r.each * r.length
                    used.setdefault(b, []).append((at, r.length))
            assert sum(r.rank_end - r.rank for r in runs) == n and len(used) == bins
            room = []
            for pieces in used.values():
                end = 0
                for at, size in sorted(pieces):
                    assert at == end
                    end += size
                room.append(capacity - end)
            assert sorted(room) == sorted(plain_best_fit(lengths, capacity))
    with pytest.raises(ValueError):
        packing.best_fit_decreasing({5: 1}, 4)


def test_capacity_tree():
    t = packing.CapacityTree(37)
    rnd, held = random.Random(1), set()
    for _ in range(2000):
        k = rnd.randint(0, 37)
        t.set(k, k not in held)
        held ^= {k}
        need = rnd.randint(0, 37)
        assert t.tightest(need) == min((x for x in held if x >= need), default=None)


def test_packing_rows(spark, odd, empty):
    pieces = packing.token_pieces(odd, WORD).drop("ids")
    got = packing.pack(pieces)
    assert got.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset"]
    assert got.select("doc_id").distinct().count() == 10 and got.where("length = 1").count() == 4
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert packing.pack(packing.token_pieces(empty, WORD).drop("ids")).count() == 0


def test_orc_files(spark, odd, empty, tmp_path):
    import glob

    import pyarrow.orc as orc

    path = str(tmp_path / "t")
    orc_tokens.write_token_orc(odd, path, BYTE)
    rows = orc_tokens.read_token_orc(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows][:3] == [None, 1, 2] and len(rows) == 11
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 2
        at += r.n_tokens
    picked = orc_tokens.read_token_orc(spark, path, [7])
    assert [r.doc_id for r in picked.collect()] == [7]
    assert "PushedFilters: [In(doc_id" in picked._jdf.queryExecution().toString() or "EqualTo(doc_id,7)" in picked._jdf.queryExecution().toString()
    f = orc.ORCFile(glob.glob(f"{path}/*.orc")[0])
    assert f.compression == "ZSTD" and f.row_index_stride == orc_tokens.ROW_STRIDE
    orc_tokens.write_token_orc(empty, str(tmp_path / "e"), BYTE)
    assert orc_tokens.read_token_orc(spark, str(tmp_path / "e")).count() == 0


def test_byte_bpe(spark, odd, empty):
    got = byte_bpe.decode(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN, offsets=True), RANKS).collect()
    want = sorted((t or "") for t in [r.text for r in odd.collect()])
    assert sorted(bytes(r.decoded).decode() for r in got) == want
    for r in got:
        text = bytes(r.decoded).decode()
        assert len(r.starts) == len(r.ends) == len(r.ids)
        if text:
            assert r.starts[0] == 0 and r.ends[-1] == len(text) and all(a <= b for a, b in zip(r.starts, r.ends, strict=True))
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(nulls, RANKS).collect()} == {1: None, 2: bytearray()}


def test_split_characters_cover_their_character():
    text = np.frombuffer("a🙂b".encode(), np.uint8)
    starts, ends = byte_bpe.character_offsets(text, np.array([1, 2, 2, 1]))
    assert starts.tolist() == [0, 1, 1, 2] and ends.tolist() == [1, 2, 2, 3]


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_segments_equal_the_library(path, spaced):
    rnd = random.Random(7)
    letters = list("aAbB zé  \n\n\t.,'s!|#12ß’ İΣσḰ\x1c´x̱中🙂  　") + ["'s", "'ll", " Foo", "don't", "\r\n", "  ", "<|endoftext|>", "w" * 70]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(3000)] + ["", " ", "a ", " a"]
    e = segments.encoder(path, spaced)
    want = [x.ids for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # then from what it remembers
        ids, counts = e.encode(*B.text_buffer(pa.array(texts)))
        ends = np.cumsum(counts)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)] == want


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_added_tokens_equal_the_unaltered_library(path, spaced):
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "one", " two", "  ", "\n", "é", "!", "<", "|>", " ", "'s"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8))) for _ in range(3000)] + ["one two<|endoftext|>three", "<|endof", "text|>", "", "", "<|endoftext|>", "a" * 70 + "<|endoftext|>"]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert any((49407 if path == WORD else 50256) in x for x in want)
    e = segments.encoder(path, spaced)
    for _ in range(2):
        ids, counts = e.encode(*B.text_buffer(pa.array(texts)))
        ends = np.cumsum(counts)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)] == want


def test_words_and_hashes():
    texts = ["One two", None, "", "three", "  A\x0bB  "]
    data, offs = B.text_buffer(pa.array(texts))
    starts, ends, first = B.words_of(data, offs)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"One", b"two", b"three", b"A", b"B"]
    assert np.diff(first).tolist() == [2, 0, 0, 1, 2]
    h = B.spans_hash(data, starts, ends)
    assert len(set(h.tolist())) == 5
    sliced = pa.array(["skip", *texts]).slice(1)
    assert (B.text_buffer(sliced)[1] == offs).all()


def test_html():
    x = html_layout.extract_text
    assert x(None) == x("") == ""
    assert x("<p>One<p>Two<br>three") == "One\n\nTwo\nthree"
    assert x("<ul><li>a<li>b<ol start=3><li>c</ol></ul>x") == "- a\n- b\n  3. c\n\nx"
    assert x("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b</td></table>") == "Name      | N\nlong name | 1\nb         |"
    assert x("<div hidden>no</div><p style='display: none'>no</p><script>no</script><span style='color:red'>yes</span><!-- no -->") == "yes"
    assert x("<pre>a  b\n c</pre>") == "a  b\n c"
    assert x("<details><summary>S</summary>inside</details>") == "S"
    assert x("&lt;b&gt; &amp; &eacute;") == "<b> & é"
    assert x("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>") == "r | 1\n  | 2"
    assert x("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert x("<b>x</p></b></table>y<td>z").split() == ["x", "y", "z"]
    assert "<" not in x("<p>text <b>unclosed <i>tags <a href='x'>here")


def test_html_goes_on_after_broken_declarations():
    x = html_layout.extract_text
    assert x("<p>before</p><![foo[ bar ]]><p>after</p>") == "before\n\nafter"
    assert x("<p>a</p><![ x<p>after</p>b").split() == ["a", "after", "b"]
    assert x("<p>a</p><![endif]--><p>b</p><![if x]>c") == "a\n\nb\n\nc"
    assert x("<p>a</p><![ x") == "a"
    rnd = random.Random(3)
    bits = ["<!", "<![", "[", "]", "]]>", ">", "-", "--", "<", "</", "<?", "a", "IF", "CDATA", "cdata[", " ", "'", '"', "=", "/", "&", "#", ";", "<p", "<script>", "</script"]
    for _ in range(5000):
        soup = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12)))
        assert x(f"<p>first</p>{soup}").startswith("first")


def test_html_omitted_head_end():
    x = html_layout.extract_text
    assert x("<head><title>T</title>Hello <b>world</b> <a href=x>link</a><p>more") == "Hello world link\n\nmore"
    assert x("<head>\n<meta charset=utf-8>\n<title>T</title>\n<style>s</style><script>s</script>\n<a href=x>link</a> text") == "link text"
    assert x("<head><title>T</title><img alt=pic> a") == "pic a" and x("<head><title>T</title></br>a") == "a"
    assert x("<head><title>T</title><meta name=x></head><body>b") == "b" and x("<p>x<head>y") == "xy"


def test_html_drawings_and_formulas():
    x = html_layout.extract_text
    assert x("a <svg viewBox='0 0 1 1'><title>t</title><desc>d</desc><defs><text>no</text></defs><g><text x=1>One <tspan>two</tspan></text><text>three</text></g>loose</svg> b") == "a One two three b"
    assert x("<p>n <math><mi>x</mi><mo>=</mo><mn>1</mn></math> m") == "n x=1 m"
    assert x("<math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math>") == "y"
    assert x("<annotation>stays</annotation>") == "stays"
    assert x("<svg><foreignObject><div>in</div></foreignObject></svg>") == "in"
    assert x("<svg><path d='M0'><p>after an open drawing") == "after an open drawing"
    assert x("<svg><text><![CDATA[a > b]]></text></svg>") == "a > b"
    assert x("<pre>p <svg><desc>d</desc><text>q</text></svg></pre>") == "p q"
    assert x("<table><tr><td><svg><text>cell</text></svg><td>2</table>") == "cell | 2"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", 5), (None, None, None, None), (1, "u", "<p>a", 5)], "page_id long, url string, html string, text int")
    got = html_layout.extract(df).collect()
    assert sorted((r.page_id or 0, r.url, r.text) for r in got if r.page_id) == [(1, "u", "a"), (1, "u", "a")] and len(got) == 3
    assert html_layout.extract(df.limit(0)).count() == 0


def test_tree_sum_over_many_parts(spark):
    parts = spark.range(300).repartition(7).selectExpr("id as part", "cast(null as binary) as packed")
    packed = parts.mapInPandas(lambda bs: (b.assign(packed=[np.array([1.0, k]).tobytes() for k in b["part"]]) for b in bs), "part long, packed binary")
    assert quality._tree_sum(packed, 300, width=4).tolist() == [300.0, 300 * 299 / 2]
    assert quality._tree_sum(packed.limit(0), 1) is None


CLASHING = "score double, predicted string, lang_pred int, offset string, sequence_id string, `Offset2` int, __row int, __row_ string, __live string, __lang string, c0 int, len int, rank int, decoded int, t_root int, t_lines string, `LEN_` int"


@pytest.fixture(scope="module")
def clashing(spark):
    """Two columns that matter and many whose names operators use themselves; null and repeated ids, null and empty texts."""
    texts = [(1, "the cat and the dog of the house"), (1, "the cat and the dog of the house"), (2, None), (None, "words without an id, token = q8Zr2LkV9wXcT4bN"), (3, ""), (4, "der Hund und die Katze " * 9)]
    rest = (0.5, "p", 7, "o", "q", 1, 2, "r", "l", "g", 3, 4, 5, 6, 7, "t", 8)
    rows = [(i, t, "en" if k % 2 else "de", "a/b", len(t or ""), *rest) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def test_operators_take_any_column_names(spark, clashing):
    rest = ("p", 7, "o", "q")
    model = langid.fit(clashing)
    got = langid.predict(spark, clashing, model, keep=tuple(clashing.columns))
    assert [c for c in got.columns if c not in ("lang_pred", "score")] == [c for c in clashing.columns if c not in ("lang_pred", "score")]
    assert {type(r.lang_pred) for r in got.collect()} == {str}
    flat = quality.fit(quality.describe(clashing), spark.createDataFrame([], "doc_id long, quality int"))
    scored = quality.score_texts(spark, clashing, flat)
    assert {(r.score, r.predicted) for r in scored.collect()} == {(0.5, 0)} and len(scored.columns) == len(clashing.columns)
    pieces = packing.token_pieces(clashing, WORD).drop("ids").withColumns({"offset": F.lit("o"), "sequence_id": F.lit("s"), "c0": F.lit(1), "row": F.lit(2), "part": F.lit(3), "len": F.lit(4)})
    packed = packing.pack(pieces)
    assert packed.count() == 6 and dict(packed.dtypes)["offset"] == "bigint" and {(r.c0, r.row, r.part, r.len) for r in packed.collect()} == {(1, 2, 3, 4)}
    tree = fingerprints.with_tree(clashing, "text", "t_")
    assert len({r.t_root for r in tree.collect()}) == 4 and {r.t_lines for r in tree.collect()} == {"t"}
    masked = secrets.redact(clashing)
    assert masked.columns == clashing.columns and masked.count() == 6 and {tuple(r)[6:10] for r in masked.collect()} == {rest}
    assert neardup.without_near_duplicates(clashing).columns == clashing.columns
    pages = spark.createDataFrame([(1, "<p>a", "x", 5)], "page_id long, html string, text string, url int")
    assert [tuple(r) for r in html_layout.extract(pages, keep=("url", "text", "page_id")).collect()] == [(1, 5, "a")]
    coded = byte_bpe.decode(byte_bpe.encode(clashing, RANKS, public_tokenizers.PATTERN).withColumn("decoded", F.lit(1)), RANKS)
    assert coded.columns == ["doc_id", "ids", "decoded"] and dict(coded.dtypes)["decoded"] == "binary"


def test_stages_take_any_column_names_nulls_repeats_and_empty_tables(spark, clashing, sf, monkeypatch):
    import corpus_pipeline as P

    n = {}
    for name, stage in P.STAGES[:-1]:
        got, none = stage(spark, clashing, sf), stage(spark, clashing.limit(0), sf)
        assert got.columns == clashing.columns == none.columns and got.dtypes == clashing.dtypes
        assert none.count() == 0
        n[name] = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in got.collect())
    assert len(n["language ID"]) == 4 and (2, "") not in n["language ID"]
    assert n["near-duplicates"] == [(0, "words wit"), (1, "the cat a"), (2, ""), (3, ""), (4, "der Hund ")]
    assert len(n["secret scan"]) == 6
    packed = P.packing_stage(spark, clashing, sf)
    assert packed.count() == 6 and P.packing_stage(spark, clashing.limit(0), sf).count() == 0
