"""The ten queries over whole small tables, held against plain Python versions."""

import base64
import hashlib
import re
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from corpuslake.llm import queries as Q


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas().sort_values("doc_id").reset_index(drop=True)


def rows(df):
    return df.toPandas()


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_op1(spark, sf, docs):
    got = rows(Q.op1_fingerprints(spark, sf)).set_index("doc_id")
    texts = docs.text.tolist()
    for k, (i, t) in enumerate(zip(docs.doc_id, texts, strict=True)):
        nxt = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        assert got.n_chars[i] == len(t)
        assert got.edited_sha256[i] == sha(t[: len(t) - half] + nxt[:half])
    by = {}
    for i, t in zip(docs.doc_id, texts, strict=True):
        assert by.setdefault(t, got.fingerprint[i]) == got.fingerprint[i]
    assert len(set(by.values())) == len(by)
    assert ((got.paragraphs_edited == 0) == (got.fingerprint == got.edited_fingerprint)).mean() > 0.99 and ((got.sections_edited == "") == (got.fingerprint == got.edited_fingerprint)).mean() > 0.99
    assert (got.sections_edited.str.count(",") + (got.sections_edited != "") <= got.paragraphs_edited).mean() > 0.9
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got.near_edited.mean() > got.near_next.mean() + 0.2


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_components(ids, texts):
    sets = [shingles(t) for t in texts]
    at = defaultdict(list)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        seen = defaultdict(int)
        for x in s:
            for j in at[x]:
                seen[j] += 1
            at[x].append(k)
        for j, n in seen.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return [(i, len(sets[k]), least[find(k)]) for k, i in enumerate(ids)]


def test_op2(spark, sf, docs):
    got = rows(Q.op2_near_duplicates(spark, sf)).set_index("doc_id")
    for i, n, c in near_components(docs.doc_id.tolist(), docs.text.tolist()):
        assert (got.n_shingles[i], got.component_id[i], got.kept[i]) == (n, c, c == i)


def base_spans(text):
    out = []
    rx = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(rx, text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_op3(spark, sf, docs):
    got = rows(Q.op3_secret_scan(spark, sf)).set_index("doc_id")
    hits = 0
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        want = base_spans(t)
        hits += len(want)
        parts = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert got.base_sha256[i] == sha(",".join(parts))
        assert [got.n_assign[i], got.n_access[i], got.n_hex[i]] == [sum(w[1] == k for w in want) for k in range(3)]
        assert set(parts) <= set(got.spans[i].split(",")) | {""}
    assert hits and got.n_live.sum()


def test_op4(spark, sf):
    import numpy as np

    v = pq.read_table(f"{sf}/embeddings.parquet").to_pandas()
    x = np.floor(np.stack(v.embedding).astype(np.float64) * 1024).astype(np.int64)
    want = []
    for q in np.flatnonzero(v.vec_id % 100 == 0):
        s = x @ x[q]
        order = [c for c in np.lexsort((v.vec_id, -s)) if c != q][:10]
        want += [(int(v.vec_id[q]), r + 1, int(v.vec_id[c]), int(s[c])) for r, c in enumerate(order)]
    got = rows(Q.op4_top_k(spark, sf))
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == sorted(want)


def test_op5_held_out_accuracy(spark, sf, docs):
    got = rows(Q.op5_language_id(spark, sf)).merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_op6(spark, sf):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pandas()
    got = rows(Q.op6_html_layout(spark, sf))
    assert sorted(got.page_id) == sorted(pages.page_id)
    assert (got.text.str.len() > 0).mean() > 0.9
    assert not got.text.str.contains("<script|</", regex=True).any()


def test_op7_held_out_accuracy(spark, sf, docs):
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    got = rows(Q.op7_quality(spark, sf))
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.97


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(got, ids_of, capacity=4096):
    total = 0
    for i, ids in ids_of.items():
        pieces = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.tolist() == [len(p) for p in pieces]
        assert mine.start.tolist() == [k * capacity for k in range(len(pieces))]
        assert mine.ids_crc32.tolist() == [zlib.crc32(struct.pack(f"<{len(p)}I", *p)) for p in pieces]
        total += len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= capacity
    return -(-total // capacity)


def test_op8(spark, sf, docs, word_tokenizer):
    got = rows(Q.op8_best_fit_packing(spark, sf))
    ids = {i: [*e.ids, 1] for i, e in zip(docs.doc_id, word_tokenizer.encode_batch_fast(docs.text.tolist(), add_special_tokens=False), strict=True)}
    least = check_packing(got, ids)
    assert got.sequence_id.nunique() <= least * 1.02 + 1


def test_op9(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(Q.op9_token_orc(spark, sf)).set_index("doc_id")
    start = 0
    for i, e in zip(docs.doc_id, t.encode_batch_fast(docs.text.tolist(), add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        assert (got.start[i], got.n_tokens[i], got.ids_crc32[i]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op10(spark, sf, docs):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(Q.op10_byte_bpe(spark, sf)).set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = t.encode_ordinary(text)
        assert (got.n_tokens[i], got.ids_sha256[i], got.decoded_sha256[i]) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_registered_sql_agrees(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in Q.ORACLE_SQL.items():
        want = con.execute(sql).fetchdf()
        got = rows(Q.QUERIES[name](spark, sf))
        assert sorted(got.columns) == sorted(want.columns)
        order = list(want.columns)
        assert sorted(map(tuple, got[order].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
