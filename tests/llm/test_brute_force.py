"""Operators that SQL cannot express, held against plain versions on every row."""

import html as H
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B
from corpuslake.llm import html_layout, langid, neardup, quality, queries, secrets
from corpuslake.operators import skew

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SMALL}/documents.parquet").to_pandas().sort_values("doc_id").reset_index(drop=True)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


# -- op5: multinomial naive Bayes over dictionaries -------------------------
def grams(text):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    padded = re.sub(" +", " ", f" {letters} ")
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            g = padded[k : k + n]
            if n == 1 and g == " ":
                continue
            if n == 1:
                h = ord(g) * 0x9E3779B1 + 1
            else:
                h = n
                for c in g:
                    h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
                    h ^= h >> 15
                h *= 0x9E3779B1
            out[(h & 0xFFFFFFFF) >> 18] += 1
    return out, padded.strip() != ""


def plain_languages(rows):
    """(id, language, score) of rows (id, text, lang), learned from those that are not held out."""
    counts, of = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if not held(i) and text is not None and lang is not None:
            counts[lang] += grams(text)[0]
            of[lang] += 1
    langs = sorted(of)
    total = {x: sum(counts[x].values()) for x in langs}
    out = []
    for i, text, _ in rows:
        got, letters = grams(text)
        if not letters or not langs:
            out.append((i, "und", 0.0))
            continue
        root = math.sqrt(max(sum(got.values()), 1))
        logs = {}
        for x in langs:
            likely = sum(n * (math.log(counts[x][g] + 0.5) - math.log(total[x] + 0.5 * 16384)) for g, n in got.items())
            logs[x] = likely / root + math.log(of[x] / sum(of.values()))
        top = max(logs.values())
        weight = {x: math.exp(v - top) for x, v in logs.items()}
        best = max(langs, key=lambda x: weight[x])
        out.append((i, best, weight[best] / sum(weight.values())))
    return out


def test_op5_equals_plain_naive_bayes(spark, docs):
    got = {r.doc_id: r for r in queries.op5_language_id(spark, SMALL).collect()}
    want = plain_languages(list(zip(docs.doc_id, docs.text, docs.lang, strict=True)))
    assert len(got) == len(want)
    for i, lang, score in want:
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4) and got[i].held_out == held(i)


def test_language_in_slices_equals_plain_naive_bayes(spark, monkeypatch):
    rnd = random.Random(2)
    words = "the cat der Hund le chat el perro ÀÉ Straße 12 !? 🙂 𐐀 İ".split()
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 60]))), rnd.choice(["a", "b", "c", None])) for k in range(300)] + [(300, None, "a"), (301, "", "b")]
    monkeypatch.setattr(langid, "_CHUNK", 150)
    monkeypatch.setattr(langid, "_SLICE", 40)
    texts, langs = pa.array([t for i, t, x in rows if x is not None and t is not None and not held(i)]), [x for i, t, x in rows if x is not None and t is not None and not held(i)]
    sums = defaultdict(Counter)
    for b in langid._count(iter([pa.RecordBatch.from_arrays([texts, pa.array(langs)], ["t", "l"])])):
        for lang, bucket, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums[lang][bucket] += n
    plain = defaultdict(Counter)
    for t, x in zip(texts.to_pylist(), langs, strict=True):
        plain[x] += grams(t)[0]
        plain[x][-1] += 1
    assert sums == plain


# -- op7: ridge over random Fourier features, pooled adjacent violators -----
def plain_statistics(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not data:
        return [0.0] * 16
    n, w = len(data), max(len(words), 1)
    share = lambda chars: sum(c in chars for c in data) / n
    letters = {*range(65, 91), *range(97, 123), *range(128, 256)}
    points = set(b".,;:'\"()-?")
    symbols = {c for c in range(33, 127) if c not in letters and c not in points and not 48 <= c < 58}
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w
    spread = math.sqrt(max(sum(s * s for s in sizes) / w - mean * mean, 0))
    count = Counter(words)
    return [
        math.log1p(n), math.log1p(len(words)), mean, spread, share(letters), share(range(65, 91)), share(range(48, 58)), share(b" \t\n\x0b\x0c\r"), share(b"\n"), share(points), share(symbols),
        sum(any(c in symbols for c in x) for x in words) / w, sum(2 * sum(65 <= c < 91 for c in x) > len(x) for x in words) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        math.log(max(len(count), 1)) / math.log(w + 1), max(count.values(), default=0) / w,
    ]


def plain_isotonic(value, weight):
    """The max-min formula over the entries that have weight; the others take the next one's value, or the last one's."""
    at = [k for k, w in enumerate(weight) if w > 0]
    v, w = np.array([value[k] for k in at]), np.array([weight[k] for k in at])
    s, t = np.concatenate([[0], np.cumsum(v * w)]), np.concatenate([[0], np.cumsum(w)])
    mean = lambda i, j: (s[j + 1] - s[i]) / (t[j + 1] - t[i])
    fit = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    return np.array([fit[min(np.searchsorted(at, k), len(at) - 1)] for k in range(len(value))])


def test_pooling_equals_the_max_min_formula():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        value, weight = rng.random(n), rng.integers(0, 3, n).astype(float)
        if weight.any():
            assert np.allclose(quality.pool_adjacent_violators(value, weight), plain_isotonic(value, weight))


def test_op7_equals_plain_ridge(spark, docs):
    x = np.array([plain_statistics(t) for t in docs.text], np.float32).astype(np.float64)
    labels = pq.read_table(f"{SMALL}/labels.parquet").to_pandas().groupby("doc_id").quality.mean()
    fold = {r.doc_id: r.f for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("f")).collect()}
    train = [k for k, i in enumerate(docs.doc_id) if i in labels.index and not held(i)]
    y, folds = np.array([labels[docs.doc_id[k]] for k in train]), np.array([fold[docs.doc_id[k]] for k in train])
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(11)
    directions, phases = rng.normal(0, math.sqrt(2 * 0.02), (16, 192)), rng.uniform(0, 2 * math.pi, 192)

    def waves(rows):
        z = np.clip((rows - mean) / scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), np.cos(z @ directions + phases) * math.sqrt(2 / 192)], axis=1)

    def ridge(f, t):
        penalty = np.full(193, 1e-3 * len(f))
        penalty[0] = 1e-9
        return np.linalg.solve(f.T @ f + np.diag(penalty), f.T @ t)

    f = waves(x[train])
    bins = lambda raw: np.clip(((raw + 0.5) / 2 * 400).astype(int), 0, 399)
    n, ones = np.zeros(400), np.zeros(400)
    for q in range(3):
        at = bins(f[folds == q] @ ridge(f[folds != q], y[folds != q]))
        np.add.at(n, at, 1)
        np.add.at(ones, at, y[folds == q])
    steps = plain_isotonic(np.divide(ones, n, out=np.zeros(400), where=n > 0), n)
    want = steps[bins(waves(x) @ ridge(f, y))]
    got = queries.op7_quality(spark, SMALL).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert np.abs(got.score.to_numpy() - want).max() < 1e-6
    assert (got.predicted == (want >= 0.7)).all() and (got.held_out == [held(i) for i in docs.doc_id]).all()


def test_statistics_equal_plain_ones():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aB 1.\n#é中\t-'") for _ in range(rnd.randint(0, 60))) for _ in range(500)] + ["", " ", "a a a a", None]
    got = quality.statistics(*B.text_buffer(pa.array(texts)))
    assert np.allclose(got, np.array([plain_statistics(t) for t in texts]), atol=1e-5)


# -- op6: a second, simple renderer -----------------------------------------
def plain_page(page):
    """Lines of a page of the test tables: flat blocks, one list of items, breaks, hidden parts; by patterns, not by a tree."""
    page = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style)>.*?</\1>", "", page)
    out, blank, item, paragraph = [], False, False, False
    line = ""

    def end(asked):
        nonlocal line, blank, item
        text = re.sub(r"[ \t\n\r\f]+", " ", H.unescape(line)).strip(" ")
        line = ""
        if text:
            if blank and out:
                out.append("")
            blank = False
            out.append(("- " if item else "") + text)
            item = False
        blank |= asked

    for bit in re.split(r"(<[^>]*>)", page):
        tag = re.fullmatch(r"<(/?)([a-z0-9]+)[^>]*>", bit)
        if not tag:
            line += bit
        elif tag[2] in ("p", "ul", "h1", "h2", "h3"):
            end(True)
            paragraph = tag[2] == "p" and not tag[1]
        elif tag[2] == "li":
            end(False)
            item = not tag[1]
        elif tag[2] in ("body", "html", "div", "article", "footer", "nav"):
            end(paragraph)  # ends an open paragraph
            paragraph = False
        elif tag[2] == "br":
            if line.strip():
                end(False)
            else:
                blank |= bool(out)
    end(False)
    return "\n".join(out)


def test_op6_equals_a_plain_renderer(spark, sf):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pandas()
    got = {r.page_id: r.text for r in queries.op6_html_layout(spark, sf).collect()}
    assert len(got) == len(pages)
    for i, page in zip(pages.page_id, pages.html, strict=True):
        assert got[i] == plain_page(page)


def made(rnd, depth):
    """(html, lines) of a random block; lines of a spaced block stand apart."""
    kind = rnd.choice(["p", "div", "ul", "ol", "table", "hidden", "pre", "quote"] if depth else ["p", "hidden", "pre"])
    word = lambda: "".join(rnd.choice("abcdé&<") for _ in range(rnd.randint(1, 6)))
    if kind == "p":
        words = [word() for _ in range(rnd.randint(1, 5))]
        return "<p>" + " \n ".join(f"<b>{H.escape(w)}</b>" if rnd.random() < 0.3 else H.escape(w) for w in words) + "</p>", [("block", [" ".join(words)])]
    if kind == "pre":
        lines = [word() + "  " + word() for _ in range(rnd.randint(1, 3))]
        return "<pre>" + H.escape("\n".join(lines)) + "</pre>", [("block", lines)]
    if kind == "hidden":
        inner, _ = made(rnd, max(depth - 1, 0))
        if rnd.random() < 0.3:
            seen, unseen = word(), rnd.choice(["<p>{}</p>", "<pre>{}</pre>", "<ul><li>{}</ul>", "<table><tr><td>{}</table>"]).format(H.escape(word()))
            return f'<div style="visibility:hidden">{unseen}<p style="visibility:visible">{H.escape(seen)}</p>{unseen}</div>', [("block", [seen])]
        how = rnd.choice(['<div hidden>{}</div>', '<section style="display:none">{}</section>', "<template>{}</template>", "<!-- {} -->"])
        return how.format(inner.replace("--", "")), []
    if kind == "div":
        parts = [made(rnd, depth - 1) for _ in range(rnd.randint(1, 3))]
        return "<div>" + "".join(p[0] for p in parts) + "</div>", [b for p in parts for b in p[1]]
    if kind == "quote":
        inner, blocks = made(rnd, depth - 1)
        return f"<blockquote>{inner}</blockquote>", [("block", ["  " + x if x else "" for x in joined(blocks)])] if blocks else []
    if kind == "table":
        cells = [[word() for _ in range(3)] for _ in range(rnd.randint(1, 3))]
        wide = [max(len(r[k]) for r in cells) for k in range(3)]
        lines = [" | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in cells]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{H.escape(c)}" + rnd.choice(["", "</td>"]) for c in r) for r in cells) + "</table>", [("block", lines)]
    items = [[word() for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 4))]
    lines = [(f"{k}. " if kind == "ol" else "- ") + " ".join(ws) for k, ws in enumerate(items, 1)]
    return f"<{kind}>" + "".join(f"<li>{H.escape(' '.join(ws))}" + rnd.choice(["", "</li>"]) for ws in items) + f"</{kind}>", [("block", lines)]


def joined(blocks):
    out = []
    for _, lines in blocks:
        out += [""] * bool(out) + lines
    return out


def test_html_equals_pages_made_with_their_text():
    rnd = random.Random(10)
    for _ in range(2000):
        parts = [made(rnd, 3) for _ in range(rnd.randint(1, 4))]
        page = "<!DOCTYPE html><title>t</title><body>" + "\n".join(p[0] for p in parts)
        assert html_layout.extract_text(page) == "\n".join(joined([b for p in parts for b in p[1]]))


def test_html_of_any_depth_hides_what_is_hidden():
    x = html_layout.extract_text
    for depth in (1, 150, 300, 5000):
        assert x("<div>" * depth + "<div hidden><span>SECRET <b>too</b></span></div>seen") == "seen"
        assert x("<svg>" + "<g>" * depth + "<defs><text>no</text></defs><text>yes</text>") == "yes"
    rows = x("<table><tr><td>a<td>" * 300 + "deep").split("\n")
    assert rows == [" | ".join(["a"] * 300 + ["deep"])]
    for depth in (40, 100, 300):
        assert x("<ul><li>a" * depth).split("\n")[-1] == "  " * (depth - 1) + "- a"


def plain_table(rnd):
    """(html, lines) of a table with spans, its cells placed one by one on a grid of places."""
    n, taken, cells, page = rnd.randint(1, 6), set(), {}, []
    for r in range(n):
        c = 0
        row = []
        for _ in range(rnd.randint(0, 4)):
            while (r, c) in taken:
                c += 1
            wide, tall = rnd.choice([1, 1, 2, 3]), rnd.choice([1, 1, 2, 3, 7])
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5)))
            said = [f' colspan="{wide}"' if wide > 1 else "", f' rowspan="{tall}"' if tall > 1 else ""]
            row.append(f"<td{said[0]}{said[1]}>{word}")
            if word:
                cells[r, c] = word
            free = 0
            while free < wide and (r, c + free) not in taken:  # a span from above keeps its columns
                free += 1
            for k in range(tall if tall > 1 else 1):
                taken |= {(r + k, c + j) for j in range(free)}
            c += wide
        page.append("<tr>" + "".join(row) + "</tr>")
    used = sorted({c for _, c in cells})
    width = {c: max(len(w) for (_, d), w in cells.items() if d == c) for c in used}
    lines = [" | ".join(cells.get((r, c), "").ljust(width[c]) for c in used).rstrip() for r in range(n) if any((r, c) in cells for c in used)]
    return "<table>" + "".join(page) + "</table>", lines


def test_spans_equal_cells_placed_one_by_one():
    rnd = random.Random(12)
    for _ in range(2000):
        page, lines = plain_table(rnd)
        assert html_layout.extract_text(page).split("\n") == "\n".join(lines).strip("\n").split("\n"), page
    x = html_layout.extract_text
    far = x("<table><tr><td rowspan=70000>A<td>1</tr>" + "".join(f"<tr><td>{k}</tr>" for k in range(2, 3000)) + "</table>").split("\n")
    assert far[0] == "A | 1" and far[2998] == "  | 2999" and len({len(line) for line in far}) <= 4
    assert x("<table><tbody><tr><td rowspan=0>A<td>1<tr><td>2<tbody><tr><td>3<td>4</table>") == "A | 1\n  | 2\n3 | 4"
    assert x("<table><tr><td colspan='2px'>a<td>b<tr><td>c<td>d<td>e</table>") == "a |   | b\nc | d | e"


def test_the_layout_is_linear_in_the_page():
    x = html_layout.extract_text
    wide = "<table><tr><td>" + "w" * 80_000 + "<td>b</tr>" + "<tr><td>a<td>b</tr>" * 800 + "</table>"
    lines = x(wide).split("\n")
    assert len("\n".join(lines)) < 2 * len(wide) and lines[0] == "w" * 80_000 + " | b" and lines[1] == "a | b"
    many = "<table><tr>" + "<td colspan=1000>a" * 2000 + "</table>"
    tracemalloc.start()
    assert x(many) == " | ".join(["a"] * 2000)
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    n = 2000
    held = "<table><tr>" + "<td rowspan=65534>a" * n + "</tr>" + "<tr><td>b" * n + "</table>"
    assert len(x(held)) < 2 * len(held)
    deep = "<ul><li>a" * 20_000
    assert len(x(deep)) < (2 * html_layout.INDENT + 2 * html_layout.LEVELS) * len(deep)


def test_visibility_is_inherited_and_taken_back():
    x = html_layout.extract_text
    assert x('<div style="visibility:hidden">h<span style="visibility:visible">SEEN</span>h<p>no<b style="visibility: visible">also</b></p></div>') == "SEEN\n\nalso"
    assert x('<div style="display:none"><p style="visibility:visible;display:block">no</p></div>yes') == "yes"
    assert x('<body style="visibility:hidden">a<ul><li>b<li style="visibility:visible">c</ul><table><tr><td>d<td style="visibility:visible">e</table><pre>f</pre><img alt="g"><hr>') == "- c\n\ne"
    assert x('<pre style="visibility:hidden">a\n<b style="visibility:visible">b</b></pre><p>c') == "b\n\nc"


def test_comments_and_elements_that_hold_text():
    x = html_layout.extract_text
    assert x("<p>a</p><!-- open <p>b") == "a" and x("<p>a</p><!-- <p>b</p> --><p>c</p><!doctype") == "a\n\nc" and x("a<?php b") == "a"
    assert x("<textarea><p>x</p> &amp; y</textarea>") == "<p>x</p> & y" and x("<p>a<textarea>open &lt;b>") == "aopen <b>"
    assert x("a<xmp><b>t</b>\n  &amp;</xmp>b") == "a\n\n<b>t</b>\n  &amp;\n\nb"
    assert x("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>") == "kr" and x("<noframes><p>x</noframes>y<iframe><p>z</iframe>") == "y"


# -- op2 and op3 on hot keys and many matches --------------------------------
def test_near_duplicates_with_hot_keys(spark, monkeypatch):
    """Hundreds of copies and near copies, empties among them, with every join by shuffles and every hot key dealt out."""
    from tests.llm.test_contracts import near_components

    monkeypatch.setattr(skew, "FEW", 50)
    monkeypatch.setattr(skew, "SHARE", 40)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(neardup, "FOLLOWERS", 16)
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 40)
    rnd = random.Random(6)
    base = [f"b{k}" for k in range(40)]
    texts = [" ".join(base)] * 600 + [""] * 200
    for k in range(160):
        words = list(base)
        words[rnd.randrange(40)] = f"x{k}"
        texts.append(" ".join(words))
    for k in range(100):  # chains: each shares most with the one before
        texts.append(" ".join(f"c{k // 50}_{j}" for j in range(k % 50 * 3, k % 50 * 3 + 30)))
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (n, c, c == i) for i, n, c in near_components(list(range(len(texts))), texts)}


def test_forty_thousand_matches_in_one_text(spark):
    import time

    hexes = [f"{k:016x}" for k in range(40_000)]
    assigns = [f"token = secret{k:08}" for k in range(3_000)]
    text = " ".join(hexes) + "é" + "; ".join(assigns)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("source", F.lit("s"))
    began = time.monotonic()
    found = secrets.candidates(df).first().found
    assert time.monotonic() - began < 60
    assert [(s.s, s.e) for s in found if s.kind == "hex"] == [(17 * k, 17 * k + 16) for k in range(40_000)]
    want = [(m.start(), m.end()) for m in re.finditer(r"token = secret\d{8}", text)]
    assert [(s.s, s.e) for s in found if s.kind == "assign"] == want


def test_masks_over_many_and_overlapping_spans(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcé🙂 ") for _ in range(300)) for _ in range(40)]
    rows, want = [], []
    for k, t in enumerate(texts):
        spans = sorted((a, min(a + rnd.randint(1, 20), 300)) for a in rnd.sample(range(299), rnd.choice([1, 2, 30])))
        merged = []
        for a, b in spans:
            if merged and merged[-1][1] > a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        at, out = 0, ""
        for a, b in merged:
            out, at = out + t[at:a] + "[X]", b
        rows.append((k, t, spans))
        want.append(out + t[at:])
    df = spark.createDataFrame(rows, "k int, t string, spans array<struct<s: bigint, e: bigint>>")
    got = {r.k: r.m for r in df.select("k", F.expr(secrets._masked("t", "spans", "[X]")).alias("m")).collect()}
    assert [got[k] for k in range(len(rows))] == want
