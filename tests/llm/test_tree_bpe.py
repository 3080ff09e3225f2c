"""Tree concatenation against the library's own encoding and decoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corpuslake.llm import queries as Q
from corpuslake.llm import tree_bpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ["ab", "abcdefghijklmnopqrstuvwxyz", "aeinst", "étoñ漢字テ🙂", "0123456789", "=-_#*.", " \n\t", "the and ing tion", "   x", "'s're"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def some_texts(n, lengths=(5, 20, 100, 700)):
    r = random.Random(11)
    for _ in range(n):
        alphabet = "".join(r.sample(ALPHABETS, r.choice([1, 1, 2, 3])))
        s = "".join(r.choice(alphabet) for _ in range(r.choice(lengths)))
        yield s[: len(s) // 2] + "<|endoftext|>" + s[len(s) // 2 :] if r.random() < 0.1 else s


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_trees_equal_the_library(library, leaf):
    enc = tree_bpe.TreeEncoder(library, leaf)
    for s in some_texts(700):
        want = library.encode(s, add_special_tokens=False).ids
        data = np.frombuffer(s.encode(), np.uint8)
        assert enc.encode(data, np.array([0, len(data)]))[0].tolist() == want
        for most in (1, 7, 30):
            parts = list(tree_bpe.parts_of(s, enc, most))
            assert tree_bpe.whole_ids([k for k, _ in parts], [tree_bpe.part_ids(k, c, enc) for k, c in parts], enc) == want
    assert enc.joins > 1000


def test_windows_grow_where_a_join_reaches_far(library):
    """Runs of one character have long tokens, which leaves of five bytes cut up."""
    enc = tree_bpe.TreeEncoder(library, 5)
    widths = []

    def encode(s):
        widths.append(len(s))
        return enc._short(s)

    for letter in "a-=":
        for n in (31, 64, 333, 1000):
            leaves = [enc._short(letter * min(5, n - at)) for at in range(0, n, 5)]
            assert tree_bpe.concatenated(leaves, enc.spell, encode) == enc._short(letter * n)
    assert max(widths) > 40 and min(widths) <= 10
    assert tree_bpe.concatenated([], enc.spell, encode) == []


def test_long_texts_meet_again(spark, library):
    r = random.Random(3)
    letters = "".join(r.choice("abcdefghijklmnop") for _ in range(9000))
    texts = [None, "", "short", letters, "word " * 3000, "a" * 5000, f"{letters}<|endoftext|>{'=' * 4000} x  \n\n y{letters[:50]}", "é" * 2500, "\n" * 3000, "1. " * 1500]
    rows = [(k % 7 if k else None, t, "x") for k, t in enumerate([*texts, texts[3], texts[4]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    for part in (700, 4000, 1 << 16):
        got = tree_bpe.encode(df, BYTE, part=part).collect()
        assert sorted((str(x.doc_id), x.ids) for x in got) == want
    back = tree_bpe.round_trip(df, BYTE, part=700).collect()
    assert sorted((str(x.doc_id), x.decoded) for x in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert tree_bpe.round_trip(df.limit(0), BYTE).count() == 0


def test_decoding_equals_the_library(spark, library):
    r = random.Random(5)
    ids = [[r.randrange(50257) for _ in range(r.choice([0, 1, 5, 60]))] for _ in range(300)] + [[50256, 220, 50256], [60000, 40]]
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(ids)] + [(-1, None, 1)], "k int, ids array<int>, Decoded int")
    got = {x.k: x.decoded for x in tree_bpe.decode(df, BYTE).collect()}
    assert got.pop(-1) is None
    for k, x in enumerate(ids):
        assert got[k] == library.decode(x, skip_special_tokens=False)


def test_op11(spark, sf, library):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas().set_index("doc_id")
    got = Q.op11_tree_bpe(spark, sf).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index)
    for i, t in docs.text.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
