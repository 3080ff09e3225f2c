"""Each stage of the pipeline against a plain version over its own input."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_contracts import base_spans, check_packing, near_components


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The tables between the stages, the input first."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(folder / f"{k}-{uuid.uuid4().hex}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [t.toPandas().sort_values("doc_id").reset_index(drop=True) for t in out]


def test_stages_keep_the_columns(stages):
    for t in stages[:-1]:
        assert list(t.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [name for name, _ in P.STAGES] == ["quality classifier", "language ID", "near-duplicates", "secret scan", "best-fit packing"]


def test_quality_stage(stages, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    kept = set(stages[1].doc_id)
    assert kept <= set(stages[0].doc_id)
    good, bad = labels[labels.quality == 1].doc_id, labels[labels.quality == 0].doc_id
    assert good.isin(kept).mean() > 0.98 and bad.isin(kept).mean() < 0.1


def test_language_stage_keeps_clean_documents(stages):
    assert len(stages[2]) >= 0.99 * len(stages[1])
    extra = stages[1][~stages[1].doc_id.isin(stages[2].doc_id)]
    assert not (extra.n_chars > 500).any()


def test_language_stage_drops_what_has_no_letters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(200)
    odd = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("1234 5678 !!").alias("text"), "lang", "source", "n_chars")
    got = P.language_stage(spark, docs.unionByName(odd), sf)
    assert got.where("doc_id = -1").count() == 0 and got.count() >= 198


def test_near_duplicate_stage(stages):
    rows = near_components(stages[2].doc_id.tolist(), stages[2].text.tolist())
    assert stages[3].doc_id.tolist() == [i for i, _, c in rows if c == i]


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def near_rows():
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    c = " ".join(f"c{k}" for k in range(60))
    # 5: two texts under one id, one of them a copy of 2's; 7: an exact repeat; null ids stay, copies or not
    rows = [(9, a), (2, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, a), (None, "own words only"), (3, "")]
    want = [(2, a), (3, ""), (5, b), (7, c), (None, a), (None, a), (None, "own words only")]
    return rows, want


def test_near_duplicate_stage_on_null_and_repeated_ids(spark, sf):
    rows, want = near_rows()
    docs = spark.createDataFrame([(i, t, "en", "s/r", len(t)) for i, t in rows], ROWS).repartition(3)
    got = P.near_duplicate_stage(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert P.near_duplicate_stage(spark, docs.limit(0), sf).count() == 0


def test_secret_stage_on_null_and_repeated_ids(spark, sf):
    key = "token = {}"
    live = ["q8Zr2LkV9wXcT4bN", "m3Yt7HsB1dQpJ6uG", "z5Wn8FvR2kAxC9eL"]
    rows = [(None, key.format(live[0])), (4, "x " + key.format(live[1])), (4, "plain words that must stay as they are, all of them"), (4, key.format(live[2]) + " end"), (None, "nothing")]
    docs = spark.createDataFrame([(i, t, "en", f"o{k}/r", len(t)) for k, (i, t) in enumerate(rows)], ROWS).repartition(2)
    got = P.secret_stage(spark, docs, sf).collect()
    want = [(None, "token = [SECRET]"), (4, "x token = [SECRET]"), rows[2], (4, "token = [SECRET] end"), rows[4]]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in got)


def test_secret_stage(stages):
    before, after = stages[3].set_index("doc_id").text, stages[4].set_index("doc_id").text
    assert before.index.equals(after.index)
    changed = 0
    for i, t in before.items():
        if after[i] == t:
            continue
        changed += 1
        parts = after[i].split("[SECRET]")
        assert re.fullmatch(r"[A-Za-z0-9+/_.=-]+".join(map(re.escape, parts)), t)
        assert base_spans(t)
    assert changed
    assert (stages[4].n_chars == stages[4].text.str.len()).all()


def test_packing_stage_and_run(stages, spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = stages[4]
    ids = {i: [*e.ids, 1] for i, e in zip(texts.doc_id, t.encode_batch_fast(texts.text.tolist(), add_special_tokens=False), strict=True)}
    least = check_packing(stages[5], ids)
    assert stages[5].sequence_id.nunique() <= least * 1.02 + 1
    run = P.run(spark, sf).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run[key].to_numpy().tolist())) == sorted(map(tuple, stages[5][key].to_numpy().tolist()))
