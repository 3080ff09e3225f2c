"""Hand-checked literals and properties of the text metrics."""

import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslake import gold
from corpuslake.functions import text as T
from corpuslake.operators import chunking, entities, lexical, scores, syntactic, topics


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(
    ("words", "want"),
    [(["we", "will", "win"] * 20, 5.0), (["we", "will", "win"] * 17 + ["we"], 5.2), (["we", "will", "win"] * 18, 4.957377), ([f"w{k}" for k in range(54)], 54.0), (["a"] * 49, None)],
)
def test_mtld(words, want):
    got = lexical.mtld_of(words)
    assert got is None if want is None else got == pytest.approx(want, abs=1e-6)


def test_ngrams_keep_the_repeated_one_seen_last_and_filter_after_the_top(spark):
    words = " ".join(f"alpha{chr(97 + k)} beta{chr(97 + k)}" for k in range(8)) + " x. gamma delta gamma delta"
    rows = lexical.top_ngrams(docs(spark, words), 2).collect()
    assert [(r.phrase, r.cnt) for r in rows] == [("gamma delta", 2)]


def test_anaphora_pronouns_oppositions(spark):
    d = docs(spark, "We will win now. We will win again! They lie? We will lose.", None, "")
    assert {(r.phrase, r.cnt) for r in lexical.anaphora(d).collect()} == {("we will win", 2)}
    ratios = {r.doc_id: r.first_person_plural for r in lexical.pronoun_ratios(d).collect()}
    assert ratios == {0: round(3 / 13 * 1000, 2), 1: 0.0, 2: 0.0}
    o = lexical.oppositions(docs(spark, "War and peace and war.")).collect()
    assert [(r.left_word, r.right_word, r.left_count, r.right_count) for r in o] == [("peace", "war", 1, 2)]


def test_chunks():
    assert chunking.chunk_text("a b c. d e. f g h i j k l.", 5) == ["a b c. d e.", "f g h i j", "k l."]
    assert chunking.chunk_text("", 5) == chunking.chunk_text("  ", 5) == chunking.chunk_text(None, 5) == []
    with pytest.raises(ValueError):
        chunking.chunk_text("a", 0)
    text = "one two. " * 7 + "three four five six seven eight nine ten. end"
    for budget in (1, 2, 3, 5, 100):
        got = chunking.chunk_text(text, budget)
        assert " ".join(got).split() == text.split()
        assert all(len(c.split()) <= budget for c in got)
    assert chunking.resolve_max_length(10**30, 514, "roberta") == 512
    assert chunking.resolve_max_length(384) == 384


def test_weighted_scores_and_labels(spark):
    rows = [(1, 0, 3, "pos", 0.9), (1, 0, 3, "neu", 0.1), (1, 0, 3, "neg", 0.0), (1, 1, 1, "pos", 0.1), (1, 1, 1, "neu", 0.1), (1, 1, 1, "neg", 0.8)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_no int, n_words long, label string, score double")
    got = {r.label: r.score for r in scores.weighted(df).collect()}
    assert got == pytest.approx({"pos": 0.7, "neu": 0.1, "neg": 0.2})
    assert scores.dominant(scores.weighted(df)).first().label == "pos"
    low = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.4)], "doc_id long, label string, score double")
    assert [r.label for r in scores.selected(low).collect()] == ["b"]


def test_chunk_scores_add_up_to_one(spark):
    d = docs(spark, "This is good. War is bad and the worst! Nothing here.")
    scored = scores.word_list_scorer(scores.SENTIMENT)(scores.sentence_chunks(d))
    for r in scored.groupBy("chunk_no").agg(F.sum("score").alias("s")).collect():
        assert r.s == pytest.approx(1)
    payload = scores.score_payload(docs(spark, "", "good"), scores.weighted(scores.word_list_scorer(scores.SENTIMENT)(scores.sentence_chunks(docs(spark, "", "good")))), "sentiment", "label")
    by = {r.doc_id: r.sentiment for r in payload.collect()}
    assert by[0].label is None and by[0].scores == {} and by[1].label == "positive"


def tagged(spark, *pairs):
    doc = [(w, w, w, t, w.isalpha(), 0) for w, t in pairs]
    return spark.createDataFrame([(1, doc)], f"doc_id long, doc {syntactic.DOC_TYPE}")


def test_verb_tense(spark):
    r = syntactic.verb_tense(tagged(spark, ("will", "MD"), ("always", "RB"), ("fight", "VB"))).first()
    assert (r.future, r.non_finite, r.past) == (100.0, 100.0, 0.0)
    assert syntactic.verb_tense(tagged(spark, ("will", "MD"), (",", ","), ("go", "VB"))).first().future == 0.0
    assert syntactic.verb_tense(tagged(spark, ("dog", "NN"))).first().asDict() == {"doc_id": 1, "past": 0.0, "present": 0.0, "future": 0.0, "non_finite": 0.0}


def test_modality_by_lemma_and_phrase(spark):
    r = syntactic.modality(syntactic.tagged(docs(spark, "He had to go. We'll win, maybe."))).first()
    n = 7
    assert r.obligation_modality == round(1 / n * 1000, 2)
    assert r.certainty_modality == round(1 / n * 1000, 2)
    assert r.possibility_modality == round(1 / n * 1000, 2)


def test_tagger(spark):
    d = docs(spark, "He will not go; we'll quickly win! Don't say \"Ohio's\" 3.5 times, Ms. O’Neil’s Dog runs (fast).", None, " ", "a_b 12,5%")
    got = {r.doc_id: [(t.text, t.tag, t.sent) for t in r.doc] for r in syntactic.tagged(d).collect()}
    want = "He/PRP will/MD not/RB go/VB ;/; we/PRP 'll/MD quickly/VB win/NN !/."
    assert got[0][:10] == [(*x.rsplit("/", 1), 0) for x in want.split()]
    rest = "Do/VBP n't/RB say/NN \"/: Ohio/NNP 's/POS \"/: 3.5/CD times/NNS ,/, Ms/NNP ./."
    assert got[0][10:22] == [(*x.rsplit("/", 1), 1) for x in rest.split()]
    assert [x[0] for x in got[0][22:]] == ["O", "’", "Neil", "’s", "Dog", "runs", "(", "fast", ")", "."] and got[0][25][1] == "POS"
    assert got[1] == got[2] == [] and got[3] == [("a", "DT", 0), ("_", ":", 0), ("b", "NN", 0), ("12,5", "CD", 0), ("%", ":", 0)]


def test_entities_fold_case_and_show_the_commonest_spelling(spark):
    m = spark.createDataFrame([(1, 0, "Biden", "PERSON"), (1, 1, "biden", "PERSON"), (1, 2, "Biden", "PERSON"), (1, 3, "Ohio", "GPE"), (1, 4, "  ", "GPE"), (1, 5, "five", "CARDINAL")], "doc_id long, pos long, text string, label string")
    got = {(r.grp, r.text): r.cnt for r in entities.grouped(m).collect()}
    assert got == {("persons", "Biden"): 3, ("locations", "Ohio"): 1, ("other", "five"): 1}
    payload = entities.payload(docs(spark, "x", "y").withColumn("doc_id", F.col("doc_id") + 1), m)
    by = {r.doc_id: r.entities for r in payload.collect()}
    assert by[1].total_entities == 5 and by[1].by_label == {"PERSON": 3, "GPE": 1, "CARDINAL": 1} and by[2].total_entities == 0


def test_posts_titles_prompts(spark):
    d = docs(spark, "Jobs! See https://a.b/c @me #tag   now", '"@user: hi', "RT @u: x", "@u thanks", "hello @u")
    rows = d.select(T.clean_post("text").alias("c"), T.is_repost("text").alias("r")).collect()
    assert rows[0].c == "Jobs! See now" and [r.r for r in rows] == [False, True, True, True, False]
    p = d.select(T.transcription_prompt("Base.", F.lit("T"), F.lit("c" * 400)).alias("p")).first().p
    assert p == "Base. Title: T. Context: " + "c" * 300
    h = spark.createDataFrame([("https://truthsocial.com/@Some.One/posts/1",), (None,)], "h string").select(T.permalink_handle("h").alias("h")).collect()
    assert [r.h for r in h] == ["some.one", "realdonaldtrump"]


def test_scores_within_rows_equal_scores_by_shuffles(spark):
    d = spark.createDataFrame([(1, "Good war. Great hope and fear! nothing here"), (2, None), (3, ""), (4, "..."), (5, "is is bad. Joy joy LOVE"), (None, "win")], "doc_id long, text string")
    rows = scores.by_document(d, {"a": scores.SENTIMENT, "b": scores.EMOTION}).cache()
    for name, lists in (("a", scores.SENTIMENT), ("b", scores.EMOTION)):
        chunks = scores.word_list_scorer(lists)(scores.sentence_chunks(d))
        for column, apart in ((f"{name}_mean", scores.weighted(chunks)), (f"{name}_most", scores.strongest(chunks))):
            got = {(r.doc_id, x.label): round(x.score, 9) for r in rows.collect() for x in r[column] or []}
            assert got == {(r.doc_id, r.label): round(r.score, 9) for r in apart.collect()}
            key = lambda r: str(r)
            assert sorted(scores.dominant_entry(rows, column).collect(), key=key) == sorted(scores.dominant(apart).collect(), key=key)
            assert sorted(scores.selected_entries(rows, column, 0.2).collect(), key=key) == sorted(scores.selected(apart, 0.2).collect(), key=key)
    plan = gold.sentiment(d)._jdf.queryExecution().executedPlan().toString() + gold.labels(d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert scores.by_document(d.limit(0), {"a": scores.SENTIMENT}).count() == 0


def test_topics_need_enough_documents(spark):
    d = docs(spark, *["word " * 3] * 5).withColumn("word_count", F.lit(3))
    v = d.select("doc_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert topics.fit(d, v).count() == 0
    many = docs(spark, *[f"apple pear {k % 2 and 'plum' or 'fig'} fruit" for k in range(40)]).withColumn("word_count", F.lit(3))
    vec = many.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    got = topics.fit(many, vec, k=2).collect()
    assert len(got) == 40 and {r.topics.corpus for r in got} == {"short_form"} and {r.topics.topic_id for r in got} == {0, 1}
    assert all(r.keywords == r.topics.topic_keywords for r in got)


def test_repost_and_length_rules_see_whole_texts(spark):
    from corpuslake.plans.catalogue import QUERIES

    link = "see http://x.y/" + "z" * 300
    cases = [(1, "RT @u: hello", True, True), (2, '"@user: hi', True, True), (3, "hello @u", False, True), (4, "http://x.y/abc https://z.w/d", False, False), (5, "a " + "http://x.y/q " * 40 + "b", False, True), (6, link, False, True), (7, "ok", False, False), (8, "http://x.y/ words that stand after a link", False, True), (9, None, None, None)]
    folder = tempfile.mkdtemp()
    spark.createDataFrame([(i, t) for i, t, *_ in cases], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: (r.is_repost, r.is_substantive) for r in QUERIES["retweet_filter_whole"](spark, folder).collect()}
    assert got == {i: (a, b) for i, _, a, b in cases}


def test_tagger_takes_few_atoms_at_a_time():
    import pyarrow as pa

    from corpuslake.operators import syntactic

    rows = [[["a"] * 60_000], [["b"] * 30_000, ["c"] * 20_000], [], [["d"] * 150_000], [["e"]]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(rows, pa.list_(pa.list_(pa.string())))], ["doc_id", "atoms"])
    assert [x.column(0).to_pylist() for x in syntactic._batches(iter([batch, batch.slice(1, 0), batch.slice(2, 3)]))] == [[0], [1, 2], [3], [4], [2], [3], [4]]


def test_terms_meet_their_totals_without_a_join(spark):
    from corpuslake.operators import topics

    docs = spark.createDataFrame([("x", "alpha beta"), ("x", "alpha"), ("y", "alpha gamma beta"), ("y", None)], "topic string, text string")
    out = topics.ctfidf(docs, "topic", least_topics=2)
    assert {(r.topic, r.rank, r.term) for r in out.collect()} == {("x", 1, "alpha"), ("x", 2, "beta"), ("y", 1, "beta"), ("y", 2, "alpha")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # sizes of topics, their average


def test_gold_modules_in_one_pass(spark, sf, monkeypatch):
    from corpuslake.plans import catalogue

    plan = catalogue.QUERIES["gold_modules"](spark, sf)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
    docs = spark.createDataFrame([(1, "A great win. A bad war! Jobs."), (1, "fear"), (None, "Taxation is bad."), (2, None), (3, ""), *((k, "We are glad. " * k) for k in range(4, 30))], "doc_id long, text string")
    monkeypatch.setattr(scores, "SENTENCES", 7)  # most texts are scored by themselves
    got = sorted(map(repr, gold.scored(docs).collect()))
    monkeypatch.undo()
    alone = gold.MODULES["sentiment"].compute(docs.where("doc_id > 1")).join(gold.MODULES["labels"].compute(docs.where("doc_id > 1")), "doc_id")
    assert len(got) == 31 and set(map(repr, alone.select("doc_id", "sentiment", "emotions", "labels").collect())) <= set(got)
    sizes = [p.num_rows for p in scores._pieces(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([[1], [1] * 200_000, [], [1]])], ["a", "b"])]))]
    assert sizes == [1, 1, 2]
