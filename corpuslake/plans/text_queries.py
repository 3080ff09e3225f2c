"""Text metrics, scores, chunks, topics and embeddings over documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import bronze as B
from corpuslake.operators import chunking, density, embeddings, entities, gazetteer, lexical, scores, syntactic, topics, wordvectors
from corpuslake.plans import syntax_sql as X
from corpuslake.plans.derived import half_up, table
from corpuslake.plans.syntax_sql import SENTENCES as _SENT
from corpuslake.plans.syntax_sql import SENTS
from corpuslake.plans.syntax_sql import TOKENS as _T


def docs(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents")


def _list(words) -> str:  # noqa: ANN001
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TOK = f"tok AS (SELECT doc_id, text, {_T.format('text')} AS t FROM documents)"
ROWS = "r AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS pos FROM tok)"
STOP = _list(T.STOPWORDS)


def _ranked(src: str, name: str, having: str = "") -> str:
    return f"""c AS (SELECT doc_id, {name}, count(*) AS cnt, min(pos) AS fp FROM {src} GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, fp) AS rank FROM c)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, {name}, cnt FROM k WHERE rank <= 15{having}"""


def _grams(n: int) -> str:
    leads = ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{k}" for k in range(1, n))
    names = ["w", *[f"w{k}" for k in range(1, n)]]
    return f"""WITH {TOK}, {ROWS}, g AS (SELECT doc_id, pos, w, {leads} FROM r),
    p AS (SELECT doc_id, pos, concat_ws(' ', {', '.join(names)}) AS phrase FROM g WHERE {names[-1]} IS NOT NULL AND NOT ({' AND '.join(f'{x} IN {STOP}' for x in names)})), {_ranked('p', 'phrase', ' AND cnt >= 2')}"""


def _ratio(words) -> str:  # noqa: ANN001
    return f"CASE WHEN len(t) > 0 THEN {half_up(f'1000 * len([x FOR x IN t IF x IN {_list(words)}])', 'len(t)', 2)} ELSE 0.0 END"


_LETTERS = "length(array_to_string(t, ''))"

_FOLD = """list_reduce([{{'s': [x], 'n': 1, 'f': 0}} FOR x IN {0}], lambda a, b:
        CASE WHEN (len(a.s) + CAST(NOT list_contains(a.s, b.s[1]) AS INT)) / (a.n + 1) < 0.72::DOUBLE THEN {{'s': CAST([] AS VARCHAR[]), 'n': 0, 'f': a.f + 1}}
        ELSE {{'s': CASE WHEN list_contains(a.s, b.s[1]) THEN a.s ELSE list_append(a.s, b.s[1]) END, 'n': a.n + 1, 'f': a.f}} END, {{'s': CAST([] AS VARCHAR[]), 'n': 0, 'f': 0}})"""
_FACTORS = "({0}.f + CASE WHEN {0}.n > 0 THEN (1 - len({0}.s) / {0}.n) / (1 - 0.72::DOUBLE) ELSE 0 END)"
_MTLD = f"""WITH {TOK}, b AS (SELECT doc_id, t FROM tok WHERE len(t) >= 50), f AS (SELECT doc_id, len(t) AS n, {_FOLD.format('t')} AS p, {_FOLD.format('list_reverse(t)')} AS q FROM b),
    v AS (SELECT doc_id, n, {_FACTORS.format('p')} AS x, {_FACTORS.format('q')} AS y FROM f),
    m AS (SELECT doc_id, round((CASE WHEN x > 0 THEN n / x ELSE n END + CASE WHEN y > 0 THEN n / y ELSE n END) / 2, 6) AS mtld FROM v)
    SELECT tok.doc_id, mtld FROM tok LEFT JOIN m USING (doc_id)"""

_CHUNKS = rf"""WITH {SENTS}, c AS (SELECT doc_id, pos, s, regexp_extract_all(s, '\S+') AS ws FROM sent),
    g AS (SELECT *, len(ws) > 60 AS long, sum(CAST(len(ws) > 60 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM c),
    u AS (SELECT doc_id, pos, 0 AS w, s AS t, len(ws) AS n, 2 * k AS g FROM g WHERE NOT long UNION ALL
        SELECT doc_id, pos, unnest(range(len(ws))), unnest(ws), 1, 2 * k - 1 FROM g WHERE long),
    l AS (SELECT doc_id, list({{'done': CAST([] AS VARCHAR[]), 'cur': [t], 'used': CAST(n AS BIGINT), 'g': CAST(g AS BIGINT)}} ORDER BY pos, w) AS us FROM u GROUP BY doc_id),
    f AS (SELECT doc_id, list_reduce(us, lambda a, b: CASE WHEN a.g <> b.g OR a.used + b.used > 60
        THEN {{'done': list_append(a.done, array_to_string(a.cur, ' ')), 'cur': b.cur, 'used': b.used, 'g': b.g}}
        ELSE {{'done': a.done, 'cur': list_append(a.cur, b.cur[1]), 'used': a.used + b.used, 'g': b.g}} END) AS r FROM l),
    d AS (SELECT doc_id, list_append(r.done, array_to_string(r.cur, ' ')) AS cs FROM f)
    SELECT doc_id, CAST(no AS INTEGER) AS chunk_no, chunk, len(regexp_extract_all(chunk, '\S+')) AS n_words FROM (SELECT doc_id, unnest(cs) AS chunk, unnest(range(len(cs))) AS no FROM d)"""

LISTS = {"positive": ("the", "is", "und", "le"), "negative": ("a", "of", "der", "de"), "neutral": ("in", "to", "and", "la")}


def _scored_sql(lists: dict[str, tuple[str, ...]], kind: str) -> str:
    every = _list(sorted({w for ws in lists.values() for w in ws}))
    parts = " UNION ALL ".join(f"SELECT doc_id, n, '{k}' AS label, (len([x FOR x IN h IF x IN {_list(ws)}]) + 1.0) / (tot + {float(len(lists))}) AS score FROM ch" for k, ws in lists.items())
    total = " + ".join(f"len([x FOR x IN h IF x IN {_list(ws)}])" for ws in lists.values())
    agg = {"weighted": "sum(CAST(score AS DOUBLE) * n) / sum(n)", "max": "greatest(max(score), 0.0)"}[kind]
    return rf"""WITH {SENTS}, c0 AS (SELECT doc_id, pos, len(regexp_extract_all(s, '\S+')) AS n, [x FOR x IN {_T.format('s')} IF x IN {every}] AS h FROM sent),
    ch AS (SELECT *, {total} AS tot FROM c0), sc AS ({parts}),
    ds AS (SELECT doc_id, label, round(CAST({agg} AS DOUBLE), 6) AS score FROM sc GROUP BY 1, 2 HAVING sum(n) > 0),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(label), label) AS rank FROM ds) """


#: The twelve labels, each with words that the test texts hold, so that scores reach the threshold.
TOPICS = {label: (*scores.TOPIC_WORDS[label], word) for label, word in zip(scores.TOPIC_LABELS, ("the", "is", "and", "of", "in", "to", "und", "der", "que", "le", "de", "la"), strict=True)}
EMO = {"anger": ("the", "on"), "disgust": ("der",), "fear": ("is", "le"), "joy": ("a", "la"), "neutral": ("of", "und"), "sadness": ("in", "de"), "surprise": ("to", "que")}


def _scores(lists, how):  # noqa: ANN001, ANN202
    return lambda s, d: how(scores.by_document(docs(s, d), {"x": lists}))


_GIVEN = "given AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 3 THEN text END AS text FROM documents)"


def _dedup(spark, d):  # noqa: ANN001, ANN202
    """Documents as candidates, some of them without content."""
    given = docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 17 != 3, F.col("text")))
    rows = B.with_checksum(given, "text").withColumn("discovery_order", F.col("doc_id"))
    return B.deduplicated(rows).select("doc_id", "checksum", "file_size", "outcome")


def _paired(spark, d):  # noqa: ANN001, ANN202
    """The documents with the words of pairs in place of common ones."""
    text = F.col("text")
    for common, word in X.SWAPS:
        text = F.regexp_replace(text, f" {common} ", f" {word} ")
    return docs(spark, d).select("doc_id", text.alias("text"))


def _flat(entries: str, name: str):  # noqa: ANN202
    return F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x[name], x["count"].cast("string"))), ",")


def _lexical_payload(spark, d):  # noqa: ANN001, ANN202
    """The payload's parts as columns; lists as text."""
    rows = lexical.payload(docs(spark, d)).select("doc_id", "lex_metrics.*")
    return rows.select(
        "doc_id", "total_words", F.round("lexical_diversity.ttr", 6).alias("ttr"), F.round("lexical_diversity.mtld", 6).alias("mtld"), *[F.col("pronoun_ratios")[k].alias(k) for k in T.PRONOUNS],
        _flat("top_content_words", "word").alias("words"), _flat("repetitions", "phrase").alias("repetitions"), _flat("bigrams", "phrase").alias("bigrams"), _flat("trigrams", "phrase").alias("trigrams"),
        F.size("oppositions").cast("long").alias("n_oppositions"),
    )


def _syntactic_payload(spark, d):  # noqa: ANN001, ANN202
    """The payload's parts as columns."""
    rows = syntactic.payload(docs(spark, d)).select("doc_id", "syntactic_metrics.*")
    maps = [F.col(m)[k].alias(k) for m, names in (("modality", syntactic.MODAL_MARKERS), ("pos_distribution", syntactic.POS_BUCKETS), ("verb_tense", X.TENSES)) for k in names]
    return rows.select("doc_id", "speech_stats.*", *maps, "total_tagged_tokens")


_REACH = """v AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings),
    d AS (SELECT a.i, b.i AS j, list_distance(a.x, b.x) AS d FROM v a, v b),
    c AS (SELECT i, list(d ORDER BY d)[10] AS core FROM d GROUP BY i)"""


def _core_distances(spark, d):  # noqa: ANN001, ANN202
    fitted, _, n = density.fitted_points(table(spark, d, "embeddings"), "vec_id", "embedding")
    points = density.with_core(fitted.select("node", "x"), density.blocks_of(n), 10)
    return fitted.select("node", "id").join(points, "node").select(F.col("id").alias("vec_id"), F.round("core", 6).alias("core"))


def _tree_weights(spark, d):  # noqa: ANN001, ANN202
    """How often each weight is in the minimum spanning tree; that does not depend on which tree it is."""
    fitted, _, n = density.fitted_points(table(spark, d, "embeddings"), "vec_id", "embedding")
    _, edges = density.tree_edges(fitted.select("node", "x"), n, 10)
    return edges.groupBy(F.round("w", 6).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark, d):  # noqa: ANN001, ANN202
    """(pairs by numbers, words by number) of all documents."""
    words = [r["word"] for r in wordvectors.vocabulary(docs(spark, d)).collect()]
    names = spark.createDataFrame(list(enumerate(words)), "k long, w string")
    return wordvectors.pair_counts(docs(spark, d), words), names


def _named(rows, names):  # noqa: ANN001, ANN202
    """``rows`` with the words of i and j; the vocabulary is bounded."""
    a, b = (F.broadcast(names.select(F.col("k").alias(c), F.col("w").alias(f"word_{c}"))) for c in "ij")
    return rows.join(a, "i").join(b, "j")


def _information(spark, d):  # noqa: ANN001, ANN202
    pairs, names = _pairs(spark, d)
    return _named(wordvectors.positive_information(pairs), names).select("word_i", "word_j", F.round("v", 6).alias("information"))


_COUNTED = f"""{TOK}, {ROWS}, vocab AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS k FROM r GROUP BY w HAVING count(*) >= {wordvectors.LEAST}),
    known AS (SELECT doc_id, pos, w, k FROM r JOIN vocab USING (w) WHERE k <= {wordvectors.VOCABULARY}),
    pairs AS (SELECT CASE WHEN a.k <= b.k THEN a.w ELSE b.w END AS word_i, CASE WHEN a.k <= b.k THEN b.w ELSE a.w END AS word_j, count(*) AS n
        FROM (SELECT *, unnest(range(1, {wordvectors.WINDOW} + 1)) AS gap FROM known) a JOIN known b ON a.doc_id = b.doc_id AND b.pos = a.pos + a.gap GROUP BY 1, 2)"""

#: Prim's method: ``best`` has each point's least reachability from the tree so far, null inside it.
_TREE = f"""WITH RECURSIVE {_REACH},
    m AS (SELECT d.i, list(greatest(d.d, a.core, b.core) ORDER BY j) AS r FROM d JOIN c a ON a.i = d.i JOIN c b ON b.i = d.j GROUP BY d.i),
    t(k, w, best) AS (
        SELECT 1, NULL::DOUBLE, [CASE WHEN q = 1 THEN NULL ELSE r[q] END FOR q IN range(1, len(r) + 1)] FROM m WHERE i = 1
        UNION ALL
        SELECT k + 1, s.w, [CASE WHEN s.best[q] IS NULL OR q = s.now THEN NULL ELSE least(s.best[q], m.r[q]) END FOR q IN range(1, len(m.r) + 1)]
        FROM (SELECT k, best, list_min(best) AS w, list_position(best, list_min(best)) AS now FROM t WHERE list_min(best) IS NOT NULL) s JOIN m ON m.i = s.now)
    SELECT round(w, 6) AS weight, count(*) AS n FROM t WHERE w IS NOT NULL GROUP BY 1"""

#: name: (function of (spark, sf_dir), SQL or None)
ENTRIES = {
    "tokens_basic": (
        lambda s, d: docs(s, d).select("doc_id", T.tokens("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_types"), F.get("t", F.lit(0)).alias("first_token")),
        f"WITH {TOK} SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_types, t[1] AS first_token FROM tok",
    ),
    "word_count": (lambda s, d: docs(s, d).select("doc_id", T.word_count("text").cast("long").alias("word_count")), r"SELECT doc_id, CASE WHEN text <> '' THEN len(regexp_extract_all(text, '\S+')) END AS word_count FROM documents"),
    "sentence_count": (lambda s, d: docs(s, d).select("doc_id", F.size(T.sentences("text")).cast("long").alias("n_sentences")), f"SELECT doc_id, len({_SENT.format('text')}) AS n_sentences FROM documents"),
    "top_content_words": (lambda s, d: lexical.top_content_words(docs(s, d)), f"WITH {TOK}, {ROWS}, f AS (SELECT doc_id, w AS word, pos FROM r WHERE length(w) > 2 AND w NOT IN {STOP}), {_ranked('f', 'word')}"),
    "bigrams_top": (lambda s, d: lexical.top_ngrams(docs(s, d), 2), _grams(2)),
    "trigrams_top": (lambda s, d: lexical.top_ngrams(docs(s, d), 3), _grams(3)),
    "pronoun_ratios": (lambda s, d: lexical.pronoun_ratios(docs(s, d)), f"WITH {TOK} SELECT doc_id, {', '.join(f'{_ratio(ws)} AS {k}' for k, ws in T.PRONOUNS.items())} FROM tok"),
    "lexical_diversity_ttr": (
        lambda s, d: lexical.type_token_ratio(docs(s, d)).withColumn("ttr", F.round("ttr", 6)),
        f"WITH {TOK} SELECT doc_id, len(t) AS total_words, len(list_distinct(t)) AS types, CASE WHEN len(t) > 0 THEN round(len(list_distinct(t)) / len(t), 6) ELSE 0.0 END AS ttr FROM tok",
    ),
    "lexical_diversity_mtld": (lambda s, d: lexical.mtld(docs(s, d)).withColumn("mtld", F.round("mtld", 6)), _MTLD),
    "anaphora": (
        lambda s, d: lexical.anaphora(docs(s, d)),
        f"WITH {SENTS}, o AS (SELECT doc_id, {_T.format('s')} AS t FROM sent) SELECT doc_id, concat_ws(' ', t[1], t[2], t[3]) AS phrase, count(*) AS cnt FROM o WHERE len(t) >= 3 GROUP BY 1, 2 HAVING count(*) >= 2",
    ),
    "oppositions": (lambda s, d: lexical.oppositions(_paired(s, d)), X.OPPOSED),
    "punctuation_counts": (
        lambda s, d: docs(s, d).select("doc_id", T.count_of("text", "?").alias("questions"), T.count_of("text", "!").alias("exclamations")),
        "SELECT doc_id, length(text) - length(replace(text, '?', '')) AS questions, length(text) - length(replace(text, '!', '')) AS exclamations FROM documents",
    ),
    "avg_word_length": (
        lambda s, d: docs(s, d).select("doc_id", T.average_word_length(T.tokens("text")).alias("avg_word_length")),
        f"WITH {TOK} SELECT doc_id, CASE WHEN len(t) > 0 THEN {half_up(_LETTERS, 'len(t)', 2)} ELSE 0.0 END AS avg_word_length FROM tok",
    ),
    "speech_stats": (
        lambda s, d: syntactic.speech_stats(docs(s, d)),
        f"""WITH {TOK}, q AS (SELECT doc_id, text, t, len({_SENT.format('text')}) AS n FROM tok) SELECT doc_id, n AS sentence_count, CASE WHEN n > 0 THEN {half_up('len(t)', 'n', 2)} ELSE 0.0 END AS avg_sentence_length,
        CASE WHEN len(t) > 0 THEN {half_up(_LETTERS, 'len(t)', 2)} ELSE 0.0 END AS avg_word_length, length(text) - length(replace(text, '?', '')) AS question_count, length(text) - length(replace(text, '!', '')) AS exclamation_count FROM q""",
    ),
    "modality_markers": (lambda s, d: syntactic.measured(docs(s, d)).select("doc_id", *syntactic.modality_counts()), X.MODALITY),
    "pos_distribution": (lambda s, d: syntactic.measured(docs(s, d)).select("doc_id", *syntactic.pos_counts(), F.col("n_tokens").alias("total_tagged_tokens")), X.POS),
    "verb_future_lookahead": (lambda s, d: syntactic.measured(docs(s, d)).select("doc_id", *syntactic.tense_counts()), X.TENSE),
    "entity_mentions": (lambda s, d: entities.grouped(entities.mentions_by_rule(docs(s, d))), X.MENTIONS),
    "chunk_pack": (lambda s, d: chunking.chunks(docs(s, d), 60), _CHUNKS),
    "weighted_sentiment": (_scores(LISTS, lambda x: scores.dominant_entry(x, "x_mean")), _scored_sql(LISTS, "weighted") + "SELECT doc_id, label, score FROM rk WHERE rank = 1"),
    "weighted_emotion": (_scores(EMO, lambda x: scores.dominant_entry(x, "x_mean")), _scored_sql(EMO, "weighted") + "SELECT doc_id, label, score FROM rk WHERE rank = 1"),
    "zero_shot_labels": (_scores(EMO, lambda x: scores.selected_entries(x, "x_most", 0.3)), _scored_sql(EMO, "max") + "SELECT doc_id, CAST(rank AS INTEGER) AS rank, label, score FROM rk WHERE score >= 0.3 OR rank = 1"),
    "topic_labels": (_scores(TOPICS, lambda x: scores.selected_entries(x, "x_most")), _scored_sql(TOPICS, "max") + "SELECT doc_id, CAST(rank AS INTEGER) AS rank, label, score FROM rk WHERE score >= 0.5 OR rank = 1"),
    "bronze_dedup": (
        _dedup,
        f"""WITH {_GIVEN}, h AS (SELECT doc_id, sha256(text) AS checksum, CAST(octet_length(encode(text)) AS BIGINT) AS file_size FROM given)
        SELECT doc_id, checksum, file_size, CASE WHEN checksum IS NULL THEN 'failed' WHEN doc_id = min(doc_id) OVER (PARTITION BY checksum) THEN 'ingested' ELSE 'skipped' END AS outcome FROM h""",
    ),
    "bronze_counters": (lambda s, d: B.counters(_dedup(s, d)), f"WITH {_GIVEN} SELECT count(DISTINCT text) AS ingested, count(text) - count(DISTINCT text) AS skipped, count(*) - count(text) AS failed FROM given"),
    "bronze_ids": (
        lambda s, d: B.with_ids(_dedup(s, d).where("outcome = 'ingested'").withColumn("discovery_order", F.col("doc_id")).select("checksum", "discovery_order"), 100).select("doc_id", "checksum"),
        f"WITH {_GIVEN} SELECT 100 + row_number() OVER (ORDER BY m) AS doc_id, checksum FROM (SELECT sha256(text) AS checksum, min(doc_id) AS m FROM given WHERE text IS NOT NULL GROUP BY 1)",
    ),
    "corpus_split": (
        lambda s, d: topics.corpora(docs(s, d)),
        r"SELECT CASE WHEN len(regexp_extract_all(text, '\S+')) >= 500 THEN 'long_form' ELSE 'short_form' END AS corpus, count(*) AS n_docs, count(*) >= 20 AS fitted FROM documents GROUP BY 1",
    ),
    "ctfidf_keywords": (
        lambda s, d: topics.ctfidf(docs(s, d), "lang"),
        rf"""WITH {TOK}, r AS (SELECT d.lang AS topic, unnest(t) AS term FROM tok JOIN documents d USING (doc_id)), f AS (SELECT * FROM r WHERE length(term) >= 2 AND term NOT IN {STOP}),
        c AS (SELECT topic, term, count(*) AS n FROM f GROUP BY 1, 2), bt AS (SELECT term, sum(n) AS f FROM c GROUP BY 1), tp AS (SELECT topic, sum(n) AS size FROM c GROUP BY 1), av AS (SELECT avg(size) AS a FROM tp),
        s AS (SELECT topic, term, round(n / size * ln(1 + a / f), 8) AS score FROM c JOIN bt USING (term) JOIN tp USING (topic), av)
        SELECT topic, CAST(k AS INTEGER) AS rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS k FROM s) WHERE k <= 10""",
    ),
    "ctfidf_bigrams": (
        lambda s, d: topics.ctfidf(docs(s, d), "source", least_topics=2, bigrams=True),
        rf"""WITH {TOK}, w AS (SELECT d.source AS topic, [x FOR x IN t IF length(x) >= 2 AND x NOT IN {STOP}] AS f FROM tok JOIN documents d USING (doc_id)), r AS (SELECT topic, unnest(f || [f[i] || ' ' || f[i + 1] FOR i IN range(1, len(f))]) AS term FROM w),
        c AS (SELECT topic, term, count(*) AS n FROM r GROUP BY 1, 2), bt AS (SELECT term, sum(n) AS f FROM c GROUP BY 1 HAVING count(*) >= 2), k0 AS (SELECT topic, term, n, f FROM c JOIN bt USING (term)), tp AS (SELECT topic, sum(n) AS size FROM k0 GROUP BY 1), av AS (SELECT avg(size) AS a FROM tp),
        s AS (SELECT topic, term, round(n / size * ln(1 + a / f), 8) AS score FROM k0 JOIN tp USING (topic), av)
        SELECT topic, CAST(k AS INTEGER) AS rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS k FROM s) WHERE k <= 10""",
    ),
    "embedding_mean": (
        lambda s, d: embeddings.dimension_means(table(s, d, "embeddings"), "label"),
        "WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM u GROUP BY 1, 2",
    ),
    "embedding_weighted_pool": (
        lambda s, d: embeddings.weighted_pool(table(s, d, "embeddings"), "label", "embedding", F.col("vec_id") % 7 + 1).withColumn("value", F.round("value", 6)),
        "WITH u AS (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(sum(CAST(x AS DOUBLE) * w) / sum(w), 6) AS value FROM u GROUP BY 1, 2",
    ),
    "word_pairs": (lambda s, d: _named(*_pairs(s, d)).select("word_i", "word_j", "n"), f"WITH {_COUNTED} SELECT word_i, word_j, n FROM pairs"),
    "word_information": (
        _information,
        f"""WITH {_COUNTED}, c AS (SELECT word_i AS i, word_j AS j, CASE WHEN word_i = word_j THEN 2 * n ELSE n END AS n FROM pairs UNION ALL SELECT word_j, word_i, n FROM pairs WHERE word_i <> word_j),
        s AS (SELECT i, sum(n) AS s FROM c GROUP BY i), x AS (SELECT c.i, c.j, ln(CAST(n AS DOUBLE) * (SELECT sum(n) FROM c) / (CAST(a.s AS DOUBLE) * b.s)) AS v FROM c JOIN s a ON a.i = c.i JOIN s b ON b.i = c.j)
        SELECT i AS word_i, j AS word_j, round(v, 6) AS information FROM x WHERE v > 0""",
    ),
    "document_vectors": (lambda s, d: wordvectors.document_vectors(docs(s, d)), None),
    "name_words": (
        lambda s, d: gazetteer.chosen_words(gazetteer.name_words(docs(s, d))),
        rf"""WITH {SENTS}, w AS (SELECT unnest(regexp_extract_all(s, '\p{{L}}+(?:[''’-]\p{{L}}+)*')[2:]) AS w FROM sent), c AS (SELECT lower(w) AS word, count(*) FILTER (WHERE regexp_matches(w, '^\p{{Lu}}')) AS capital, count(*) AS n FROM w GROUP BY 1)
        SELECT word, capital FROM c WHERE capital >= {gazetteer.LEAST} AND capital >= {gazetteer.SHARE} * n ORDER BY capital DESC, word LIMIT {gazetteer.MOST}""",
    ),
    "name_mentions": (lambda s, d: entities.grouped(gazetteer.mentions_of_corpus(docs(s, d))), None),
    "topic_core_distances": (_core_distances, f"WITH {_REACH} SELECT vec_id, round(core, 6) AS core FROM v JOIN c USING (i)"),
    "topic_tree_weights": (_tree_weights, _TREE),
    "topic_clusters": (lambda s, d: topics.clusters(table(s, d, "embeddings")), None),
}

_SQL = {name: sql for name, (_, sql) in ENTRIES.items()}


def _joined(name: str, label: str, order: str) -> str:
    return f"(SELECT doc_id, string_agg({label} || ':' || cnt, ',' ORDER BY {order}) AS x FROM ({_SQL[name]}) GROUP BY doc_id)"


#: Payloads: their parts by the SQL of the parts' own queries, joined.
ENTRIES["lexical_payload"] = (
    _lexical_payload,
    f"""SELECT doc_id, total_words, ttr, mtld, {', '.join(T.PRONOUNS)}, coalesce(w.x, '') AS words, coalesce(a.x, '') AS repetitions, coalesce(b.x, '') AS bigrams, coalesce(t.x, '') AS trigrams, coalesce(o.n, 0) AS n_oppositions
    FROM ({_SQL['lexical_diversity_ttr']}) JOIN ({_SQL['lexical_diversity_mtld']}) USING (doc_id) JOIN ({_SQL['pronoun_ratios']}) USING (doc_id)
    LEFT JOIN {_joined('top_content_words', 'word', 'rank')} w USING (doc_id) LEFT JOIN {_joined('anaphora', 'phrase', 'cnt DESC, phrase')} a USING (doc_id)
    LEFT JOIN {_joined('bigrams_top', 'phrase', 'rank')} b USING (doc_id) LEFT JOIN {_joined('trigrams_top', 'phrase', 'rank')} t USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({X.OPPOSED_AS_IS}) GROUP BY doc_id) o USING (doc_id)""",
)
ENTRIES["syntactic_payload"] = (
    _syntactic_payload,
    f"SELECT * FROM ({_SQL['speech_stats']}) JOIN ({_SQL['modality_markers']}) USING (doc_id) JOIN ({_SQL['pos_distribution']}) USING (doc_id) JOIN ({_SQL['verb_future_lookahead']}) USING (doc_id)",
)
