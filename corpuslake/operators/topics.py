"""Corpus topics: split by length, clusters of embeddings, class-based TF-IDF keywords.

Vectors are reduced by ``layout`` and clustered by ``density``, both fitted on all vectors; every
vector gets a cluster or is an outlier (-1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import density, layout
from corpuslake.session import cut, few, stored

LONG_FORM_WORDS, LEAST_DOCS, LEAST_TOPIC, KEYWORDS = 500, 20, 10, 10
OUTLIER = -1
#: Standard deviations beyond the mean distance at which a vector is off its k-means cluster.
FAR = 3.0


def with_corpus(docs: DataFrame, words: str = "word_count") -> DataFrame:
    """``docs`` with corpus: long_form from 500 words on, else short_form."""
    return docs.withColumn("corpus", F.when(F.coalesce(words, F.lit(0)) >= LONG_FORM_WORDS, "long_form").otherwise("short_form"))


def corpora(docs: DataFrame) -> DataFrame:
    """corpus, n_docs, fitted: whether each corpus has the documents that a fit takes."""
    rows = with_corpus(docs.select(T.word_count("text").alias("word_count"))).groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"))
    return rows.withColumn("fitted", F.col("n_docs") >= LEAST_DOCS)


def ctfidf(docs: DataFrame, topic: str, top: int = KEYWORDS, least_topics: int = 1, bigrams: bool = False, digits: int = 8) -> DataFrame:
    """topic, rank, term, score: tf (share of the topic's terms) x ln(1 + average terms per topic / term's frequency).

    Terms are tokens of two letters or more that are no stop words, with ``bigrams`` also
    pairs of neighbours; those in fewer than ``least_topics`` topics are left out.
    Counts are partial sums by (topic, term); a second shuffle brings a term's counts together (a row a topic at most), whose total stands beside each, and
    what is left is stored once. Each task hands on the best of each topic only.
    """
    words = F.filter(T.tokens("text"), lambda w: (F.length(w) >= 2) & ~T.in_words(w, T.STOPWORDS))
    rows = docs.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), words.alias("ws"))
    terms = F.expr("concat(ws, transform(slice(ws, 2, greatest(size(ws) - 1, 0)), (w, k) -> concat(ws[k], ' ', w)))") if bigrams else F.col("ws")
    counts = rows.select("topic", F.explode(terms).alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    of_term = Window.partitionBy("term")
    kept = counts.select("topic", "term", "n", F.sum("n").over(of_term).alias("f"), F.count(F.lit(1)).over(of_term).alias("topics"))
    kept = stored(kept.where(F.col("topics") >= least_topics).drop("topics"))
    by_topic = cut(kept.groupBy("topic").agg(F.sum("n").alias("size")))
    average = by_topic.agg(F.avg("size").alias("a"))  # one row
    scored = kept.join(few(by_topic), "topic").join(F.broadcast(average)).withColumn("score", F.round(F.col("n") / F.col("size") * F.log(1 + F.col("a") / F.col("f")), digits))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("topic", "rank", "term", "score")


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int | None = None, least: int = LEAST_TOPIC, seed: int = 42, reduce: bool = True) -> DataFrame:
    """id, topic_id, probability: clusters numbered by size, -1 (with probability 0) for outliers.

    The vectors are reduced (``reduce``) to a few dimensions that keep neighbours together and clustered by density, without a number
    of clusters; probability is the membership in the cluster. With ``k`` it is that many clusters by k-means instead.
    """
    if k is not None:
        return _by_number(vectors, id_col, vector, k, least, seed)
    if reduce:
        fitted, _, n = density.fitted_points(vectors, id_col, vector)
        vectors, id_col, vector = fitted.select("node", "id").join(layout.reduced(fitted.select("node", "x"), n, seed=seed) if n >= 2 else fitted.select("node", "x"), "node"), "id", "x"
    rows = density.density_clusters(vectors, id_col, vector, least)
    return rows.select("id", F.col("cluster").alias("topic_id"), F.round("probability", 4).alias("probability"))


def _by_number(vectors: DataFrame, id_col: str, vector: str, k: int, least: int, seed: int) -> DataFrame:
    """As clusters(), for ``k`` clusters by k-means; those of fewer than ``least`` members, and vectors far off their cluster, are outliers.

    probability falls from 1 with the distance to the cluster's centre relative to the distances to all.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = cut(vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    if rows.count() < least:
        return rows.select("id", F.lit(OUTLIER).alias("topic_id"), F.lit(0.0).alias("probability"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="c").fit(rows)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(rows).withColumn("x", vector_to_array("features"))
    d = F.transform(centers, lambda c: F.sqrt(F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
    out = out.withColumn("d", d).withColumn("own", F.get("d", F.col("c")))
    out = cut(out.withColumn("probability", F.round(1 / (F.col("own") + 1e-9) / F.aggregate("d", F.lit(0.0), lambda s, v: s + 1 / (v + 1e-9)), 4)).select("id", "c", "own", "probability"))
    sizes = out.groupBy("c").agg(F.count(F.lit(1)).alias("n"), (F.avg("own") + FAR * F.coalesce(F.stddev("own"), F.lit(0.0)) + 1e-9).alias("far"))
    numbered = sizes.withColumn("topic_id", F.when(F.col("n") >= least, F.row_number().over(Window.orderBy(F.desc("n"), "c")) - 1).otherwise(OUTLIER)).select("c", "far", "topic_id")
    out = out.join(F.broadcast(numbered), "c")  # k rows
    topic = F.when(F.col("own") > F.col("far"), OUTLIER).otherwise(F.col("topic_id"))
    return out.select("id", topic.alias("topic_id"), F.when(topic == OUTLIER, 0.0).otherwise(F.col("probability")).alias("probability"))


def fit(docs: DataFrame, vectors: DataFrame, k: int | None = None, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, topics (corpus, topic_id, topic_keywords, probability), keywords for each corpus that is large enough.

    ``docs`` has doc_id, text, word_count; ``vectors`` has doc_id and embedding. A corpus of fewer
    than ``least_docs`` documents is left out.
    """
    split = with_corpus(docs)
    sizes = {r["corpus"]: r["count"] for r in split.groupBy("corpus").count().collect()}  # two rows
    out = None
    for corpus in sorted(c for c, n in sizes.items() if n >= least_docs):
        part = split.where(F.col("corpus") == corpus)
        assigned = clusters(vectors.join(part.select("doc_id"), "doc_id", "left_semi"), "doc_id", k=k).withColumnRenamed("id", "doc_id")
        words = ctfidf(part.join(assigned.where(F.col("topic_id") != OUTLIER), "doc_id"), "topic_id", least_topics=2, bigrams=True)
        lists = words.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda v: v["term"]).alias("topic_keywords")).withColumnRenamed("topic", "topic_id")
        rows = assigned.join(F.broadcast(lists), "topic_id", "left").withColumn("topic_keywords", F.coalesce("topic_keywords", F.expr("cast(array() as array<string>)")))
        rows = rows.select("doc_id", F.struct(F.lit(corpus).alias("corpus"), "topic_id", "topic_keywords", "probability").alias("topics"), F.col("topic_keywords").alias("keywords"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, topics struct<corpus:string,topic_id:int,topic_keywords:array<string>,probability:double>, keywords array<string>")
    return out
