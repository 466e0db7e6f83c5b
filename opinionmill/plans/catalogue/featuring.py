"""Tokens, vocabulary, TF-IDF, bags of words, dense vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionmill.functions.text import fold_accents, ngrams, whitespace_tokens, word_tokens
from opinionmill.functions.vectors import argmax, cosine, norm, unit
from opinionmill.operators import features, sampling
from opinionmill.operators.boosting import entries
from opinionmill.operators.relational import lookup_join
from opinionmill.plans import fixtures as fx
from opinionmill.plans.catalogue.preparing import sql_split
from opinionmill.plans.catalogue.registry import query

SQL_GRAMS = f"""{fx.SQL_TEXTS}, words AS (SELECT doc_id, lang, {fx.sql_words('review')} AS t FROM texts),
grams AS (SELECT doc_id, lang, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM words)"""


@query("tokens", f"WITH {SQL_GRAMS} SELECT doc_id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS BIGINT) AS n FROM words")
def tokens(spark, d):
    docs = fx.texts(spark, d).select("doc_id", word_tokens("review").alias("t"))
    return docs.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n"))


@query("ngram_counts", f"""WITH {SQL_GRAMS} SELECT doc_id, CAST(len(g) AS BIGINT) AS n, md5(array_to_string(g, '|')) AS digest FROM grams""")
def ngram_counts(spark, d):
    docs = fx.texts(spark, d).select("doc_id", ngrams(word_tokens("review"), 1, 2).alias("g"))
    return docs.select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("digest"))


@query("accent_fold", f"WITH {fx.SQL_TEXTS} SELECT doc_id, strip_accents(review) AS folded FROM texts")
def accent_fold(spark, d):
    return fx.texts(spark, d).select("doc_id", fold_accents("review").alias("folded"))


@query(
    "doc_freq",
    f"""WITH {SQL_GRAMS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(g)) AS term FROM grams)
GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.95 * (SELECT count(*) FROM texts)""",
)
def doc_freq(spark, d):
    return features.fit_vocabulary(fx.texts(spark, d)).select("term", "df")


# Split of the whole corpus by language, so every document takes part.
SQL_SPLIT = f"{SQL_GRAMS}, {sql_split('grams', 'lang')}"
SQL_VOCAB = f"""{SQL_SPLIT}, n_train AS (SELECT count(*) AS n FROM split_of WHERE split = 'train'),
dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(g)) AS term FROM split_of WHERE split = 'train') GROUP BY term),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
  FROM dfs, n_train WHERE df >= 5 AND df <= 0.95 * n)"""


def sql_tfidf(split: str) -> str:
    return f"""WITH {SQL_VOCAB}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(g) AS term FROM split_of WHERE split = '{split}') GROUP BY doc_id, term),
w AS (SELECT doc_id, tf.term, term_id, (1.0 + ln(tf)) * idf AS w FROM tf JOIN vocab ON tf.term = vocab.term)
SELECT doc_id, term, term_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w"""


def split_texts(spark, d):
    return sampling.stratified_split(fx.texts(spark, d).select("doc_id", "lang", "review", "label"), strata="lang")


def tfidf_of(spark, d, split: str):
    docs = split_texts(spark, d)
    vocab = features.fit_vocabulary(docs.where("split = 'train'"))
    weights = features.tfidf(docs.where(F.col("split") == split), vocab)
    return weights.withColumn("tfidf", F.round("tfidf", 6))


@query("tfidf_train", sql_tfidf("train"))
def tfidf_train(spark, d):
    return tfidf_of(spark, d, "train")


@query("tfidf_test", sql_tfidf("test"))
def tfidf_test(spark, d):
    return tfidf_of(spark, d, "test")


@query("vocabulary", f"WITH {SQL_VOCAB} SELECT term, term_id, df, round(idf, 6) AS idf FROM vocab")
def vocabulary(spark, d):
    vocab = features.fit_vocabulary(split_texts(spark, d).where("split = 'train'"))
    return vocab.withColumn("idf", F.round("idf", 6))


@query(
    "vocabulary_stats",
    f"WITH {SQL_VOCAB} SELECT count(*) AS vocab_size, max(term_id) AS max_term_id, min(df) AS min_df, max(df) AS max_df FROM vocab",
)
def vocabulary_stats(spark, d):
    return features.vocabulary_stats(features.fit_vocabulary(split_texts(spark, d).where("split = 'train'")))


@query(
    "bow_filtered",
    f"""WITH {fx.SQL_TEXTS}, t AS (SELECT doc_id, {fx.sql_ws_tokens('review')} AS t FROM texts),
keep AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT unnest(list_distinct(t)) AS term FROM t) GROUP BY term
  HAVING count(*) >= 10 AND count(*) <= 0.5 * (SELECT count(*) FROM t))
SELECT doc_id, e.term, term_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) e JOIN keep ON e.term = keep.term
GROUP BY doc_id, e.term, term_id""",
)
def bow_filtered(spark, d):
    return features.bag_of_words(fx.texts(spark, d))[1]


@query(
    "tfidf_vectors",
    f"""WITH {SQL_VOCAB}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(g) AS term FROM split_of WHERE split = 'test') GROUP BY doc_id, term),
w AS (SELECT doc_id, count(*) AS n_terms, sum(term_id) AS id_sum FROM tf JOIN vocab ON tf.term = vocab.term GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_terms, 0) AS n_terms, CAST(coalesce(id_sum, 0) AS BIGINT) AS id_sum,
  CASE WHEN n_terms IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length
FROM split_of s LEFT JOIN w ON s.doc_id = w.doc_id WHERE split = 'test'""",
)
def tfidf_vectors(spark, d):
    """Assembled vectors, summed up by their non-zero places, place numbers and length."""
    docs = split_texts(spark, d)
    vocab = features.fit_vocabulary(docs.where("split = 'train'"))
    test = docs.where("split = 'test'")
    vectors = features.to_vectors(features.tfidf(test, vocab), vocab.count(), test)
    found = vectors.select("doc_id", entries("features").alias("e"))
    return found.select("doc_id", F.col("e.feature").alias("p"), norm("e.value").alias("length")).select(
        "doc_id",
        F.size("p").cast("long").alias("n_terms"),
        F.aggregate("p", F.lit(0).cast("long"), lambda s, i: s + i).alias("id_sum"),
        F.round("length", 6).alias("length"),
    )


@query(
    "doc_embeddings",
    f"WITH {fx.SQL_TEXTS} SELECT doc_id, CAST(32 AS BIGINT) AS dim, true AS unit_or_zero FROM texts",
)
def doc_embeddings(spark, d):
    """Word-vector means of all documents: dimension, and length one (zero without known words)."""
    docs = fx.texts(spark, d)
    dense = features.embed(docs, features.fit_embedder(docs, dim=32))
    length = F.round(norm("embedding"), 6)
    return dense.select("doc_id", F.size("embedding").cast("long").alias("dim"), length.isin(0.0, 1.0).alias("unit_or_zero"))


@query(
    "missing_vectors",
    f"WITH {fx.SQL_TEXTS}, {fx.SQL_VECTORS} SELECT doc_id, lang FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM vectors)",
)
def missing_vectors(spark, d):
    return features.missing_vectors(fx.texts(spark, d), fx.vectors(spark, d)).select("doc_id", "lang")


@query(
    "embed_with_cache",
    f"""WITH {fx.SQL_TEXTS}, {fx.SQL_VECTORS} SELECT t.doc_id, round(coalesce(v.embedding[1], length(t.review)), 6) AS first,
  CAST(coalesce(len(v.embedding), 1) AS BIGINT) AS dim FROM texts t LEFT JOIN vectors v ON t.doc_id = v.doc_id""",
)
def embed_with_cache(spark, d):
    """Stored vectors are kept; only the other documents go through a user's encoder."""
    out = features.embed(fx.texts(spark, d), encoder=lambda s: s.str.len().to_numpy()[:, None], cached=fx.vectors(spark, d))
    return out.select(
        "doc_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.size("embedding").cast("long").alias("dim")
    )


@query(
    "cosine_to_topic",
    f"""WITH {fx.SQL_VECTORS}, flat AS (SELECT topic, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM vectors),
c AS (SELECT topic, list(x ORDER BY i) AS centroid FROM (SELECT topic, i, avg(x) AS x FROM flat GROUP BY topic, i) GROUP BY topic)
SELECT doc_id, v.topic, round(list_cosine_similarity(embedding, centroid), 6) + 0.0 AS similarity FROM vectors v JOIN c ON v.topic = c.topic""",
)
def cosine_to_topic(spark, d):
    from opinionmill.operators.topics import centroids

    vectors = fx.vectors(spark, d)
    centre = centroids(vectors, vectors.select("doc_id", "topic"))
    return lookup_join(vectors, centre, "topic", "inner").select(
        "doc_id", "topic", F.round(cosine("embedding", "centroid"), 6).alias("similarity")
    )


@query(
    "unit_vectors",
    f"""WITH {fx.SQL_VECTORS} SELECT doc_id, round(embedding[1] / sqrt(list_dot_product(embedding, embedding)), 6) + 0.0 AS first,
  CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS place FROM vectors""",
)
def unit_vectors(spark, d):
    scaled = fx.vectors(spark, d).select("doc_id", unit("embedding").alias("u"), argmax("embedding").alias("place"))
    return scaled.select("doc_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), "place")


@query(
    "tokens_on_whitespace",
    f"WITH {fx.SQL_TEXTS} SELECT doc_id, CAST(len({fx.sql_ws_tokens('review')}) AS BIGINT) AS n FROM texts",
)
def tokens_on_whitespace(spark, d):
    return fx.texts(spark, d).select("doc_id", F.size(whitespace_tokens("review")).cast("long").alias("n"))
