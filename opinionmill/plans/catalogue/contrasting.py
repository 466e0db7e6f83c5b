"""Word use by class, ranking weights, two corpora side by side, agreement beyond chance."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionmill.functions.text import word_tokens
from opinionmill.operators import evaluation, features, lexicon, topics
from opinionmill.plans import fixtures as fx
from opinionmill.plans.catalogue.evaluating import SQL_PRED, predictions, rounded
from opinionmill.plans.catalogue.registry import query
from opinionmill.plans.catalogue.topicking import STOPS, sql_words

SQL_TERMS = f"t AS (SELECT doc_id, label, unnest({fx.sql_words('review')}) AS term FROM texts)"


@query(
    "class_word_frequency",
    f"""WITH {fx.SQL_TEXTS}, {SQL_TERMS}, c AS (SELECT label, term, count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY label, term)
SELECT label, term, n, round(n / sum(n) OVER (PARTITION BY label), 12) AS share FROM c""",
)
def class_word_frequency(spark, d):
    found = features.class_term_counts(fx.texts(spark, d), word_tokens("review"))
    return found.withColumn("share", F.round("share", 12))


@query(
    "bm25_weights",
    f"""WITH {fx.SQL_TEXTS}, {SQL_TERMS}, c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
l AS (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS len, count(*) OVER (PARTITION BY term) AS df FROM c),
s AS (SELECT (SELECT count(*) FROM texts) AS n, (SELECT sum(tf) FROM c) / (SELECT count(*) FROM texts) AS avg_len)
SELECT doc_id, term, tf, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
  / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)), 6) AS bm25 FROM l, s""",
)
def bm25_weights(spark, d):
    """Ranking weight of every word of every text."""
    return features.bm25(fx.texts(spark, d), word_tokens("review")).withColumn("bm25", F.round("bm25", 6))


@query(
    "vocabulary_contrast",
    f"""WITH {fx.SQL_TEXTS}, a AS (SELECT term, count(*) AS n FROM (SELECT unnest({fx.sql_words('review')}) AS term FROM texts) GROUP BY term),
b AS (SELECT term, count(*) AS n FROM (SELECT unnest({fx.sql_words('text')}) AS term FROM conversations) GROUP BY term),
j AS (SELECT coalesce(a.term, b.term) AS term, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b ON a.term = b.term)
SELECT term, n_left, n_right, round(ln(((n_left + 0.5::DOUBLE) / (sum(n_left) OVER () + count(*) OVER () / 2))
  / ((n_right + 0.5::DOUBLE) / (sum(n_right) OVER () + count(*) OVER () / 2))), 9) + 0.0 AS log_ratio FROM j""",
)
def vocabulary_contrast(spark, d):
    """Words of the reviews against those of the conversations."""
    turns = fx.load(spark, d, "conversations").select("text")
    found = features.vocabulary_contrast(fx.texts(spark, d), turns, word_tokens("review"), word_tokens("text"))
    return found.withColumn("log_ratio", F.round("log_ratio", 9))


@query(
    "cohen_kappa",
    f"""WITH {SQL_PRED}, n AS (SELECT model, count(*) AS n, avg(CAST(label = prediction AS INTEGER)) AS observed FROM pred GROUP BY model),
t AS (SELECT model, label AS c, count(*) AS k FROM pred GROUP BY ALL), p AS (SELECT model, prediction AS c, count(*) AS k FROM pred GROUP BY ALL),
e AS (SELECT t.model, sum(t.k * CAST(p.k AS DOUBLE)) AS s FROM t JOIN p ON t.model = p.model AND t.c = p.c GROUP BY t.model)
SELECT n.model, n, round(observed, 9) AS observed, round(coalesce(s, 0) / n / n, 9) AS expected,
  round((observed - coalesce(s, 0) / n / n) / nullif(1 - coalesce(s, 0) / n / n, 0), 9) AS kappa FROM n LEFT JOIN e ON n.model = e.model""",
)
def cohen_kappa(spark, d):
    return rounded(evaluation.cohen_kappa(predictions(spark, d)), ["observed", "expected", "kappa"], 9)


@query(
    "label_cardinality",
    f"""WITH {fx.SQL_TEXTS}, {fx.SQL_EMOLEX}, w AS (SELECT doc_id, unnest({fx.sql_ws_tokens('review')}) AS word FROM texts),
m AS (SELECT DISTINCT doc_id, emotion FROM w JOIN emolex ON w.word = emolex.word WHERE value = 1), s AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
SELECT count(*) AS documents, (SELECT count(DISTINCT emotion) FROM m) AS labels, round(sum(n) / count(*), 9) AS cardinality,
  round(sum(n) / count(*) / (SELECT count(DISTINCT emotion) FROM m), 9) AS density FROM s""",
)
def label_cardinality(spark, d):
    """Emotions per document, a document having those of its words."""
    from opinionmill.functions.text import whitespace_tokens
    from opinionmill.operators.relational import lookup_join

    words = fx.texts(spark, d).select("doc_id", F.explode(whitespace_tokens("review")).alias("word"))
    marks = fx.emolex(spark).where("value = 1").select("word", F.col("emotion").alias("label")).distinct()
    found = evaluation.label_cardinality(lookup_join(words, marks, "word", "inner").select("doc_id", "label").distinct())
    return rounded(found, ["cardinality", "density"], 9)


@query(
    "rake_phrases",
    rf"""WITH {fx.SQL_TEXTS}, m AS (SELECT [CASE WHEN t IN ({', '.join(f"'{w}'" for w in STOPS)}) THEN '|' ELSE t END FOR t IN {fx.sql_words('review', False)}] AS m FROM texts),
r AS (SELECT trim(unnest(string_split(array_to_string(m, ' '), '|'))) AS phrase FROM m), p AS (SELECT phrase, count(*) AS n FROM r WHERE phrase <> '' GROUP BY phrase),
w AS (SELECT phrase, n, unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) AS l FROM p),
s AS (SELECT word, CAST(sum(n * l) AS DOUBLE) / sum(n) AS s FROM w GROUP BY word),
f AS (SELECT phrase, any_value(n) AS n, round(sum(s), 6) AS score FROM w JOIN s ON w.word = s.word GROUP BY phrase)
SELECT CAST(row_number() OVER (ORDER BY score DESC, n DESC, phrase) AS INTEGER) AS rank, phrase, n, score FROM f ORDER BY rank LIMIT 50""",
)
def rake_phrases(spark, d):
    """The 50 best phrases of all texts."""
    return topics.rake(fx.texts(spark, d), STOPS, 50)


AXES = ("anger", "joy")


@query(
    "real_valued_means",
    f"""WITH {fx.SQL_TEXTS}, {fx.SQL_EMOLEX}, w AS (SELECT doc_id, unnest({fx.sql_ws_tokens('review')}) AS word FROM texts),
v AS (SELECT word, {', '.join(f"coalesce(avg(value) FILTER (emotion = '{a}'), 0) AS {a}" for a in AXES)} FROM emolex GROUP BY word)
SELECT doc_id, {', '.join(f"round(coalesce(sum({a}) / count(*), 0), 9) AS axis_{a}" for a in AXES)} FROM (SELECT texts.doc_id, w.word FROM texts LEFT JOIN w ON texts.doc_id = w.doc_id) x
LEFT JOIN v ON x.word = v.word GROUP BY doc_id""",
)
def real_valued_means(spark, d):
    """Mean of real-valued axes over a text's words, as for valence, arousal and dominance."""
    table = lexicon.emotion_table(fx.emolex(spark), AXES, flag=False)
    return rounded(lexicon.emotion_means(fx.texts(spark, d), table, AXES, prefix="axis_"), [f"axis_{a}" for a in AXES], 9)


@query(
    "topic_words_by_class",
    f"""WITH {fx.SQL_DOC_VECTORS}, {sql_words('topic, label')} SELECT topic, label, term, tf, round(weight, 9) AS weight FROM tw WHERE label IS NOT NULL""",
)
def topic_words_by_class(spark, d):
    """Class-based TF-IDF of the words of each topic and class."""
    found = topics.words(fx.doc_vectors(spark, d), by=["topic", "label"]).where("label IS NOT NULL")
    return found.withColumn("weight", F.round("weight", 9))
