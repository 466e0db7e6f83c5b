"""Lexicon scores, the joined signature, and category scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionmill.operators import audit, categories, lexicon
from opinionmill.operators.evaluation import metrics
from opinionmill.plans import fixtures as fx
from opinionmill.plans.catalogue.preparing import sql_describe
from opinionmill.plans.catalogue.registry import query
from opinionmill.plans.stages import CATEGORIES
from opinionmill.session import checkpoint

NAMES = [categories.column_of(c) for c in CATEGORIES]
EMO = [f"emo_{e}" for e in fx.EMOTIONS]

# The longest entry at a place wins and covers its words: what a leftmost alternation sorted by
# length does.
_ALTERNATION = "|".join(sorted((p for p, _ in fx.PHRASES), key=lambda p: (-len(p), p)))
SQL_SUM = f"""{fx.SQL_PHRASES}, padded AS (
  SELECT doc_id, review, regexp_replace(regexp_replace(lower(review), '([^\\p{{L}}\\p{{N}}_])', ' \\1 ', 'g'), '^|$', ' ', 'g') AS p FROM texts),
found AS (SELECT doc_id, unnest(regexp_extract_all(p, ' (?:{_ALTERNATION.replace(' ', '   ')}) ')) AS m FROM padded),
phrase_sums AS (SELECT doc_id, CAST(sum(score) AS DOUBLE) AS s FROM found JOIN phrases ON phrase = replace(trim(m), '   ', ' ') GROUP BY doc_id),
lex_sums AS (SELECT t.doc_id, coalesce(s, 0.0) AS lex_sum, coalesce(s, 0.0) / greatest(len({fx.sql_ws_tokens('review')}), 1) AS lex_sum_norm
  FROM texts t LEFT JOIN phrase_sums ON t.doc_id = phrase_sums.doc_id)"""


@query("lex_sum", f"WITH {fx.SQL_TEXTS}, {SQL_SUM} SELECT doc_id, lex_sum FROM lex_sums")
def lex_sum(spark, d):
    return lexicon.valence_sum(fx.texts(spark, d), fx.phrases(spark)).select("doc_id", "lex_sum")


@query("lex_sum_norm", f"WITH {fx.SQL_TEXTS}, {SQL_SUM} SELECT doc_id, round(lex_sum_norm, 6) + 0.0 AS lex_sum_norm FROM lex_sums")
def lex_sum_norm(spark, d):
    sums = lexicon.valence_sum(fx.texts(spark, d), fx.phrases(spark))
    return sums.select("doc_id", F.round("lex_sum_norm", 6).alias("lex_sum_norm"))


def _sql_step(k: int) -> str:
    damp = {1: 1.0, 2: 0.95, 3: 0.9}[k]
    negated = f"CASE WHEN coalesce(g{k}, false) OR contains(p{k}, 'n''t') THEN -0.74 ELSE 1.0 END"
    factor = {
        1: negated,
        2: f"CASE WHEN p2 = 'never' AND p1 IN ('so', 'this') THEN 1.5 ELSE {negated} END",
        3: f"CASE WHEN (p3 = 'never' AND p2 IN ('so', 'this')) OR p1 IN ('so', 'this') THEN 1.25 ELSE {negated} END",
    }[k]
    return f"""s{k} AS (SELECT * REPLACE (CASE WHEN p{k} IS NULL OR coalesce(l{k}, false) THEN v ELSE
    (v + CASE WHEN v < 0 THEN -coalesce(b{k}, 0.0) ELSE coalesce(b{k}, 0.0) END * CAST({damp} AS DOUBLE)) * CAST({factor} AS DOUBLE) END AS v) FROM {'s' + str(k - 1) if k > 1 else 'ctx'})"""


_EDGE = r"""^(?:[.!?,;:\-''"]|!!!?|\?\?\??|\?!\?|!\?!|\?!\?!|!\?!\?)([^!-/:-@\[-`{-~]{2,})$|^([^!-/:-@\[-`{-~]{2,})(?:[.!?,;:\-''"]|!!!?|\?\?\??|\?!\?|!\?!|\?!\?!|!\?!\?)$"""
SQL_POLARITY = f"""{fx.SQL_VALENCE}, {fx.SQL_MODIFIERS},
listed AS (SELECT doc_id, review, list_transform(list_filter({fx.sql_ws_tokens('review')}, lambda t: length(t) > 1),
    lambda t: regexp_replace(t, '{_EDGE}', '\\1\\2')) AS t FROM texts),
tok AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w FROM listed),
near AS (SELECT *, lag(w, 1) OVER o AS p1, lag(w, 2) OVER o AS p2, lag(w, 3) OVER o AS p3, row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS nth
  FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ctx AS (SELECT n.doc_id, n.w, p1, p2, p3, CAST(v.valence AS DOUBLE) AS v,
    v1.word IS NOT NULL AS l1, v2.word IS NOT NULL AS l2, v3.word IS NOT NULL AS l3,
    CAST(m1.booster AS DOUBLE) AS b1, CAST(m2.booster AS DOUBLE) AS b2, CAST(m3.booster AS DOUBLE) AS b3,
    m1.negator AS g1, m2.negator AS g2, m3.negator AS g3
  FROM near n JOIN valence v ON n.w = v.word
  LEFT JOIN valence v1 ON p1 = v1.word LEFT JOIN valence v2 ON p2 = v2.word LEFT JOIN valence v3 ON p3 = v3.word
  LEFT JOIN modifiers m1 ON p1 = m1.word LEFT JOIN modifiers m2 ON p2 = m2.word LEFT JOIN modifiers m3 ON p3 = m3.word
  WHERE nth = 1),
{_sql_step(1)}, {_sql_step(2)}, {_sql_step(3)},
each_hit AS (SELECT s3.doc_id, v * m AS v, m FROM s3
  JOIN (SELECT doc_id, w, count(*) AS m FROM tok GROUP BY doc_id, w) c ON s3.doc_id = c.doc_id AND s3.w = c.w),
sums AS (SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + m ELSE 0 END) AS pos, sum(CASE WHEN v < 0 THEN v - m ELSE 0 END) AS neg,
    sum(CASE WHEN v <> 0 THEN m ELSE 0 END) AS hits FROM each_hit GROUP BY doc_id),
raised AS (SELECT l.doc_id, len(t) AS n, len(t) - coalesce(hits, 0) AS neu, coalesce(s, 0) AS s, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg,
    least(length(review) - length(replace(review, '!', '')), 4) * 0.292::DOUBLE AS e,
    length(review) - length(replace(review, '?', '')) AS q
  FROM listed l LEFT JOIN sums ON l.doc_id = sums.doc_id),
amp AS (SELECT * REPLACE (e + CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * 0.18::DOUBLE ELSE 0.96 END AS e) FROM raised),
added AS (SELECT doc_id, n, neu, CASE WHEN s > 0 THEN s + e WHEN s < 0 THEN s - e ELSE s END AS s,
    CASE WHEN pos > abs(neg) THEN pos + e ELSE pos END AS pos, CASE WHEN pos < abs(neg) THEN neg - e ELSE neg END AS neg FROM amp),
lex_polarity AS (SELECT doc_id,
    CASE WHEN n > 0 THEN round(abs(neg) / (pos + abs(neg) + neu), 3) ELSE 0.0 END + 0.0 AS lex_neg,
    CASE WHEN n > 0 THEN round(neu / (pos + abs(neg) + neu), 3) ELSE 0.0 END + 0.0 AS lex_neu,
    CASE WHEN n > 0 THEN round(pos / (pos + abs(neg) + neu), 3) ELSE 0.0 END + 0.0 AS lex_pos,
    round(s / sqrt(s * s + 15.0), 4) + 0.0 AS lex_compound FROM added)"""


@query("lex_polarity", f"WITH {fx.SQL_TEXTS}, {SQL_POLARITY} SELECT * FROM lex_polarity")
def lex_polarity(spark, d):
    return lexicon.polarity(fx.texts(spark, d), fx.valence(spark), fx.modifiers(spark))


SQL_WIDE = f"""{fx.SQL_EMOLEX}, wide AS (SELECT word, {', '.join(
    f"coalesce(avg(CASE WHEN emotion = '{e}' THEN CAST(value AS DOUBLE) END), 0.0) AS {e}" for e in fx.EMOTIONS
)} FROM emolex WHERE value = 1 GROUP BY word)"""


@query("emotion_pivot", f"WITH {SQL_WIDE}, hit AS (SELECT word, count(*) AS n FROM (SELECT unnest({fx.sql_ws_tokens('lower(text)')}) AS word FROM documents) GROUP BY word) SELECT wide.*, n FROM wide JOIN hit ON wide.word = hit.word")
def emotion_pivot(spark, d):
    """The pivoted lexicon beside the corpus frequency of its words."""
    from opinionmill.functions.text import whitespace_tokens

    docs = fx.load(spark, d, "documents", "doc_id")
    seen = docs.select(F.explode(whitespace_tokens(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(lexicon.emotion_table(fx.emolex(spark), fx.EMOTIONS), "word").select("word", *fx.EMOTIONS, "n")


SQL_EMOTIONS = f"""{SQL_WIDE}, etok AS (SELECT doc_id, unnest({fx.sql_ws_tokens('review')}) AS word FROM texts),
esum AS (SELECT doc_id, {', '.join(f'sum(coalesce({e}, 0)) / count(*) AS emo_{e}' for e in fx.EMOTIONS)}
  FROM etok LEFT JOIN wide ON etok.word = wide.word GROUP BY doc_id),
emo AS (SELECT t.doc_id, {', '.join(f'coalesce({e}, 0.0) AS {e}' for e in EMO)} FROM texts t LEFT JOIN esum ON t.doc_id = esum.doc_id)"""


@query("emotion_means", f"WITH {fx.SQL_TEXTS}, {SQL_EMOTIONS} SELECT doc_id, {', '.join(f'round({e}, 6) + 0.0 AS {e}' for e in EMO)} FROM emo")
def emotion_means(spark, d):
    out = lexicon.emotion_means(fx.texts(spark, d), lexicon.emotion_table(fx.emolex(spark), fx.EMOTIONS), fx.EMOTIONS)
    return out.select("doc_id", *[F.round(e, 6).alias(e) for e in EMO])


def signature_of(spark, d):
    """All score columns; the texts are cleaned once and stored, since three scorers read them."""
    docs = checkpoint(fx.texts(spark, d).select("doc_id", "label", "review"))
    return lexicon.signature(
        docs,
        lexicon.polarity(docs, fx.valence(spark), fx.modifiers(spark)),
        lexicon.valence_sum(docs, fx.phrases(spark)),
        lexicon.emotion_means(docs, lexicon.emotion_table(fx.emolex(spark), fx.EMOTIONS), fx.EMOTIONS),
    )


SCORES = ["lex_neg", "lex_neu", "lex_pos", "lex_compound", "lex_sum", "lex_sum_norm", *EMO]
SQL_SIGNATURE = f"""{fx.SQL_TEXTS}, {SQL_POLARITY}, {SQL_SUM}, {SQL_EMOTIONS},
sig AS (SELECT t.doc_id, t.label, {', '.join(SCORES)} FROM texts t JOIN lex_polarity p ON t.doc_id = p.doc_id
  JOIN lex_sums s ON t.doc_id = s.doc_id JOIN emo ON t.doc_id = emo.doc_id)"""


@query("signature", f"WITH {SQL_SIGNATURE} SELECT doc_id, label, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in SCORES)} FROM sig")
def signature(spark, d):
    return signature_of(spark, d).select("doc_id", "label", *[F.round(c, 6).alias(c) for c in SCORES])


@query("signature_describe", f"WITH {SQL_SIGNATURE} {sql_describe('sig', ['lex_sum', 'lex_sum_norm', 'lex_compound'], 9)}")
def signature_describe(spark, d):
    # Scores have four places, so a mean can lie exactly between two six-place numbers.
    out = audit.describe(signature_of(spark, d), ["lex_sum", "lex_sum_norm", "lex_compound"])
    return out.withColumn("value", F.round("value", 9))


@query(
    "signature_class_means",
    f"WITH {SQL_SIGNATURE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, round(avg({c}) FILTER (WHERE label = 0), 9) + 0.0 AS negative, round(avg({c}) FILTER (WHERE label = 1), 9) + 0.0 AS positive FROM sig"
        for c in SCORES
    ),
)
def signature_class_means(spark, d):
    means = lexicon.class_means(signature_of(spark, d), SCORES)
    return means.select("dimension", F.round("negative", 9).alias("negative"), F.round("positive", 9).alias("positive"))


def sql_binary_metrics(source: str, by: str = "") -> str:
    """One row per group of ``source(label, prediction, ...)`` with two classes present."""
    f1 = "coalesce(2.0 * {tp} / nullif(2.0 * {tp} + {fp} + {fn}, 0), 0.0)"
    pos = f1.format(tp="count(*) FILTER (WHERE label = 1 AND prediction = 1)", fp="count(*) FILTER (WHERE label = 0 AND prediction = 1)", fn="count(*) FILTER (WHERE label = 1 AND prediction = 0)")
    neg = f1.format(tp="count(*) FILTER (WHERE label = 0 AND prediction = 0)", fp="count(*) FILTER (WHERE label = 1 AND prediction = 0)", fn="count(*) FILTER (WHERE label = 0 AND prediction = 1)")
    head, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {head}CAST(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS accuracy,
  ({pos} + {neg}) / 2 AS f1_macro, {pos} AS f1_pos, {neg} AS f1_neg FROM {source}{group}"""


def sql_round(columns: list[str], places: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {places}) + 0.0 AS {c}" for c in columns)


METRICS = ["accuracy", "f1_macro", "f1_pos", "f1_neg"]


@query(
    "lex_accuracy",
    f"""WITH {fx.SQL_LABELLED}, {SQL_POLARITY}, pred AS (SELECT l.label, CASE WHEN lex_compound > -0.2 THEN 1 ELSE 0 END AS prediction
  FROM labelled l JOIN lex_polarity p ON l.doc_id = p.doc_id), m AS ({sql_binary_metrics('pred')}) SELECT {sql_round(METRICS)} FROM m""",
)
def lex_accuracy(spark, d):
    docs = fx.stored_labelled(spark, d)
    scored = lexicon.signature(docs, lexicon.polarity(docs, fx.valence(spark), fx.modifiers(spark)))
    rows = metrics(lexicon.classify(scored, threshold=-0.2), by=None)
    return rows.select(*[F.round(c, 6).alias(c) for c in METRICS])


SQL_SCORES = f"""{fx.SQL_SEEDS}, ctok AS (SELECT doc_id, len(t) AS n, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS word
  FROM (SELECT doc_id, {fx.sql_words('review')} AS t FROM texts)),
csum AS (SELECT doc_id, max(n) AS n, {', '.join(
    f"coalesce(sum(weight) FILTER (WHERE category = '{c}'), 0.0) AS {n}" for c, n in zip(CATEGORIES, NAMES)
)} FROM ctok LEFT JOIN seeds ON word = seed_term GROUP BY doc_id),
scores AS (SELECT t.doc_id, t.label, t.review, {', '.join(f'1 / (1 + exp(-(4.0 * {n} / sqrt(greatest(c.n, 1)) - 2.0))) AS {n}' for n in NAMES)}
  FROM texts t JOIN csum c ON t.doc_id = c.doc_id)"""


@query("category_scores", f"WITH {fx.SQL_TEXTS}, {SQL_SCORES} SELECT doc_id, {sql_round(NAMES)} FROM scores")
def category_scores(spark, d):
    scores = categories.score(fx.texts(spark, d), CATEGORIES, seeds=fx.seeds(spark))
    return scores.select("doc_id", *[F.round(n, 6).alias(n) for n in NAMES])


def labelled_scores(spark, d):
    docs = checkpoint(fx.texts(spark, d).select("doc_id", "label", "review"))
    scores = categories.score(docs, CATEGORIES, seeds=fx.seeds(spark))
    # Rounded so that equal scores tie in every engine and the key decides.
    return docs, docs.select("doc_id", "label").join(scores, "doc_id").select("doc_id", "label", *[F.round(n, 9).alias(n) for n in NAMES])


@query(
    "category_class_means",
    f"WITH {fx.SQL_TEXTS}, {SQL_SCORES} SELECT label, {', '.join(f'round(avg({n}), 6) AS {n}' for n in NAMES)} FROM scores GROUP BY label",
)
def category_class_means(spark, d):
    means = categories.class_means(labelled_scores(spark, d)[1], NAMES)
    return means.select("label", *[F.round(n, 6).alias(n) for n in NAMES])


SQL_TOP3 = f"""{SQL_SCORES}, flat AS (UNPIVOT (SELECT doc_id, label, review, {', '.join(f'round({n}, 9) AS {n}' for n in NAMES)} FROM scores)
  ON {', '.join(NAMES)} INTO NAME category VALUE score),
top3 AS (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, label, score, review
  FROM flat QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, doc_id) <= 3)"""


@query("category_top3", f"WITH {fx.SQL_TEXTS}, {SQL_TOP3} SELECT category, rank, doc_id, label, round(score, 6) AS score, review FROM top3")
def category_top3(spark, d):
    docs, scores = labelled_scores(spark, d)
    return categories.top_examples(scores, NAMES, docs).withColumn("score", F.round("score", 6))


@query(
    "category_examples",
    f"""WITH {fx.SQL_TEXTS}, {SQL_TOP3} SELECT category, CAST(3 AS BIGINT) AS n, string_agg(CAST(length(review) AS VARCHAR), ',' ORDER BY rank) AS lengths
FROM top3 GROUP BY category""",
)
def category_examples(spark, d):
    """The nested example document, read back from its JSON text."""
    docs, scores = labelled_scores(spark, d)
    document = categories.examples_document(categories.top_examples(scores, NAMES, docs))
    entries = F.from_json("examples", "array<struct<label: long, score: double, review: string>>")
    return document.select("category", entries.alias("e")).select(
        "category",
        F.size("e").cast("long").alias("n"),
        F.array_join(F.transform("e", lambda x: F.char_length(x["review"]).cast("string")), ",").alias("lengths"),
    )


@query("category_scores_by_vector")
def category_scores_by_vector(spark, d):
    """The same scores from dense vectors: word vectors of the seed terms as prototypes."""
    from opinionmill.operators import features

    docs = fx.texts(spark, d)
    model = features.fit_embedder(docs, dim=32)
    prototypes = categories.prototypes_from_seeds(model, fx.seeds(spark), CATEGORIES)
    return categories.score(features.embed(docs, model), CATEGORIES, "vector", prototypes=prototypes)
