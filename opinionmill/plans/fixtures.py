"""Views over the driver's tables and small lookup tables, each with its SQL twin.

The views give the engine its input shape: labelled reviews from ``documents`` and ``labels``,
web texts from ``pages``, topic-labelled vectors from ``embeddings``. Every view takes whole
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinionmill.operators.cleaning import drop_incomplete, with_review
from opinionmill.operators.relational import literal_table
from opinionmill.plans.stages import CATEGORIES
from opinionmill.session import checkpoint
from opinionmill.sources.tables import read_table

TOXIC = ("trash", "scum", "clown", "idiot", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting")
VALENCE = [(w, -2.0 - 0.1 * i) for i, w in enumerate(TOXIC)] + [
    ("best", 3.2), ("thing", 1.1), ("is", 0.4), ("est", 0.3), ("for", 0.2), ("pas", -0.6), ("no", -1.2), ("than", -0.3),
    ("good", 1.9), ("great", 3.1), ("love", 3.2), ("bad", -2.5), ("hate", -2.7),
]
MODIFIERS = [
    ("very", 0.293, False), ("extremely", 0.293, False), ("slightly", -0.293, False), ("with", 0.293, False),
    ("from", -0.293, False), ("not", 0.0, True), ("never", 0.0, True), ("nicht", 0.0, True), ("that", 0.0, True),
    ("no", 0.0, True),
]
PHRASES = [(w, -3) for w in TOXIC] + [
    ("best", 3), ("is", 1), ("of the", 2), ("is the", -1), ("is the of", 4), ("th", 1), ("thing", 1), ("not good", -2),
    ("good", 3), ("de la", 1), ("la", -1),
]
EMOTIONS = ("anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust")
EMOLEX = (
    [(w, e, 1) for w in TOXIC for e in ("anger", "disgust")]
    + [(w, "joy", 0) for w in TOXIC]
    + [("the", "trust", 1), ("the", "trust", 1), ("and", "joy", 1), ("of", "anticipation", 1), ("de", "surprise", 1)]
    + [("la", "sadness", 0), ("und", "fear", 1), ("best", "joy", 1), ("best", "trust", 1), ("no", "sadness", 1)]
)
SEEDS = [
    (category, term, weight)
    for category, terms in zip(
        CATEGORIES,
        (
            (("best", 2.0), ("thing", 1.0), ("than", 1.0), ("ist", 0.5)),
            (("then", 1.0), ("this", 1.0), ("dans", 1.0), ("nicht", 1.5)),
            (("for", 1.0), ("to", 1.0), ("pour", 1.0), ("para", 1.0)),
            (("with", 1.0), ("and", 0.5), ("und", 0.5), ("et", 0.5)),
            (("in", 1.0), ("on", 1.0), ("der", 1.0), ("la", 0.5), ("best", 1.0)),
            (("the", 0.25), ("of", 0.25), ("die", 0.5), ("de", 0.25), ("best", 1.5)),
        ),
    )
    for term, weight in terms
]


def load(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", spread_by)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the polarity of the labelled ones (1 toxic, 2 not); one source has no title."""
    docs = load(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "lang", "source")
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    polarity = F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).cast("long")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", polarity.alias("polarity"), F.nullif("source", F.lit("src0")).alias("title"), "text", "lang", "source"
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cleaned; ``label`` is null for unlabelled ones."""
    return with_review(reviews(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete reviews only, cleaned and labelled."""
    return with_review(drop_incomplete(reviews(spark, sf_dir)))


def stored_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labelled`` cleaned once and stored, for queries that score its texts in several ways."""
    return checkpoint(labelled(spark, sf_dir).select("doc_id", "label", "review"))


def web_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages", "page_id")
    return pages.select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("text"))


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, with the given topic number."""
    vectors = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("topic")
    )
    return texts(spark, sf_dir).select("doc_id", "label", "review").join(vectors, "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("topic")
    )


def valence(spark: SparkSession) -> DataFrame:
    return literal_table(spark, VALENCE, "word string, valence double")


def modifiers(spark: SparkSession) -> DataFrame:
    return literal_table(spark, MODIFIERS, "word string, booster double, negator boolean")


def phrases(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PHRASES, "phrase string, score int")


def emolex(spark: SparkSession) -> DataFrame:
    return literal_table(spark, EMOLEX, "word string, emotion string, value int")


def seeds(spark: SparkSession) -> DataFrame:
    return literal_table(spark, SEEDS, "category string, seed_term string, weight double")


# ---- SQL twins -------------------------------------------------------------------------------


def values(name: str, columns: str, rows) -> str:
    def literal(x) -> str:
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in rows) + ")"


def sql_clean(x: str) -> str:
    # Fixed value: the cleaning patterns, as in ``functions.text``.
    urls = rf"regexp_replace(lower({x}), 'https?://\S+|www\.\S+', ' ', 'g')"
    return rf"trim(regexp_replace(replace(replace({urls}, '&quot;', '\"'), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


def sql_ws_tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"


def sql_words(x: str, fold: bool = True) -> str:
    inner = f"strip_accents(lower({x}))" if fold else f"lower({x})"
    return rf"regexp_extract_all({inner}, '[\p{{L}}\p{{N}}_]{{2,}}')"


SQL_REVIEWS = """reviews AS (
  SELECT d.doc_id, CAST(CASE l.toxic WHEN 1 THEN 1 WHEN 0 THEN 2 END AS BIGINT) AS polarity,
         nullif(d.source, 'src0') AS title, d.text, d.lang, d.source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
SQL_RAW = "coalesce(title, '') || '. ' || coalesce(text, '')"
SQL_TEXTS = SQL_REVIEWS + f""", texts AS (
  SELECT *, {SQL_RAW} AS raw, {sql_clean(SQL_RAW)} AS review, polarity - 1 AS label FROM reviews)"""
SQL_LABELLED = SQL_TEXTS + """, labelled AS (SELECT * FROM texts WHERE polarity IS NOT NULL AND text IS NOT NULL)"""
SQL_VECTORS = """vectors AS (
  SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding, label AS topic FROM embeddings)"""
SQL_DOC_VECTORS = SQL_TEXTS + ", " + SQL_VECTORS + """, doc_vectors AS (
  SELECT t.doc_id, t.label, t.review, v.embedding, v.topic FROM texts t JOIN vectors v ON t.doc_id = v.doc_id)"""
SQL_VALENCE = values("valence", "word, valence", VALENCE)
SQL_MODIFIERS = values("modifiers", "word, booster, negator", MODIFIERS)
SQL_PHRASES = values("phrases", "phrase, score", PHRASES)
SQL_EMOLEX = values("emolex", "word, emotion, value", EMOLEX)
SQL_SEEDS = values("seeds", "category, seed_term, weight", SEEDS)


def sql_rank(source: str, strata: str, name: str) -> str:
    part = f"PARTITION BY {strata} " if strata else ""
    return f"{name} AS (SELECT *, row_number() OVER ({part}ORDER BY md5('42:' || doc_id)) AS rk FROM {source})"


def sql_quota(source: str, strata: str, size: str, n: str, name: str) -> str:
    """Largest-remainder seats over a table with one row per stratum."""
    return f"""{name}_b AS (
  SELECT *, CAST({n} AS HUGEINT) AS seats, CAST({n} AS HUGEINT) * {size} // (SELECT sum({size}) FROM {source}) AS base,
         CAST({n} AS HUGEINT) * {size} % (SELECT sum({size}) FROM {source}) AS rest FROM {source}),
{name} AS (
  SELECT * EXCLUDE (seats, base, rest), base + CASE WHEN row_number() OVER (ORDER BY rest DESC, {strata})
         <= seats - sum(base) OVER () THEN 1 ELSE 0 END AS {name} FROM {name}_b)"""
