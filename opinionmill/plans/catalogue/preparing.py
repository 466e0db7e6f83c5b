"""Audit, cleaning, identity, sampling and splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opinionmill.functions.text import clean_text, truncate_tokens, whitespace_tokens, word_count
from opinionmill.operators import audit, cleaning, sampling
from opinionmill.plans import fixtures as fx
from opinionmill.plans.catalogue.registry import query
from opinionmill.session import ensure_checkpoint_dir
from opinionmill.sources import reviews as review_files, tables


def scratch(spark) -> str:
    """A new folder below the one the session shares for checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


@query("audit_shape", f"WITH {fx.SQL_REVIEWS} SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM reviews")
def audit_shape(spark, d):
    return audit.shape(fx.reviews(spark, d))


@query("audit_label_counts", f'WITH {fx.SQL_REVIEWS} SELECT polarity, count(*) AS "count" FROM reviews GROUP BY polarity')
def audit_label_counts(spark, d):
    return audit.value_counts(fx.reviews(spark, d), "polarity")


@query(
    "audit_nulls",
    f"""WITH {fx.SQL_REVIEWS}, c AS (
  SELECT count(*) - count(doc_id) AS doc_id, count(*) - count(polarity) AS polarity, count(*) - count(title) AS title,
         count(*) - count(text) AS text, count(*) - count(lang) AS lang, count(*) - count(source) AS source FROM reviews)
UNPIVOT c ON doc_id, polarity, title, text, lang, source INTO NAME "column" VALUE null_count""",
)
def audit_nulls(spark, d):
    return audit.null_counts(fx.reviews(spark, d))


SQL_LENGTHS = f"""{fx.SQL_REVIEWS}, sized AS (
  SELECT *, CAST(length(coalesce(title, '')) AS BIGINT) AS title_len, CAST(length(coalesce(text, '')) AS BIGINT) AS text_len,
         CAST(len(string_split(coalesce(text, ''), ' ')) AS BIGINT) AS text_words FROM reviews)"""


@query("audit_lengths", f"WITH {SQL_LENGTHS} SELECT doc_id, title_len, text_len, text_words FROM sized")
def audit_lengths(spark, d):
    return audit.lengths(fx.reviews(spark, d)).select("doc_id", "title_len", "text_len", "text_words")


def sql_describe(source: str, columns: list[str], places: int = 6) -> str:
    parts = []
    for c in columns:
        stats = {
            "count": f"count({c})", "null_count": f"count(*) - count({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})",
            "min": f"min({c})", "25%": f"quantile_cont({c}, 0.25)", "50%": f"quantile_cont({c}, 0.5)",
            "75%": f"quantile_cont({c}, 0.75)", "max": f"max({c})",
        }
        parts += [
            f"SELECT '{c}' AS \"column\", '{s}' AS statistic, round(CAST({e} AS DOUBLE), {places}) + 0.0 AS value FROM {source}"
            for s, e in stats.items()
        ]
    return " UNION ALL ".join(parts)


@query("audit_describe", f"WITH {SQL_LENGTHS} {sql_describe('sized', ['title_len', 'text_len', 'text_words'])}")
def audit_describe(spark, d):
    sized = audit.lengths(fx.reviews(spark, d))
    out = audit.describe(sized, ["title_len", "text_len", "text_words"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "audit_histogram",
    f"""WITH {SQL_LENGTHS}, x AS (SELECT CAST(least(text_len, 1500) AS DOUBLE) AS x FROM sized),
b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 60 AS w FROM x),
p AS (SELECT least(CAST(floor((x - lo) / w) AS INTEGER) + 1, 60) AS bin FROM x, b)
SELECT CAST(e.bin AS INTEGER) AS bin, round(lo + (e.bin - 1) * w, 6) AS bin_from, round(lo + e.bin * w, 6) AS bin_to, count(p.bin) AS "count"
FROM range(1, 61) e(bin) CROSS JOIN b LEFT JOIN p ON p.bin = e.bin GROUP BY e.bin, lo, w""",
)
def audit_histogram(spark, d):
    out = audit.histogram(audit.lengths(fx.reviews(spark, d)), "text_len", 60, 1500)
    return out.withColumns({c: F.round(c, 6) for c in ("bin_from", "bin_to")})


@query("clean_reviews", f"WITH {fx.SQL_TEXTS} SELECT doc_id, review, label FROM texts")
def clean_reviews(spark, d):
    return fx.texts(spark, d).select("doc_id", "review", "label")


@query("clean_web_text", "SELECT page_id AS doc_id, " + fx.sql_clean("url || ' ' || html") + " AS review FROM pages")
def clean_web_text(spark, d):
    return fx.web_reviews(spark, d).select("doc_id", clean_text("text").alias("review"))


@query("labelled_reviews", f"WITH {fx.SQL_LABELLED} SELECT doc_id, raw, label FROM labelled")
def labelled_reviews(spark, d):
    return fx.labelled(spark, d).select("doc_id", "raw", "label")


@query(
    "word_counts",
    f"""WITH {fx.SQL_TEXTS} SELECT doc_id, CAST(len(string_split(coalesce(text, ''), ' ')) AS BIGINT) AS by_space,
  CAST(greatest(len({fx.sql_ws_tokens('review')}), 1) AS BIGINT) AS by_words FROM texts""",
)
def word_counts(spark, d):
    return fx.texts(spark, d).select(
        "doc_id", word_count("text", "space").alias("by_space"), word_count("review", "ws").alias("by_words")
    )


@query(
    "doc_ids",
    """SELECT md5(concat_ws(chr(1), lang, text)) || '-' || row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS doc_id,
  lang, CAST(length(text) AS BIGINT) AS n FROM documents""",
)
def doc_ids(spark, d):
    docs = fx.load(spark, d, "documents").select("lang", "text")
    keyed = cleaning.assign_doc_id(docs, ["lang", "text"])
    return keyed.select("doc_id", "lang", F.char_length("text").cast("long").alias("n"))


@query(
    "truncated_tokens",
    f"""WITH {fx.SQL_TEXTS}, t AS (SELECT doc_id, {fx.sql_ws_tokens('review')} AS t FROM texts)
SELECT doc_id, array_to_string(list_concat(t[1:192], list_transform(range(192 - len(t[1:192])), lambda x: '<pad>')), ' ') AS tokens FROM t""",
)
def truncated_tokens(spark, d):
    cut = truncate_tokens(whitespace_tokens("review"), 192, "<pad>")
    return fx.texts(spark, d).select("doc_id", F.array_join(cut, " ").alias("tokens"))


HALF = "(SELECT count(*) // 2 FROM labelled)"


@query(
    "sample_stratified",
    f"""WITH {fx.SQL_LABELLED}, cls AS (SELECT label, count(*) AS c FROM labelled GROUP BY label),
{fx.sql_quota('cls', 'label', 'c', HALF, 'q')}, {fx.sql_rank('labelled', 'label', 'r')}
SELECT r.doc_id, r.label FROM r JOIN q ON r.label = q.label WHERE rk <= q""",
)
def sample_stratified(spark, d):
    docs = fx.labelled(spark, d)
    return sampling.stratified_sample(docs, docs.count() // 2, "label").select("doc_id", "label")


@query(
    "sample_multi_strata",
    f"""WITH {fx.SQL_REVIEWS}, cls AS (SELECT lang, source, count(*) AS c FROM reviews GROUP BY lang, source),
{fx.sql_quota('cls', 'lang, source', 'c', '(SELECT count(*) // 2 FROM reviews)', 'q')}, {fx.sql_rank('reviews', 'lang, source', 'r')}
SELECT r.doc_id, r.lang, r.source FROM r JOIN q ON r.lang = q.lang AND r.source = q.source WHERE rk <= q""",
)
def sample_multi_strata(spark, d):
    docs = fx.reviews(spark, d)
    return sampling.stratified_sample(docs, docs.count() // 2, ["lang", "source"]).select("doc_id", "lang", "source")


def sql_split(source: str, stratum: str) -> str:
    """CTEs ending in ``split_of(doc_id, <stratum>, split)``."""
    return f"""tot AS (SELECT count(*) AS t, CAST(ceil(0.2 * count(*)) AS BIGINT) AS h FROM {source}),
cls AS (SELECT {stratum}, count(*) AS c FROM {source} GROUP BY {stratum}),
{fx.sql_quota('cls', stratum, 'c', '(SELECT t - h FROM tot)', 'q1')},
held AS (SELECT *, c - q1 AS rest_c FROM q1),
{fx.sql_quota('held', stratum, 'rest_c', '(SELECT h - CAST(ceil(0.5 * h) AS BIGINT) FROM tot)', 'q2')},
{fx.sql_rank(source, stratum, 'r')},
split_of AS (SELECT r.*, CASE WHEN rk <= q1 THEN 'train' WHEN rk <= q1 + q2 THEN 'val' ELSE 'test' END AS split
  FROM r JOIN q2 ON r.{stratum} = q2.{stratum})"""


@query("split_80_10_10", f"WITH {fx.SQL_LABELLED}, {sql_split('labelled', 'label')} SELECT doc_id, label, split FROM split_of")
def split_80_10_10(spark, d):
    return sampling.stratified_split(fx.labelled(spark, d), strata="label").select("doc_id", "label", "split")


@query(
    "split_checks",
    f"""WITH {fx.SQL_LABELLED} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra,
  CAST(0 AS BIGINT) AS overlap FROM labelled""",
)
def split_checks(spark, d):
    """Disjoint and complete: set differences of the splits and the whole are empty."""
    whole = fx.labelled(spark, d).select("doc_id")
    split = sampling.stratified_split(fx.labelled(spark, d), strata="label").select("doc_id", "split")
    train, rest = (split.where(c).select("doc_id") for c in ("split = 'train'", "split <> 'train'"))
    kinds = {
        "n_rows": split.select("doc_id"),
        "missing": whole.exceptAll(split.select("doc_id")),
        "extra": split.select("doc_id").exceptAll(whole),
        "overlap": train.intersect(rest),
    }
    stacked = None
    for kind, rows in kinds.items():
        part = rows.select(F.lit(kind).alias("kind"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


@query(
    "sample_plain",
    f"""WITH {fx.SQL_REVIEWS}, {fx.sql_rank('reviews', '', 'r')}
SELECT doc_id, lang FROM r WHERE rk <= (SELECT count(*) // 5 FROM reviews)""",
)
def sample_plain(spark, d):
    docs = fx.reviews(spark, d)
    return sampling.sample_n(docs, docs.count() // 5).select("doc_id", "lang")


@query(
    "under_sampled",
    f"""WITH {fx.SQL_LABELLED}, {fx.sql_rank('labelled', 'label', 'r')}
SELECT doc_id, label FROM r WHERE rk <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labelled GROUP BY label))""",
)
def under_sampled(spark, d):
    return sampling.under_sample(fx.labelled(spark, d), "label").select("doc_id", "label")


@query(
    "sample_fraction",
    f"""WITH {fx.SQL_LABELLED} SELECT doc_id, label FROM labelled
WHERE CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) < CASE label WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 END * 4294967296""",
)
def sample_fraction(spark, d):
    return sampling.fraction_sample(fx.labelled(spark, d), {0: 0.5, 1: 0.25}).select("doc_id", "label")


@query(
    "csv_roundtrip",
    f"""WITH {fx.SQL_REVIEWS} SELECT polarity, count(*) AS n, CAST(sum(length(title)) AS BIGINT) AS title_chars,
  CAST(sum(length(text)) AS BIGINT) AS text_chars, CAST(0 AS BIGINT) AS corrupt FROM reviews GROUP BY polarity""",
)
def csv_roundtrip(spark, d):
    """The whole corpus through a headerless CSV, found by search and read with a fixed schema."""
    root = scratch(spark)
    columns = fx.reviews(spark, d).select("polarity", "title", "text")
    columns.write.option("escape", '"').csv(f"{root}/nested/train.csv")
    path = review_files.locate_reviews(spark, f"{root}/nested", "part-*")
    back = review_files.read_reviews(spark, path.rsplit("/", 1)[0], keep_corrupt=True)
    return back.groupBy("polarity").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.char_length("title")).alias("title_chars"),
        F.sum(F.char_length("text")).alias("text_chars"),
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("corrupt"),
    )


@query(
    "split_tables",
    f"WITH {fx.SQL_LABELLED}, {sql_split('labelled', 'label')} SELECT doc_id, label FROM split_of WHERE split = 'test'",
)
def split_tables(spark, d):
    """Splits written one folder each; reading one prunes the others."""
    root = f"{scratch(spark)}/split"
    split = sampling.stratified_split(fx.labelled(spark, d), strata="label")
    tables.write_splits(split.select("doc_id", "label", "split"), root)
    return tables.read_split(spark, root, "test").select("doc_id", "label")


@query(
    "lexicon_file",
    f"""WITH {fx.SQL_TEXTS} SELECT word, 'seen' AS emotion, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT unnest({fx.sql_ws_tokens('review')}) AS word FROM texts) GROUP BY word""",
)
def lexicon_file(spark, d):
    """An emotion lexicon built from the corpus, through its tab-separated file form."""
    root = f"{scratch(spark)}/lexicon"
    words = fx.texts(spark, d).select(F.explode(whitespace_tokens("review")).alias("word")).groupBy("word").agg(
        F.lit("seen").alias("emotion"), F.count(F.lit(1)).alias("value")
    )
    words.write.option("sep", "\t").option("quote", "").csv(root)
    return review_files.read_lexicon(spark, root)
