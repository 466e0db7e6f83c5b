"""Metrics, ROC-AUC, confusion counts, comparison tables and the metric store."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionmill.operators import evaluation, lexicon
from opinionmill.operators.relational import literal_table
from opinionmill.plans import fixtures as fx
from opinionmill.plans.catalogue.preparing import scratch
from opinionmill.plans.catalogue.registry import query
from opinionmill.plans.catalogue.scoring import METRICS, SQL_POLARITY, SQL_SUM, sql_binary_metrics, sql_round
from opinionmill.sources import metric_sets, tables

# Lexicon classifiers on all labelled reviews: three thresholds of the polarity score and one of
# the valence sum, each with its own score.
CUTS = {"polarity@-0.5": -0.5, "polarity@-0.2": -0.2, "polarity@0": 0.0}
SQL_PRED = f"""{fx.SQL_LABELLED}, {SQL_POLARITY}, {SQL_SUM}, pred AS (
  {' UNION ALL '.join(f"SELECT {i} AS ord, '{m}' AS model, l.doc_id, CAST(l.label AS INTEGER) AS label, CASE WHEN lex_compound > {t} THEN 1 ELSE 0 END AS prediction, lex_compound AS score FROM labelled l JOIN lex_polarity p ON l.doc_id = p.doc_id" for i, (m, t) in enumerate(CUTS.items()))}
  UNION ALL SELECT 3, 'sum', l.doc_id, CAST(l.label AS INTEGER), CASE WHEN lex_sum > 0 THEN 1 ELSE 0 END, lex_sum FROM labelled l JOIN lex_sums s ON l.doc_id = s.doc_id)"""
SQL_AUC = """ranked AS (SELECT model, label, score, (rank() OVER (PARTITION BY model ORDER BY score) + rank() OVER (PARTITION BY model ORDER BY score)
    + count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM pred),
auc AS (SELECT model, (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
    / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS roc_auc FROM ranked GROUP BY model)"""
SQL_METRICS = f"{SQL_PRED}, {SQL_AUC}, plain AS ({sql_binary_metrics('pred', 'model')}), rows_of AS (SELECT plain.*, roc_auc FROM plain JOIN auc ON plain.model = auc.model)"
ALL = [*METRICS, "roc_auc"]


def predictions(spark, d):
    docs = fx.stored_labelled(spark, d)
    scored = lexicon.signature(
        docs, lexicon.polarity(docs, fx.valence(spark), fx.modifiers(spark)), lexicon.valence_sum(docs, fx.phrases(spark))
    )
    variants = [
        F.struct(F.lit(i).alias("ord"), F.lit(m).alias("model"), (F.col("lex_compound") > t).cast("int").alias("prediction"), F.col("lex_compound").alias("score"))
        for i, (m, t) in enumerate(CUTS.items())
    ]
    variants.append(F.struct(F.lit(3).alias("ord"), F.lit("sum").alias("model"), (F.col("lex_sum") > 0).cast("int").alias("prediction"), F.col("lex_sum").alias("score")))
    return scored.select("doc_id", F.col("label").cast("int").alias("label"), F.inline(F.array(*variants)))


def metric_rows(spark, d):
    return evaluation.metrics(predictions(spark, d), score="score")


def rounded(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("metrics_binary", f"WITH {SQL_METRICS} SELECT model, {sql_round(ALL)} FROM rows_of")
def metrics_binary(spark, d):
    return rounded(metric_rows(spark, d), ALL)


@query("roc_auc", f"WITH {SQL_PRED}, {SQL_AUC} SELECT model, {sql_round(['roc_auc'])} FROM auc")
def roc_auc(spark, d):
    return rounded(evaluation.roc_auc(predictions(spark, d)), ["roc_auc"])


@query(
    "roc_auc_continuous",
    f"""WITH l AS (SELECT e.vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label, unnest(range(1, len(embedding) + 1)) AS i,
    CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings e),
pred AS (SELECT 'dim' || i AS model, label, score FROM l), {SQL_AUC} SELECT model, {sql_round(['roc_auc'])} FROM auc""",
)
def roc_auc_continuous(spark, d):
    """One scorer per vector component: many models, nearly all scores distinct."""
    flat = fx.vectors(spark, d).select(
        (F.col("topic") >= 5).cast("int").alias("label"), F.posexplode("embedding").alias("i", "score")
    )
    pred = flat.withColumn("model", F.concat(F.lit("dim"), (F.col("i") + 1).cast("string")))
    return rounded(evaluation.roc_auc(pred), ["roc_auc"])


@query(
    "confusion",
    f"""WITH {SQL_PRED}, g AS (SELECT DISTINCT model, l AS label, p AS prediction FROM pred, (VALUES (0), (1)) a(l), (VALUES (0), (1)) b(p))
SELECT g.model, g.label, g.prediction, count(pred.doc_id) AS n FROM g LEFT JOIN pred ON g.model = pred.model AND g.label = pred.label AND g.prediction = pred.prediction
GROUP BY ALL""",
)
def confusion(spark, d):
    return evaluation.confusion(predictions(spark, d), by="model")


@query(
    "class_f1",
    f"""WITH {SQL_PRED}, c AS (SELECT model, unnest([0, 1]) AS class, label, prediction FROM pred)
SELECT model, class, count(*) FILTER (WHERE label = class AND prediction = class) AS tp, count(*) FILTER (WHERE label <> class AND prediction = class) AS fp,
  count(*) FILTER (WHERE label = class AND prediction <> class) AS fn,
  round(coalesce(2.0 * count(*) FILTER (WHERE label = class AND prediction = class) / nullif(2.0 * count(*) FILTER (WHERE label = class AND prediction = class)
    + count(*) FILTER (WHERE label <> class AND prediction = class) + count(*) FILTER (WHERE label = class AND prediction <> class), 0), 0.0), 6) AS f1
FROM c GROUP BY model, class""",
)
def class_f1(spark, d):
    return rounded(evaluation.class_f1(predictions(spark, d)), ["f1"])


@query(
    "best_model",
    f"""WITH {SQL_METRICS}, o AS (SELECT DISTINCT model, ord FROM pred)
SELECT r.model, round(f1_macro, 6) AS f1_macro FROM rows_of r JOIN o ON r.model = o.model ORDER BY r.f1_macro DESC, ord LIMIT 1""",
)
def best_model(spark, d):
    pred = predictions(spark, d)
    rows = evaluation.metrics(pred, by=["ord", "model"])
    return rounded(evaluation.best(rows), ["f1_macro"])


SQL_COMPARISON = f"""{SQL_METRICS}, tiers AS (
  SELECT 'lexicon' AS tier, model, accuracy, CAST(NULL AS DOUBLE) AS f1_macro, CAST(NULL AS DOUBLE) AS roc_auc FROM rows_of WHERE model = 'polarity@0'
  UNION ALL SELECT 'classical', model, accuracy, f1_macro, roc_auc FROM rows_of WHERE model <> 'polarity@0'
  UNION ALL SELECT 'neural', model, accuracy, f1_macro, NULL FROM rows_of WHERE model = 'sum'
  UNION ALL SELECT 'neural', 'not run', NULL, NULL, NULL)"""


def comparison_of(spark, d):
    """Metric rows of different width, one set prefixed, one row without accuracy."""
    rows = metric_rows(spark, d)
    neural = rows.where("model = 'sum'").select(
        "model", F.col("accuracy").alias("eval_accuracy"), F.col("f1_macro").alias("eval_f1_macro"), F.lit("neural").alias("tier")
    )
    idle = literal_table(spark, [("neural", "not run")], "tier string, model string")
    return evaluation.compare(
        rows.where("model = 'polarity@0'").select("model", "accuracy", F.lit("lexicon").alias("tier")),
        rows.where("model <> 'polarity@0'").withColumn("tier", F.lit("classical")),
        neural,
        idle,
    )


@query("comparison", f"WITH {SQL_COMPARISON} SELECT tier, model, {sql_round(['accuracy', 'f1_macro', 'roc_auc'], 4)} FROM tiers")
def comparison(spark, d):
    return evaluation.rounded(comparison_of(spark, d), 4)


@query(
    "plot_table",
    f"WITH {SQL_COMPARISON} SELECT tier, model, {sql_round(['accuracy'], 4)} FROM tiers WHERE accuracy IS NOT NULL",
)
def plot_table(spark, d):
    return evaluation.rounded(evaluation.plot_table(comparison_of(spark, d)), 4).select("tier", "model", "accuracy")


@query(
    "metrics_roundtrip",
    f"""WITH {SQL_METRICS} SELECT CASE WHEN model = 'sum' THEN 'sums' ELSE 'rules' END AS metric_set, model,
  round(accuracy, 6) AS accuracy, CASE WHEN model <> 'sum' THEN round(CAST(roc_auc AS DOUBLE), 6) END AS roc_auc FROM rows_of""",
)
def metrics_roundtrip(spark, d):
    """Two sets of different width, saved, one of them twice, and loaded as one table."""
    root = f"{scratch(spark)}/metrics"
    rows = metric_rows(spark, d)
    metric_sets.save_metrics(rows.limit(1), root, "sums")
    metric_sets.save_metrics(rows.where("model = 'sum'").select("model", "accuracy"), root, "sums")
    metric_sets.save_metrics(rows.where("model <> 'sum'"), root, "rules")
    return rounded(metric_sets.load_metrics(spark, root).select("metric_set", "model", "accuracy", "roc_auc"), ["accuracy", "roc_auc"])


@query(
    "metric_documents",
    f"""WITH {SQL_METRICS} SELECT 'lexicon' AS metric_set, model, round(accuracy, 6) AS accuracy FROM rows_of""",
)
def metric_documents(spark, d):
    """A nested JSON document per set, saved and picked apart again."""
    root = f"{scratch(spark)}/documents"
    rows = metric_rows(spark, d).select("model", "accuracy")
    nested = rows.agg(F.collect_list(F.struct("model", "accuracy")).alias("results"))
    tables.write_json(nested, f"{root}/metrics_lexicon.json")
    documents = metric_sets.load_metric_documents(spark, f"{root}/metrics_lexicon.json", "part-")
    results = F.from_json("document", "results array<struct<model: string, accuracy: double>>")["results"]
    picked = documents.select(F.lit("lexicon").alias("metric_set"), F.inline(results))
    return rounded(picked, ["accuracy"])
