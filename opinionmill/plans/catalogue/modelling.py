"""Classifiers on TF-IDF and dense vectors. Models have no SQL twin; their data steps have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from opinionmill.operators import evaluation, features, models, sampling
from opinionmill.plans import fixtures as fx
from opinionmill.plans.catalogue.preparing import scratch, sql_split
from opinionmill.plans.catalogue.registry import query
from opinionmill.session import checkpoint
from opinionmill.sources import tables

MAX_ITER = 1000
ROUNDS = 300


def training_data(spark, d):
    """Vocabulary, its size, and labelled TF-IDF vectors of all reviews with their split."""
    docs = sampling.stratified_split(fx.labelled(spark, d).select("doc_id", "review", "label"), strata="label")
    docs = checkpoint(docs)
    vocab = features.fit_vocabulary(docs.where("split = 'train'"))
    size = vocab.count()
    return vocab, checkpoint(models.tfidf_vectors(docs, vocab, size, keep=["split"]))


def scored(spark, d, fit):
    _, data = training_data(spark, d)
    model = fit(data)
    return models.predict(model, data.where("split = 'test'"))


def train_of(data):
    return data.where("split = 'train'")


@query("logreg")
def logreg(spark, d):
    return scored(spark, d, lambda data: models.fit_logreg(train_of(data), max_iter=MAX_ITER))


@query("linear_svc")
def linear_svc(spark, d):
    return scored(spark, d, lambda data: models.fit_svc(train_of(data), max_iter=MAX_ITER))


@query("gbt")
def gbt(spark, d):
    return scored(
        spark, d,
        lambda data: models.fit_gbt(train_of(data), data.where("split = 'val'"), rounds=ROUNDS, depth=4),
    )


@query("logreg_undersampled")
def logreg_undersampled(spark, d):
    return scored(spark, d, lambda data: models.fit_undersampled_logreg(train_of(data), max_iter=MAX_ITER))


@query("model_comparison")
def model_comparison(spark, d):
    """Metric rows of two linear models, the better one marked as such on the validation split."""
    _, data = training_data(spark, d)
    fitted = {"LogReg": models.fit_logreg(train_of(data), max_iter=MAX_ITER), "LinearSVC": models.fit_svc(train_of(data), max_iter=MAX_ITER)}

    def table(split):
        parts = [
            models.predict(m, data.where(F.col("split") == split)).withColumn("model", F.lit(name)).withColumn("ord", F.lit(i))
            for i, (name, m) in enumerate(fitted.items())
        ]
        return evaluation.metrics(parts[0].unionByName(parts[1]), by=["ord", "model"], score="score")

    winner = evaluation.best(table("val")).first()["model"]
    return table("test").withColumn("is_best", F.col("model") == winner)


@query("coef_top_features")
def coef_top_features(spark, d):
    vocab, data = training_data(spark, d)
    model = models.fit_logreg(train_of(data), max_iter=MAX_ITER)
    return evaluation.top_features(models.coefficients(model, vocab), 20)


@query(
    "top_features_given",
    f"""WITH {fx.SQL_LABELLED}, t AS (SELECT label, unnest(list_distinct({fx.sql_words('review')})) AS term FROM labelled),
c AS (SELECT term, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) / (SELECT count(*) FROM labelled WHERE label = 1)
   - CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / (SELECT count(*) FROM labelled WHERE label = 0) AS coef FROM t GROUP BY term),
p AS (SELECT term, row_number() OVER (ORDER BY round(coef, 9) DESC, term) AS rank FROM c),
n AS (SELECT term, row_number() OVER (ORDER BY round(coef, 9), term) AS rank FROM c)
SELECT CAST(p.rank AS INTEGER) AS rank, p.term AS positive_features, n.term AS negative_features FROM p JOIN n ON p.rank = n.rank WHERE p.rank <= 20""",
)
def top_features_given(spark, d):
    """The two ends of a coefficient list SQL can compute: difference in document share by class."""
    from opinionmill.functions.text import word_tokens

    docs = fx.labelled(spark, d)
    sizes = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    n = {r["label"]: r["n"] for r in sizes.collect()}
    terms = docs.select("label", F.explode(F.array_distinct(word_tokens("review"))).alias("term"))
    share = F.count_if(F.col("label") == 1) / F.lit(float(n[1])) - F.count_if(F.col("label") == 0) / F.lit(float(n[0]))
    return evaluation.top_features(terms.groupBy("term").agg(F.round(share, 9).alias("coef")), 20)


@query(
    "training_rows",
    f"""WITH {fx.SQL_LABELLED}, {sql_split('labelled', 'label')} SELECT split, label, count(*) AS n FROM split_of GROUP BY split, label""",
)
def training_rows(spark, d):
    """Vectors joined to labels by key: no row is lost or doubled."""
    _, data = training_data(spark, d)
    return data.groupBy("split", F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("mlp")
def mlp(spark, d):
    """Dense classifier over word-vector means of all labelled reviews."""
    docs = sampling.stratified_split(fx.labelled(spark, d).select("doc_id", "review", "label"), strata="label")
    docs = checkpoint(docs)
    model = features.fit_embedder(docs.where("split = 'train'"), dim=64)
    data = docs.select("doc_id", "split", F.col("label").cast("double").alias("label")).join(features.embed(docs, model), "doc_id")
    best, _ = models.fit_mlp(data.where("split = 'train'"), data.where("split = 'val'"), budgets=(25, 50))
    test = data.where("split = 'test'").withColumn("features", models.array_to_vector("embedding"))
    return models.predict(best, test)


@query("model_roundtrip", f"WITH {fx.SQL_LABELLED} SELECT count(*) AS n, CAST(0 AS BIGINT) AS changed FROM labelled")
def model_roundtrip(spark, d):
    """A fitted model saved, loaded and used again: no prediction changes."""
    _, data = training_data(spark, d)
    model = models.fit_logreg(train_of(data), max_iter=MAX_ITER)
    path = tables.save_model(model, f"{scratch(spark)}/model")
    before = models.predict(model, data)
    after = models.predict(tables.load_model(path), data).select("doc_id", F.col("prediction").alias("again"))
    return before.join(after, "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") != F.col("again")).alias("changed")
    )


MODELS = ("LogReg", "LinearSVC", "BoostedTrees", "LogReg+undersampled", "NaiveBayes", "RandomForest")


@query(
    "model_properties",
    f"""WITH {fx.SQL_LABELLED}, {sql_split('labelled', 'label')}, t AS (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM split_of WHERE split = 'test')
SELECT model, n, positives, true AS one_row_each, true AS follows_score, true AS in_range, true AS ranks_training_rows
FROM t, (VALUES {', '.join(f"('{m}')" for m in MODELS)}) m(model)""",
)
def model_properties(spark, d):
    """What must hold for the predictions of every classifier, whatever its weights."""
    _, data = training_data(spark, d)
    train, val, test = (data.where(F.col("split") == s) for s in tables.SPLITS)
    fitted = (
        models.fit_logreg(train, max_iter=MAX_ITER),
        models.fit_svc(train, max_iter=MAX_ITER),
        models.fit_gbt(train, val, rounds=ROUNDS, depth=4),
        models.fit_undersampled_logreg(train, max_iter=MAX_ITER),
        models.fit_naive_bayes(train),
        models.fit_random_forest(train),
    )
    def scored_on(rows):
        parts = [
            models.predict(model, rows).select("*", F.lit(name).alias("model"), F.lit(0.0 if name == "LinearSVC" else 0.5).alias("cut"))
            for name, model in zip(MODELS, fitted)
        ]
        return checkpoint(reduce(DataFrame.unionByName, parts))

    scored = scored_on(test)
    bounded = (F.col("model") == "LinearSVC") | F.col("score").between(0, 1)
    flat = scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("positives"),
        (F.count_distinct("doc_id") == F.count(F.lit(1))).alias("one_row_each"),
        F.every((F.col("prediction") == 1) == (F.col("score") > F.col("cut"))).alias("follows_score"),
        F.every(bounded).alias("in_range"),
    )
    # A test split may hold few rows of a class; the rows it has learned from, any model must rank.
    ranks = evaluation.roc_auc(scored_on(train)).select("model", (F.col("roc_auc") > 0.5).alias("ranks_training_rows"))
    return flat.join(ranks, "model")


@query("batch_lengths", f"WITH {fx.SQL_TEXTS} SELECT doc_id, CAST(length(review) AS BIGINT) AS n FROM texts")
def batch_lengths(spark, d):
    """A user's batch function over Arrow batches."""
    return models.batch_apply(
        fx.texts(spark, d).select("doc_id", "review"),
        lambda pdf: pdf.assign(n=pdf["review"].str.len())[["doc_id", "n"]],
        "doc_id long, n long",
    )
