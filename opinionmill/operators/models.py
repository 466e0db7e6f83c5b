"""Text classifiers from Spark ML on keyed feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from opinionmill.operators import boosted_columns, features
from opinionmill.operators.evaluation import metrics
from opinionmill.operators.features import batch_apply
from opinionmill.operators.relational import few_parts
from opinionmill.operators.sampling import under_sample
from opinionmill.session import SEED

__all__ = [
    "batch_apply", "coefficients", "features_with_labels", "fit_gbt", "fit_logreg", "fit_mlp", "fit_naive_bayes",
    "fit_random_forest", "fit_svc", "fit_undersampled_logreg", "predict", "tfidf_vectors",
]


def features_with_labels(vectors: DataFrame, labels: DataFrame, label: str = "label", key: str = "doc_id") -> DataFrame:
    """``(doc_id, features, label)`` by key."""
    return vectors.join(labels.select(key, F.col(label).cast("double").alias(label)), key)


def tfidf_vectors(
    docs: DataFrame, vocab: DataFrame, size: int, label: str = "label", key: str = "doc_id", keep: Sequence[str] = (), **options
) -> DataFrame:
    """Labelled TF-IDF vectors of ``docs`` over a fitted vocabulary, with other columns of theirs to ``keep``."""
    labelled = docs.withColumn(label, F.col(label).cast("double"))
    return features.tfidf_vectors(labelled, vocab, size, (label, *keep), key=key, **options)


def _ridge(train: DataFrame, c: float) -> float:
    # Mean loss plus regParam/2 |w|^2 equals 1/2 |w|^2 plus C times the summed loss over C*n.
    return 1.0 / (c * max(train.count(), 1))


def fit_logreg(train: DataFrame, c: float = 1.0, max_iter: int = 1000, label: str = "label", features: str = "features") -> PipelineModel:
    stage = LogisticRegression(
        featuresCol=features, labelCol=label, regParam=_ridge(train, c), standardization=False, maxIter=max_iter
    )
    return Pipeline(stages=[stage]).fit(few_parts(train))


def fit_svc(train: DataFrame, c: float = 1.0, max_iter: int = 2000, label: str = "label", features: str = "features") -> PipelineModel:
    stage = LinearSVC(
        featuresCol=features, labelCol=label, regParam=_ridge(train, c), standardization=False, maxIter=max_iter
    )
    return Pipeline(stages=[stage]).fit(few_parts(train))


def fit_gbt(
    train: DataFrame,
    val: DataFrame | None = None,
    rounds: int = 300,
    step: float = 0.05,
    depth: int = 6,
    max_features: int | None = None,
    seed: int = SEED,
    label: str = "label",
    features: str = "features",
) -> PipelineModel:
    """Boosted trees, stopped early on ``val`` when one is given. Tree depth takes the place of a
    leaf count. ``max_features`` keeps only the columns most related to the label. The fit is that of
    ``boosted_columns``, as Spark's own holds a number for every feature of every row."""
    boost = GBTClassifier(featuresCol=features, labelCol=label, maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed)
    selectors = []
    if max_features is not None:
        select = (
            UnivariateFeatureSelector(featuresCol=features, labelCol=label, outputCol="_selected", selectionMode="numTopFeatures")
            .setFeatureType("continuous")
            .setLabelType("categorical")
            .setSelectionThreshold(max_features)
        )
        selectors = [select.fit(train)]
        boost = boost.setFeaturesCol("_selected")
    data = train.withColumn("is_val", F.lit(False))
    if val is not None:
        data = data.unionByName(val.withColumn("is_val", F.lit(True)))
        boost = boost.setValidationIndicatorCol("is_val")
    for selector in selectors:
        data = selector.transform(data)
    return PipelineModel([*selectors, boosted_columns.fit(data, boost, "is_val")])


def fit_naive_bayes(train: DataFrame, smoothing: float = 1.0, label: str = "label", features: str = "features") -> PipelineModel:
    """Multinomial naive Bayes on non-negative weights."""
    return Pipeline(stages=[NaiveBayes(featuresCol=features, labelCol=label, smoothing=smoothing)]).fit(train)


def fit_random_forest(
    train: DataFrame, trees: int = 100, depth: int = 8, seed: int = SEED, label: str = "label", features: str = "features"
) -> PipelineModel:
    stage = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[stage]).fit(train)


def fit_undersampled_logreg(train: DataFrame, seed: int = SEED, label: str = "label", key: str = "doc_id", **params) -> PipelineModel:
    """Logistic regression on a training set cut to equal class sizes."""
    return fit_logreg(under_sample(train, label, seed, key), label=label, **params)


def fit_mlp(
    train: DataFrame,
    val: DataFrame,
    budgets: Sequence[int] = (25, 50),
    hidden: Sequence[int] = (32,),
    vector: str = "embedding",
    label: str = "label",
    n_classes: int = 2,
    block: int = 128,
    seed: int = SEED,
) -> tuple[PipelineModel, DataFrame]:
    """A feed-forward classifier over dense document vectors.

    One candidate per iteration budget; the one with the best macro-F1 on ``val`` is kept.
    Returns it with the table of candidate metrics.
    """
    train = train.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    val = val.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    width = train.select(F.size(vector)).first()[0]
    train = train.persist()
    candidates, tables = [], []
    try:
        for order, budget in enumerate(budgets):
            stage = MultilayerPerceptronClassifier(
                labelCol=label, layers=[width, *hidden, n_classes], maxIter=budget, blockSize=block, seed=seed
            )
            fitted = Pipeline(stages=[stage]).fit(train)
            candidates.append(fitted)
            scored = predict(fitted, val, label).withColumn("model", F.lit(f"mlp_{budget}"))
            tables.append(metrics(scored, label=label).withColumn("ord", F.lit(order)))
    finally:
        train.unpersist()
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other)
    # One row per budget.
    rows = table.select("ord", "f1_macro").toArrow().to_pylist()
    table = train.sparkSession.createDataFrame(table.toArrow(), table.schema)
    winner = max(rows, key=lambda r: (r["f1_macro"], -r["ord"]))["ord"]
    return candidates[winner], table


def predict(model: Transformer, df: DataFrame, label: str = "label", key: str = "doc_id") -> DataFrame:
    """``(doc_id, label, prediction, score)``: probability of class 1, or the margin where a
    model gives none."""
    scored = model.transform(df)
    source = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.select(
        key,
        F.col(label).cast("int").alias(label),
        F.col("prediction").cast("int").alias("prediction"),
        F.get(vector_to_array(source), F.lit(1)).alias("score"),
    )


def coefficients(model: PipelineModel, vocab: DataFrame) -> DataFrame:
    """``(term, term_id, coef)`` of a fitted linear model, joined by column number."""
    weights = model.stages[-1].coefficients.toArray()  # the fitted model's own array, as long as the vocabulary
    arrays = {"term_id": pa.array(np.arange(len(weights))), "coef": pa.array(weights)}
    table = vocab.sparkSession.createDataFrame(pa.table(arrays))
    return vocab.select("term", "term_id").join(table, "term_id").select("term", "term_id", "coef")
