"""Accuracy, F1, exact ROC-AUC, confusion counts and model comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.operators.relational import lookup_join, settled, top_k_per_group
from opinionmill.session import checkpoint

AUC_EDGES = 256


def _groups(df: DataFrame, by: Sequence[str] | str | None) -> tuple[DataFrame, list[str]]:
    if not by:
        return df.withColumn("_group", F.lit(0)), ["_group"]
    return df, [by] if isinstance(by, str) else list(by)


def outcome_counts(pred: DataFrame, by: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(..., label, prediction, n)``; rows without a label take no part."""
    rows = F.sum("_rows") if "_rows" in pred.columns else F.count(F.lit(1))
    return pred.where(F.col(label).isNotNull()).groupBy(*by, F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(
        rows.alias("n")
    )


def class_f1(pred: DataFrame, by: Sequence[str] | str | None = "model", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """F1 of every class seen in truth or prediction, 0 where undefined."""
    pred, by = _groups(pred, by)
    out = _class_f1(outcome_counts(pred, by, label, prediction), by)
    return out.drop("_group")


def _class_f1(counts: DataFrame, by: list[str]) -> DataFrame:
    seen = counts.withColumn("class", F.explode(F.array_distinct(F.array("label", "prediction"))))
    true, said = F.col("label") == F.col("class"), F.col("prediction") == F.col("class")
    sums = seen.groupBy(*by, "class").agg(
        F.sum(F.when(true & said, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~true & said, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(true & ~said, F.col("n")).otherwise(0)).alias("fn"),
    )
    double = 2.0 * F.col("tp")
    return sums.withColumn("f1", F.coalesce(F.try_divide(double, double + F.col("fp") + F.col("fn")), F.lit(0.0)))


def metrics(
    pred: DataFrame,
    by: Sequence[str] | str | None = "model",
    label: str = "label",
    prediction: str = "prediction",
    score: str | None = None,
) -> DataFrame:
    """One row per group: accuracy, f1_macro, f1_pos, f1_neg and, given a score, roc_auc.

    The rows are reduced to outcome counts in one aggregate; all else works on those.
    """
    pred, by = _groups(pred, by)
    if score is not None:
        # Read the predictions once: rows with equal outcome and score become one stored count.
        pred = checkpoint(
            pred.groupBy(*by, F.col(label).cast("int").alias(label), prediction, F.col(score).cast("double").alias(score)).agg(
                F.count(F.lit(1)).alias("_rows")
            )
        )
    counts = outcome_counts(pred, by, label, prediction)
    totals = counts.groupBy(*by).agg(
        (F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")
    )
    f1 = _class_f1(counts, by).groupBy(*by).agg(
        F.avg("f1").alias("f1_macro"),
        F.coalesce(F.max(F.when(F.col("class") == 1, F.col("f1"))), F.lit(0.0)).alias("f1_pos"),
        F.coalesce(F.max(F.when(F.col("class") == 0, F.col("f1"))), F.lit(0.0)).alias("f1_neg"),
    )
    out = totals.join(f1, by)
    if score is not None:
        weighted = pred.withColumnRenamed(score, "_s")
        out = out.join(_auc(_score_counts(weighted, by, label, F.col("_rows")), by), by, "left")
    return out.drop("_group")


def roc_auc(pred: DataFrame, by: Sequence[str] | str | None = "model", label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, ties counting one half; null for one-class input.

    Rows collapse to distinct scores. Those are cut into buckets at approximate quantiles; a
    running sum inside each bucket plus the negatives of the buckets below gives every score
    its rank, so no window spans a group and the result does not depend on the edges.
    """
    grouped, by_cols = _groups(pred, by)
    named = grouped.withColumn("_s", F.col(score).cast("double"))
    out = _auc(checkpoint(_score_counts(named, by_cols, label, F.lit(1))), by_cols)
    return out.drop("_group")


def _score_counts(pred: DataFrame, by: list[str], label: str, rows: Column) -> DataFrame:
    """Positives and negatives per distinct score ``_s``; other labels and null count for neither."""
    return pred.groupBy(*by, "_s").agg(
        F.sum(F.when(F.col(label) == 1, rows).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 0, rows).otherwise(0)).alias("_neg"),
    )


def _auc(distinct: DataFrame, by_cols: list[str]) -> DataFrame:
    steps = [i / AUC_EDGES for i in range(1, AUC_EDGES)]
    edges = distinct.groupBy(*by_cols).agg(F.array_distinct(F.percentile_approx("_s", F.lit(steps), 2_000)).alias("_edges"))
    edges, small = settled(edges)
    placed = lookup_join(distinct, edges, by_cols, "inner", small=small)
    placed = placed.withColumn("_bucket", F.size(F.filter("_edges", lambda e: e < F.col("_s")))).drop("_edges")
    inside = Window.partitionBy(*by_cols, "_bucket").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # Pairs won inside the bucket, to be completed by the negatives of lower buckets.
    ranked = placed.withColumn("_below", F.coalesce(F.sum("_neg").over(inside), F.lit(0)))
    won = F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2.0)
    buckets = ranked.groupBy(*by_cols, "_bucket").agg(
        F.sum(won).alias("_won"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
    )
    lower = Window.partitionBy(*by_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_lower", F.coalesce(F.sum("_neg").over(lower), F.lit(0)))
    area = F.sum(F.col("_won") + F.col("_pos").cast("double") * F.col("_lower"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return buckets.groupBy(*by_cols).agg(F.try_divide(area, pairs).alias("roc_auc"))


def confusion(
    pred: DataFrame, by: Sequence[str] | str | None = None, label: str = "label", prediction: str = "prediction", classes: Sequence[int] = (0, 1)
) -> DataFrame:
    """``(label, prediction, n)`` over the full class grid, zeros kept: ``classes`` and all others
    that the group's labels or predictions hold."""
    pred, by_cols = _groups(pred, by)
    counts = checkpoint(outcome_counts(pred, by_cols, label, prediction))
    # One row per group; a group's classes are few.
    seen = F.flatten(F.collect_set(F.filter(F.array("label", "prediction"), lambda c: c.isNotNull())))
    given = F.array(*[F.lit(int(c)) for c in classes]).cast("array<int>")
    grid = (
        counts.groupBy(*by_cols)
        .agg(F.array_union(given, seen).alias("_classes"))
        .withColumn("label", F.explode("_classes"))
        .withColumn("prediction", F.explode("_classes"))
        .drop("_classes")
    )
    full = grid.join(counts, [*by_cols, "label", "prediction"], "left").na.fill({"n": 0})
    return full.drop("_group")


def cohen_kappa(pred: DataFrame, by: Sequence[str] | str | None = "model", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(..., n, observed, expected, kappa)``: agreement beyond chance; null where chance alone is perfect."""
    pred, by_cols = _groups(pred, by)
    counts = checkpoint(outcome_counts(pred.where(F.col(prediction).isNotNull()), by_cols, label, prediction))
    agreed = counts.groupBy(*by_cols).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("_same")
    )
    sides = counts.select(*by_cols, "n", F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(True).alias("t")), F.struct(F.col("prediction").alias("c"), F.lit(False).alias("t")))).alias("s"))
    margins = sides.groupBy(*by_cols, F.col("s.c").alias("_c")).agg(
        F.sum(F.when(F.col("s.t"), F.col("n")).otherwise(0)).alias("_true"), F.sum(F.when(F.col("s.t"), 0).otherwise(F.col("n"))).alias("_said")
    )
    chance = margins.groupBy(*by_cols).agg(F.sum(F.col("_true").cast("double") * F.col("_said")).alias("_chance"))
    total = F.col("n").cast("double")
    out = agreed.join(chance, by_cols).select(*by_cols, "n", (F.col("_same") / total).alias("observed"), (F.col("_chance") / total / total).alias("expected"))
    kappa = F.try_divide(F.col("observed") - F.col("expected"), F.lit(1.0) - F.col("expected"))
    return out.withColumn("kappa", kappa).drop("_group")


def label_cardinality(pairs: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """``(documents, labels, cardinality, density)`` of multi-label data, one row per (document, label):
    labels per document, and that divided by the number of distinct labels."""
    kept = pairs.where(F.col(key).isNotNull())
    per = kept.groupBy(key).agg(F.count_distinct(label).alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("_n"))
    n_labels = F.lit(kept.agg(F.count_distinct(label)).first()[0]).cast("long")
    cardinality = F.try_divide(F.col("_n"), F.col("documents"))
    return per.select("documents", n_labels.alias("labels"), cardinality.alias("cardinality"), F.try_divide(cardinality, n_labels).alias("density"))


def best(rows: DataFrame, on: str = "f1_macro", order: str = "ord") -> DataFrame:
    """The model with the highest ``on``; on a tie the one with the smallest ``order``."""
    return rows.where(F.col(on).isNotNull()).agg(
        F.max_by("model", F.struct(F.col(on), -F.col(order))).alias("model"), F.max(on).alias(on)
    )


def top_features(coefs: DataFrame, k: int = 20, term: str = "term", coef: str = "coef") -> DataFrame:
    """``(rank, positive_features, negative_features)``: the two ends of the coefficient list."""
    one = coefs.withColumn("_end", F.lit(0))
    high = top_k_per_group(one, ["_end"], [F.desc(coef), F.col(term)], k, spread=term)
    low = top_k_per_group(one, ["_end"], [F.asc(coef), F.col(term)], k, spread=term)
    return high.select("rank", F.col(term).alias("positive_features")).join(
        low.select("rank", F.col(term).alias("negative_features")), "rank"
    )


RESULT_COLUMNS = ("tier", "model", "accuracy", "f1_macro", "roc_auc")


def compare(*metric_sets: DataFrame) -> DataFrame:
    """Union of metric rows of different width as ``(tier, model, accuracy, f1_macro, roc_auc)``.

    ``eval_`` prefixes are dropped; metrics a set does not have are null.
    """
    plain = [
        rows.withColumnsRenamed({c: c.removeprefix("eval_") for c in rows.columns if c.startswith("eval_")})
        for rows in metric_sets
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), plain)
    return merged.select(*[F.col(c) if c in merged.columns else F.lit(None).cast("double").alias(c) for c in RESULT_COLUMNS])


def plot_table(comparison: DataFrame) -> DataFrame:
    return comparison.dropna(subset=["accuracy"])


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Every double column rounded."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.round(c, places) for c in doubles})
