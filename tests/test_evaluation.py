import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from opinionmill.operators import audit, evaluation

SCHEMA = "model string, label int, prediction int, score double"


def test_f1_with_an_absent_class_and_perfect_predictions(spark):
    rows = [("ones", i % 2, 1, 0.5) for i in range(10)] + [("perfect", i % 2, i % 2, float(i % 2)) for i in range(10)]
    rows += [("only", 1, 1, 0.3)] * 4
    got = {r.model: r for r in evaluation.metrics(spark.createDataFrame(rows, SCHEMA), score="score").collect()}
    assert (got["ones"].accuracy, got["ones"].f1_neg, got["ones"].roc_auc) == (0.5, 0.0, 0.5)
    assert got["ones"].f1_macro == pytest.approx((2 / 3 + 0) / 2)
    assert (got["perfect"].f1_macro, got["perfect"].roc_auc) == (1.0, 1.0)
    assert (got["only"].f1_macro, got["only"].f1_neg, got["only"].roc_auc) == (1.0, 0.0, None)


@pytest.mark.parametrize("levels", [3, 100_000])
def test_auc_is_exact_with_and_without_ties(spark, levels):
    rng = random.Random(3)
    rows = [("m", int(rng.random() < 0.3), 0, rng.randrange(levels) / levels) for _ in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = evaluation.roc_auc(frame).first().roc_auc
    spark_auc = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(frame)
    assert got == pytest.approx(spark_auc, abs=1e-12)


def test_confusion_keeps_zero_cells(spark):
    rows = evaluation.confusion(spark.createDataFrame([("m", 1, 1, 0.0)] * 3, SCHEMA)).orderBy("label", "prediction").collect()
    assert [(r.label, r.prediction, r.n) for r in rows] == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 3)]


def test_unlabelled_rows_take_no_part(spark):
    rows = [("m", 1, 1, 0.9), ("m", 0, 0, 0.1), ("m", None, 1, 0.95), ("m", None, 0, 0.0)]
    got = evaluation.metrics(spark.createDataFrame(rows, SCHEMA), score="score").first()
    assert (got.accuracy, got.f1_macro, got.roc_auc) == (1.0, 1.0, 1.0)


def test_confusion_shows_all_classes_seen(spark):
    rows = [("m", 2, 1, 0.0), ("m", 0, 0, 0.0), ("n", 1, 1, 0.0)]
    got = {(r.model, r.label, r.prediction): r.n for r in evaluation.confusion(spark.createDataFrame(rows, SCHEMA), "model").collect()}
    assert len(got) == 9 + 4 and got["m", 2, 1] == 1 and got["m", 2, 2] == 0


def test_kappa_of_chance_and_of_perfect_agreement(spark):
    rows = [("chance", a, b, 0.0) for a in (0, 1) for b in (0, 1)] + [("same", a, a, 0.0) for a in (0, 1)] + [("one", 1, 1, 0.0)]
    got = {r.model: r.kappa for r in evaluation.cohen_kappa(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"chance": 0.0, "same": 1.0, "one": None}


def test_best_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([("a", 0.5, 0), ("b", 0.7, 1), ("c", 0.7, 2), ("d", None, 3)], "model string, f1_macro double, ord int")
    assert evaluation.best(rows).first().model == "b"


def test_comparison_of_uneven_sets(spark):
    a = spark.createDataFrame([("lexicon", "l", 0.61239)], "tier string, model string, accuracy double")
    b = spark.createDataFrame([("neural", "n", 0.9, 0.8)], "tier string, model string, eval_accuracy double, eval_f1_macro double")
    c = spark.createDataFrame([("classical", "c", None)], "tier string, model string, accuracy double")
    table = evaluation.compare(a, b, c)
    assert table.columns == list(evaluation.RESULT_COLUMNS)
    assert {tuple(r) for r in evaluation.rounded(evaluation.plot_table(table)).collect()} == {
        ("lexicon", "l", 0.6124, None, None), ("neural", "n", 0.9, 0.8, None)
    }


def test_top_features(spark):
    coefs = spark.createDataFrame([(f"t{i:03d}", float(i % 50)) for i in range(100)], "term string, coef double")
    rows = evaluation.top_features(coefs, 3).orderBy("rank").collect()
    assert [r.positive_features for r in rows] == ["t049", "t099", "t048"]
    assert [r.negative_features for r in rows] == ["t000", "t050", "t001"]


def test_histogram_puts_the_largest_value_in_the_last_bin(spark):
    frame = spark.range(0, 101).select(F.col("id").alias("x"))
    counts = [r["count"] for r in audit.histogram(frame, "x", 10, cap=100).orderBy("bin").collect()]
    assert counts == [10] * 9 + [11]
    assert sum(r["count"] for r in audit.histogram(frame.where("x = 5"), "x", 4).collect()) == 1


def test_describe_and_null_counts(spark):
    frame = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, None), (5.0, "b")], "x double, s string")
    got = {r.statistic: r.value for r in audit.describe(frame, ["x"]).collect()}
    assert (got["count"], got["null_count"], got["50%"], got["max"]) == (3, 1, 2, 5)
    assert {tuple(r) for r in audit.null_counts(frame).collect()} == {("x", 1), ("s", 2)}
    assert audit.describe(frame, ["x"], approx=True).count() == 9
