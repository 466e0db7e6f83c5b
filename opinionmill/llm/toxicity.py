"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams and itself, each with an embedding; the mean over the words of
a window goes into a two-class softmax. Both are trained jointly: first on the mean over whole texts,
then on the window that speaks most for class 1, which is also how a text is scored, so one sentence
in a long text counts. Unseen misspellings share n-grams with known words.

Training: up to ``per_label`` labelled texts of each label, whole, in the order of a hash of the id.
A tenth of them sets the decision point, weighted to the labels' real shares.

Cases: an empty or null text gets the score of no evidence; several labels of one id count as the
largest; null labels teach nothing; without both labels the score is the share of label 1 (0 if none);
repeated rows are scored alike; a text of any length is read whole; a row without doc_id teaches nothing
and is scored like any other; other columns, whatever their names, pass unchanged (those named like a
result are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opinionmill.llm import words
from opinionmill.llm.storage import put_back, set_apart, with_fields
from opinionmill.operators.relational import top_k_per_group

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
DIM = 12
WINDOW = 8
PER_LABEL = 2500
MEAN_STEPS, WINDOW_STEPS = 60, 120


class Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.t = value, rate, 0
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)

    def step(self, slope: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (slope - self.m)
        self.v += 0.001 * (slope * slope - self.v)
        self.value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def best_windows(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest mean of ``WINDOW`` word values in a row per text (all words of a shorter text; 0 if
    none), and the word where that window begins."""
    sums = np.append(0.0, np.cumsum(values))
    n = np.diff(first)
    size = np.minimum(n, WINDOW)
    count = np.where(n > 0, n - size + 1, 0)
    at = words.ragged(first[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    mean = (sums[at + size[owner]] - sums[at]) / size[owner]
    top, begin = np.zeros(len(n)), first[:-1].copy()
    full = np.flatnonzero(count)
    if len(full):
        starts = (np.cumsum(count) - count)[full]
        top[full] = np.maximum.reduceat(mean, starts)
        is_top = np.flatnonzero(mean == top[owner])
        which, where = np.unique(owner[is_top], return_index=True)
        begin[which] = at[is_top[where]]
    return top, begin


def fit(texts: pa.Array, labels: np.ndarray, share: float, seed: int = 42) -> tuple[np.ndarray, float]:
    """Value of every feature (its embedding times the softmax direction) and the bias."""
    rng = np.random.default_rng(seed)
    codes, distinct, first = words.coded(texts, lower=True)
    features, begins = words.subwords(distinct, SIZES, BUCKETS)
    counts = np.diff(np.append(begins, len(features)))
    table = Adam(rng.normal(0, 0.1, (BUCKETS, DIM)), 0.05)
    output = Adam(np.append(rng.normal(0, 1, DIM), 0.0), 0.05)
    n, hidden = np.diff(first), rng.random(len(labels)) < 0.1
    learn = ~hidden & (n > 0)
    weight = np.where(labels == 1, 0.5 / max((labels[learn] == 1).sum(), 1), 0.5 / max((labels[learn] == 0).sum(), 1)) * learn
    text_of = np.repeat(np.arange(len(n)), n)

    def word_values() -> np.ndarray:
        return np.add.reduceat((table.value @ output.value[:-1])[features], begins) / counts

    for step in range(MEAN_STEPS + WINDOW_STEPS):
        values = word_values()
        if step < MEAN_STEPS:
            scale = 8.0  # a mean over a whole text is flatter than over a window
            top = scale * np.bincount(text_of, weights=values[codes], minlength=len(n)) / np.maximum(n, 1)
            slope = weight * (sigmoid(top + output.value[-1]) - labels)
            per_word = np.bincount(codes, weights=(scale * slope / np.maximum(n, 1))[text_of], minlength=len(distinct))
        else:
            top, begin = best_windows(values[codes], first)
            slope = weight * (sigmoid(top + output.value[-1]) - labels)
            size = np.minimum(n, WINDOW)
            at = words.ragged(begin, size)
            per_word = np.bincount(codes[at], weights=np.repeat(slope / np.maximum(size, 1), size), minlength=len(distinct))
        per_feature = np.bincount(features, weights=np.repeat(per_word / counts, counts), minlength=BUCKETS)
        to_output = np.append(per_feature @ table.value, slope.sum())
        table.step(np.outer(per_feature, output.value[:-1]))
        output.step(to_output)
    values = table.value @ output.value[:-1]
    top, _ = best_windows((np.add.reduceat(values[features], begins) / counts)[codes], first)
    check = np.flatnonzero(hidden & (n > 0))
    bias = float(output.value[-1])
    if len(np.unique(labels[check])) == 2:
        cost = np.where(labels[check] == 1, share / (labels[check] == 1).sum(), (1 - share) / (labels[check] == 0).sum())
        order = check[np.argsort(top[check])]
        cost = cost[np.argsort(top[check])]
        positive = labels[order] == 1
        # Errors when the texts from place i on are called 1, and the middle of the best range of places.
        errors = np.append(0, np.cumsum(cost * positive)) + np.append(np.cumsum((cost * ~positive)[::-1])[::-1], 0)
        best = np.flatnonzero(errors <= errors.min() + 1e-12)
        edges = np.concatenate([[top[order[0]] - 1], (top[order][1:] + top[order][:-1]) / 2, [top[order[-1]] + 1]])
        bias = -float(edges[best].mean())
    return values.astype(np.float32), bias


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_label: int = PER_LABEL) -> DataFrame:
    """``text, label`` of at most ``per_label`` texts of each label."""
    marks = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = top_k_per_group(marks, ["_label"], order, per_label, spread="_id").select("_id", "_label")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", F.col("_label").alias("label"))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_label: int = PER_LABEL) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; ``learn`` marks the rows of ``labels`` to learn from."""
    counted = labels.where(learn).agg(F.avg(F.when(F.col(label).isin(0, 1), F.col(label).cast("double"))).alias("p")).first()["p"]
    share = counted or 0.0
    sample = training_rows(docs, labels, learn, label, per_label).toArrow()
    marks = sample.column("label").to_numpy()
    if len(np.unique(marks)) == 2:
        model = fit(sample.column("text").combine_chunks(), marks, share)
    else:
        model = (np.zeros(1, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    rows = set_apart(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, bias = shared.value
        for batch in words.sliced(batches, "text"):
            codes, distinct, first = words.coded(batch.column("text"), lower=True)
            top = np.zeros(batch.num_rows)
            if len(codes):
                features, begins = words.subwords(distinct, SIZES, len(values))
                counts = np.diff(np.append(begins, len(features)))
                top, _ = best_windows((np.add.reduceat(values[features].astype(float), begins) / counts)[codes], first)
            score = sigmoid(np.where(np.diff(first) > 0, top, 0.0) + bias)
            columns = [batch.column("row"), batch.column("text"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "score", "predicted"])

    return put_back(rows.mapInArrow(predict, with_fields(rows.schema, "score double, predicted int")), docs)
