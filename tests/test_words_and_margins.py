"""Word vectors, lexicon expansion, the squared-hinge classifier and perturbations against numpy and plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from opinionmill.operators import embedding, expansion, margin, models, perturbation
from opinionmill.session import checkpoint


def test_eigenpairs_of_the_pmi_matrix(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(14)]
    texts = [(i, " ".join(rng.choice(words[: 7 + 7 * (i % 2)]) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    docs = spark.createDataFrame([*texts, (99, None), (98, "")], "doc_id long, review string").repartition(3)
    counts, single = Counter(), Counter(w for _, t in texts for w in t.split())
    for _, text in texts:
        t = text.split()
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 3]:
                counts[a, b] += 1
                counts[b, a] += 1
    known = sorted(w for w, n in single.items() if n >= 3)
    counts = {k: n for k, n in counts.items() if k[0] in known and k[1] in known}
    found = embedding.cooccurrences(docs, 2, 3)
    assert {(r.a, r.b): r.n for r in found.collect()} == counts
    sums, total = Counter(), sum(counts.values())
    for (a, _), n in counts.items():
        sums[a] += n
    matrix = np.zeros((len(known), len(known)))
    for (a, b), n in counts.items():
        matrix[known.index(a), known.index(b)] = max(0.0, math.log(n * total / (sums[a] * sums[b])))
    vectors, values = embedding.word_vectors(embedding.positive_pmi(found), 4)
    exact = np.linalg.eigvalsh(matrix)
    exact = exact[np.argsort(-np.abs(exact))][:4]
    assert np.allclose(values, exact, atol=1e-6)
    rows = {r.word: np.array(r.v) for r in vectors.collect()}
    v = np.stack([rows.get(w, np.zeros(4)) for w in known])
    assert np.allclose(matrix @ v, v * exact, atol=1e-3)
    lengths = {r.doc_id: math.sqrt(sum(x * x for x in r.embedding)) for r in embedding.document_vectors(docs, vectors, 4).collect()}
    assert lengths[99] == lengths[98] == 0 and all(n == pytest.approx(1) or n == 0 for n in lengths.values()) and len(lengths) == 62


def test_products_meet_in_blocks_of_the_matrix(spark, monkeypatch):
    """A block of the matrix is one row, whatever number of entries it has; blocks and pieces add up to the whole product."""
    for name, n in (("CHUNK", 4), ("HIGH", 2), ("WIDE", 3), ("PIECE", 20)):
        monkeypatch.setattr(embedding, name, n)
    rng = np.random.default_rng(5)
    dense = rng.random((30, 30)) * (rng.random((30, 30)) < 0.4)
    # Three groups of words, so that the three largest eigenvalues stand out.
    dense = np.triu(dense) + np.triu(dense, 1).T + np.kron(np.diag([5.0, 4.0, 3.0]), np.ones((10, 10)))
    names = [f"w{i:02}" for i in range(30)]
    entries = [(names[i], names[j], float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    matrix = spark.createDataFrame(entries, "a string, b string, pmi double").repartition(5)
    words = spark.createDataFrame([(w, i) for i, w in enumerate(names)], "word string, id long")
    packed, (high, wide, pieces) = embedding.blocks(matrix, words)
    assert (high, wide) == (4, 3) and pieces > 1 and packed.count() <= high * wide * pieces < len(entries)
    start = np.zeros((32, 3))
    start[:30] = rng.random((30, 3))
    rows = spark.createDataFrame([(c, start[4 * c : 4 * c + 4].tobytes()) for c in range(8)], "chunk int, v binary")
    found = {r.chunk: np.frombuffer(r.v).reshape(4, 3) for r in embedding.times(packed, (high, wide, pieces), rows, 3).collect()}
    got = np.concatenate([found.get(c, np.zeros((4, 3))) for c in range(8)])
    assert np.allclose(got[:30], dense @ start[:30]) and not got[30:].any()
    vectors, values = embedding.word_vectors(matrix, 3)
    exact = np.linalg.eigvalsh(dense)
    exact = exact[np.argsort(-np.abs(exact))][:3]
    assert np.allclose(values, exact, atol=1e-6)
    v = np.stack([{r.word: np.array(r.v) for r in vectors.collect()}[w] for w in names])
    assert np.allclose(dense @ v, v * exact, atol=1e-3)


def test_walk_settles_where_the_equations_hold(spark):
    edges = [("a", "b", 2.0), ("b", "a", 2.0), ("b", "c", 1.0), ("c", "b", 1.0), ("c", "d", 3.0), ("d", "c", 3.0), ("a", "a", 9.0)]
    graph = expansion.relation_graph(spark.createDataFrame(edges, "a string, b string, pmi double"), 2)
    seeds = spark.createDataFrame([("a", 1.0), ("d", -1.0), ("zz", 1.0)], "word string, score double")
    got = {r.word: r.score for r in expansion.expand_lexicon(graph, seeds, restart=0.5, tol=1e-5).collect()}
    share = np.array([[0, 1, 0, 0], [2 / 3, 0, 1 / 3, 0], [0, 1 / 4, 0, 3 / 4], [0, 0, 1, 0]])
    want = np.linalg.solve(np.eye(4) - 0.5 * share.T, 0.5 * np.array([1.0, 0, 0, -1]))
    assert [got[w] for w in "abcd"] == pytest.approx(want.tolist(), abs=1e-4) and got["zz"] == 0.5


def test_squared_hinge_is_stationary_and_ranks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5)) * (rng.random((80, 5)) < 0.7)
    y = (x @ [1, -2, 0.5, 0, 1] + 0.3 + rng.normal(size=80) * 0.3 > 0).astype(int)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("features", VectorUDT())])
    rows = [(i, int(y[i]), Vectors.dense(x[i]) if i % 2 else Vectors.sparse(5, [(j, v) for j, v in enumerate(x[i]) if v])) for i in range(80)]
    data = spark.createDataFrame(rows, schema).repartition(3)
    model = margin.fit_squared_hinge(data, c=2.0, tol=1e-8)
    w, full, sign = np.append(model.weights, model.intercept), np.hstack([x, np.ones((80, 1))]), 2 * y - 1
    short = np.maximum(0, 1 - sign * (full @ w))
    assert np.abs(w - 4 * full.T @ (sign * short)).max() < 1e-5
    got = {r.doc_id: (r.prediction, r.score) for r in model.predict(data).collect()}
    assert np.allclose([got[i][1] for i in range(80)], full @ w) and np.mean([got[i][0] == y[i] for i in range(80)]) > 0.9
    assert margin.fit_squared_hinge(data.limit(0)).weights.tolist() == []


def test_perturbations_cut_a_text_into_words_once(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, review string")
    for frame in (docs.select(perturbation.changed("swap", 30)), perturbation.perturbed(docs)):
        # Named inside a lambda, the cut would be made anew for every word.
        assert frame._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_perturbations_are_the_same_for_any_order(spark):
    texts = [(i, " ".join(f"word{j}é" for j in range(i % 23))) for i in range(60)] + [(100, None), (101, "  a  b ")]
    docs = spark.createDataFrame(texts, "doc_id long, review string")
    one = {(r.doc_id, r.kind): r.review for r in perturbation.perturbed(docs, share=30).collect()}
    other = {(r.doc_id, r.kind): r.review for r in perturbation.perturbed(docs.repartition(5).orderBy(F.desc("doc_id")), share=30).collect()}
    assert one == other and one[100, "typo"] == ""
    for (doc_id, kind), text in one.items():
        before, after = (dict(texts)[doc_id] or "").split(), text.split()
        if kind == "negation":
            assert [w for w in after if w != "not"] == before
        elif kind == "typo":
            assert [sorted(w) for w in after] == [sorted(w) for w in before] and all(a[0] == b[0] for a, b in zip(after, before))
        elif kind == "swap":
            assert sorted(after) == sorted(before) and all({*after[i : i + 2]} == {*before[i : i + 2]} for i in range(0, len(before), 2))
        else:
            assert len(after) <= len(before) and set(after) <= set(before)
    assert any(one[i, k] != dict(texts)[i] for i in range(60) for k in perturbation.KINDS)


def test_sign_test(spark):
    rows = [(0, 0), (3, 0), (1, 9), (40, 40), (5, 4), (700, 800)]
    table = spark.createDataFrame(rows, "up long, down long").withColumn("p", perturbation.sign_test(F.col("up"), F.col("down")))

    def exact(a, b):
        n = a + b
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2**n) if n else 1.0

    for r in table.collect():
        assert r.p == pytest.approx(exact(r.up, r.down), rel=1e-9)


def test_linear_fits_run_in_one_task_per_core(spark):
    """Every task of a linear fit sends a vector as long as the vocabulary: many small ones multiply it."""
    rng = random.Random(4)
    rows = [(i, i % 2, [float(i % 2) + rng.random(), rng.random()]) for i in range(400)]
    data = spark.createDataFrame(rows, "doc_id long, label int, x array<double>").repartition(64)
    data = checkpoint(data.select("doc_id", F.col("label").cast("double").alias("label"), models.array_to_vector("x").alias("features")))
    context = spark.sparkContext
    for name, fit in (("logreg", models.fit_logreg), ("svc", models.fit_svc), ("hinge", lambda t, max_iter: margin.fit_squared_hinge(t, max_iter=max_iter))):
        context.setJobGroup(f"fit-{name}", name)
        fit(data, max_iter=8)
        status = context.statusTracker()
        stages = [status.getStageInfo(i) for j in status.getJobIdsForGroup(f"fit-{name}") for i in status.getJobInfo(j).stageIds]
        context.setLocalProperty("spark.jobGroup.id", None)
        wide = [s.numTasks for s in stages if s is not None and s.numTasks > context.defaultParallelism]
        # Only counting the rows and looking at the first one may use all stored partitions.
        assert len(stages) > 4 and len(wide) <= 2, (name, wide)
