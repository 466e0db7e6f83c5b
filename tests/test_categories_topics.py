import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionmill.operators import categories, features, models, topics, relational


def test_category_scores_and_hooks(spark):
    docs = spark.createDataFrame([(0, 1, "need need want"), (1, 0, ""), (2, 1, "want")], "doc_id long, label int, review string")
    seeds = spark.createDataFrame([("real need", "need", 1.0), ("a wish", "want", 2.0)], "category string, seed_term string, weight double")
    names = ["real need", "a wish", "no seeds"]
    rows = {r.doc_id: r for r in categories.score(docs, names, seeds=seeds).collect()}
    squash = lambda x: 1 / (1 + math.exp(-(4 * x - 2)))
    assert rows[0].real_need == pytest.approx(squash(2 / math.sqrt(3))) and rows[0].a_wish == pytest.approx(squash(2 / math.sqrt(3)))
    assert rows[1].real_need == rows[1].no_seeds == pytest.approx(squash(0))
    hook = lambda texts, cats: np.stack([texts.str.len() / 100] * len(cats), axis=1)
    hooked = {r.doc_id: r.a_wish for r in categories.score(docs, names, hook).collect()}
    assert hooked[2] == pytest.approx(0.04)


def test_top_examples_break_ties_by_key(spark):
    scores = spark.createDataFrame([(i, i % 2, 0.5, float(i)) for i in range(6)], "doc_id long, label int, a double, b double")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, review string")
    rows = categories.top_examples(scores, ["a", "b"], docs, 2).orderBy("category", "rank").collect()
    assert [(r.category, r.doc_id, r.review) for r in rows] == [("a", 0, "text 0"), ("a", 1, "text 1"), ("b", 5, "text 5"), ("b", 4, "text 4")]
    few = categories.top_examples(scores.limit(1), ["a"], docs, 3)
    assert few.count() == 1


def brute_density(points, cell, min_points, min_size):
    place = {i: tuple(math.floor(x / cell) for x in p) for i, p in points.items()}
    count = Counter(place.values())
    dense = {c for c, n in count.items() if n >= min_points}
    component = {}
    for start in dense:
        if start in component:
            continue
        stack, component[start] = [start], start
        while stack:
            c = stack.pop()
            for axis in range(len(c)):
                for step in (-1, 1):
                    n = c[:axis] + (c[axis] + step,) + c[axis + 1 :]
                    if n in dense and n not in component:
                        component[n] = start
                        stack.append(n)
    groups = {}
    for i, c in place.items():
        if c in component:
            groups.setdefault(component[c], set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) >= min_size}


def test_density_against_flood_fill(spark):
    rng = random.Random(5)
    points = {i: [rng.random() * 4, rng.random() * 4] for i in range(400)}
    # A third of all documents in one spot.
    points.update({1000 + i: [1.0, 1.0] for i in range(200)})
    frame = spark.createDataFrame([(i, p) for i, p in points.items()], "doc_id long, reduced array<double>")
    got = topics.density(frame, 0.35, 5, 20).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.topic, set()).add(r.doc_id)
    noise = groups.pop(-1, set())
    assert {frozenset(g) for g in groups.values()} == brute_density(points, 0.35, 5, 20)
    sizes = [len(groups[t]) for t in sorted(groups)]
    assert sizes == sorted(sizes, reverse=True) and len(noise) + sum(sizes) == 600


def test_components_of_a_long_chain(spark):
    n = 200
    both = [(f"{i:03d}", f"{i + 1:03d}") for i in range(n)] + [(f"{i + 1:03d}", f"{i:03d}") for i in range(n)]
    edges = spark.createDataFrame(both, "a string, b string")
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(n + 1)] + [("zzz",)], "node string")
    rows = {r.node: r.component for r in topics.connected_components(edges, nodes).collect()}
    assert set(rows.values()) == {"000", "zzz"} and rows["200"] == "000"


@pytest.mark.parametrize("kind", ["string", "long"])
def test_components_of_few_edges_need_no_rounds(spark, kind):
    links = [(i, i + 1) for i in range(30) if i % 5] + [(7, 26), (90, 91)]
    edges = spark.createDataFrame([e for a, b in links for e in ((a, b), (b, a))], "a long, b long").select(*[F.col(c).cast(kind).alias(c) for c in "ab"])
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 90, 91, 95]], "node long").select(F.col("node").cast(kind).alias("node"))
    found, rounds = (sorted(map(tuple, topics.connected_components(edges, nodes, **k).collect())) for k in ({"max_rounds": 0}, {"at_once": 0}))
    assert found == rounds and len(found) == 34
    assert topics.connected_components(edges.limit(0), nodes, max_rounds=0).where("node <> component").isEmpty()


def test_topic_words_and_noise(spark):
    docs = spark.createDataFrame(
        [(0, -1, "noise it's"), (1, 0, "apple apple pear"), (2, 0, "apple"), (3, 1, "car pear car")], "doc_id long, topic int, review string"
    )
    rows = {(r.topic, r.term): r.weight for r in topics.words(docs).collect()}
    average = (2 + 4 + 3) // 3
    assert rows[(0, "apple")] == pytest.approx(3 / 4 * math.log(1 + average / 3))
    assert (-1, "its") in rows
    assert [r.topic for r in topics.largest_topics(docs, 1).collect()] == [0]
    info = topics.info(docs, topics.words(docs), k_name=2).collect()
    assert [(r.topic, r["count"]) for r in info] == [(-1, 1), (0, 2), (1, 1)] and info[1].name == "0_apple_pear"


def test_clusters_below_the_size_limit_are_noise(spark):
    rows = [(i, [0.0, 0.0 + i / 1000]) for i in range(60)] + [(100 + i, [9.0, 9.0]) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, reduced array<double>")
    got = Counter(r.topic for r in topics.cluster(frame, 2, min_size=10).collect())
    assert got == {0: 60, -1: 5}


def test_nearest_prototype(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.0, 2.0])], "doc_id long, embedding array<double>")
    prototypes = spark.createDataFrame([(3, [1.0, 0.0]), (5, [0.0, 1.0]), (-1, [1.0, 1.0])], "topic int, centroid array<double>")
    assert {r.doc_id: r.topic for r in topics.assign(vectors, prototypes).collect()} == {0: 3, 1: 5}


def test_classifiers_separate_an_easy_corpus(spark):
    rng = random.Random(7)
    filler = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(200):
        label = i % 2
        words = rng.choices(filler, k=12) + (["awful", "broken"] if label == 0 else ["lovely", "perfect"])
        rows.append((i, label, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, label int, review string")
    vocab = features.fit_vocabulary(docs, min_df=2, ngram=(1, 1))
    size = vocab.count()
    data = models.tfidf_vectors(docs, vocab, size, ngram=(1, 1)).persist()
    from opinionmill.operators.evaluation import metrics

    for fit in (
        lambda t: models.fit_logreg(t, max_iter=20), lambda t: models.fit_svc(t, max_iter=10),
        lambda t: models.fit_gbt(t, t, rounds=3, depth=2, max_features=10), lambda t: models.fit_undersampled_logreg(t, max_iter=20),
    ):
        scored = models.predict(fit(data), data).withColumn("model", F.lit("m"))
        row = metrics(scored, score="score").first()
        assert row.roc_auc > 0.95 and row.f1_macro > 0.9
    coefs = {r.term: r.coef for r in models.coefficients(models.fit_logreg(data, max_iter=20), vocab).collect()}
    assert coefs["lovely"] > 0 > coefs["awful"]
    model = features.fit_embedder(docs, dim=8, min_count=1, iterations=2)
    dense = docs.select("doc_id", F.col("label").cast("double").alias("label")).join(features.embed(docs, model), "doc_id")
    best, table = models.fit_mlp(dense, dense, budgets=(5, 60), hidden=(6,))
    assert table.count() == 2 and best.stages[-1].getMaxIter() in (5, 60)


def test_rake_deals_numbers_not_phrases(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red cat the big red dog of cat"), (2, "big dog and big dog the big red dog"), (3, None)], "doc_id long, review string")
    met = []
    monkeypatch.setattr(topics, "lookup_join", lambda big, lookup, *a, **k: met.append(big.columns) or relational.lookup_join(big, lookup, "word", "inner", 0))
    found = [tuple(r) for r in topics.rake(docs, ("the", "of", "and"), 3).collect()]
    # red: (2 + 2 * 3) / 3, cat: (2 + 1) / 2, big and dog: (2 * 3 + 2 * 2) / 4
    assert found == [(1, "big red dog", 2, 7.666667), (2, "big dog", 2, 5.0), (3, "red cat", 1, 4.166667)]
    assert met == [["_id", "word"]]


def test_candidates_are_not_dealt_by_topic(spark, monkeypatch):
    texts = spark.createDataFrame([(1, 0, "red cat"), (2, 0, "big dog"), (3, 1, "cat")], "doc_id long, topic int, text string")

    def embed(df, model, text, key):
        return df.select(key, F.array(F.length(text).cast("double"), F.lit(1.0)).alias("embedding"))

    met = []
    monkeypatch.setattr(topics, "embed", embed)
    monkeypatch.setattr(topics, "lookup_join", lambda big, lookup, on, how, small=False: met.append((on, small)) or relational.lookup_join(big, lookup, on, how, small=small))
    found = topics.keyphrases(texts, None, 2)
    assert {(r.topic, r["rank"], r.term) for r in found.collect()} == {(0, 1, "big dog"), (0, 2, "red cat"), (1, 1, "cat")}
    assert met == [("topic", True)]
