"""Topic discovery and topic tables. Topic -1 is noise."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import PCA, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.functions.text import ngrams, word_tokens
from opinionmill.functions.vectors import cosine
from opinionmill.operators.features import bag_of_words, embed, to_vectors
from opinionmill.operators.relational import as_small, exploded, fits, lookup_join, settled, top_k_per_group
from opinionmill.session import SEED, checkpoint, packed_table

NOISE = -1
#: Edges that one task joins up.
EDGES_AT_ONCE = 1 << 20


def reduce_dims(vectors: DataFrame, k: int = 5, key: str = "doc_id", vector: str = "embedding", out: str = "reduced") -> DataFrame:
    """Project unit vectors on their first ``k`` principal components."""
    dense = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(dense)
    return model.transform(dense).select(key, vector_to_array("_p").alias(out))


def renumber_by_size(assigned: DataFrame, min_size: int = 1, key: str = "doc_id", cluster: str = "cluster") -> DataFrame:
    """``(doc_id, topic)``: clusters numbered from 0 by falling size; small ones and rows without
    a cluster (null) become noise."""
    sizes = assigned.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first")
    )
    # One row per cluster of at least min_size documents.
    order = Window.orderBy(F.desc("_n"), "_first")
    ids = sizes.where(F.col("_n") >= min_size).select(cluster, (F.row_number().over(order) - 1).alias("topic"))
    ids, small = settled(ids)
    joined = lookup_join(assigned, ids, cluster, "left", small=small)
    return joined.select(key, F.coalesce("topic", F.lit(NOISE)).cast("int").alias("topic"))


def cluster(
    vectors: DataFrame,
    k: int,
    min_size: int = 80,
    noise_quantile: float | None = None,
    key: str = "doc_id",
    vector: str = "reduced",
    max_iter: int = 20,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, topic)`` by k-means; clusters below ``min_size`` and, if asked for, points
    further out than a distance quantile are noise."""
    dense = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v")).persist()
    try:
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="cluster").fit(dense)
    finally:
        dense.unpersist()
    assigned = model.transform(dense)
    if noise_quantile is not None:
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
        gap = F.zip_with(vector_to_array("_v"), F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b))
        assigned = assigned.withColumn("_far", F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))
        limit = assigned.agg(F.percentile_approx("_far", noise_quantile, 10_000)).first()[0]
        assigned = assigned.withColumn("cluster", F.when(F.col("_far") <= limit, F.col("cluster")))
    return renumber_by_size(assigned.select(key, "cluster"), min_size, key)


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to ``n`` - 1 the smallest one it is joined to by edges ``a, b``."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def smallest_of_ends(edges: DataFrame, kind: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all ends of a bounded number of ``edges (a, b)``, in one task."""

    def union(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(frame[["a", "b"]].to_numpy(), return_inverse=True)
        return pd.DataFrame({"node": nodes, "component": nodes[smallest_labels(len(nodes), *ends.reshape(-1, 2).T)]})

    return edges.groupBy(F.lit(0).alias("_all")).applyInPandas(union, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """``(node, component)``: smallest node reachable over ``edges (a, b)``, given both ways.

    Up to ``at_once`` edges are joined up in one task. With more, each round takes the smallest neighbour label and then the label of that label, so chains
    shorten geometrically; every round is written to the checkpoint folder.
    """
    if fits(edges, at_once):
        ends = smallest_of_ends(edges.select("a", "b"), nodes.schema["node"].dataType.simpleString()).withColumnRenamed("node", "_node")
        known = nodes.join(ends, F.col("node") == F.col("_node"), "left")
        return checkpoint(known.select("node", F.coalesce("component", "node").alias("component")))
    labels = checkpoint(nodes.select("node", F.col("node").alias("component")))
    for _ in range(max_rounds):
        offered = edges.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("_offer")
        )
        lowered = labels.join(offered, "node", "left").select(
            "node", "component", F.least("component", F.coalesce("_offer", "component")).alias("_new")
        )
        jump = lowered.select(F.col("node").alias("_new"), F.col("_new").alias("_jump"))
        # Many nodes share a label, so this is a join on hot keys.
        moved = lookup_join(lowered, jump, "_new", "left").select(
            "node", F.least("_new", F.coalesce("_jump", "_new")).alias("component"), F.col("component").alias("_old")
        )
        moved = checkpoint(moved)
        labels = moved.select("node", "component")
        if moved.where(F.col("component") != F.col("_old")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def density(
    vectors: DataFrame, cell: float, min_points: int, min_size: int = 1, key: str = "doc_id", vector: str = "reduced"
) -> DataFrame:
    """``(doc_id, topic)`` by density on a grid of cells of side ``cell``.

    A cell with at least ``min_points`` documents is dense; dense cells that share a face form
    one topic, everything else is noise. Documents are only counted per cell, never paired, so
    a crowded spot costs no more than any other; the linking works on dense cells alone. Meant
    for the few dimensions ``reduce_dims`` leaves.
    """
    place = F.transform(vector, lambda x: F.floor(x / F.lit(float(cell))).cast("long"))
    placed = vectors.select(key, place.alias("_cell"))
    dense = checkpoint(
        placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).select("_cell")
    )
    name = F.array_join(F.transform("_cell", lambda x: x.cast("string")), ",")
    nodes = dense.select(name.alias("node"), "_cell")

    def shifted(step: int) -> Column:
        return F.transform(
            "_cell",
            lambda _, axis: F.transform("_cell", lambda x, i: F.when(i == axis, x + step).otherwise(x)),
        )

    neighbour = nodes.select(F.col("node").alias("a"), F.explode(F.concat(shifted(1), shifted(-1))).alias("_cell"))
    edges = checkpoint(neighbour.select("a", name.alias("b")).join(nodes.select(F.col("node").alias("b")), "b", "left_semi"))
    components = connected_components(edges, nodes.select("node"))
    named = placed.select(key, name.alias("node"))
    assigned = lookup_join(named, components.select("node", F.col("component").alias("cluster")), "node", "left")
    return renumber_by_size(assigned.select(key, "cluster"), min_size, key)


def centroids(vectors: DataFrame, topics: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """``(topic, centroid)``: mean vector per topic, noise left out."""
    joined = topics.where(F.col("topic") != NOISE).join(vectors.select(key, vector), key)
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    return joined.groupBy("topic").agg(Summarizer.mean(dense).alias("_m")).select("topic", vector_to_array("_m").alias("centroid"))


def assign(vectors: DataFrame, prototypes: DataFrame, key: str = "doc_id", vector: str = "embedding", max_topics: int = 10_000) -> DataFrame:
    """``(doc_id, topic, similarity)``: nearest prototype by cosine, smallest topic on a tie.

    Prototypes ``(topic, centroid)`` go to every task as one matrix. Their number is checked and a
    larger set is refused, never cut.
    """
    table = as_small(prototypes.where(F.col("topic") != NOISE).orderBy("topic"), max_topics)
    if table is None:
        raise ValueError(f"more than {max_topics} prototypes; cluster them first")
    frame = table.toPandas().sort_values("topic")
    names = frame["topic"].to_numpy()
    matrix = np.array(frame["centroid"].tolist(), dtype="float64")
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("topic int, similarity double")
    def nearest(values: pd.Series) -> pd.DataFrame:
        x = np.array(values.tolist(), dtype="float64").reshape(len(values), -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        at, best = np.zeros(len(x), dtype=int), np.full(len(x), -np.inf)
        for first in range(0, len(matrix), 256):
            similarity = x @ matrix[first : first + 256].T
            here = similarity.argmax(axis=1)
            value = similarity[np.arange(len(x)), here]
            at, best = np.where(value > best, first + here, at), np.maximum(value, best)
        return pd.DataFrame({"topic": names[at], "similarity": best})

    return vectors.select(key, nearest(vector).alias("_n")).select(key, "_n.topic", "_n.similarity")


def topic_tokens(text: str | Column = "review", ascii_only: bool = True) -> Column:
    """Words of a text as topic words see them: other signs than ASCII letters, digits and
    blanks are deleted first unless told otherwise."""
    value = F.col(text) if isinstance(text, str) else text
    value = F.regexp_replace(value, r"[\n\t]", " ")
    value = F.regexp_replace(value, "[^A-Za-z0-9 ]+", "") if ascii_only else value
    return word_tokens(value, fold=False)


def words(
    df: DataFrame, by: Sequence[str] = ("topic",), text: str = "review", ascii_only: bool = True, key: str = "doc_id"
) -> DataFrame:
    """``(topic, term, tf, weight)`` by class-based TF-IDF: share of the term in the topic times
    ``ln(1 + A / f)``, with A the (whole) mean number of words per topic and f the term's total.

    Words are counted per (topic, term) with partial sums; no topic's text is brought together.
    """
    by = list(by)
    tokens = df.select(*by, F.explode(topic_tokens(text, ascii_only)).alias("term"))
    counts = checkpoint(tokens.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("tf")))
    totals, small = settled(counts.groupBy(*by).agg(F.sum("tf").alias("_words")))
    average = totals.agg(F.floor(F.avg("_words"))).first()[0]
    if average is None:
        average = 0
    frequency = counts.groupBy("term").agg(F.sum("tf").alias("_f"))
    weighted = lookup_join(counts.join(frequency, "term"), totals, by, "inner", small=small)
    weight = F.col("tf") / F.col("_words") * F.log(F.lit(1.0) + F.lit(float(average)) / F.col("_f"))
    return weighted.select(*by, "term", "tf", weight.alias("weight"))


def top_words(weights: DataFrame, k: int = 8, by: Sequence[str] = ("topic",)) -> DataFrame:
    """``(topic, rank, term, weight)``: best ``k`` words of each topic."""
    ranked = top_k_per_group(weights, list(by), [F.desc("weight"), F.col("term")], k, spread="term")
    return ranked.select(*by, "rank", "term", "weight")


def largest_topics(topics: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` biggest topics, noise left out."""
    sizes = topics.where(F.col("topic") != NOISE).groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    return sizes.orderBy(F.desc("count"), "topic").limit(n)


def topic_count(topics: DataFrame, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct("topic") if approx else F.count_distinct("topic")
    return topics.agg(count.alias("n_topics"))


def info(
    docs: DataFrame,
    weights: DataFrame,
    vectors: DataFrame | None = None,
    k_words: int = 10,
    k_name: int = 4,
    k_docs: int = 3,
    key: str = "doc_id",
    vector: str = "embedding",
) -> DataFrame:
    """``(topic, count, name, words[, representative_docs])`` ordered by topic.

    Representative documents are those closest to the topic's mean vector.
    """
    sizes = docs.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    ranked = top_words(weights, k_words)
    listed = ranked.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_w"))
    listed = listed.select("topic", F.transform("_w", lambda e: e["term"]).alias("words"))
    out = sizes.join(listed, "topic", "left").select(
        "topic",
        "count",
        F.concat_ws("_", F.col("topic").cast("string"), F.array_join(F.slice("words", 1, k_name), "_")).alias("name"),
        "words",
    )
    if vectors is not None:
        out = out.join(representative_docs(docs, vectors, k_docs, key, vector), "topic", "left")
    return out.orderBy("topic")


def representative_docs(docs: DataFrame, vectors: DataFrame, k: int = 3, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    topics = docs.select(key, "topic")
    centre = centroids(vectors, topics, key, vector)
    centre, small = settled(centre, 10_000)
    placed = lookup_join(topics.join(vectors.select(key, vector), key), centre, "topic", "inner", small=small)
    near = placed.select(key, "topic", F.round(cosine(vector, "centroid"), 9).alias("_sim"))
    best = top_k_per_group(near, ["topic"], [F.desc("_sim"), F.col(key)], k, spread=key)
    listed = best.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", key))).alias("_d"))
    return listed.select("topic", F.transform("_d", lambda e: e[key]).alias("representative_docs"))


def label_share(docs: DataFrame, k: int = 15, label: str = "label") -> DataFrame:
    """``(topic, pos_share, count)`` of the ``k`` biggest topics; unlabelled rows do not enter
    the share."""
    shares = docs.groupBy("topic").agg(F.avg(label).alias("pos_share"), F.count(label).alias("count"))
    return shares.orderBy(F.desc("count"), "topic").limit(k)


def concatenated(docs: DataFrame, n: int = 50, text: str = "review", key: str = "doc_id", n_topics: int | None = None) -> DataFrame:
    """``(topic, text)``: the first ``n`` texts of each topic by document key, joined by blanks;
    ``n_topics`` keeps the topics with the smallest numbers.

    Keys are ranked without their texts; the texts of the chosen ones are fetched afterwards.
    """
    keys = docs.select(key, "topic")
    if n_topics is not None:
        chosen = keys.select("topic").distinct().orderBy("topic").limit(n_topics)
        keys = keys.join(F.broadcast(as_small(chosen, n_topics)), "topic", "left_semi")
    first = top_k_per_group(keys, ["topic"], [F.col(key)], n, spread=key)
    texts = lookup_join(docs.select(key, text), checkpoint(first.select(key, "topic", "rank")), key, "inner")
    listed = texts.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", text))).alias("_t"))
    return listed.select("topic", F.array_join(F.transform("_t", lambda e: e[text]), " ").alias("text"))


def phrase_candidates(texts: DataFrame, stop_words: Sequence[str] | None = None, ngram: tuple[int, int] = (1, 2)) -> DataFrame:
    """``(topic, term, tf)``: one- and two-word phrases without stop words, from any number of texts
    per topic. Counts are summed by (topic, term); no topic's texts are brought together."""
    stop_words = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    stops = F.array(*[F.lit(w) for w in stop_words])
    tokens = F.filter(word_tokens("text", fold=False), lambda t: ~F.array_contains(stops, t))
    return exploded(texts, ["topic"], ngrams(tokens, *ngram), "term").groupBy("topic", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def keyphrases_by_frequency(texts: DataFrame, k: int = 8, **options) -> DataFrame:
    """``(topic, rank, term, tf)``: most frequent candidates, ties in term order."""
    ranked = top_k_per_group(phrase_candidates(texts, **options), ["topic"], [F.desc("tf"), F.col("term")], k, spread="term")
    return ranked.select("topic", "rank", "term", "tf")


def rake(df: DataFrame, stop_words: Sequence[str] | None = None, k: int = 50, text: str = "review") -> DataFrame:
    """``(rank, phrase, n, score)``: runs of words between stop words, scored by their words' degrees.

    A word's degree is the summed length of the phrases it stands in, its score degree / frequency,
    a phrase's score the sum over its words. Phrases are counted first, so word statistics and the
    final join work on distinct phrases.
    """
    stop_words = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    marked = F.transform(word_tokens(text, fold=False), lambda t: F.when(t.isin(list(stop_words)), F.lit("|")).otherwise(t))
    runs = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda p: F.trim(p))
    phrases = exploded(df, [], F.filter(runs, lambda p: p != ""), "phrase").groupBy("phrase")
    phrases = checkpoint(phrases.agg(F.count(F.lit(1)).alias("n")))
    # Stored rows keep their places, so a number can stand for the phrase wherever only its words matter.
    phrases = phrases.withColumn("_id", F.monotonically_increasing_id())
    parts = F.split("phrase", " ")
    weighed = phrases.select(F.explode(parts).alias("word"), "n", F.size(parts).alias("_len")).groupBy("word")
    scores = checkpoint(weighed.agg((F.sum(F.col("n") * F.col("_len")) / F.sum("n")).alias("_score")))
    scored = lookup_join(phrases.select("_id", F.explode(parts).alias("word")), scores, "word", "inner")
    scored = checkpoint(scored.groupBy("_id").agg(F.round(F.sum("_score"), 6).alias("score")))
    # Only phrases as good as the k-th best meet their texts again; ties are all kept until they are ranked.
    least = scored.orderBy(F.desc("score")).limit(k).agg(F.min("score")).first()[0]
    best = phrases.join(scored.where(F.col("score") >= F.lit(least)), "_id").select("phrase", "n", "score")
    return best.orderBy(F.desc("score"), F.desc("n"), "phrase").limit(k).select(
        F.row_number().over(Window.orderBy(F.desc("score"), F.desc("n"), "phrase")).alias("rank"), "phrase", "n", "score"
    )


def keyphrases(texts: DataFrame, model: PipelineModel, k: int = 8, key: str = "doc_id", **options) -> DataFrame:
    """``(topic, rank, term, similarity)``: candidates closest to the mean vector of the topic's texts."""
    whole = centroids(embed(texts, model, text="text", key=key), texts.select(key, "topic"), key).withColumnRenamed("centroid", "_whole")
    # Few topics own many candidates each: their vectors go to the candidates, which are not dealt by topic.
    whole, small = settled(whole, 10_000)
    candidates = packed_table(phrase_candidates(texts, **options))
    encoded = embed(candidates.select("term").distinct(), model, text="term", key="term")
    scored = lookup_join(candidates.join(encoded, "term"), whole, "topic", "inner", small=small)
    near = scored.select("topic", "term", cosine("embedding", "_whole").alias("similarity")).where(F.col("similarity").isNotNull())
    ranked = top_k_per_group(near, ["topic"], [F.desc("similarity"), F.col("term")], k, spread="term")
    return ranked.select("topic", "rank", "term", "similarity")


def lda(
    df: DataFrame,
    k: int = 8,
    n_docs: int | None = None,
    passes: int = 2,
    n_words: int = 6,
    no_below: int = 10,
    no_above: float = 0.5,
    subsampling: float = 0.05,
    text: str = "review",
    key: str = "doc_id",
    seed: int = SEED,
) -> DataFrame:
    """``(topic, rank, term, weight)`` of an online LDA over all documents, or the first ``n_docs``
    by key. One pass is ``1 / subsampling`` mini-batches."""
    docs = df.select(key, text)
    if n_docs is not None:
        # Only keys are sorted; the texts stay where they are.
        docs = lookup_join(docs, docs.select(key).orderBy(key).limit(n_docs), key, "left_semi")
    dictionary, counts = bag_of_words(docs, text, no_below, no_above, key)
    size = dictionary.count()
    if not size:
        raise ValueError("no term is left after filtering")
    bags = counts.withColumn("tf", F.col("tf").cast("double"))
    vectors = to_vectors(bags, size, key=key, value="tf").select("features").persist()
    try:
        model = LDA(
            k=k, maxIter=max(1, round(passes / subsampling)), optimizer="online", subsamplingRate=subsampling, seed=seed
        ).fit(vectors)
    finally:
        vectors.unpersist()
    described = model.describeTopics(n_words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("_i", "_e"))
    return described.join(dictionary, F.col("_e.termIndices") == F.col("term_id")).select(
        "topic", (F.col("_i") + 1).alias("rank"), "term", F.col("_e.termWeights").alias("weight")
    )
