"""Lexicon expansion: scores of a few seed words spread over a graph of related words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opinionmill.operators.relational import lookup_join, top_k_per_group
from opinionmill.session import checkpoint


def relation_graph(matrix: DataFrame, k: int = 10) -> DataFrame:
    """``a, b, share``: each word with its ``k`` most related ones and those that name it among theirs.

    ``matrix`` holds ``a, b, pmi`` both ways. ``share`` is the part of the word's relatedness that an edge has.
    """
    rated = matrix.where("a <> b").withColumn("pmi", F.round("pmi", 9))
    near = checkpoint(top_k_per_group(rated, ["a"], [F.desc("pmi"), F.col("b")], k, spread="b").select("a", "b", "pmi"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "pmi")).groupBy("a", "b").agg(F.max("pmi").alias("pmi"))
    both = checkpoint(both)
    sums = both.groupBy("a").agg(F.sum("pmi").alias("_s"))
    return checkpoint(lookup_join(both, sums, "a", "inner").select("a", "b", (F.col("pmi") / F.col("_s")).alias("share")))


def expand_lexicon(graph: DataFrame, seeds: DataFrame, restart: float = 0.3, tol: float = 1e-4, max_rounds: int | None = None) -> DataFrame:
    """``word, score``: a signed random walk with restart from the seeds (``word, score``).

    Every round a word passes the rest of its score on along its edges and a seed gets ``restart`` times its
    own anew, until no score changes by more than ``tol`` (or ``max_rounds`` are over). The change shrinks
    at least by ``1 - restart`` a round, so that takes log(tol) / log(1 - restart) rounds at most.
    """
    known = checkpoint(seeds.groupBy("word").agg(F.sum(F.col("score").cast("double")).alias("seed")))
    scores, rounds = known.select("word", F.col("seed").alias("score")), 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        moved = lookup_join(graph, scores.select(F.col("word").alias("a"), "score"), "a", "inner")
        passed = moved.groupBy(F.col("b").alias("word")).agg(F.sum(F.col("score") * F.col("share")).alias("_in"))
        new = passed.join(known, "word", "full").select(
            "word", (F.lit(1 - restart) * F.coalesce("_in", F.lit(0.0)) + F.lit(restart) * F.coalesce("seed", F.lit(0.0))).alias("score")
        )
        before = scores.select(F.col("word").alias("_w"), F.col("score").alias("_old"))
        new = checkpoint(new.join(before, F.col("word") == F.col("_w"), "left").withColumn("_change", F.abs(F.col("score") - F.coalesce("_old", F.lit(0.0)))))
        scores = new.select("word", "score")
        if max_rounds is None and (new.agg(F.max("_change")).first()[0] or 0.0) <= tol:
            break
    return scores
