"""Mixing sources to target weights by the cube method.

Every document of a source is wanted ``target / size of the source`` times. The whole part is taken
for sure; the fraction is an inclusion probability. The cube method moves these probabilities along
the null space of the balancing constraints (number of documents and number of words) until each is
0 or 1 but for at most as many as there are constraints. This runs in shards of bounded size, so a
source that holds most rows is many tasks. A shard lands its few undecided documents itself: it takes
those that come nearest to the shard's goal and makes up for the rest with as few decided documents
as it can, so the errors of shards stay at a few words and do not depend on a long document. Only
(source, doc_id, size) rows are shuffled, never texts.

Cases: null text has size 0; a null source is a source of its own, last in order; a source whose
size is 0 gets target 0; repeated rows are decided each for itself; an empty table gives an empty
result; other columns, whatever their names, are ignored or passed on unchanged; rows of one id (or
without one) are spread by their texts, so only equal rows of one source share a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.llm.quality import words_of
from opinionmill.llm.storage import quoted, stored
from opinionmill.operators.relational import number_rows, sorted_table

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SHARD_ROWS = 2048
MOST_TASKS = 10_000
_EPS = 1e-9


def text_size(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from rows of ``source, size``.

    The total of all sizes is shared by weight; a share stops at ``most`` times the source's size and
    the excess is shared again among the others. Each round is one small aggregate of the table of
    sources, and only sums come to the driver, so the number of sources is not bounded.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ordered = sorted_table(totals.withColumn("_last", F.col("source").isNull()), "_last", "source")
    numbered = number_rows(ordered, "_n").drop("_last")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    table = stored(numbered.withColumn("_w", cycle), "sources")
    share = F.lit(float("inf"))
    total, cap = table.agg(F.sum("source_size")).first()[0] or 0, F.lit(float(most)) * F.col("source_size")
    capped_before = -1
    while True:
        full = cap <= share * F.col("_w") if capped_before >= 0 else F.lit(False)
        row = table.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == capped_before or not row["open"]:
            break
        capped_before = row["n"]
        share = F.lit((total - row["taken"]) / row["open"])
    return table.select("source", "source_size", "n_docs", F.least(cap, share * F.col("_w")).alias("target"))


def flight(pi: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: 0 or 1 but for at most ``balance.shape[1]`` of them.

    ``balance`` has one row per document; its column sums, weighted by ``pi``, stay as they are. Only
    one document more than there are constraints is held at a time, so the cost is linear.
    """
    pi, k = pi.copy(), balance.shape[1]
    undecided = [i for i in range(len(pi)) if _EPS < pi[i] < 1 - _EPS]
    held, at = undecided[: k + 1], k + 1
    while len(held) > k:
        rows = balance[held]
        direction = np.linalg.svd(rows.T, full_matrices=True)[2][-1]
        p = pi[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(direction > _EPS, (1 - p) / direction, np.where(direction < -_EPS, -p / direction, np.inf)).min()
            down = np.where(direction > _EPS, p / direction, np.where(direction < -_EPS, (p - 1) / direction, np.inf)).min()
        p = p + direction * (up if rng.random() * (up + down) < down else -down)
        p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
        pi[held] = p
        held = [i for i, v in zip(held, p) if 0 < v < 1]
        while len(held) <= k and at < len(undecided):
            held.append(undecided[at])
            at += 1
        if len(held) <= k:
            break
    return pi


def land(pi: np.ndarray, size: np.ndarray, goal: float) -> np.ndarray:
    """All of ``pi`` decided, with a number of words near ``goal``.

    The few open documents go where the words come nearest to the goal. While a decided document
    turned over would bring them nearer, the one that does so best is turned over.
    """
    pi = pi.copy()
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    sure = float(size[pi == 1].sum())
    choices = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    miss = np.abs(sure + choices @ size[open_] - goal)
    pi[open_] = choices[np.lexsort((choices.sum(axis=1), miss))[0]]
    while True:
        error = goal - float(size[pi == 1].sum())
        able = np.flatnonzero((pi == (0 if error > 0 else 1)) & (size > 0) & (size < 2 * abs(error) - _EPS))
        if not len(able):
            return pi
        best = able[np.abs(size[able] - abs(error)).argmin()]
        pi[best] = 1 - pi[best]


def decider(seed: int):
    """The function that flies and lands one shard of one source."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "doc_id", "_mark"], ascending=[False, True, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, int(part["_key"].iloc[0]) & 0x7FFFFFFF])
        pi, size = part["_pi"].to_numpy(dtype=float), part["size"].to_numpy(dtype=float)
        balance = np.stack([np.ones(len(pi)), size / max(size.max(), 1.0)], axis=1)
        return part.assign(_pi=land(flight(pi, balance, rng), size, float(pi @ size)))

    return run


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = 42, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row of ``docs``."""
    text = F.col("text").cast("string")
    sizes = docs.select(F.col("doc_id").cast("long"), "source", text_size(text).alias("size"), F.xxhash64(text).alias("_mark"))
    sizes = stored(sizes, "sizes")
    targets = source_targets(sizes, weights, most)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(wanted + _EPS)
    # One row per source: equal null sources meet through the null-safe comparison.
    named = targets.withColumnRenamed("source", "_source")
    rows = (
        sizes.join(named, sizes["source"].eqNullSafe(named["_source"]), "left")
        .withColumn("copies", whole.cast("int"))
        .withColumn("_pi", F.greatest(wanted - whole, F.lit(0.0)))
        .withColumn("_parts", F.ceil(F.col("n_docs") / F.lit(shard_rows)).cast("long"))
        .drop("_source")
    )
    # Equal or null ids are spread by their texts; only rows equal in both share a shard for sure.
    part = F.pmod(F.xxhash64("doc_id", "_mark"), F.col("_parts"))
    rest = rows.where(F.col("_pi") > _EPS)
    rest = rest.withColumn("_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), part))
    # The rows are small but their decisions are not: as many tasks as shards, not as bytes suggest.
    shards = targets.agg(F.sum(F.ceil(F.col("n_docs") / F.lit(shard_rows)))).first()[0] or 1
    flown = rest.repartition(int(min(shards, MOST_TASKS)), "_key").groupBy("_key").applyInPandas(decider(seed), rest.schema)
    out = rows.where(F.col("_pi") <= _EPS).withColumn("_pi", F.lit(0.0)).unionByName(flown.drop("_key"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.col("_pi").cast("int")).alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Decisions meet their documents by two 64-bit hashes of (doc_id, source); repeated rows take one
    decision each. The second hash and the row's number are compared behind the join, so the texts
    are shuffled once, for the numbering and the join together.
    """

    def marked(rows: DataFrame, order: Column, *names: str) -> DataFrame:
        source, doc_id = F.coalesce("source", F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
        parts = (doc_id, F.col("doc_id").isNull(), source, F.col("source").isNull())
        rows = rows.withColumns({names[0]: F.xxhash64(*parts), names[1]: F.xxhash64(F.lit(1), *parts)})
        return rows.withColumn(names[2], F.row_number().over(Window.partitionBy(names[0]).orderBy(names[1], order)))

    decided = marked(mix(docs, **options), F.col("copies"), "_key", "_check", "_number")
    decided = decided.select("_key", "_check", "_number", F.col("copies").alias("_copies"))
    # The user's row is kept apart, so no name in it can clash.
    order = F.col("n_chars") if "n_chars" in docs.columns else F.lit(1)
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "doc_id", "source", order.alias("order"))
    rows = marked(rows, F.col("order"), "_own", "_own_check", "_own_number")
    same = (F.col("_check").bitwiseXOR(F.col("_own_check")) == 0) & (F.col("_number") - F.col("_own_number") == 0)
    joined = rows.join(decided, (F.col("_own") == F.col("_key")) & same).where("_copies > 0")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
