"""Exact, seeded samples and splits that do not depend on partitioning.

Rows are ordered by ``md5(seed:doc_id)``; a sample is the first so many rows of each stratum.
Instead of ranking the table, the key at which each stratum has to be cut is found: counts per
key prefix locate the one prefix that holds the cut, and only the rows with that prefix are
ranked. Selecting the rows is then a comparison with a broadcast cut key: the documents
themselves are never shuffled. The key column must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.operators.relational import lookup_join, settled
from opinionmill.session import SEED, checkpoint

PREFIX_DIGITS = 4  # 65,536 key prefixes per stratum
_EXACT = "decimal(38,0)"


def sample_key(seed: int = SEED, key: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _strata(df: DataFrame, strata: Sequence[str] | str | None) -> tuple[DataFrame, list[str]]:
    if not strata:
        return df.withColumn("_all", F.lit(0)), ["_all"]
    return df, [strata] if isinstance(strata, str) else list(strata)


def _prefix_counts(df: DataFrame, strata: list[str], seed: int, key: str) -> DataFrame:
    prefix = F.substring(sample_key(seed, key), 1, PREFIX_DIGITS).alias("_prefix")
    return checkpoint(df.groupBy(*strata, prefix).agg(F.count(F.lit(1)).alias("_n")))


def _class_sizes(counts: DataFrame, strata: list[str]) -> DataFrame:
    return settled(counts.groupBy(*strata).agg(F.sum("_n").alias("_size")))[0]


def _quota(sizes: DataFrame, strata: list[str], n: int, total: int, size: str, name: str) -> DataFrame:
    """Largest-remainder shares of ``n`` seats; equal remainders go by stratum order."""
    seats = F.lit(n).cast("decimal(19,0)") * F.col(size).cast("decimal(19,0)")
    shares = sizes.withColumns(
        {
            "_base": F.floor(seats.cast(_EXACT) / F.lit(total)).cast("long"),
            "_rest": (seats.cast(_EXACT) % F.lit(total).cast(_EXACT)).cast("long"),
        }
    )
    # One row per stratum.
    everything = Window.partitionBy(F.lit(0))
    ranked = shares.withColumns(
        {
            "_open": F.lit(n) - F.sum("_base").over(everything),
            "_turn": F.row_number().over(everything.orderBy(F.desc("_rest"), *strata)),
        }
    )
    extra = (F.col("_turn") <= F.col("_open")).cast("long")
    return ranked.withColumn(name, F.col("_base") + extra).drop("_base", "_rest", "_open", "_turn")


def _cut_keys(
    df: DataFrame, counts: DataFrame, ranks: DataFrame, strata: list[str], names: list[str], seed: int, key: str
) -> DataFrame:
    """Per stratum, the key of the row with each of the ranks in columns ``names``; '' for rank 0."""
    upto = Window.partitionBy(*strata).orderBy("_prefix")
    running = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_before", F.col("_upto") - F.col("_n"))
    wanted = ranks.unpivot(strata, names, "_cut", "_rank")
    wanted_keys = [F.col(f"c.{s}").eqNullSafe(F.col(f"w.{s}")) for s in strata]
    on = (F.col("w._rank") > F.col("c._before")) & (F.col("w._rank") <= F.col("c._upto"))
    for condition in wanted_keys:
        on = on & condition
    edge = running.alias("c").join(wanted.alias("w"), on).select(
        *[F.col(f"c.{s}").alias(s) for s in strata],
        F.col("c._prefix").alias("_prefix"),
        F.col("w._cut").alias("_cut"),
        (F.col("w._rank") - F.col("c._before")).alias("_need"),
    )
    keyed = df.select(*strata, sample_key(seed, key).alias("_key")).withColumn(
        "_prefix", F.substring("_key", 1, PREFIX_DIGITS)
    )
    edge, small = settled(edge)
    near = lookup_join(keyed, edge, [*strata, "_prefix"], "inner", small=small)
    order = Window.partitionBy(*strata, "_cut").orderBy("_key")
    found = near.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == F.col("_need"))
    cuts = found.groupBy(*strata).pivot("_cut", names).agg(F.first("_key"))
    every = _join_all(ranks.select(*strata), cuts, strata)
    return every.select(*strata, *[F.coalesce(F.col(n), F.lit("")).alias(f"_key_{n}") for n in names])


def _join_all(left: DataFrame, right: DataFrame, strata: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({s: f"_r_{s}" for s in strata})
    on = F.lit(True)
    for s in strata:
        on = on & F.col(s).eqNullSafe(F.col(f"_r_{s}"))
    return left.join(renamed, on, "left").drop(*[f"_r_{s}" for s in strata])


def _attach(df: DataFrame, cuts: DataFrame, strata: list[str]) -> DataFrame:
    cuts, small = settled(cuts)
    return lookup_join(df, cuts, strata, "inner", small=small)


def _totals(sizes: DataFrame) -> tuple[int, int, int]:
    row = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.min("_size"), F.lit(0))).first()
    return int(row[0]), int(row[1]), int(row[2])


def _check(n: int, total: int, classes: int, smallest: int) -> None:
    if n < 1 or n >= total:
        raise ValueError(f"sample size {n} must be between 1 and {total - 1}")
    if smallest < 2:
        raise ValueError("a stratum with one member cannot be stratified")
    if n < classes or total - n < classes:
        raise ValueError(f"both sides need at least {classes} rows, one per stratum")


def stratified_sample(df: DataFrame, n: int, strata: Sequence[str] | str = "label", seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Exactly ``n`` rows, every stratum at its share, without replacement."""
    columns = df.columns
    df, strata = _strata(df, strata)
    counts = _prefix_counts(df, strata, seed, key)
    sizes = _class_sizes(counts, strata)
    total, classes, smallest = _totals(sizes)
    _check(n, total, classes, smallest)
    ranks = _quota(sizes, strata, n, total, "_size", "take")
    cuts = _cut_keys(df, counts, ranks, strata, ["take"], seed, key)
    return _attach(df, cuts, strata).where(sample_key(seed, key) <= F.col("_key_take")).select(*columns)


def stratified_split(
    df: DataFrame,
    fractions: tuple[float, float, float] = (0.8, 0.1, 0.1),
    strata: Sequence[str] | str = "label",
    seed: int = SEED,
    key: str = "doc_id",
) -> DataFrame:
    """Add ``split``: two chained stratified splits, hold-out first, then validation | test.

    The side split off has ``ceil(fraction * N)`` rows; quotas are taken for the side kept.
    """
    train, val, test = (Fraction(str(f)) for f in fractions)
    if train + val + test != 1 or min(train, val, test) <= 0:
        raise ValueError("three positive fractions that add up to one are needed")
    columns = df.columns
    df, strata = _strata(df, strata)
    counts = _prefix_counts(df, strata, seed, key)
    sizes = _class_sizes(counts, strata)
    total, classes, smallest = _totals(sizes)
    held = math.ceil((val + test) * total)
    _check(total - held, total, classes, smallest)
    tested = math.ceil(test / (val + test) * held)
    ranks = _quota(sizes, strata, total - held, total, "_size", "train")
    ranks, _ = settled(ranks.withColumn("_held", F.col("_size") - F.col("train")))
    least_held = ranks.agg(F.min("_held")).first()[0]
    _check(held - tested, held, classes, least_held)
    ranks = _quota(ranks, strata, held - tested, held, "_held", "_val")
    ranks = ranks.withColumn("val", F.col("train") + F.col("_val"))
    cuts = _cut_keys(df, counts, ranks, strata, ["train", "val"], seed, key)
    place = sample_key(seed, key)
    split = (
        F.when(place <= F.col("_key_train"), "train").when(place <= F.col("_key_val"), "val").otherwise("test")
    )
    return _attach(df, cuts, strata).select(*columns, split.alias("split"))


def sample_n(df: DataFrame, n: int, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Exactly ``n`` rows of the whole table."""
    columns = df.columns
    df, strata = _strata(df, None)
    counts = _prefix_counts(df, strata, seed, key)
    sizes = _class_sizes(counts, strata)
    total, _, _ = _totals(sizes)
    if n < 1 or n > total:
        raise ValueError(f"sample size {n} must be between 1 and {total}")
    ranks = sizes.select(*strata, F.lit(n).cast("long").alias("take"))
    cut = _cut_keys(df, counts, ranks, strata, ["take"], seed, key).first()["_key_take"]
    return df.where(sample_key(seed, key) <= F.lit(cut)).select(*columns)


def under_sample(df: DataFrame, label: str = "label", seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Every class cut down to the size of the smallest."""
    columns = df.columns
    df, strata = _strata(df, label)
    counts = _prefix_counts(df, strata, seed, key)
    sizes = _class_sizes(counts, strata)
    _, _, smallest = _totals(sizes)
    ranks = sizes.select(*strata, F.lit(smallest).cast("long").alias("take"))
    cuts = _cut_keys(df, counts, ranks, strata, ["take"], seed, key)
    return _attach(df, cuts, strata).where(sample_key(seed, key) <= F.col("_key_take")).select(*columns)


def fraction_sample(
    df: DataFrame, fractions: Mapping[object, float], label: str = "label", seed: int = SEED, key: str = "doc_id"
) -> DataFrame:
    """About the given share of each class in one narrow pass; sizes are not exact. A row is in when
    the first 32 bits of its sample key lie below the share, whatever the partitioning."""
    place = F.conv(F.substring(sample_key(seed, key), 1, 8), 16, 10).cast("long")
    limit = F.lit(None).cast("double")
    for value, share in fractions.items():
        limit = F.when(F.col(label) == F.lit(value), F.lit(float(share))).otherwise(limit)
    return df.where(place < limit * F.lit(float(1 << 32)))
