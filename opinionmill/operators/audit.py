"""Corpus audit: counts, nulls, lengths, summary statistics, histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opinionmill.functions.text import char_count, word_count
from opinionmill.operators.relational import settled

STATISTICS = ("count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(column)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def null_counts(df: DataFrame) -> DataFrame:
    """One pass over all columns, as ``(column, null_count)``."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "null_count")


def lengths(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Add ``title_len``, ``text_len`` (characters) and ``text_words``."""
    return df.withColumns(
        {"title_len": char_count(title), "text_len": char_count(text), "text_words": word_count(text, "space")}
    )


def describe(df: DataFrame, columns: Sequence[str], approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Summary statistics of several columns in one aggregate, as ``(column, statistic, value)``.

    Quartiles are exact and interpolated. The exact form keeps a count per distinct value, fine
    for lengths and rounded scores; ``approx`` has bounded memory for anything else.
    """
    levels = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    aggregates = []
    for c in columns:
        value = F.col(c).cast("double")
        quartiles = F.percentile_approx(value, levels, accuracy) if approx else F.percentile(value, levels)
        aggregates.append(
            F.struct(
                F.count(value).cast("double"),
                F.count_if(value.isNull()).cast("double"),
                F.avg(value),
                F.stddev_samp(value),
                F.min(value),
                F.get(quartiles, F.lit(0)),
                F.get(quartiles, F.lit(1)),
                F.get(quartiles, F.lit(2)),
                F.max(value),
            ).alias(c)
        )
    wide = df.agg(*aggregates)
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(name).alias("statistic"), F.col(f"`{c}`.col{i + 1}").alias("value"))
        for c in columns
        for i, name in enumerate(STATISTICS)
    ]
    return wide.select(F.inline(F.array(*entries)))


def histogram(df: DataFrame, column: str, bins: int = 60, cap: float | None = None) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and largest (capped) value.

    The largest value belongs to the last bin. Empty bins are listed with zero. Values are
    counted per distinct value first, in the only pass over the data.
    """
    value = F.col(column).cast("double")
    value = F.least(value, F.lit(float(cap))) if cap is not None else value
    distinct = df.select(value.alias("_x")).where(F.col("_x").isNotNull()).groupBy("_x").agg(
        F.count(F.lit(1)).alias("_n")
    )
    distinct, _ = settled(distinct)
    low, high = distinct.agg(F.min("_x"), F.max("_x")).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, bin_from double, bin_to double, count long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col("_x") - F.lit(low)) / F.lit(width)).cast("int") + 1, F.lit(bins))
    counts = distinct.groupBy(place.alias("bin")).agg(F.sum("_n").alias("_count"))
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("bin_from"),
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_to"),
        F.coalesce("_count", F.lit(0)).cast("long").alias("count"),
    )
