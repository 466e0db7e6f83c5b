"""Joins, ranks and numbering that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from opinionmill.session import checkpoint

MAX_BROADCAST_ROWS = 500_000
MAX_LOCAL_ROWS = 100_000
MAX_HOT_KEYS = 10_000
MAX_KNOWN_WORDS = 10_000
PART_ROWS = 1024


_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows written in code, as a relation the planner knows the size of; plain columns only."""
    fields = T.StructType.fromDDL(schema)
    columns = [[row[i] for row in rows] for i in range(len(fields))]
    arrays = [pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=fields.names), schema=fields)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


def as_small(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> DataFrame | None:
    """The rows of an aggregate as a local table, or None when there are more than ``max_rows``."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def exploded(df: DataFrame, keep: Sequence[str], array: Column | str, name: str) -> DataFrame:
    """One row per array element, null elements and empty arrays dropped.

    The outer form is used on purpose: for the inner one the optimizer derives a "not empty"
    filter and pushes it to the scan, where it would compute the array a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def by_key(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Partition by ``key`` so that later steps per key need no shuffle.

    ``rows`` says how many rows ``df`` has: partitions then hold about ``PART_ROWS`` each, however long the
    table is, for steps that make many rows of one. Otherwise adaptive execution sets their number by their bytes.
    """
    if rows is None:
        return df.repartition(key)
    return df.repartition(max(-(-rows // PART_ROWS), df.sparkSession.sparkContext.defaultParallelism), key)


def few_parts(df: DataFrame) -> DataFrame:
    """``df`` in one partition per core at most, without a shuffle: for steps whose every task sends a vector as
    long as the vocabulary, however few rows it has read."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, 1))


def settled(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> tuple[DataFrame, bool]:
    """An aggregate computed once: as a local table when it is small (True), else stored."""
    local = as_small(df, max_rows)
    return (checkpoint(df), False) if local is None else (local, True)


def known_words(lookup: DataFrame, word: str, max_words: int = MAX_KNOWN_WORDS) -> list[str] | None:
    """The distinct words of a lookup table, to tell hits from other words before rows are made of them; None when there
    are more than ``max_words``."""
    rows = lookup.where(F.col(word).isNotNull()).select(word).distinct().limit(max_words + 1).toArrow()
    return None if rows.num_rows > max_words else rows.column(0).to_pylist()


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    max_hot: int = MAX_HOT_KEYS,
    small: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join a large table to a lookup table by equal keys (null equals null).

    ``small`` says that the lookup's size was checked already. A lookup of at most ``max_rows`` rows is broadcast. A longer one is joined by shuffle,
    except for the hot keys: those holding more than 1/``max_hot`` of the rows of ``big``.
    There can be no more than ``max_hot`` of them, so their lookup rows are broadcast and
    no reducer receives one key's whole share. ``hot`` names those keys where they are known
    already (at most ``max_hot``); otherwise ``big`` is read once more to count them.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if small or fits(lookup, max_rows):
        return _join(big, F.broadcast(lookup), keys, how)

    if hot is None:
        total = big.count()
        counted = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        hot = counted.where(F.col("_n") * max_hot > total)
    hot = as_small(hot.select(*keys, F.lit(True).alias("_hot")), max_hot)
    if hot is None:
        raise ValueError(f"more than {max_hot} hot keys were named")
    marked = _join(big, F.broadcast(hot), keys, "left")
    hot_lookup = _join(lookup, F.broadcast(hot.drop("_hot")), keys, "left_semi")
    if fits(hot_lookup, max_rows):
        hot_lookup = F.broadcast(hot_lookup)
    cold = _join(marked.where(F.col("_hot").isNull()), lookup, keys, how)
    warm = _join(marked.where(F.col("_hot").isNotNull()), hot_lookup, keys, how)
    return cold.unionByName(warm).drop("_hot")


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    condition = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_r_{key}")) for key in keys])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{key}" for key in keys])


def top_k_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: str = "doc_id",
    rank: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """The first ``k`` rows of every group, numbered from 1.

    Ranks inside (group, salt) first, then among the at most ``k * salts`` survivors of a
    group, so a group with a large share of the rows never meets one task. Catalyst cuts each
    map task's output to ``k`` rows per window key before either shuffle.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)))
    first = Window.partitionBy(*groups, "_salt").orderBy(*order)
    kept = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k).drop("_rn", "_salt")
    last = Window.partitionBy(*groups).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= k)


def sorted_table(df: DataFrame, *order: str) -> DataFrame:
    """``df`` range-sorted and written to the checkpoint folder, so its partitions are fixed."""
    return checkpoint(df.orderBy(*order))


def number_rows(stored: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Number the rows of a ``sorted_table`` consecutively in its order, without a global window.

    Row position inside a stored partition plus the size of the partitions before it; only
    the table of partition sizes is ranked as a whole.
    """
    tagged = stored.withColumn("_place", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftrightunsigned("_place", 33)).withColumn(
        "_place", F.col("_place").bitwiseAND((1 << 33) - 1)
    )
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # One row per partition: the scheduler's own limit bounds it.
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_place") + F.lit(start))
        .drop("_part", "_place", "_before")
    )
