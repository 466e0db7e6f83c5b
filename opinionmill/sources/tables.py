"""Reading and writing tables and models. Every write overwrites, so stages can be rerun."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

SPLITS = ("train", "val", "test")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | str | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.parquet(path)
    return path


SPREAD_SPLITS = 8


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A stored table. With ``spread_by`` a table of at most ``SPREAD_SPLITS`` scan tasks, fewer than
    there are cores, is repartitioned by that key: no more than that many splits' bytes move."""
    table = spark.read.parquet(path)
    if not spread_by:
        return table
    splits, cores = table.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    return table.repartition(cores, spread_by) if splits < min(cores, SPREAD_SPLITS + 1) else table


def write_splits(df: DataFrame, path: str) -> str:
    """One folder per split below ``path``, so reading a split prunes the others."""
    return write_table(df, path, "split")


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return spark.read.parquet(path).where(f"split = '{split}'")


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
