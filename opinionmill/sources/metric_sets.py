"""Metric sets as JSON rows, one folder ``metric_set=<name>`` per set."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def save_metrics(df: DataFrame, root: str, metric_set: str) -> str:
    """Replace one set; other sets below ``root`` stay."""
    path = f"{root.rstrip('/')}/metric_set={metric_set}"
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def load_metrics(spark: SparkSession, root: str) -> DataFrame:
    """All sets as one table with the column ``metric_set``; fields a set lacks are null."""
    return spark.read.option("basePath", root).json(f"{root.rstrip('/')}/metric_set=*")


def load_metric_set(spark: SparkSession, root: str, metric_set: str) -> DataFrame | None:
    """One set with its own columns, or None when it was never written."""
    try:
        return spark.read.json(f"{root.rstrip('/')}/metric_set={metric_set}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def load_metric_documents(spark: SparkSession, root: str, prefix: str = "metrics_") -> DataFrame:
    """Hand-written documents ``<prefix><name>.json``: ``(metric_set, document)`` with the whole
    file as text, so sets of different shape share one table."""
    files = spark.read.text(f"{root.rstrip('/')}/{prefix}*.json", wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), rf"^{prefix}|\.json$", "")
    return files.select(name.alias("metric_set"), F.col("value").alias("document"))
