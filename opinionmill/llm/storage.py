"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from opinionmill.session import ensure_checkpoint_dir


def quoted(name: str) -> str:
    """A column name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a like one that is no column of ``docs``."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def set_apart(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs`` but ``text``, so that no name in it can clash) and ``text``."""
    others = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    return docs.select(F.struct(F.lit(True).alias("_"), *others).alias("row"), F.col("text"))


def put_back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``row`` and ``text``, in their order, and then the other columns of ``found``."""
    own = [F.col("text") if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns]
    return found.select(*own, *[c for c in found.columns if c not in ("row", "text")])


def with_fields(schema: T.StructType, fields: str) -> T.StructType:
    """``schema`` and further fields given as DDL; names of ``schema`` need no quotes."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(fields).fields])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back.

    The lineage ends at the files, so a lost executor costs a reread, not a recomputation. Column
    pruning works on the result, unlike on a checkpoint.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
