"""Row cleaning, identity and column assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opinionmill.functions.text import clean_text, raw_text

COPIES_PER_TASK = 100_000


def drop_incomplete(df: DataFrame, columns: Sequence[str] = ("polarity", "text")) -> DataFrame:
    return df.dropna(subset=list(columns))


def with_review(df: DataFrame, title: str = "title", text: str = "text", polarity: str | None = "polarity") -> DataFrame:
    """Add ``raw``, ``review`` and, given a polarity column (1 or 2), ``label`` (0 or 1)."""
    out = df.withColumn("raw", raw_text(title, text)).withColumn("review", clean_text("raw"))
    return out.withColumn("label", F.col(polarity) - 1) if polarity else out


def assign_doc_id(df: DataFrame, columns: Sequence[str], name: str = "doc_id", chunk: int = COPIES_PER_TASK) -> DataFrame:
    """A key that depends on content only: hash of ``columns`` plus a copy number.

    Rows are counted per distinct content first, so a heavily copied text crosses the network
    once per task and not once per copy; long runs of copies are numbered chunk by chunk on
    different tasks. Only ``columns`` are kept, since rows equal in them are interchangeable.
    """
    columns = list(columns)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(chr(2))) for c in columns]
    digest = F.md5(F.concat_ws(chr(1), *parts))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_digest", digest)

    def numbered(part: DataFrame, first, last) -> DataFrame:
        copies = part.withColumn("_copy", F.explode(F.sequence(first, last)))
        key = F.concat_ws("-", "_digest", F.col("_copy").cast("string"))
        return copies.select(key.alias(name), *columns)

    one = F.lit(1).cast("long")
    few = numbered(counted.where(F.col("_copies") <= chunk), one, F.col("_copies"))
    many = counted.where(F.col("_copies") > chunk)
    many = many.withColumn("_from", F.explode(F.sequence(one, F.col("_copies"), F.lit(chunk).cast("long"))))
    many = many.repartition("_digest", "_from")
    last = F.least(F.col("_from") + (chunk - 1), F.col("_copies"))
    return few.unionByName(numbered(many, F.col("_from"), last))
