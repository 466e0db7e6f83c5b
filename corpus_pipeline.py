"""From raw documents to packed training sequences in five stages.

Every stage takes the documents that its predecessor kept. All but the last return the columns of
``documents``; the last returns the pieces of all documents with their places in sequences.

Cases, for every stage: null and empty texts and null sources are rows like others (the quality rules
reject texts without words); rows without a doc_id are kept by the near-duplicate and passage stages,
which cannot name them; repeated rows become one in the near-duplicate stage; rows of one id with
different texts all stay; texts of any length are read whole; columns beyond those of ``documents``,
whatever their names, pass unchanged up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinionmill.llm import mixing, neardup, packing, quality, substrings
from opinionmill.llm.storage import quoted, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and all rules of the table."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies."""
    return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the windows of words that a document with a smaller id holds."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.lit(True).alias("_"), *map(quoted, others)).alias("_rest")
    found = substrings.remove_repeats(docs.select("doc_id", "text", rest))
    changed = F.col("n_removed") > 0
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(f"_rest.{quoted(c)}") for c in others}
    if "n_chars" in own:
        own["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(own["n_chars"])
    return found.select(*[own[c].alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights takes them."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixed sources", mixed_sources),
    ("packed sequences", packed_sequences),
]

#: The near-duplicate, mixing and packing stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
