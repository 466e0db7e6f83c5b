"""Reading review files and lexicon files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

REVIEW_SCHEMA = "polarity long, title string, text string"
LEXICON_SCHEMA = "word string, emotion string, value double"


CSV_OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
_COMPLETE, _HEAD, _WHOLE, _TAIL = range(4)


def read_reviews(spark: SparkSession, path: str | Sequence[str], keep_corrupt: bool = False) -> DataFrame:
    """A CSV without header line, in the order polarity, title, text, quotes doubled.

    Line ends inside quotes stay in the text, and a large file is still read in splits: see
    ``read_records``. ``keep_corrupt`` adds ``_corrupt_record``, null for well-formed rows. Parsing
    is worth doing once; convert to parquet, then read that.
    """
    records = read_records(spark, path)
    schema = REVIEW_SCHEMA + ", _corrupt_record string"
    parsed = records.select(F.from_csv("record", schema, CSV_OPTIONS).alias("row")).select("row.*")
    return parsed if keep_corrupt else parsed.drop("_corrupt_record")


def read_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The records of CSV files as one string column ``record``, line ends inside quotes kept.

    A line begins inside quotes when the lines before it in its file hold an odd number of quote
    characters. One aggregate counts the quotes of every split, a running sum over that table (one
    row per split) says how each split begins, and each task puts its own records together. Only
    the at most two fragments that a split has at its borders are joined across splits. A quote
    inside an unquoted field breaks the count; the rows behind it come out as corrupt.
    """
    lines = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    lines = lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # One row per input split: the scheduler's own limit bounds it.
    placed = lines.join(F.broadcast(opened), ["file", "start"])
    parts = placed.select("value", "file", "start", "inside").mapInArrow(_assemble, "file long, start long, kind int, record string")
    whole = parts.where(F.col("kind") == _COMPLETE).select("record")
    cut = parts.where(F.col("kind") != _COMPLETE)
    order = Window.partitionBy("file").orderBy("start", "kind")
    cut = cut.withColumn("n", F.sum(F.when(F.col("kind") == _TAIL, 1).otherwise(0)).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("start", "kind", "record")))
    joined = cut.groupBy("file", "n").agg(F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record"))
    record = F.regexp_replace("record", "\r$", "")
    return whole.unionByName(joined.select("record")).select(record.alias("record")).where("record <> ''")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole splits, in order, to records and border fragments."""
    split, open_, kind = None, [], _COMPLETE

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
        return pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "record"])

    def border() -> list[tuple]:
        # What is open at a split's end: the rest of a record, or all of the split inside one.
        return [(*split, _WHOLE if kind == _HEAD else _TAIL, "\n".join(open_))] if open_ else []

    for batch in batches:
        out: list[tuple] = []
        values = batch.column("value")
        odd = pc.bit_wise_and(pc.count_substring(values, '"'), 1).to_pylist()
        columns = (values.to_pylist(), odd, *(batch.column(c).to_pylist() for c in ("file", "start", "inside")))
        for value, flips, file, start, inside in zip(*columns):
            if (file, start) != split:
                out += border()
                split, open_, kind = (file, start), [], _HEAD if inside else _COMPLETE
            was_open = bool(open_) or kind == _HEAD
            if was_open != bool(flips):
                open_.append(value)
            elif was_open:
                out.append((file, start, kind, "\n".join([*open_, value])))
                open_, kind = [], _COMPLETE
            else:
                out.append((file, start, kind, value))
        yield rows(out)
    yield rows(border())


def locate_reviews(spark: SparkSession, root: str, name: str = "train.csv", folders: Sequence[str] = ()) -> str:
    """Path of ``name``: in ``root`` itself, then in ``folders`` below it, else the first match
    of a recursive search in path order. No match is an error."""
    try:
        listing = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
        )
        base = root.rstrip("/")
        preferred = [f"{base}/{name}", *[f"{base}/{folder}/{name}" for folder in folders]]
        # Only names are read. The first preferred path wins, then the smallest of all.
        rank = F.lit(len(preferred))
        for i, candidate in reversed(list(enumerate(preferred))):
            path = F.col("path")
            rank = F.when((path == candidate) | path.endswith(":" + candidate) | path.endswith("://" + candidate), i).otherwise(rank)
        row = listing.agg(F.min(F.struct(rank.alias("rank"), "path")).alias("best")).first()
    except AnalysisException as error:
        raise FileNotFoundError(f"no {name} below {root}") from error
    if row["best"] is None:
        raise FileNotFoundError(f"no {name} below {root}")
    return row["best"]["path"]


def corrupt_count(reviews: DataFrame) -> DataFrame:
    """``(rows, corrupt)`` of a frame read with ``keep_corrupt``."""
    # The reader refuses to parse for the corrupt column alone, so a data column is counted too.
    first = F.col(reviews.columns[0])
    return reviews.agg(
        (F.count(first) + F.count_if(first.isNull())).alias("rows"),
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("corrupt"),
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``word, emotion, value`` without header; a missing file is an empty lexicon."""
    try:
        return spark.read.schema(LEXICON_SCHEMA).option("sep", "\t").option("quote", "").csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEXICON_SCHEMA)
