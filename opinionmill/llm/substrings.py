"""Removal of long word sequences that a document with a smaller id has too.

Every window of ``width`` words gets a Rabin-Karp hash. A task sends its windows to shards by hash,
as one compressed block per shard, not as one row per window. A shard finds the smallest document of
every hash and returns, per document, the windows that another document owns. Per document these
merge into maximal intervals of words, which are removed. Windows are judged on the input alone.

Of the hash 56 bits are sent and the shard number is log2(shards) more, at least 62 together and more
for a larger corpus; two given windows that differ share all with probability below 2^-62.

Cases: a null or empty text has no words; a text shorter than a window keeps all its words; words
are compared unchanged; a null doc_id owns nothing and loses nothing; rows of one doc_id, with equal or
different texts, count as one document towards others and lose nothing to each other; other columns,
whatever their names, pass unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opinionmill.llm import words
from opinionmill.llm.storage import put_back, set_apart, with_fields

WIDTH = 13
SHARD_BYTES = 16 << 20
MIN_SHARDS = 64
HASH_BYTES = 7
_BASE = 0x9E3779B97F4A7C15 | 1
_ZSTD = pa.Codec("zstd", compression_level=1)

BLOCKS = "shard int, n long, hashes binary, docs binary, marks binary, places binary"


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** n`` modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` codes in a row: a difference of prefix sums, brought to
    the same power of the base, and mixed."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(_BASE, n)[:n], dtype=np.uint64, out=sums[1:])
    h = (sums[width:] - sums[:-width]) * powers(pow(_BASE, -1, 1 << 64), n - width)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def text_mark() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64("text")


def shard_count(docs: DataFrame) -> int:
    """A power of two that follows the bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << max(MIN_SHARDS - 1, total // SHARD_BYTES).bit_length()


def _pressed(values: np.ndarray) -> bytes:
    """Compressed differences of ``values``, behind their length in bytes."""
    values = np.diff(values, prepend=values.dtype.type(0))
    return len(values.tobytes()).to_bytes(8, "little") + _ZSTD.compress(values.tobytes(), asbytes=True)


def _loosened(data: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.cumsum(np.frombuffer(_ZSTD.decompress(data[8:], size, asbytes=True), dtype), dtype=dtype)


def _blocks(doc_ids: np.ndarray, marks: np.ndarray, hashes: np.ndarray, doc: np.ndarray, place: np.ndarray, shards: int):
    """One row per shard: hashes without the shard's own bits; documents, their texts' marks and places
    as differences."""
    bits = shards.bit_length() - 1
    shard = (hashes & np.uint64(shards - 1)).astype(np.uint32)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    rest = (hashes[order] >> np.uint64(bits)).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    ids, texts, places = doc_ids[doc[order]], marks[doc[order]], place[order]
    for s in range(shards):
        a, b = int(edges[s]), int(edges[s + 1])
        if a < b:
            yield s, b - a, rest[a:b].tobytes(), _pressed(ids[a:b]), _pressed(texts[a:b]), _pressed(places[a:b])


def _unblocked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = table.column("n").to_pylist()
    raw = np.zeros((sum(n), 8), np.uint8)
    raw[:, :HASH_BYTES] = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, HASH_BYTES)
    ids, marks = (np.concatenate([_loosened(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("docs", "marks"))
    places = np.concatenate([_loosened(x, np.int32) for x in table.column("places").to_pylist()])
    return raw.reshape(-1).view(np.uint64), ids, marks, places


def windows(docs: DataFrame, width: int, shards: int) -> DataFrame:
    """Blocks of window hashes of all documents, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.sliced(batches, "text"):
            codes, distinct, first = words.coded(batch.column("text"))
            h = window_hashes(words.hashes(distinct)[codes], width)
            sizes = np.maximum(np.diff(first) - width + 1, 0)
            at = words.ragged(first[:-1], sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rows = list(_blocks(batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("mark").to_numpy(), h[at], doc, (at - first[doc]).astype(np.int32), shards))
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                names = ["shard", "n", "hashes", "docs", "marks", "places"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kept = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * width - 1))
    return kept.select(F.col("doc_id").cast("long"), text_mark().alias("mark"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def foreign_windows(blocks: DataFrame) -> DataFrame:
    """Per document, text and shard the windows (as int32 places) whose words a smaller document has."""

    def find(table: pa.Table) -> pa.Table:
        h, ids, marks, places = _unblocked(table)
        order = np.argsort(h)
        h, ids, marks, places = h[order], ids[order], marks[order], places[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        owner = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(h))))
        foreign = ids != owner
        ids, marks, places = ids[foreign], marks[foreign], places[foreign]
        order = np.lexsort((places, marks, ids))
        ids, marks, places = ids[order], marks[order], places[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))
        edges = np.append(np.flatnonzero(new), len(ids)) if len(ids) else np.zeros(1, np.int64)
        parts = [places[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        firsts = {"doc_id": ids[edges[:-1]], "mark": marks[edges[:-1]]}
        return pa.table({**{n: pa.array(v, pa.int64()) for n, v in firsts.items()}, "places": pa.array(parts, pa.binary())})

    return blocks.groupBy("shard").applyInArrow(find, "doc_id long, mark long, places binary")


def intervals(places: np.ndarray, width: int) -> np.ndarray:
    """Maximal half-open intervals of words that windows at ``places`` cover, one per row."""
    places = np.unique(places)
    if not len(places):
        return np.empty((0, 2), np.int64)
    new = np.flatnonzero(np.append(True, np.diff(places) > width))
    last = np.append(new[1:], len(places)) - 1
    return np.stack([places[new], places[last] + width], axis=1).astype(np.int64)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, spans: np.ndarray) -> bytes:
    """``text`` without the words of ``spans`` and the white space behind each; the rest unchanged."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(text[at : starts[a]])
        at = starts[b]
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``removed`` (word intervals), ``n_removed`` and
    ``kept_sha256`` of the kept words joined by one space; ``with_text`` adds ``kept_text``.

    Columns of ``docs`` with these names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "removed", "kept_sha256", "kept_text")
    docs = docs if with_text else docs.select("doc_id", "text")
    shards = shard_count(docs)
    found = foreign_windows(windows(docs, width, shards)).groupBy("doc_id", "mark").agg(F.collect_list("places").alias("places"))
    found = found.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
    rows = set_apart(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "mark": text_mark()})
    joined = rows.join(found, (F.col("id") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").select("row", "text", "places")
    fields = "n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept_sha256 string"
    fields += ", kept_text string" if with_text else ""
    passed = ["row", "text"] if with_text else ["row"]
    schema = with_fields(joined.select(*passed).schema, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.sliced(batches, "text"):
            out = {"n_words": [], "n_removed": [], "removed": [], "kept_sha256": [], "kept_text": []}
            for text, parts in zip(batch.column("text"), batch.column("places").to_pylist()):
                text = text.as_py()
                raw = (text or "").encode()
                tokens = raw.split()
                spans = intervals(np.frombuffer(b"".join(parts or []), np.int32), width)
                out["n_words"].append(len(tokens))
                out["removed"].append([{"start": a, "stop": b} for a, b in spans.tolist()])
                for a, b in spans[::-1].tolist():
                    del tokens[a:b]
                out["n_removed"].append(out["n_words"][-1] - len(tokens))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                if with_text:
                    out["kept_text"].append(without(raw, spans).decode() if len(spans) else text)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()})), pa.string(), pa.string()]
            made = [(n, pa.array(out[n], k)) for n, k in zip(out, kinds) if with_text or n != "kept_text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in passed] + [a for _, a in made], names=[*passed, *(n for n, _ in made)])

    return put_back(joined.mapInArrow(run, schema), docs if with_text else docs.select("doc_id"))
