"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

Each piece goes where the sum over all residual gaps g of (open bins with gap g) squared becomes
smallest. Pieces are packed in shards of bounded size; the pieces of badly filled bins of all
shards meet again on the next level, in far fewer shards, so that the waste of a shard's end does
not add up. Only small rows (no text, no ids) are shuffled.

Cases: a null text counts as empty and still gives one piece (its end mark); a text of any length
is tokenised whole; repeated rows are packed each for itself; an empty table gives an empty result;
other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from opinionmill.llm import words
from opinionmill.llm.storage import quoted, stored, with_fields

CAPACITY = 1024
END_ID = 2
SHARD_PIECES = 4096
LEVELS = 3
OPEN_GAP = 8

#: Fixed value: the pre-tokenisation pattern of the vocabulary, with possessive quantifiers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TextEncoder:
    """Ids of whole Arrow text columns. Every distinct chunk between single spaces is encoded once.

    A cut before a space between two other characters never falls inside a pre-token, so encoding
    chunks equals encoding the text, and so does encoding distinct chunks in a row: the byte
    lengths of the ids tell where each chunk ends. Chunks that could hold a special token's string
    go to the full tokenizer; for the others the rank table of the same vocabulary gives the same
    ids faster.
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.full = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.id_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.id_bytes[list(ranks.values())] = list(map(len, ranks))

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and where each chunk's ids begin (one more at the end)."""
        offsets = np.frombuffer(chunks.buffers()[1], np.int64)[: len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[: offsets[-1]]
        alone = (data[offsets[:-1]] != 0x20) | words._SPACE[data[offsets[1:] - 1]]
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        alone[np.searchsorted(offsets, marks, side="right") - 1] = True
        sizes, parts = np.zeros(len(chunks), np.int64), [None] * len(chunks)
        plain = np.flatnonzero(~alone)
        row = data[words.ragged(offsets[plain], np.diff(offsets)[plain])].tobytes().decode("utf-8", "replace")
        ids = np.asarray(self.fast.encode_ordinary(row), np.uint32)
        ends = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(np.diff(offsets)[plain])) + 1
        sizes[plain] = np.diff(ends, prepend=0)
        others = np.flatnonzero(alone)
        for i, chunk in zip(others.tolist(), chunks.take(pa.array(others)).to_pylist()):
            text = chunk.decode("utf-8", "replace")
            special = "<|" in text
            parts[i] = self.full.encode(text, add_special_tokens=False).ids if special else self.fast.encode_ordinary(text)
            sizes[i] = len(parts[i])
        begins = np.append(0, np.cumsum(sizes))
        out = np.empty(begins[-1], np.uint32)
        out[words.ragged(begins[plain], sizes[plain])] = ids
        for i in others.tolist():
            out[begins[i] : begins[i + 1]] = parts[i]
        return out, begins

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text."""
        data, offsets = words.flat_bytes(texts)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        space = np.ones(len(data) + 2, dtype=bool)
        space[1:-1] = words._SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        # Lead bytes of the white space beyond ASCII: a run of white space may not be cut.
        space[1:-1] |= np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))
        before = np.ones(len(data), dtype=bool)
        before[1:] = words._SPACE[data[:-1]]
        starts = np.flatnonzero(((data == 0x20) & ~before & ~space[2:]) | edge[:-1])
        places = np.append(starts, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])
        chunks = chunks.dictionary_encode()
        flat, begins = self._distinct(chunks.dictionary)
        codes = chunks.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(begins)[codes]
        before = np.append(0, np.cumsum(sizes))
        return flat[words.ragged(begins[codes], sizes)], np.diff(before[np.searchsorted(starts, offsets)])


def cut(n: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, number, start and length of the pieces of texts with ``n`` ids; the first may be shorter."""
    count = -(-n // capacity)
    owner = np.repeat(np.arange(len(n)), count)
    number = words.ragged(np.zeros(len(n), np.int64), count)
    head = n - (count - 1) * capacity
    start = np.where(number == 0, 0, head[owner] + (number - 1) * capacity)
    return owner, number, start, np.where(number == 0, head[owner], capacity)


def tokenised_pieces(
    docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece of every document, without the ids; one pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(json_path, ranks_path)
        for batch in words.sliced(batches, "text"):
            ids, n = encoder.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
            base = np.cumsum(n + 1) - (n + 1)
            owner, number, start, length = cut(n + 1, capacity)
            view, first = memoryview(ids).cast("B"), base[owner] + start
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every piece, and the gap left in every bin, longest pieces first."""
    # Half a bin stands for "a new bin" at gap ``capacity`` and "closed" at gap 0: with these the
    # change of the sum of squares is 2 * (count at the new gap - count at the old gap + 1) for all.
    count = np.zeros(capacity + 1)
    count[0], count[capacity] = -0.5, 0.5
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        old = count[size:]
        change = np.where(old > 0, count[: capacity + 1 - size] - old, np.inf)
        gap = int(change.argmin()) + size
        if gap == capacity:
            place, used = used, used + 1
        else:
            place = waiting[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = place, capacity - gap
        if gap > size:
            count[gap - size] += 1
            waiting[gap - size].append(place)
    left = np.full(used, 0, np.int64)
    for gap, places in enumerate(waiting):
        left[places] = gap
    return bins, offsets, left


def filler(columns: list[str], base: int, capacity: int):
    """The function that packs one shard; sequence numbers hold the shard's number from ``base`` on."""

    def fill(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets, left = sum_of_squares(shard["length"].to_numpy(), capacity)
        number = base + int(shard["shard"].iloc[0])
        out = shard[columns].copy()
        out["sequence_id"], out["offset"], out["gap"] = (number << 32 | bins) * 2 + 1, offsets, left[bins]
        return out

    return fill


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, levels: int = LEVELS) -> DataFrame:
    """``pieces`` (with ``doc_id``, ``piece``, ``length``) plus ``sequence_id`` and ``offset``.

    A piece of full length is a sequence of its own. The number of shards of a level follows the
    number of its rows. Bins with more than ``OPEN_GAP`` free places are packed anew on the next
    level; the last level keeps all its bins.
    """
    columns = pieces.columns
    made = stored(pieces, "pieces")
    full = made.where(F.col("length") >= capacity).select(
        *columns, (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    schema = with_fields(made.select(*map(quoted, columns)).schema, "sequence_id long, offset long, gap long")
    done, rest, base = [full], made.where(F.col("length") < capacity), 0
    for level in range(levels):
        n = rest.count()
        if not n:
            break
        shards = -(-n // shard_pieces)

        # The checksum and place spread the pieces of equal or null ids.
        key = F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in columns], F.lit(level)), F.lit(shards)).alias("shard")
        packed = rest.select(*columns, key).groupBy("shard").applyInPandas(filler(columns, base, capacity), schema)
        packed, base = stored(packed, f"packed{level}"), base + shards
        if shards == 1 or level == levels - 1:
            done.append(packed.drop("gap"))
            break
        done.append(packed.where(F.col("gap") <= OPEN_GAP).drop("gap"))
        rest = packed.where(F.col("gap") > OPEN_GAP).select(*columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack(tokenised_pieces(docs, json_path, ranks_path, capacity, end_id), capacity)
