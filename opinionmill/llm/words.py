"""Words of whole Arrow text columns as integer codes, without a Python loop per word.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. These bytes never occur inside a longer
UTF-8 sequence, so working on bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

SLICE_BYTES = 8 << 20


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in a row and the ``n + 1`` offsets of its texts; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` text bytes; a longer text stays whole, alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every text (``n + 1`` numbers)."""
    solid = np.empty(len(data) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings between ``starts`` and ``ends`` (in rising order) as one Arrow array."""
    sizes = ends - starts
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1) if len(starts) and np.any(starts[1:] == ends[:-1]) else inside.__setitem__(starts, 1)
    if len(ends):
        inside[ends] -= 1
    kept = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    places = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=places[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)])


def coded(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of every word, the distinct words by code, and the first word of every text."""
    data, offsets = flat_bytes(texts)
    if lower:
        data = _LOWER[data]
    starts, ends, first = spans(data, offsets)
    found = pieces(data, starts, ends).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary, first


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every byte string."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``sizes[i]`` numbers) for every i, in a row."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return np.arange(total, dtype=np.int64) + shift


def subwords(distinct: pa.Array, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below ``buckets`` of each word in a row, and where each word's begin.

    A word is set between a start and an end mark. Its features are the byte n-grams of ``sizes``
    (those with a mark are its affixes) and the whole word.
    """
    n = len(distinct)
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + n + 1]
    length = np.diff(offsets)
    places = offsets[:-1] - offsets[0] + 2 * np.arange(n)
    data = np.empty(int(length.sum()) + 2 * n, np.uint64)
    data[places], data[places + length + 1] = 2, 3
    data[ragged(places + 1, length)] = np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    columns, counts = [], []
    for size in sizes:
        code = np.full(len(data), size * 0x9E3779B9, np.uint64)
        for k in range(size):
            code[: len(data) - k] = (code[: len(data) - k] ^ data[k:]) * np.uint64(0x100000001B3)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        count = np.maximum(length + 2 - size + 1, 0)
        columns.append((code[ragged(places, count)] >> np.uint64(33)) % np.uint64(buckets))
        counts.append(count)
    columns.append(hashes(distinct) % np.uint64(buckets))
    counts.append(np.ones(n, np.int64))
    total = np.sum(counts, axis=0)
    begins = np.cumsum(total) - total
    out, at = np.empty(int(total.sum()), np.int64), begins.copy()
    for values, count in zip(columns, counts):
        out[ragged(at, count)] = values.astype(np.int64)
        at += count
    return out, begins
