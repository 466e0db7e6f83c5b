"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

1. Words are counted: partial counts per block of text, summed by shuffle.
2. Every letter is hashed to one of ``SYMBOLS`` symbols. A reduced word is the sequence of its letters'
   symbols, so words one edit apart are at most one edit apart when reduced, too.
3. Each distinct reduced word generates its whole one-edit neighbourhood (itself, every deletion,
   replacement and insertion of a symbol) as 64-bit hashes, made from prefix and suffix hashes.
   Neighbourhoods are symmetric, so of two reduced words only the one with the smaller hash keeps the
   other's: every pair meets once when the neighbourhoods are joined with the reduced vocabulary.
4. The words of two reduced words that met are candidates and verified on their own letters. A
   reduced word with many words is cut into blocks of about ``BLOCK``, and its pairs into pairs of
   blocks, so no task receives a whole crowd.
5. The number of near words and the best one per word come from one aggregate with partial results,
   the last form from doubling steps along the forms.

Reduction and hashes only choose which pairs are looked at: a collision costs a comparison, never a link.

Cases: a null text has no words; a text of any length is read whole; words shorter than ``MIN_LENGTH`` or
rarer than ``MIN_COUNT`` neither get nor become forms; of equally frequent near words the smallest in
code-point order is the form; repeated rows count as often as they stand there; the runs of a row without
doc_id are counted as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opinionmill.llm import words
from opinionmill.llm.storage import stored
from opinionmill.operators.relational import lookup_join

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
SYMBOLS = 8
BLOCK = 256
ROWS_AT_ONCE = 2048

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: The lead byte of U+00C0 to U+00FF in UTF-8; every character with it is one of these letters.
_LEAD = 0xC3
_BASE = 0x9E3779B97F4A7C15


class JoinedCrc:
    """crc32 of ``prefix + word`` from the two crc32s and the word's length, for whole arrays."""

    def __init__(self) -> None:
        self.tables: dict[int, np.ndarray] = {}

    def _table(self, n: int) -> np.ndarray:
        if n not in self.tables:
            zeros = bytes(n)
            own = zlib.crc32(zeros)
            self.tables[n] = np.array([[zlib.crc32(zeros, v << 8 * k) ^ own for v in range(256)] for k in range(4)], np.uint32)
        return self.tables[n]

    def __call__(self, prefix: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = word.copy()
        order = np.argsort(size, kind="stable")
        borders = np.flatnonzero(np.diff(size[order], prepend=-1))
        for a, b in zip(borders, [*borders[1:], len(order)]):
            at = order[a:b]
            table = self._table(int(size[at[0]]))
            for k in range(4):
                out[at] ^= table[k][(prefix[at] >> np.uint32(8 * k)) & np.uint32(255)]
        return out


def count_words(docs: DataFrame, delete_every: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the letter runs of all texts, A-Z lowered.

    With ``delete_every`` a run loses one letter where that number divides the crc32 of
    ``<doc_id>:<run>``: known misspellings, planted for a test.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = JoinedCrc()
        for batch in words.sliced(batches, "text"):
            data, offsets = words.flat_bytes(batch.column("text"))
            data = words._LOWER[data]
            lead = data == _LEAD
            solid = _LETTER[data] | lead
            solid[1:] |= lead[:-1]
            starts, ends, first = spans_of(solid, offsets)
            before = np.append(0, np.cumsum(lead))
            letters = ends - starts - (before[ends] - before[starts])
            long = letters >= min_length
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[long]
            starts, ends, letters = starts[long], ends[long], letters[long]
            found = words.pieces(data, starts, ends).dictionary_encode()
            codes, distinct = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()
            n, changed = np.bincount(codes, minlength=len(distinct)), Counter()
            if delete_every:
                ids = batch.column("doc_id").to_pylist()
                prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
                own = np.array([zlib.crc32(w) for w in distinct], np.uint32)
                h = joined(prefix[owner], own[codes], ends - starts)
                named = np.array([i is not None for i in ids], bool)[owner]
                hit = np.flatnonzero((h % np.uint32(delete_every) == 0) & named)
                n -= np.bincount(codes[hit], minlength=len(distinct))
                hit = hit[letters[hit] > min_length]
                for code, at in zip(codes[hit].tolist(), (h[hit] % letters[hit]).tolist()):
                    word = distinct[code].decode()
                    changed[word[:at] + word[at + 1 :]] += 1
            used = np.flatnonzero(n)
            for names, counts in (([distinct[i].decode() for i in used.tolist()], n[used].tolist()), (list(changed), list(changed.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def spans_of(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of marked bytes, and the first run of every text (``n + 1`` numbers)."""
    edge = np.zeros(len(solid) + 1, dtype=bool)
    edge[offsets] = True
    around = np.zeros(len(solid) + 2, dtype=bool)
    around[1:-1] = solid
    starts = np.flatnonzero(solid & (~around[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid & (~around[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def symbols_of(texts: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol (from 1) of every character of the words in a row, and ``n + 1`` offsets.

    The hash is the code point's remainder: with eight symbols it keeps the most frequent letters of
    Latin script (e, t, n, o, r, h, s) apart, which a mixing hash does not.
    """
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts.to_pylist()), np.int64, len(texts))
    return (chars % np.uint32(symbols) + 1).astype(np.uint8), np.append(0, np.cumsum(sizes))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, _BASE, np.uint64)), dtype=np.uint64)


def neighbourhood(rows: np.ndarray, symbols: int) -> np.ndarray:
    """Hashes of the one-edit neighbourhood of equally long reduced words (rows of symbols).

    First the words themselves, then all deletions, replacements and insertions; a neighbour that
    comes about in several ways stands there several times.
    """
    n, size = rows.shape
    power = _powers(size + 1)
    rows = rows.astype(np.uint64)
    # upto[:, i] is the hash of the first i symbols, behind[:, i] of those from i on.
    behind = np.zeros((n, size + 1), np.uint64)
    behind[:, :-1] = np.cumsum((rows * power[size - 1 :: -1][:size])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    upto = np.zeros((n, size + 1), np.uint64)
    for i in range(size):
        upto[:, i + 1] = upto[:, i] * np.uint64(_BASE) + rows[:, i]
    places, marks = np.arange(size), np.arange(1, symbols + 1, dtype=np.uint64)
    gone = upto[:, :-1] * power[size - 1 - places] + behind[:, 1:]
    put = upto[:, :-1] * power[size - places] + behind[:, 1:]
    put = put[:, :, None] + power[size - 1 - places][:, None] * marks
    ends = np.arange(size + 1)
    added = (upto * power[size + 1 - ends] + behind)[:, :, None] + power[size - ends][:, None] * marks
    return mixed(np.concatenate([behind[:, :1], gone, put.reshape(n, -1), added.reshape(n, -1)], axis=1))


def reduced(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``vocabulary`` plus ``r``, the hash of the reduced word, and ``shape``, its symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, offsets = symbols_of(batch.column("word"), symbols)
            raw, sizes = found.tobytes(), np.diff(offsets)
            r = np.zeros(len(sizes), np.uint64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                rows = found[offsets[at][:, None] + np.arange(size)].astype(np.uint64)
                r[at] = mixed((rows * _powers(size)[size - 1 :: -1][:size]).sum(axis=1, dtype=np.uint64)) if size else 0
            shapes = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column("word"), batch.column("n"), pa.array(r.view(np.int64)), pa.array(shapes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "r", "shape"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, r long, shape binary")


def neighbours(shapes: DataFrame, symbols: int) -> DataFrame:
    """``r, blocks, key``: each reduced word with itself and with every neighbour of a larger hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape, r = batch.column("shape").to_pylist(), batch.column("r").to_numpy()
            blocks, sizes = batch.column("blocks").to_numpy(), np.fromiter(map(len, shape), np.int64, len(shape))
            for size in np.unique(sizes).tolist():
                where = np.flatnonzero(sizes == size)
                for a in range(0, len(where), ROWS_AT_ONCE):
                    at = where[a : a + ROWS_AT_ONCE]
                    rows = np.frombuffer(b"".join(shape[i] for i in at.tolist()), np.uint8).reshape(len(at), size)
                    keys = neighbourhood(rows, symbols).view(np.int64)
                    own = keys[:, :1].copy()
                    keys.sort(axis=1)
                    keep = keys >= own
                    keep[:, 1:] &= keys[:, 1:] != keys[:, :-1]
                    of, place = np.nonzero(keep)
                    columns = [pa.array(r[at][of]), pa.array(blocks[at][of]), pa.array(keys[of, place])]
                    yield pa.RecordBatch.from_arrays(columns, names=["r", "blocks", "key"])

    return shapes.select("r", "blocks", "shape").mapInArrow(run, "r long, blocks int, key long")


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS, block: int = BLOCK) -> DataFrame:
    """``a, a_n, b, b_n`` for every unordered pair of words (``word, n``) that differ by one edit."""
    rows = stored(reduced(vocabulary, symbols), "reduced")
    shapes = rows.groupBy("r").agg(F.first("shape").alias("shape"), F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    shapes = stored(shapes, "shapes")
    crowded = shapes.where("blocks > 1").select("r", F.col("blocks").alias("_blocks"))
    part = F.pmod(F.xxhash64("word"), F.coalesce("_blocks", F.lit(1))).cast("int")
    rows = lookup_join(rows.select("word", "n", "r"), crowded, "r", "left").select("word", "n", "r", part.alias("part"))

    known = shapes.select(F.col("r").alias("_key"), F.col("blocks").alias("_blocks"))
    met = neighbours(shapes, symbols).join(known, F.col("key") == F.col("_key"))
    count_up = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met = met.select("r", "key", "_blocks", F.explode(count_up("blocks")).alias("p")).select("r", "key", "p", F.explode(count_up("_blocks")).alias("q"))
    met = met.where((F.col("r") != F.col("key")) | (F.col("p") <= F.col("q")))
    left, right = (
        rows.select(F.col("r").alias(f"_{x}r"), F.col("part").alias(f"_{x}p"), F.col("word").alias(x), F.col("n").alias(f"{x}_n")) for x in "ab"
    )
    pairs = met.join(left, (F.col("r") == F.col("_ar")) & (F.col("p") == F.col("_ap")))
    pairs = pairs.join(right, (F.col("key") == F.col("_br")) & (F.col("q") == F.col("_bp")))
    once = (F.col("r") != F.col("key")) | (F.col("p") != F.col("q")) | (F.col("a") < F.col("b"))
    return pairs.where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for every row of ``forms`` (``word, form``): where the forms end. A form is
    more frequent than its word, so there are no circles; every round doubles the steps taken."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        moved = stored(at.join(further, F.col("root") == F.col("_word"), "left").select("word", "root", "_next"), "roots")
        if moved.where("_next IS NOT NULL").isEmpty():
            return at
        at = moved.select("word", F.coalesce("_next", "root").alias("root"))


def variants(vocabulary: DataFrame, symbols: int = SYMBOLS, block: int = BLOCK, ratio: float = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``vocabulary`` (``word, n``).

    The form is the most frequent near word if it is at least ``ratio`` times as frequent.
    """
    vocabulary = stored(vocabulary, "vocabulary")
    one = lambda w, other, n: F.struct(F.col(w).alias("_word"), (-F.col(n)).alias("_n"), F.col(other).alias("_other"))
    sides = near_pairs(vocabulary, symbols, block).select(F.explode(F.array(one("a", "b", "b_n"), one("b", "a", "a_n"))).alias("_e")).select("_e.*")
    best = sides.groupBy("_word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("_n", "_other")).alias("_best"))
    found = vocabulary.join(best, F.col("word") == F.col("_word"), "left")
    form_n = -F.col("_best._n")
    good = form_n >= F.col("n") * ratio
    found = found.select(
        "word", F.when(good, F.col("_best._other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, form_n).alias("form_n")
    )
    found = stored(found, "forms")
    roots = last_forms(found.where("form IS NOT NULL")).withColumnRenamed("word", "_word")
    return found.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
