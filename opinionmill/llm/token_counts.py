"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only.

Texts of an Arrow batch are read as one run of bytes and worked off in blocks of about
``BLOCK_BYTES``, whatever the number of rows, so short and long texts cost a task alike. A block ends
at a safe boundary, in the middle of a long text if need be: before ASCII white space that follows
a character which is surely not white space. No token of the supported vocabularies reaches across
such a place and no special token's string holds white space, so the counts of the parts add up to
that of the text. Inside a block the text is cut at all safe boundaries, every distinct part is
encoded once, in batches of about ``BATCH_BYTES``, and only its number of ids is kept.

A text without any safe boundary (a long run without white space) is encoded whole.

Cases: a null text counts as empty and has no bytes and no tokens; special strings inside a text are
handled as the library's default does; a row without doc_id is counted like any other; repeated rows
give repeated results; an empty table gives an empty result; other columns, also those named like a
result, are ignored unless named in ``carry``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from opinionmill.llm import words

LIMIT = 1024
BLOCK_BYTES = 4 << 20
BATCH_BYTES = 1 << 18
#: Counts of distinct parts that a task remembers from block to block, and the longest such part.
KNOWN = 500_000
KNOWN_BYTES = 64
CUT = b"\xff"

Encode = Callable[[list[str]], list[int]]


def boundaries(data: np.ndarray) -> np.ndarray:
    """Whether a text may be cut before each byte: white space behind a character that is none."""
    lead = np.zeros(len(data) + 3, np.uint8)
    lead[3:] = data
    one, two, three, four = lead[2:-1], lead[1:-2], lead[:-3], np.append(np.uint8(0), lead[:-4])
    behind = (one >= 0x21) & (one <= 0x7E)
    # Two-byte characters from U+00C0 on; three- and four-byte ones beyond the blocks with white space.
    behind |= (one >= 0x80) & (one < 0xC0) & (
        ((two >= 0xC3) & (two <= 0xDF)) | ((two >= 0x80) & (two < 0xC0) & ((three >= 0xE4) & (three <= 0xEF) | (three >= 0x80) & (three < 0xC0) & (four >= 0xF0)))
    )
    return words._SPACE[data] & behind


def encoder(path: str) -> Encode:
    """The function that gives the number of ids of each string of a list, by the file's library.

    ``.json`` files are read by ``tokenizers``, ``.model`` files by ``sentencepiece``.
    """
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size())):
            raise ValueError(f"{path} has pieces that reach over a blank")
        return lambda texts: list(map(len, model.encode(texts, num_threads=1)))
    raise ValueError(f"{path} is neither a .json nor a .model file")


class Counter:
    """Numbers of ids of Arrow text columns; distinct parts seen lately are not encoded again."""

    def __init__(self, path: str):
        self.encode, self.known = encoder(path), {}
        # A sentencepiece model normalises runs of white space, so it is cut at single blanks only. It
        # puts a blank before every text itself, so the one at which a part was cut goes: it is
        # overwritten by a byte that no UTF-8 text holds.
        self.single = path.endswith(".model")

    def _sizes(self, parts: list[bytes]) -> np.ndarray:
        sizes, known = np.zeros(len(parts), np.int64), self.known
        batch: list[int] = []
        size = 0

        def flush() -> None:
            texts = [parts[i].removeprefix(CUT).decode("utf-8", "replace") for i in batch]
            for i, n in zip(batch, self.encode(texts)):
                sizes[i] = n
                if len(parts[i]) <= KNOWN_BYTES:
                    known[parts[i]] = n

        for i, part in enumerate(parts):
            n = known.get(part)
            if n is not None:
                sizes[i] = n
                continue
            if batch and size + len(part) > BATCH_BYTES:
                flush()
                batch, size = [], 0
            batch.append(i)
            size += len(part)
        if batch:
            flush()
        if len(known) > KNOWN:
            known.clear()
        return sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of UTF-8 bytes and of ids of each text."""
        data, offsets = words.flat_bytes(texts)
        tokens = np.zeros(len(offsets) - 1, np.int64)
        begins = offsets[:-1]
        start = 0
        while start < len(data):
            stop = self._end(data, begins, start)
            cut = self._cuts(data, start, stop)
            borders = begins[np.searchsorted(begins, start) : np.searchsorted(begins, stop, side="right")] - start
            firsts, chunk = borders[borders < stop - start], data[start:stop]
            if self.single:
                # A blank at either end of a text is no cut, whatever the next text begins with.
                cut[firsts] = cut[borders[borders > 0] - 1] = False
                chunk = np.where(cut, np.uint8(CUT[0]), chunk)
            cut[firsts] = cut[0] = True
            starts = np.flatnonzero(cut)
            places = np.append(starts, stop - start).astype(np.int64)
            parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(chunk)])
            parts = parts.dictionary_encode()
            sizes = self._sizes(parts.dictionary.to_pylist())[parts.indices.to_numpy(zero_copy_only=False)]
            owner = np.searchsorted(begins, starts + start, side="right") - 1
            np.add.at(tokens, owner, sizes)
            start = stop
        return np.diff(offsets), tokens

    def _cuts(self, data: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Safe boundaries of the block; the characters before and behind it are looked at."""
        left, right = max(0, start - 4), min(len(data), stop + 1)
        cut = boundaries(data[left:right])
        if self.single:
            solid = np.append(~words._SPACE[data[left:right]], False)
            solid &= np.append((data[left:right] >= 0x21) & (data[left:right] <= 0x7E), False)
            cut &= (data[left:right] == 0x20) & solid[1:]
            cut[1:] &= solid[:-2]
        return cut[start - left : stop - left]

    def _end(self, data: np.ndarray, begins: np.ndarray, start: int) -> int:
        """The first safe boundary or text start at least ``BLOCK_BYTES`` behind ``start``."""
        at = start + BLOCK_BYTES
        while at < len(data):
            stop = min(at + (1 << 16), len(data))
            found = np.flatnonzero(self._cuts(data, at, stop))
            next_text = np.searchsorted(begins, at)
            text_start = int(begins[next_text]) if next_text < len(begins) else len(data)
            # A blank before a text's start may be that text's end; the start itself is as near.
            options = [at + int(f) for f in found[:2] if at + f + 1 < text_start] or [text_start]
            if options[0] < stop:
                return options[0]
            at = stop
        return len(data)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (and the ``carry`` columns) of every row of ``docs``.

    One pass over the texts in splits of the input; nothing is shuffled and no id leaves a task.
    """
    # A user's column may have a result's name: it is kept apart until the end.
    kept = [F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(carry)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"), *kept)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_text"])
    for name in ("n_bytes", "n_tokens"):
        schema = schema.add(name, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or Counter(path)
            n_bytes, n_tokens = count(batch.column("_text"))
            names = [n for n in batch.schema.names if n != "_text"]
            columns = [batch.column(n) for n in names] + [pa.array(n_bytes, pa.int64()), pa.array(n_tokens)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, schema)
    back = [F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)]
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *back)
