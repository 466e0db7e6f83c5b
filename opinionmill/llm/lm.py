"""Scores of an n-gram model kept as Elias-Fano tries, one per shard of contexts.

The model interpolates bigrams with smoothed unigrams by modified Kneser-Ney discounts:
``p(w | v) = max(c(v,w) - D, 0) / c(v) + mass(v) / c(v) * p(w)``. It is as large as the corpus has
distinct bigrams, so no machine holds it whole:

1. ``blocks``: texts become word codes, a few million tokens per block, written once.
2. ``requests``: a block sends each shard its words (with training counts) and their successors.
   A word of more than 1/2000 of the tokens is a hot context; its successors go to all shards.
3. ``answers``: a shard sums the training counts, builds its trie in memory-mapped files and looks
   every requested word and bigram up in it. Answers go back in the order of the request.
4. ``scores``: a block puts its answers together and sums the log probabilities of its documents.

Only codes, hashes and counts are shuffled, each distinct bigram once per block. Distinct words share
a 64-bit hash with probability below n^2 / 2^65, two successors of one context a 56-bit one.

Cases: a null or empty text is only the end mark; texts are read whole; a null doc_id counts as
training data; repeated rows count as often as they occur; with no training rows every word is
unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from opinionmill.llm import words
from opinionmill.llm.elias_fano import EliasFano
from opinionmill.llm.storage import stored

BLOCK_TOKENS = 2_000_000
SHARD_TOKENS = 2_000_000
MIN_SHARDS = 64
HOT_SHARE = 2000
SUCCESSOR_BYTES = 7
_END = np.uint64(0x5DEECE66D1234567)
_PROB_STEP = 16 / 65535  # log10 probabilities from -16 to 0
_ZSTD = pa.Codec("zstd", compression_level=1)

BLOCKS = (
    "block long, n_tokens long, doc_ids array<long>, held array<boolean>, sizes binary, codes binary, "
    "vocab binary, frequent array<struct<word:long,n:long>>"
)
REQUESTS = "shard int, block long, words binary, counts binary, fan binary, next binary, next_counts binary, hot binary, hot_next binary, hot_next_counts binary, hot_counts binary"
ANSWERS = "block long, shard int, totals binary, mass binary, probs binary, hot_probs binary, n_train long, n_types long, hot_mass array<double>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def press(values: np.ndarray) -> bytes:
    """``values`` compressed by byte planes, behind their number."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else np.empty(0, np.uint8)
    return len(values).to_bytes(8, "little") + (_ZSTD.compress(planes.tobytes(), asbytes=True) if len(values) else b"")


def loosen(data: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(_ZSTD.decompress(data[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(dtype)


def _short(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SUCCESSOR_BYTES].tobytes()


def _long(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // SUCCESSOR_BYTES, 8), np.uint8)
    raw[:, :SUCCESSOR_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SUCCESSOR_BYTES)
    return raw.reshape(-1).view(np.uint64)


def blocks(docs: DataFrame, held_out) -> DataFrame:
    """Texts as word codes; codes of a block follow the order of its words' hashes."""

    def emit(parts: list, number: int) -> pa.RecordBatch:
        vocab, codes = np.unique(np.concatenate([[_END], *(p[0] for p in parts)]).astype(np.uint64), return_inverse=True)
        at, mapped = 1, []
        for hashes, own, *_ in parts:
            mapped.append(codes[at : at + len(hashes)][own])
            at += len(hashes)
        codes = np.concatenate(mapped).astype(np.int32)
        sizes = np.concatenate([p[2] for p in parts])
        held = pa.concat_arrays([p[4] for p in parts])
        trained = np.repeat(~held.to_numpy(zero_copy_only=False), sizes)
        counts = np.bincount(codes, weights=trained, minlength=len(vocab)).astype(np.int64)
        often = np.flatnonzero(counts * HOT_SHARE > max(counts.sum(), 1))
        frequent = [{"word": int(np.int64(vocab[i].astype(np.int64))), "n": int(counts[i])} for i in often]
        row = {
            "block": number, "n_tokens": int(sizes.sum() + len(sizes)), "doc_ids": pa.concat_arrays([p[3] for p in parts]).to_pylist(),
            "held": held.to_pylist(), "sizes": press(sizes.astype(np.int64)), "codes": press(codes), "vocab": press(np.diff(vocab, prepend=np.uint64(0))),
            "frequent": frequent,
        }
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct({"word": pa.int64(), "n": pa.int64()}))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, parts, tokens = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in words.sliced(batches, "text"):
            codes, distinct, first = words.coded(batch.column("text"), lower=True)
            parts.append((words.hashes(distinct), codes, np.diff(first), batch.column("doc_id"), batch.column("held")))
            tokens += len(codes) + batch.num_rows
            if tokens >= BLOCK_TOKENS:
                yield emit(parts, base + made)
                made, parts, tokens = made + 1, [], 0
        if parts:
            yield emit(parts, base + made)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string"))
    return rows.mapInArrow(run, BLOCKS)


class Layout:
    """Distinct words and bigrams of a block in the order in which its requests list them."""

    def __init__(self, row: dict, hot: np.ndarray, bits: int):
        self.vocab = np.cumsum(loosen(row["vocab"], np.uint64), dtype=np.uint64)
        self.sizes = loosen(row["sizes"], np.int64)
        codes, nv = loosen(row["codes"], np.int32), len(self.vocab)
        end = int(np.searchsorted(self.vocab, _END))
        stops = np.cumsum(self.sizes)
        self.word = np.insert(codes, stops, end).astype(np.int64)
        self.first = np.append(0, stops + np.arange(1, len(stops) + 1))
        before = np.append(nv, self.word[:-1])
        before[self.first[:-1]] = nv
        self.pairs, self.pair_of = np.unique(before * (nv + 1) + self.word, return_inverse=True)
        self.context, self.next = self.pairs // (nv + 1), self.pairs % (nv + 1)
        self.shard_of_word = (self.vocab >> np.uint64(64 - bits)).astype(np.int64)
        # The hot contexts: frequent words and, last, the start of a text.
        hot_of = np.full(nv + 1, -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hot), nv - 1)
        there = self.vocab[at] == hot
        hot_of[at[there]] = np.flatnonzero(there)
        hot_of[nv] = len(hot)
        self.hot_words, self.hot_there, self.n_hot = at, there, len(hot)
        self.hot = hot_of[self.context]
        shards = 1 << bits
        self.word_edges = np.searchsorted(self.shard_of_word, np.arange(shards + 1))
        self.plain = np.flatnonzero(self.hot < 0)
        self.plain_edges = np.searchsorted(self.shard_of_word[self.context[self.plain]], np.arange(shards + 1))
        hot_pairs = np.flatnonzero(self.hot >= 0)
        mixed = (self.vocab[self.next[hot_pairs]] + self.hot[hot_pairs].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        shard = (mixed >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        self.hot_pairs = hot_pairs[order]
        self.hot_edges = np.searchsorted(shard[order], np.arange(shards + 1))


def requests(made: DataFrame, hot: np.ndarray, bits: int) -> DataFrame:
    """One row per block and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lay = Layout(row, hot, bits)
                trained = np.repeat(~np.array(row["held"], bool), lay.sizes + 1).astype(float)
                counts = np.bincount(lay.word, weights=trained, minlength=len(lay.vocab)).astype(np.int64)
                pair_counts = np.bincount(lay.pair_of, weights=trained, minlength=len(lay.pairs)).astype(np.int64)
                fan = np.bincount(lay.context[lay.plain], minlength=len(lay.vocab)).astype(np.int32)
                starts = int((~np.array(row["held"], bool)).sum())
                hot_counts = press(np.append(np.where(lay.hot_there, counts[lay.hot_words], 0), starts).astype(np.int64))
                names, out = [x.split(" ")[0] for x in REQUESTS.split(", ")], []
                for s in range(1 << bits):
                    a, b = lay.word_edges[s : s + 2]
                    p = lay.plain[slice(*lay.plain_edges[s : s + 2])]
                    h = lay.hot_pairs[slice(*lay.hot_edges[s : s + 2])]
                    out.append((
                        s, row["block"], press(lay.vocab[a:b]), press(counts[a:b]), press(fan[a:b]),
                        _short(lay.vocab[lay.next[p]]), press(pair_counts[p]),
                        press(lay.hot[h].astype(np.int32)), _short(lay.vocab[lay.next[h]]), press(pair_counts[h]), hot_counts,
                    ))
                kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return made.select("block", "held", "sizes", "codes", "vocab").mapInArrow(run, REQUESTS)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (index 0 unused)."""
    n = np.maximum(np.bincount(np.minimum(counts, 5), minlength=6)[1:5], 1).astype(float)
    y = n[0] / (n[0] + 2 * n[1])
    out = np.array([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.clip(out, [0, 0.1, 0.1, 0.1], [0, 0.95, 1.9, 2.85])


class Trie:
    """Words, bigrams relative to their context, and quantised probabilities, in one mapped file.

    Levels: word hashes; pointers from each context to its successors; the successors' words; and
    the bigrams, each ``context * words + rank of the successor``, so that a search inside a context
    is one successor search in this flat list. Lookups do not read the pointers, and the order is 2.
    """

    def __init__(self, folder: str, nodes: np.ndarray, n_hot: int, context: np.ndarray, following: np.ndarray, p: np.ndarray):
        """``context`` (ascending; hot ones behind ``nodes``) and ``following`` name the bigrams."""
        names, rank = np.unique(following, return_inverse=True)
        self.n_names = max(len(names), 1)
        n_nodes = len(nodes) + n_hot
        levels = [
            EliasFano.of(nodes, 1 << 64),
            EliasFano.of(np.searchsorted(context, np.arange(n_nodes + 1)), len(context) + 1),
            EliasFano.of(names, 1 << (8 * SUCCESSOR_BYTES)),
            EliasFano.of(context.astype(np.uint64) * np.uint64(self.n_names) + rank.astype(np.uint64), max(n_nodes * self.n_names, 1)),
        ]
        code = np.clip(np.round(-np.log10(p) / _PROB_STEP), 0, 65534).astype(np.uint16) + np.uint16(1)
        path, shapes = os.path.join(folder, "trie"), []
        with open(path, "wb") as file:
            for array in [a for level in levels for a in level.arrays] + [code]:
                shapes.append((file.tell(), array.dtype, len(array)))
                file.write(array.tobytes())
        mapped = [np.memmap(path, dtype, "r", offset, (n,)) if n else np.empty(0, dtype) for offset, dtype, n in shapes]
        self.nodes, self.pointers, self.names, self.bigrams = (
            EliasFano(level.n, level.width, mapped[3 * i : 3 * i + 3]) for i, level in enumerate(levels)
        )
        self.code = mapped[-1]

    def word(self, hashes: np.ndarray) -> np.ndarray:
        return self.nodes.successor(hashes)[0]

    def probability(self, context: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Probability code of each bigram, 0 where training has none."""
        rank, known = self.names.successor(following)
        place, hit = self.bigrams.successor(context.astype(np.uint64) * np.uint64(self.n_names) + rank.astype(np.uint64))
        found = known & hit
        out = np.zeros(len(context), np.uint16)
        out[found] = self.code[place[found]]
        return out


def probability_of(code: np.ndarray) -> np.ndarray:
    """The probability that a code stands for; 0 for code 0."""
    return np.where(code > 0, 10.0 ** (-(code.astype(float) - 1) * _PROB_STEP), 0.0)


def answers(asked: DataFrame, n_hot: int) -> DataFrame:
    """Counts, masses and probability codes per request, and one row of sums per shard."""

    def look_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = [loosen(r["words"], np.uint64) for r in rows]
        counts = np.concatenate([loosen(r["counts"], np.int64) for r in rows])
        nodes, node = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(node, weights=counts, minlength=len(nodes)).astype(np.int64)
        hot_total = np.sum([loosen(r["hot_counts"], np.int64) for r in rows], axis=0)
        ends = np.cumsum([len(x) for x in own])
        asked_context, asked_next, asked_count = [], [], []
        for r, end, w in zip(rows, ends, own):
            here = node[end - len(w) : end]
            asked_context += [np.repeat(here, loosen(r["fan"], np.int32)), len(nodes) + loosen(r["hot"], np.int32).astype(np.int64)]
            asked_next += [_long(r["next"]), _long(r["hot_next"])]
            asked_count += [loosen(r["next_counts"], np.int64), loosen(r["hot_next_counts"], np.int64)]
        context, following, count = np.concatenate(asked_context), np.concatenate(asked_next), np.concatenate(asked_count)
        trained = np.flatnonzero(count)
        order = trained[np.lexsort((following[trained], context[trained]))]
        context, following, count = context[order], following[order], count[order]
        new = np.ones(len(context), bool)
        new[1:] = (context[1:] != context[:-1]) | (following[1:] != following[:-1])
        starts = np.flatnonzero(new)
        c = np.add.reduceat(count, starts) if len(starts) else np.empty(0, np.int64)
        context, following = context[starts], following[starts]
        d = discounts(c)[np.minimum(c, 3)]
        of_context = np.append(total, hot_total)
        mass = np.bincount(context, weights=d, minlength=len(of_context))
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(folder, nodes, n_hot, context, following, (c - d) / of_context[context])
            out = {name.split(" ")[0]: [] for name in ANSWERS.split(", ")}
            for i, (r, w) in enumerate(zip(rows, own)):
                at = trie.word(w)
                plain = trie.probability(np.repeat(at, loosen(r["fan"], np.int32)), asked_next[2 * i])
                hot = trie.probability(asked_context[2 * i + 1], asked_next[2 * i + 1])
                back = (mass[at] / np.maximum(total[at], 1)).astype(np.float32)
                values = (r["block"], r["shard"], press(total[at]), press(back), press(plain), press(hot), None, None, None)
                for name, value in zip(out, values):
                    out[name].append(value)
            del trie
        sums = (-1, rows[0]["shard"], None, None, None, None, int(total.sum()), int((total > 0).sum()))
        for name, value in zip(out, (*sums, (mass[len(nodes) :] / np.maximum(hot_total, 1)).tolist())):
            out[name].append(value)
        kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 4 + [pa.int64(), pa.int64(), pa.list_(pa.float64())]
        return pa.table({name: pa.array(v, k) for (name, v), k in zip(out.items(), kinds)})

    return asked.groupBy("shard").applyInArrow(look_up, ANSWERS)


def scores(made: DataFrame, answered: DataFrame, hot: np.ndarray, bits: int, n_train: int, n_types: int, hot_mass: np.ndarray) -> DataFrame:
    """One row per document."""

    def run(block: pa.Table, answer: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        lay = Layout(row, hot, bits)
        total, mass = np.zeros(len(lay.vocab) + 1, np.int64), np.zeros(len(lay.vocab) + 1)
        prob = np.zeros(len(lay.pairs))
        for r in answer.to_pylist():
            s = r["shard"]
            total[slice(*lay.word_edges[s : s + 2])] = loosen(r["totals"], np.int64)
            mass[slice(*lay.word_edges[s : s + 2])] = loosen(r["mass"], np.float32)
            prob[lay.plain[slice(*lay.plain_edges[s : s + 2])]] = probability_of(loosen(r["probs"], np.uint16))
            prob[lay.hot_pairs[slice(*lay.hot_edges[s : s + 2])]] = probability_of(loosen(r["hot_probs"], np.uint16))
        mass[lay.hot_words[lay.hot_there]] = hot_mass[:-1][lay.hot_there]
        mass[-1] = hot_mass[-1]
        # A context never seen in training leaves all its mass to the unigrams.
        seen = np.append(total[:-1] > 0, hot_mass[-1] > 0)
        mass = np.where(seen, mass, 1.0)
        unigram = (total + 0.5) / (n_train + 0.5 * (n_types + 1))
        base = np.log10(unigram[lay.word])
        pair = np.log10(prob + mass[lay.context] * unigram[lay.next])
        at = lay.first[:-1]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = (
            row["doc_ids"], row["held"], lay.sizes + 1, np.add.reduceat((total[lay.word] > 0).astype(np.int64), at),
            np.add.reduceat(base, at), np.add.reduceat(pair[lay.pair_of], at),
        )
        return pa.table({n.split(" ")[0]: pa.array(c, k) for n, c, k in zip(SCORES.split(", "), columns, kinds)})

    left = made.select("block", "doc_ids", "held", "sizes", "codes", "vocab").groupBy("block")
    return left.cogroup(answered.where("block >= 0").drop("n_train", "n_types", "hot_mass").groupBy("block")).applyInArrow(run, SCORES)


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """``SCORES`` plus ``train_tokens`` for every row of ``docs``; ``held_out`` marks rows not to learn from."""
    made = stored(blocks(docs, held_out), "lm-blocks")
    tokens = made.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(MIN_SHARDS - 1, tokens // SHARD_TOKENS).bit_length()
    often = made.select(F.explode("frequent").alias("f")).groupBy("f.word").agg(F.sum("f.n").alias("n"))
    # At most HOT_SHARE words can pass: their counts sum to no more than all tokens.
    often = often.where(F.col("n") * HOT_SHARE > tokens).select("word").toArrow().column("word").to_numpy()
    hot = np.sort(often.astype(np.int64).view(np.uint64))
    answered = stored(answers(requests(made, hot, bits), len(hot) + 1), "lm-answers")
    sums = answered.where("block < 0")
    n_train, n_types = sums.agg(F.sum("n_train"), F.sum("n_types")).first()
    mass = sums.select(F.posexplode("hot_mass").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).collect()
    hot_mass = np.zeros(len(hot) + 1)
    for r in mass:
        hot_mass[r["i"]] = r["m"]
    out = scores(made, answered, hot, bits, n_train or 0, n_types or 0, hot_mass)
    return out.withColumn("train_tokens", F.lit(n_train or 0).cast("long"))
