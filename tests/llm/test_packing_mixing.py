"""Packing and mixing: exact round trips, balance and limits."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinionmill.llm import mixing, packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_equal_the_tokenizer():
    rng = random.Random(1)
    letters = [*"ab '\n\t é1.!<|", "<|endoftext|>", "'s", " ", " "]
    texts = ["", None, " ", "a  b \n", "<|endoftext|> x", *("".join(rng.choices(letters, k=rng.randrange(50))) for _ in range(800))]
    ids, n = packing.TextEncoder(JSON, RANKS).encode(pa.array(texts))
    tokenizer, ends = Tokenizer.from_file(JSON), np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_and_sequences(documents):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "zeta"]) for _ in range(rng.choice([0, 3, 200, 700, 1500, 5000])))) for i in range(60)]
    texts += [(60, None), (61, ""), (5, texts[5][1])]
    rows = packing.pack_documents(documents(*texts).withColumn("length", F.lit("clash")), JSON, RANKS).toPandas()
    tokenizer = Tokenizer.from_file(JSON)
    by_doc = dict(texts)
    for doc_id, pieces in rows.groupby("doc_id"):
        ids = np.array(tokenizer.encode(by_doc[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        times = 2 if doc_id == 5 else 1
        assert pieces["length"].sum() == times * len(ids)
        for p in pieces.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        assert all(p.length == 1024 for p in pieces.itertuples() if p.piece > 0) or len(ids) <= 1024
    filled = rows.sort_values(["sequence_id", "offset"])
    assert (filled.groupby("sequence_id")["length"].cumsum() - filled["length"] == filled["offset"]).all()
    assert filled.groupby("sequence_id")["length"].sum().max() <= 1024
    assert rows["sequence_id"].nunique() <= 1.1 * rows["length"].sum() / 1024 + 2


def test_packing_an_empty_table(documents):
    assert packing.pack_documents(documents((1, "a")).limit(0), JSON, RANKS).count() == 0


def test_sum_of_squares_rule_step_by_step():
    """Against the rule computed from its definition."""
    rng, capacity = np.random.default_rng(4), 40
    lengths = rng.integers(1, 40, 300)
    bins, offsets, left = packing.sum_of_squares(lengths, capacity)
    gaps: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        size = lengths[i]

        def squares(after):
            counts = np.bincount([g for g in after if 0 < g < capacity], minlength=capacity)
            return (counts**2).sum()

        options = [(squares(gaps[:b] + [gaps[b] - size] + gaps[b + 1 :]), gaps[b]) for b in range(len(gaps)) if gaps[b] >= size]
        options.append((squares([*gaps, capacity - size]), capacity))
        best = min(options)
        chosen = gaps[bins[i]] if bins[i] < len(gaps) else capacity
        assert (min(o for o in options if o[1] == chosen)[0]) == best[0]
        if chosen == capacity:
            gaps.append(capacity - size)
        else:
            gaps[bins[i]] -= size
    assert gaps == left.tolist()


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, capped, the excess shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        share = rest / max(sum(w[s] for s in order if s not in capped), 1e-300)
        new = {s for s in order if s not in capped and share * w[s] >= most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in capped else share * w[s] for s in order}
        capped |= new


def test_mix_reaches_targets(documents):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["b", "a", "é", "zz", None])) for i in range(1500)]
    rows += [(2000, "w " * 3000, "b"), (2001, None, "a"), (2002, "", "empty"), (2003, "w w", "tiny"), (7, rows[7][1], rows[7][2])]
    docs = documents(*rows).withColumn("copies", F.lit("clash"))
    got = mixing.mix(docs).toPandas()
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = plain_targets(sizes)
    assert len(got) == len(rows) and got["copies"].between(0, 3).all()
    for source, part in got.groupby(got["source"].fillna("<null>")):
        key = None if source == "<null>" else source
        assert part["source_size"].iloc[0] == sizes[key]
        assert abs(part["target"].iloc[0] - targets[key]) < 1e-6
        assert abs((part["size"] * part["copies"]).sum() - targets[key]) <= 3
    again = mixing.mix(docs.repartition(7)).toPandas()
    order = ["doc_id", "source", "copies"]
    assert got[order].sort_values(order).fillna("").values.tolist() == again[order].sort_values(order).fillna("").values.tolist()


def test_mixed_documents_repeat_rows_as_often_as_decided(documents):
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(200)] + [(3, "w " * 4, "b"), (None, "w", "a")]
    docs = documents(*rows)
    decided = mixing.mix(docs).toPandas()
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    assert taken.count() == decided["copies"].sum()
    assert sum(len(r.text.split()) for r in taken.collect()) == (decided["size"] * decided["copies"]).sum()
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(8)
    size = rng.integers(1, 100, 300).astype(float)
    pi = np.full(300, 0.37)
    out = mixing.flight(pi, np.stack([np.ones(300), size], axis=1), rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs(out @ size - pi @ size) < 1e-4
