"""Spelling variants against plain counting and comparing of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionmill.llm import spelling


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if every and doc_id is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= spelling.MIN_LENGTH:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= spelling.MIN_COUNT}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out, form = {}, {}
    for w, n in counts.items():
        near = [o for o in counts if abs(len(o) - len(w)) < 2 and one_edit(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (n, len(near))
    rows = []
    for w, (n, n_near) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, n_near, counts.get(form[w])))
    return sorted(rows, key=repr)


def words_of(seed, n):
    rng = random.Random(seed)
    bases = ["".join(rng.choices("aeiouürstlnß", k=rng.randrange(4, 9))) for _ in range(n)]
    for base in list(bases):
        for _ in range(rng.randrange(4)):
            i, c = rng.randrange(len(base)), rng.choice("aeéou")
            bases.append(rng.choice([base[:i] + base[i + 1 :], base[:i] + c + base[i + 1 :], base[:i] + c + base[i:]]))
    return rng, bases


def test_whole_corpus_against_all_pairs(documents):
    rng, bases = words_of(1, 60)
    weights = [rng.choice([1, 3, 9, 60]) for _ in bases]
    rows = [(i, " ".join(w.title() if rng.random() < 0.3 else w for w in rng.choices(bases, weights, k=200)) + ",x_7") for i in range(40)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), (3, rows[3][1]), (102, (bases[0] + "'") * 4000)]
    docs = documents(*rows).withColumn("word", F.lit("clash")).withColumn("a col-x", F.lit(1)).repartition(3)
    counts = plain_counts(rows)
    found = spelling.count_words(docs, delete_every=97)
    assert {r.word: r.n for r in found.collect()} == counts
    want = plain_variants(counts)
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)
    assert sorted(map(tuple, spelling.variants(found).collect()), key=repr) == want


@pytest.mark.parametrize("symbols, block", [(1, 7), (2, 3), (4, 256)])
def test_crowded_reduced_words_lose_no_pair(spark, symbols, block):
    """With one symbol all words of a length are one reduced word, cut into many blocks."""
    _, bases = words_of(2, 40)
    counts = {w: len(w) * 3 + i for i, w in enumerate(dict.fromkeys(bases))}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(frame, symbols, block).collect()), key=repr) == plain_variants(counts)


def test_a_long_chain_of_forms_and_ties(spark):
    counts = {"a" * (5 + i): 3 * 2**i for i in range(20)} | {"bbbbbb": 40, "bbbbbc": 80, "bbbbba": 80}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {r.word: r for r in spelling.variants(frame).collect()}
    assert {rows["a" * (5 + i)].root for i in range(20)} == {"a" * 24}
    assert rows["bbbbbb"].form == "bbbbba" and rows["bbbbba"].form is None and rows["bbbbba"].n_near == 2


def test_empty_tables(documents, spark):
    assert spelling.variants(spelling.count_words(documents((1, "x")).limit(0))).count() == 0
    assert spelling.variants(spelling.count_words(documents((1, None), (2, "ab ab ab")))).count() == 0


def test_joined_crc():
    rng, joined = random.Random(4), spelling.JoinedCrc()
    words = [bytes(rng.choices(range(256), k=rng.randrange(90))) for _ in range(200)]
    prefixes = [f"{rng.randrange(10**9)}:".encode() for _ in words]
    got = joined(
        np.array([zlib.crc32(p) for p in prefixes], np.uint32), np.array([zlib.crc32(w) for w in words], np.uint32), np.array(list(map(len, words)))
    )
    assert got.tolist() == [zlib.crc32(p + w) for p, w in zip(prefixes, words)]
