"""Null ids, several texts of one id and columns of any name, for every operator and pipeline stage."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from opinionmill.llm import langid, mixing, neardup, packing, queries, substrings, topk, toxicity

from test_text_operators import plain_removal

NAMES = ("copies", "_copies", "my col-x", "_text", "_mark", "_doc", "row", "score of it", "a`b", "spoken", "shard", "_rest", "_row", "_places_")
TEXT = "the first of many words and a long tail of more words that go on and on to the end of it " * 5


def dressed(docs):
    """``docs`` with one more column for every awkward name."""
    for name in NAMES:
        docs = docs.withColumn(name, F.lit(name))
    return docs


def same_extras(rows):
    return all(r[name] == name for r in rows for name in NAMES)


@pytest.fixture
def docs(documents):
    rows = [(i, f"{TEXT} only {i} here {'x' * i}", "ab"[i % 2]) for i in range(1, 9)]
    clean = " ".join("the" if i % 4 == 0 else f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100))
    return dressed(documents(*rows, (20, clean, "a"), (None, TEXT, "a"), (None, "another text", None), (3, "a second text of three", "a"), (4, None), (5, "")))


def test_top_k_without_ids(spark):
    rows = [(1, [1, 2]), (None, [9, 9]), (2, [3, 1]), (None, [1, 1]), (50, [1, 1])]
    vectors = spark.createDataFrame(rows, "id long, v array<long>").withColumn("score", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, F.col("id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(50, 1, 2, 4), (50, 2, 1, 3)]


def test_top_k_query_takes_every_row_and_whole_sums(spark, tmp_path):
    """As the SQL twin: a repeated id has each of its rows, and sums beyond 2 ** 53 are exact."""
    big = float(1 << 20)
    rows = [(0, [big, big + 1, 3.0]), (1, [big, big, 1.0]), (1, [big, big, 2.0]), (2, [big, big - 1, 0.0]), (3, [big, big, 1.0]), (3, [big, big, 1.0])]
    rows += [(50, [1.0, 0.0, 0.0]), (50, [-1.0, 0.0, 0.0]), *((i, [big, big, 1.0 - i / 256]) for i in range(4, 9))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op1_topk(spark, str(tmp_path)).orderBy("query_id", "rank").collect()
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows]
    expected = []
    for query in (0, 50):
        pairs = [(-sum(a * b for a, b in zip(q, v)), i) for j, q in whole if j == query for i, v in whole if i != query]
        expected += [(query, r, i, -s) for r, (s, i) in enumerate(sorted(pairs)[:5], 1)]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == expected


def test_top_k_thresholds_allow_for_rounding(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(1 << 24, 1 << 25, 64)
    rows = [(i, (base + rng.integers(0, 2, 64)).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "id long, v array<long>")
    found = topk.top_k(vectors, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    expected = []
    for i, q in rows[::50]:
        expected += [(i, j, -s) for s, j in sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:5]]
    assert [(r.query_id, r.vec_id, r.score) for r in found] == expected


def test_language_of_texts_after_a_cut_batch(spark, documents):
    """A batch of more than ``SLICE_BYTES`` is cut; texts behind the cut keep their words."""
    docs = documents((0, "x" * 999 + ("y" * 999 + " ") * 9000), *((i, f"{i} {TEXT}") for i in range(1, 6))).coalesce(1)
    found = langid.label_languages(docs, F.col("doc_id") > 0, per_lang=20).select("doc_id", "lang_pred", "score").collect()
    assert {r.doc_id: r.lang_pred for r in found} == {i: "en" for i in range(6)}
    assert {r.score for r in found if r.doc_id} == {1.0}


def test_language_and_toxicity_keep_all_columns(spark, docs):
    found = langid.label_languages(docs, F.lit(True), per_lang=20)
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == docs.count() and same_extras(rows) and {r.lang_pred for r in rows if not r.text} == {"und"}
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, labels, F.lit(True))
    rows = found.collect()
    assert found.columns == [*docs.columns, "score", "predicted"] and len(rows) == docs.count() and same_extras(rows)


def test_removal_with_two_texts_of_one_id(documents):
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, "short"), (2, " ".join(["x", *words[5:40]])), (2, " ".join(words[20:58])), (3, " ".join(words[:20]))]
    docs = dressed(documents(*texts, (None, " ".join(words))))
    rows = substrings.remove_repeats(docs).collect()
    assert same_extras(rows)
    want = []
    for i, (doc_id, text) in enumerate(texts):
        # Each row beside the rows of the other ids alone: rows of one id lose nothing to each other.
        others = [t for t in texts if t[0] != doc_id]
        want.append((doc_id, text, plain_removal([*others, (doc_id, text)], 13)[doc_id][1]))
    key = lambda r: (r[0], r[1])
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in rows if r.doc_id is not None), key=key) == sorted(want, key=key)
    assert [r.n_removed for r in rows if r.doc_id is None] == [0]


def test_keep_one_loses_no_text(documents):
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "seven eight nine ten eleven")]
    rows = neardup.keep_one(dressed(documents(*texts))).collect()
    assert same_extras(rows) and sorted((r.doc_id, r.text) for r in rows) == sorted(set(texts))


def test_mixing_spreads_rows_without_ids(documents):
    rows = [(None, f"w{i} " * (i % 7 + 1), "ab"[i % 2]) for i in range(120)] + [(7, f"v{i}", "a") for i in range(60)]
    docs = dressed(documents(*rows))
    mixed = mixing.mixed_documents(docs, shard_rows=16)
    assert mixed.columns == docs.columns
    taken = mixed.collect()
    assert same_extras(taken) and len(taken) == mixing.mix(docs, shard_rows=16).agg(F.sum("copies")).first()[0]


def test_packing_pieces_with_any_columns(documents):
    made = documents((1, "a"), (None, "b"), (None, "c"))
    whole = {"start": F.lit(0).cast("long"), "length": F.lit(700).cast("long"), "ids_crc32": F.crc32("text"), "my col-x": F.lit(1)}
    pieces = made.select("doc_id", F.lit(0).alias("piece"), *[c.alias(n) for n, c in whole.items()])
    rows = packing.pack(pieces, levels=1).collect()
    assert len({r.sequence_id for r in rows}) == 3 and all(r["my col-x"] == 1 for r in rows)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_every_stage_takes_every_row(spark, docs, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "")
    rows = out.collect()
    assert rows and public_tokenizers
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and same_extras(rows)
