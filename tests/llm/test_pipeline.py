"""The five stages, each against brute force on its own input."""

import random

import corpus_pipeline
from opinionmill.llm import quality

from test_text_operators import SPLIT, plain_components, plain_removal, prose


def corpus(documents):
    rng = random.Random(31)
    filler = ["the", "and", "of", "to"]

    def clean(n):
        return " ".join(rng.choice(filler) if rng.random() < 0.3 else f"word{rng.randrange(500)}" for _ in range(n))

    passage = clean(30)
    texts = [(i, clean(rng.randrange(60, 200)), rng.choice("abc")) for i in range(40)]
    texts += [(100 + i, f"{clean(60)}\n{passage}\n{clean(40)}", "a") for i in range(6)]
    texts += [(200 + i, texts[i][1], "b") for i in range(5)]
    texts += [(300, None, "a"), (301, "", None), (302, "short", "c"), (303, " | ".join(["x"] * 90), "a")]
    return documents(*texts)


def test_stages_one_after_another(spark, documents):
    docs = corpus(documents).cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "mixed sources", "packed sequences"]
    columns = docs.columns
    good = corpus_pipeline.quality_rules(spark, docs, "").cache()
    judged = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == judged and {300, 301, 302, 303}.isdisjoint(judged)
    texts = [(r.doc_id, r.text) for r in good.collect()]
    one = corpus_pipeline.near_duplicates(spark, good, "").cache()
    assert {r.doc_id for r in one.collect()} == {d for d, (_, _, kept) in plain_components(texts).items() if kept}
    before = {r.doc_id: r for r in one.collect()}
    cut = corpus_pipeline.repeated_passages(spark, one, "").cache()
    want = plain_removal([(d, r.text) for d, r in before.items()], 13)
    for r in cut.collect():
        assert len(SPLIT.findall(r.text)) == want[r.doc_id][0] - want[r.doc_id][1]
        assert r.n_chars == len(r.text)
        if not want[r.doc_id][1]:
            assert r == before[r.doc_id]
    mixed = corpus_pipeline.mixed_sources(spark, cut, "").cache()
    assert good.columns == one.columns == cut.columns == mixed.columns == columns
    packed = corpus_pipeline.packed_sequences(spark, mixed, "").toPandas()
    assert sorted(packed[packed["piece"] == 0]["doc_id"]) == sorted(r.doc_id for r in mixed.collect())
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert prose(random.Random(1), 2)


def test_stages_take_an_empty_table(spark, documents):
    docs = documents((1, "a")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
