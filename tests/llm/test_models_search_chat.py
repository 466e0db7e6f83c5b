"""Models on held-out rows, search against brute force, chat round trips."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from opinionmill.llm import chat, langid, lm, topk, toxicity


def test_top_k_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-6, 7, 10).tolist()) for i in range(300)] + [(301, rng.integers(-6, 7, 4).tolist())]
    vectors = spark.createDataFrame([*rows, rows[5]], "id long, v array<long>")
    found = topk.top_k(vectors, F.col("id") % 20 == 0).collect()
    full = {i: np.array(v + [0] * (10 - len(v))) for i, v in rows}
    for q in range(0, 301, 20):
        if q in full:
            best = sorted(((-int(full[q] @ v), i) for i, v in full.items() if i != q))[:5]
            assert [(r.score, r.vec_id) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [(-s, i) for s, i in best]


def test_top_k_with_few_rows_and_unusable_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, None]), (100, [float("nan"), 1.0]), (7, None), (3, [float("inf"), 0.0]), (9, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, e array<float>").where(topk.usable(F.col("e")))
    vectors = table.select(F.col("vec_id").alias("id"), topk.whole_numbers(F.col("e")).alias("v"))
    assert [tuple(r) for r in topk.top_k(vectors, F.col("id") % 50 == 0).collect()] == [(0, 1, 9, 256 * 256)]
    assert topk.top_k(vectors.limit(0), F.col("id") % 50 == 0).count() == 0


def test_chat_round_trip_of_hostile_texts():
    rng = random.Random(9)
    alphabet = ["\\", "n", "\n", "<", "|", "[", "é", *chat.CONTROLS, "<\\|im_end|>", "</s>[INST] ok [/INST]"]
    for _ in range(300):
        turns = [("".join(rng.choices(alphabet, k=3)), "".join(rng.choices(alphabet, k=rng.randrange(9)))) for _ in range(rng.randrange(1, 5))]
        turns.append(("assistant", "".join(rng.choices(alphabet, k=6))))
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROLS)


def test_event_fold(spark):
    log = [
        (1, "m1", 1, "message", "user", "hi"),
        (1, "m2", 2, "message", "assistant", ""), (1, "m2", 4, "delta", None, "lo"), (1, "m2", 3, "delta", None, "hel"),
        (1, "m3", 5, "message", "user", "typo"), (1, "m3", 9, "edit", None, "fixed"), (1, "m3", 10, "delta", None, "!"),
        (1, "m4", 6, "message", "assistant", "bad"), (1, "m4", 7, "regenerate", None, None), (1, "m4", 8, "delta", None, "good"),
        (1, "m5", 11, "message", "user", "gone"), (1, "m5", 12, "delete", None, None),
        (None, "m6", 1, "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, message string, seq long, kind string, role string, text string")
    read = chat.read_back(chat.format_conversations(chat.fold_events(events))).collect()
    found = {r.conv_id: list(zip(r.roles, r.texts)) for r in read}
    assert found[1] == [("user", "hi"), ("assistant", "hello"), ("user", "fixed!"), ("assistant", "good")]
    assert found[None] == [("", "")]
    assert {r.conv_id: r.loss_texts for r in read}[1] == ["hello", "good"]


def test_turns_become_a_log_and_back(spark):
    rows = [(1, 0, "user", "x" * 1300), (1, 1, "assistant", None), (1, 1, "assistant", "tie"), (1, None, "system", "first"), (2, 0, None, "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    read = chat.read_back(chat.format_conversations(chat.fold_events(chat.log_of_turns(table)))).collect()
    found = {r.conv_id: list(zip(r.roles, r.texts)) for r in read}
    assert found == {1: [("system", "first"), ("user", "x" * 1300), ("assistant", ""), ("assistant", "tie")], 2: [("", "")]}
    assert chat.format_conversations(chat.fold_events(chat.log_of_turns(table.limit(0)))).count() == 0


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() + [None]


def test_language_model_matches_plain_counts(documents):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "Never SEEN w1"), (3, rows[3][1])]
    held = {d: d % 5 == 1 for d, _ in rows}
    found = lm.score_texts(documents(*rows).withColumn("block", F.lit("clash")), F.col("doc_id") % 5 == 1).collect()
    c, pairs = Counter(), defaultdict(Counter)
    for d, t in rows:
        if not held[d]:
            before = "<s>"
            for w in tokens(t):
                c[w] += 1
                pairs[before][w] += 1
                before = w
    n, v = sum(c.values()), len(c)
    by_doc = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        own = tokens(by_doc[r.doc_id])
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    assert sum(r.score for r in found if not r.held_out) > sum(r.base_score for r in found if not r.held_out)


def test_trie_probabilities_and_mass_sum_to_one(tmp_path):
    rng = np.random.default_rng(17)
    nodes = np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    pairs = np.unique(rng.integers(0, 53 * 400, 3000))
    context, following = pairs // 400, (pairs % 400).astype(np.uint64) << np.uint64(40)
    count = rng.geometric(0.5, len(pairs))
    d = lm.discounts(count)[np.minimum(count, 3)]
    assert (d > 0).all() and (d < count).all()
    of_context = np.bincount(context, weights=count, minlength=53)
    trie = lm.Trie(str(tmp_path), nodes, 53 - len(nodes), context, following, (count - d) / of_context[context])
    assert (trie.word(nodes) == np.arange(len(nodes))).all()
    p = lm.probability_of(trie.probability(context, following))
    mass = np.bincount(context, weights=d, minlength=53) / of_context
    assert np.allclose(np.bincount(context, weights=p, minlength=53) + mass, 1, atol=1e-3)
    absent = np.setdiff1d(np.arange(53 * 400), pairs)
    assert not trie.probability(absent // 400, (absent % 400).astype(np.uint64) << np.uint64(40)).any()
    assert not trie.probability(context, following + np.uint64(1)).any()


def test_language_model_without_training_rows(documents):
    found = lm.score_texts(documents((1, "a b"), (2, None)), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in found)
    assert lm.score_texts(documents((1, "a")).limit(0), F.lit(True)).count() == 0


LANGS = {"en": "the of and river stone that with house".split(), "de": "der die und fluß stein daß mit häuser".split()}


def test_languages_of_words_and_texts(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choices(LANGS[k], k=40)), k) for i, k in enumerate(["en", "de"] * 40)]
    mixed = " ".join(rng.choices(LANGS["en"], k=30) + rng.choices(LANGS["de"], k=50))
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, mixed, None), (903, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in langid.label_languages(docs, F.col("doc_id") % 4 != 2, with_runs=True).collect()}
    assert all(found[i].lang_pred == k for i, _, k in rows[:80])
    assert [(found[i].lang_pred, found[i].score) for i in (900, 901, 903)] == [("und", 0.0)] * 3
    assert found[902].lang_pred == "de" and 0 <= found[902].score <= 1
    assert [(r.start, r.stop, r.lang) for r in found[902].runs] == [(0, 30, "en"), (30, 80, "de")]
    none = langid.label_languages(docs, F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.label_languages(docs.limit(0), F.lit(True)).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(5)
    scores, moves = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    marginal, pairs = langid.forward_backward(scores, np.array([3]), moves, pairs=True)
    want, total, expected = np.zeros((3, 2)), 0.0, np.zeros((2, 2))
    for path in np.ndindex(2, 2, 2):
        p = math.exp(sum(scores[0, t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, k in enumerate(path):
            want[t, k] += p
        for a, b in zip(path, path[1:]):
            expected[a, b] += p
    assert np.allclose(marginal[0, :3], want / total) and np.allclose(pairs, expected / total)


def test_toxic_sentence_in_a_long_text_and_a_misspelling(spark):
    rng = random.Random(15)
    plain, bad = [f"calm{i}" for i in range(60)], ["scoundrel", "nastywords", "vilething"]
    rows, labels = [], []
    for i in range(240):
        words_ = rng.choices(plain, k=rng.randrange(20, 120))
        if i % 4 == 0:
            words_.insert(rng.randrange(len(words_)), rng.choice(bad))
        rows.append((i, " ".join(words_)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, " ".join(rng.choices(plain, k=2000) + ["scoundrel"])), (901, None), (902, ""), (903, "calm1 calm2 scoundrell calm3 calm9 calm8 calm7 calm5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (1, None), (5, 0)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks, F.col("doc_id") % 5 != 0).collect()}
    held = [i for i in range(240) if i % 5 == 0]
    assert np.mean([found[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert found[900].predicted == 1 and found[903].score > found[902].score
    assert found[901].score == found[902].score and found[901].predicted == 0
    alone = toxicity.score_toxicity(docs, marks.where("toxic = 0"), F.lit(True)).collect()
    assert all(0 <= r.score < 0.5 for r in alone)
    assert toxicity.score_toxicity(docs.limit(0), marks, F.lit(True)).count() == 0


def test_best_windows():
    values, first = np.array([1.0] * 10 + [0, 9.0] + [0.0] * 3), np.array([0, 0, 10, 12, 15])
    top, begin = toxicity.best_windows(values, first)
    assert top.tolist() == [0.0, 1.0, 4.5, 0.0] and begin[2] == 10
    assert pa.array(top).null_count == 0


def test_long_texts_of_one_language_take_no_chains_of_another():
    lang = np.repeat([0, 1], [900, 30])
    number = np.append(np.repeat(np.arange(90), 10), np.zeros(30, np.int64))
    some = langid.chosen_chains(lang, number, 50, np.random.default_rng(1))
    assert sorted(lang[some].tolist()) == [0] * 50 + [1] * 30
    assert sorted(number[some][lang[some] == 0].tolist()) == sorted(list(range(5)) * 10)
    assert len(langid.chosen_chains(lang, number, 16_000, np.random.default_rng(1))) == 930
