"""Words, quality rules, substrings and near-duplicates against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinionmill.llm import neardup, quality, substrings, words
from opinionmill.llm.elias_fano import EliasFano

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_words_are_runs_outside_the_six_blanks():
    texts = ["", None, "  a\tb\x0bc\x0c d\r\n", "é ß x", "x", "ÀB Cd"]
    for lower in (False, True):
        codes, distinct, first = words.coded(pa.array(texts), lower)
        found = [[distinct[c].as_py().decode() for c in codes[a:b]] for a, b in zip(first[:-1], first[1:])]
        plain = [SPLIT.findall("".join(c.lower() if lower and "A" <= c <= "Z" else c for c in t or "")) for t in texts]
        assert found == plain


def test_slices_keep_all_rows_and_long_texts_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "", "b" * 3, "c" * 9])], ["text"])
    parts = list(words.sliced(iter([batch]), "text", 10))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert [p.num_rows for p in parts][0] == 1


@pytest.mark.parametrize("n, universe", [(0, 9), (1, 1), (500, 40), (3000, 1 << 40), (3000, 1 << 64)])
def test_elias_fano_successor(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
    asked = np.append(values, rng.integers(0, universe - 1, 200, dtype=np.uint64, endpoint=True))
    place, hit = EliasFano.of(values, universe).successor(asked)
    assert (place == np.searchsorted(values, asked)).all()
    assert (hit == np.isin(asked, values)).all()


def plain_repeat_words(text):
    w = SPLIT.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)})


def test_quality_counts_match_plain_python(documents):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a b c a b c", "a a a a", "x\nx\n\nx\n y", "§ é# **$", prose(rng, 120, 6), prose(rng, 3)]
    got = rows_of(quality.judge(documents(*enumerate(texts))))
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = SPLIT.findall(t), [x for x in t.split("\n") if SPLIT.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.n_repeat_words == plain_repeat_words(t)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_verdicts_and_clashing_columns(documents):
    rng = random.Random(5)
    clean = " ".join(rng.choice(["the", "and", "of", "quiet", "river", "stones", "under", "lamp", f"word{i}"]) for i in range(90))
    docs = documents((1, clean), (2, " | ".join(clean.split())), (3, clean.replace(" ", "### ")), (1, clean))
    docs = docs.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(7))
    kept = quality.keep_good(docs).collect()
    assert [(r.doc_id, r.n_words, r.kept) for r in kept] == [(1, "mine", 7)] * 2
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_quality_runs_no_python(documents):
    plan = quality.judge(documents((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def plain_removal(texts, width):
    """``{doc_id: (n_words, n_removed, sha256)}`` from ``[(doc_id, text)]``."""
    owner = {}
    tokens = [(d, SPLIT.findall(t or "")) for d, t in texts]
    for d, w in tokens:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            owner[g] = min(owner.get(g, d), d)
    out = {}
    for d, w in tokens:
        gone = {j for i in range(len(w) - width + 1) if owner[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substrings_match_plain_python(documents):
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(8)]
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(20, base[0]), (21, base[1][:200] + " " + prose(rng, 30)), (22, None), (23, ""), (24, "one two"), (25, base[2] + " " + base[2])]
    texts += [(26, prose(rng, 5) + "\n\n" + " ".join(base[3].split()[10:40]) + "\tend."), (27, "x " * 400), (28, "x " * 200)]
    rng.shuffle(texts)
    docs = documents(*texts).withColumn("n_words", F.lit("clash"))
    found = rows_of(substrings.remove_repeats(docs))
    want = plain_removal(texts, 13)
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in found.items()} == want
    for d, r in found.items():
        assert sum(x.stop - x.start for x in r.removed) == r.n_removed
        assert hashlib.sha256(" ".join(SPLIT.findall(r.kept_text or "")).encode()).hexdigest() == r.kept_sha256
        if not r.n_removed:
            assert r.kept_text == r.text


def test_substrings_null_ids_repeated_rows_and_empty_table(documents):
    text = " ".join(f"t{i}" for i in range(20))
    found = substrings.remove_repeats(documents((None, text), (5, text), (5, text), (6, text))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (5, 0), (5, 0), (6, 20)]
    assert substrings.remove_repeats(documents((1, "a")).limit(0)).count() == 0


def shingles(text):
    w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_components(texts):
    sets, label = {d: shingles(t) for d, t in texts}, {d: d for d, _ in texts}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d], label[d] == d) for d in sets}


def test_near_duplicates_match_plain_python(documents):
    rng = random.Random(23)
    texts = [(1000 + i, prose(rng, 80)) for i in range(10)]
    for k in range(90):
        base = texts[rng.randrange(10)][1].split()
        for _ in range(rng.randrange(0, 4)):
            base[rng.randrange(len(base))] = f"new{rng.randrange(9999)}"
        texts.append((k, " ".join(base)))
    texts += [(500, None), (501, ""), (502, "Short Text"), (503, "short text"), (504, "other text"), (505, "SHORT text")]
    rng.shuffle(texts)
    found = rows_of(neardup.near_duplicates(documents(*texts).withColumn("component_id", F.lit("clash"))))
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in found.items()} == plain_components(texts)


def test_near_duplicates_repeated_rows_null_ids_and_empty_table(documents):
    docs = documents((7, "one two three four five six"), (7, "one two three four five six"), (None, "one two three four five six"))
    found = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, True), (7, 7, True), (7, 7, True)]
    assert neardup.keep_one(docs).count() == 2
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [16, neardup.EDGES_AT_ONCE])
def test_components_of_a_long_path_and_a_star(spark, at_once, monkeypatch):
    """Both in one block and in many, where stars of single blocks must still be joined."""
    monkeypatch.setattr(neardup, "EDGES_AT_ONCE", at_once)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    found = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[100 + i] == 100 for i in range(1, 30))


def boilerplate_pages(n_pairs, n_shared=430, n_own=80):
    """Pages of one template with similarity 0.72 to each other; pages 2 k and 2 k + 1 are real links at 0.776."""
    shared = [f"s{i}" for i in range(n_shared)]
    pages = []
    for k in range(n_pairs):
        for side in (0, 1):
            own = [f"p{k}x{i}" if i < 20 else f"p{k}x{i}side{side}" for i in range(n_own)]
            pages.append((2 * k + side, " ".join(shared + own)))
    return pages


def test_near_duplicates_in_a_template_larger_than_the_window(documents):
    texts = boilerplate_pages(400)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in texts[:3]]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.75 > len(sets[0] & sets[2]) / len(sets[0] | sets[2]) > 0.7
    found = rows_of(neardup.near_duplicates(documents(*texts)))
    assert all(found[d].component_id == d - d % 2 for d, _ in texts)


def test_remaining_pairs_match_plain_python_also_in_cells(spark, monkeypatch):
    rng = random.Random(5)
    templates = [prose(rng, 120).split() for _ in range(3)]
    rows = []
    for d in range(150):
        base = list(rng.choice(templates)) + prose(rng, rng.randrange(0, 25), 10**6).split()
        for _ in range(rng.randrange(0, 6)):
            base[rng.randrange(len(base))] = f"new{rng.randrange(99999)}"
        rows.append((d, d // 4, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc long, group long, text string")
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, _, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and a // 4 != b // 4 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    for hot in (4096, 7):
        monkeypatch.setattr(neardup, "HOT_ROWS", hot)
        found = neardup.remaining(docs)
        assert alike and {tuple(r) for r in neardup.confirmed(found, docs).collect()} == alike


def test_near_duplicates_need_no_later_round(documents):
    texts = boilerplate_pages(120)
    found = rows_of(neardup.near_duplicates(documents(*texts), rounds=1))
    assert all(found[d].component_id == d - d % 2 for d, _ in texts)


def test_rows_on_both_sides_of_a_partition_border_are_marked(spark):
    key = bytearray(range(2 * neardup.HASHES))
    rows = [(0, key, i, i) for i in range(4)]
    one = neardup.proposals(spark.createDataFrame(rows, "tree int, key binary, rep long, group long").coalesce(1))
    two = neardup.proposals(spark.createDataFrame(rows, "tree int, key binary, rep long, group long").repartition(2))
    every = {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert {tuple(r) for r in one.where("a <> b").collect()} == every
    assert {r.a for r in two.where("a = b").collect()} == set(range(4))
