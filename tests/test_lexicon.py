import math
import re

import pytest

from opinionmill.operators import lexicon, relational

VALENCE = {"good": 1.9, "great": 3.1, "bad": -2.5, "love": 3.2, "hate": -2.7, "kind": 2.4, "death": -2.9, "like": 1.5}


def brute(text):
    """The published rules, one text at a time."""
    boost = {**dict.fromkeys(lexicon.BOOSTERS, 0.293), **dict.fromkeys(lexicon.DAMPENERS, -0.293)}
    words = [w for w in text.split() if len(w) > 1]
    edge = re.compile(lexicon._EDGE)
    words = [(m.group(1) or m.group(2)) if (m := edge.match(w)) else w for w in words]
    if not words:
        return (0.0, 0.0, 0.0, 0.0)
    negated = lambda w: w in lexicon.NEGATORS or "n't" in w
    scores = []
    for word in words:
        i = words.index(word)
        if word in boost or (word == "kind" and words[i + 1 : i + 2] == ["of"]) or word not in VALENCE:
            scores.append(0.0)
            continue
        v = VALENCE[word]
        for k in (1, 2, 3):
            if i < k or words[i - k] in VALENCE:
                continue
            b = boost.get(words[i - k], 0.0) * lexicon.DAMPING[k]
            v += -b if v < 0 else b
            if k == 2 and words[i - 2] == "never" and words[i - 1] in ("so", "this"):
                v *= 1.5
            elif k == 3 and ((words[i - 3] == "never" and words[i - 2] in ("so", "this")) or words[i - 1] in ("so", "this")):
                v *= 1.25
            elif negated(words[i - k]):
                v *= -0.74
            if k == 3:
                pieces = words[i - 3 : i + 3]
                spans = [pieces[2:4], pieces[1:4], pieces[1:3], pieces[0:3], pieces[0:2]]
                hits = [lexicon.IDIOMS[" ".join(s)] for s in spans if " ".join(s) in lexicon.IDIOMS]
                v = hits[0] if hits else v
                for n in (2, 3):
                    if len(pieces[3:]) >= n and " ".join(pieces[3 : 3 + n]) in lexicon.IDIOMS:
                        v = lexicon.IDIOMS[" ".join(pieces[3 : 3 + n])]
                if {" ".join(pieces[0:2]), " ".join(pieces[1:3])} & set(lexicon.DAMPENER_PAIRS):
                    v -= 0.293
        if i > 0 and words[i - 1] == "least" and not (i > 1 and words[i - 2] in ("at", "very")):
            v *= -0.74
        scores.append(v)
    if "but" in words:
        at = words.index("but")
        scores = [s * (0.5 if j < at else 1.5 if j > at else 1) for j, s in enumerate(scores)]
    q = text.count("?")
    amp = min(text.count("!"), 4) * 0.292 + (0 if q <= 1 else q * 0.18 if q <= 3 else 0.96)
    total = sum(scores)
    total += amp if total > 0 else -amp if total < 0 else 0
    pos = sum(s + 1 for s in scores if s > 0)
    neg = sum(s - 1 for s in scores if s < 0)
    neu = sum(s == 0 for s in scores)
    if pos > -neg:
        pos += amp
    elif pos < -neg:
        neg -= amp
    mass = pos - neg + neu
    return (-neg / mass, neu / mass, pos / mass, total / math.sqrt(total * total + 15))


TEXTS = [
    "", "a", "nothing known here", "good", "very good", "very much good", "really very so good", "not good",
    "it was not very good", "they do not not like it", "good but bad", "bad and good but very good, good!", "good!!!!! great", "bad ??", "bad ????",
    "never so good", "never this very good", "he is so good", "was all of it so good", "kind of good", "it was kind of good here", "kind words",
    "at least good", "the least good", "very least good", "good good not good", "slightly bad", "extremely bad", "great bad", "(good)", "'good'", "good...",
    "don't like it", "can't say good", "this is the kiss of death", "sort of like the bad ass", "good bad good", "- good -", "very bad but not so bad !",
    "we just enough like it", "love, hate; like: kind", "hardly good. barely bad!?", "I never so much love it", "without any real love",
]


def test_polarity_against_the_rules(spark):
    frame = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(TEXTS)], "doc_id long, review string")
    valence = spark.createDataFrame(list(VALENCE.items()), "word string, valence double")
    rows = lexicon.polarity(frame, valence).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = brute(TEXTS[r.doc_id].lower())
        got = (r.lex_neg, r.lex_neu, r.lex_pos, r.lex_compound)
        assert got[:3] == pytest.approx(want[:3], abs=6e-4), TEXTS[r.doc_id]
        assert got[3] == pytest.approx(want[3], abs=6e-5), TEXTS[r.doc_id]
        assert -1 <= got[3] <= 1 and (sum(got[:3]) == pytest.approx(1, abs=2e-3) or not any(got[:3]))


def test_longest_phrase_wins_and_covers_its_words(spark):
    phrases = spark.createDataFrame(
        [("good", 3), ("not good", -2), ("can't stand", -3), ("stand", 1), ("does not work", -3), ("not working", -3)], "phrase string, score int"
    )
    texts = ["good", "not good", "not good good", "i can't stand it, stand!", "does not work", "does not working", "goodness", "not  good", "", "not, good"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, review string")
    rows = {r.doc_id: (r.lex_sum, r.lex_sum_norm) for r in lexicon.valence_sum(frame, phrases).collect()}
    assert [rows[i][0] for i in range(len(texts))] == [3, -2, 1, -2, -3, -3, 0, 3, 0, 3]
    assert rows[2][1] == pytest.approx(1 / 3) and rows[8][1] == 0


def test_emotion_means(spark):
    entries = [("dog", "joy", 1), ("dog", "joy", 1), ("dog", "fear", 0), ("war", "fear", 1), ("none", "joy", 0)]
    table = lexicon.emotion_table(spark.createDataFrame(entries, "word string, emotion string, value int"), ["fear", "joy"])
    assert sorted(map(tuple, table.collect())) == [("dog", 0.0, 1.0), ("war", 1.0, 0.0)]
    frame = spark.createDataFrame([(0, "dog dog war x"), (1, "dog, war."), (2, ""), (3, "none")], "doc_id long, review string")
    rows = {r.doc_id: (r.emo_fear, r.emo_joy) for r in lexicon.emotion_means(frame, table, ["fear", "joy"]).collect()}
    assert rows == {0: (0.25, 0.5), 1: (0.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    real = spark.createDataFrame([("dog", "valence", 0.7), ("war", "valence", 0.1)], "word string, emotion string, value double")
    wide = lexicon.emotion_table(real, ["valence"], flag=False)
    means = lexicon.emotion_means(frame, wide, ["valence"], prefix="vad_")
    assert means.where("doc_id = 0").first().vad_valence == pytest.approx(1.5 / 4)


def test_threshold_rules(spark):
    frame = spark.createDataFrame([(0, 0.0), (1, 0.1), (2, -0.1)], "doc_id long, lex_compound double")
    strict = [r.prediction for r in lexicon.classify(frame).orderBy("doc_id").collect()]
    loose = [r.prediction for r in lexicon.classify(frame, strict=False).orderBy("doc_id").collect()]
    assert strict == [0, 1, 0] and loose == [1, 1, 0]


def test_scoring_shuffles_no_text(spark):
    frame = spark.createDataFrame([(0, "good")], "doc_id long, review string")
    valence = spark.createDataFrame(list(VALENCE.items()), "word string, valence double")
    plan = lexicon.polarity(frame, valence)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "Window" not in plan


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_words_outside_the_lexicon_make_no_rows(spark, monkeypatch):
    texts = ["a good thing, not bad!", "(good) 'good' good... :good", "nothing here", "", None, "x " * 3000 + "not  good"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, review string")
    valence = spark.createDataFrame(list(VALENCE.items()), "word string, valence double")
    phrases = spark.createDataFrame([("good", 3), ("not good", -2), ("thing", 1)], "phrase string, score int")
    found = {}
    for most in (lexicon.known_words.__defaults__[0], 1):
        monkeypatch.setattr(lexicon, "known_words", lambda table, word, most=most: relational.known_words(table, word, most))
        parts = lexicon.polarity(df, valence), lexicon.valence_sum(df, phrases)
        found[most] = [sorted(map(tuple, part.collect())) for part in parts]
        if most > 1:
            assert "IN (" in plan_of(parts[0]) and "IN (" in plan_of(parts[1])
    assert len(set(map(str, found.values()))) == 1


def test_edges_of_tokens_inside_a_text(spark):
    row = spark.createDataFrame([("Good, !!bad 'x' 'ok a. :) ...hm?!? he's ok?? fine?!? last\x1cEND.",)], "t string")
    assert row.select(lexicon.polarity_tokens("t")).first()[0] == [
        "good", "bad", "'x'", "ok", "a.", ":)", "...hm?!?", "he's", "ok", "fine", "last", "end"
    ]
