"""Lexicon scores as token joins: rule-based polarity, valence sums, emotion means.

Every scorer explodes the tokens of a text, keeps those found in a lexicon table and
aggregates per document. Partial aggregation leaves one small row per document and task, so
texts are never shuffled. Lexicons are arguments; none is bundled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinionmill.functions.text import count_char, whitespace_tokens, word_count
from opinionmill.operators.relational import known_words, literal_table, lookup_join, settled

# The published constants of the rule-based polarity model (Hutto & Gilbert 2014).
BOOST = 0.293
DAMPING = {1: 1.0, 2: 0.95, 3: 0.9}
NEGATION = -0.74
NEVER_SO_NEAR, NEVER_SO_FAR = 1.5, 1.25
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
EXCLAMATION, EXCLAMATION_LIMIT = 0.292, 4
QUESTION, QUESTION_LIMIT, QUESTION_MANY = 0.18, 3, 0.96
NORMALISER = 15.0

# Single-word boosters, dampeners and negators of the same model.
BOOSTERS = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely "
    "especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin "
    "fully fucking greatly hella highly hugely incredibly intensely majorly more most particularly "
    "purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably "
    "unusually utterly very"
).split()
DAMPENERS = (
    "almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely "
    "slightly somewhat sorta sortof sort-of"
).split()
DAMPENER_PAIRS = ("just enough", "kind of", "sort of")
NEGATORS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't "
    "doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't "
    "mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt "
    "uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't "
    "wouldn't rarely seldom despite"
).split()
# Idioms that replace the valence of the word they end or start with.
IDIOMS = {
    "the shit": 3.0,
    "the bomb": 3.0,
    "bad ass": 1.5,
    "yeah right": -2.0,
    "cut the mustard": 2.0,
    "kiss of death": -1.5,
    "hand to mouth": -2.0,
}
# The punctuation that may sit before or after a bare word.
EDGE_PUNCTUATION = r"""[.!?,;:\-'"]|!!!?|\?\?\??|\?!\?|!\?!|\?!\?!|!\?!\?"""

_BARE_WORD = r"[^\s\x1C-\x1F!-/:-@\[-`{-~]{2,}+"
_EDGE = rf"(?:{EDGE_PUNCTUATION})({_BARE_WORD})|({_BARE_WORD})(?:{EDGE_PUNCTUATION})"
# Tokens are matched inside their text: one match over it is much cheaper than one per token.
_EDGES_IN_TEXT = rf"(?U)(?<![^\s\x1C-\x1F])(?:{_EDGE})(?![^\s\x1C-\x1F])"
_EDGE = rf"^(?:{_EDGE})$"
MODIFIER_SCHEMA = "word string, booster double, negator boolean"


def default_modifiers(spark: SparkSession) -> DataFrame:
    """``(word, booster, negator)`` of the published rule set."""
    rows = [(w, BOOST, False) for w in BOOSTERS] + [(w, -BOOST, False) for w in DAMPENERS]
    rows += [(w, 0.0, True) for w in NEGATORS]
    return literal_table(spark, rows, MODIFIER_SCHEMA)


def polarity_tokens(text: Column | str) -> Column:
    """White-space tokens of two or more characters, one piece of edge punctuation removed."""
    edges_off = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _EDGES_IN_TEXT, "$1$2")
    return F.transform(F.filter(whitespace_tokens(edges_off), lambda t: F.char_length(t) > 1), F.lower)


def _in_context(hits: DataFrame, idioms: Mapping[str, float]) -> DataFrame:
    """Add ``_v``: the valence of each occurrence after its predecessors and idioms had their say.

    One projection per distance keeps every step a short expression.
    """
    p = {k: F.col(f"p{k}") for k in (1, 2, 3)}
    so_this = {k: F.coalesce(p[k].isin("so", "this"), F.lit(False)) for k in (1, 2)}
    out = hits.withColumn("_v", F.col("valence").cast("double"))
    value = F.col("_v")
    for k in (1, 2, 3):
        applies = p[k].isNotNull() & ~F.coalesce(F.col(f"scored{k}"), F.lit(False))
        booster = F.coalesce(F.col(f"booster{k}"), F.lit(0.0)) * F.lit(DAMPING[k])
        boosted = value + F.when(value < 0, -booster).otherwise(booster)
        negated = F.coalesce(F.col(f"negator{k}"), F.lit(False)) | p[k].contains("n't")
        factor = F.when(negated, NEGATION).otherwise(1.0)
        if k == 2:
            factor = F.when((p[2] == "never") & so_this[1], NEVER_SO_NEAR).otherwise(factor)
        elif k == 3:
            factor = F.when(((p[3] == "never") & so_this[2]) | so_this[1], NEVER_SO_FAR).otherwise(factor)
        out = out.withColumn("_v", F.when(applies, boosted * factor).otherwise(value))
    applies = p[3].isNotNull() & ~F.coalesce(F.col("scored3"), F.lit(False))
    out = out.withColumn("_v", F.when(applies, _idiom_check(value, p, idioms)).otherwise(value))
    least = (p[1] == "least") & ~F.coalesce(F.col("scored1"), F.lit(False))
    softened = F.coalesce(p[2].isin("at", "very"), F.lit(False))
    return out.withColumn("_v", F.when(least & ~softened, value * NEGATION).otherwise(value))


def _idiom_check(value: Column, p: Mapping[int, Column], idioms: Mapping[str, float]) -> Column:
    """The value of an idiom around the word, else ``value``; less one step after a dampener pair.

    Every sequence of words is put together once and ``value`` is named once: nested
    alternatives over it would multiply the work per word.
    """
    word, n1, n2 = F.col("word"), F.col("n1"), F.col("n2")
    join = lambda *words: F.concat_ws(" ", *words)
    ahead = [F.when(n2.isNotNull(), join(word, n1, n2)), F.when(n1.isNotNull(), join(word, n1))]
    back = [join(p[1], word), join(p[2], p[1], word), join(p[2], p[1]), join(p[3], p[2], p[1]), join(p[3], p[2])]
    if idioms:
        first = F.get(F.filter(F.array(*ahead, *back), lambda s: s.isin(*idioms)), F.lit(0))
        table = F.create_map(*[F.lit(x) for item in idioms.items() for x in (item[0], float(item[1]))])
        value = F.coalesce(F.try_element_at(table, first), value)
    pair = join(p[3], p[2]).isin(*DAMPENER_PAIRS) | join(p[2], p[1]).isin(*DAMPENER_PAIRS)
    return value - F.when(pair, BOOST).otherwise(0.0)


def _places(words: str, entry: Callable[[Column, Column], Column], keep: Callable[[Column], Column]) -> Column:
    """``entry(word, place)`` of the words to ``keep``; nothing is built for the others."""
    return F.filter(F.transform(words, lambda word, i: F.when(keep(word), entry(word, i))), lambda e: e.isNotNull())


def polarity(
    df: DataFrame,
    valence: DataFrame,
    modifiers: DataFrame | None = None,
    text: str = "review",
    key: str = "doc_id",
    idioms: Mapping[str, float] = IDIOMS,
) -> DataFrame:
    """``(doc_id, lex_neg, lex_neu, lex_pos, lex_compound)`` by the published rules.

    ``valence`` is ``(word, valence)``, ``modifiers`` ``(word, booster, negator)``. As in the
    common implementation, every repeat of a word takes the context of its first occurrence,
    while the "but" weighting uses each repeat's own place. Upper-case emphasis is left out:
    reviews are lower-cased before scoring.
    """
    modifiers = default_modifiers(df.sparkSession) if modifiers is None else modifiers
    tokenised = df.select(
        key,
        polarity_tokens(text).alias("_t"),
        count_char(text, "!").alias("_ep"),
        count_char(text, "?").alias("_qm"),
    )

    def entry(at: Column, word: Column, before: dict, after: dict) -> Column:
        parts = {f"p{k}": v for k, v in before.items()} | {f"n{k}": v for k, v in after.items()}
        return F.struct(at.alias("at"), word.alias("word"), *[v.alias(name) for name, v in parts.items()])

    none = F.lit(None).cast("string")
    # Every text also yields one empty word, which the lookup lists with valence 0. It keeps texts
    # without any hit, so counts and scores come from one pass over the text.
    marker = entry(F.lit(-1), F.lit(""), dict.fromkeys((1, 2, 3), none), dict.fromkeys((1, 2), none))
    # Words of a lexicon that is not too long are told apart here, so that only hits become rows.
    listed_words = known_words(valence, "word")
    occurrences = _places(
        "_t",
        lambda word, i: entry(
            i, word, {k: F.get("_t", i - k) for k in (1, 2, 3)}, {k: F.get("_t", i + k) for k in (1, 2)}
        ),
        lambda word: F.lit(True) if listed_words is None else word.isin(listed_words),
    )
    words = tokenised.select(
        key,
        F.size("_t").alias("_n"),
        "_ep",
        "_qm",
        F.array_position("_t", F.lit("but")).alias("_but"),
        F.inline(F.concat(F.array(marker), occurrences)),
    )
    blank = literal_table(df.sparkSession, [("", 0.0)], "word string, valence double")
    listed = valence.select("word", F.col("valence").cast("double").alias("valence")).unionByName(blank)
    hits = lookup_join(words, listed, "word", "inner")

    around = (
        modifiers.select("word", "booster", "negator")
        .join(valence.select("word", F.lit(True).alias("scored")), "word", "full")
        .select("word", F.coalesce("booster", F.lit(0.0)).alias("booster"), F.coalesce("negator", F.lit(False)).alias("negator"), F.coalesce("scored", F.lit(False)).alias("scored"))
    )
    around, small = settled(around)
    boosting = around.where(F.col("booster") != 0).select("word", F.lit(True).alias("_booster"))
    hits = lookup_join(hits, boosting, "word", "left", small=small).where(F.col("_booster").isNull())
    hits = hits.where(~((F.col("word") == "kind") & F.coalesce(F.col("n1") == "of", F.lit(False))))
    for k in (1, 2, 3):
        renamed = around.select(*[F.col(c).alias(f"p{k}" if c == "word" else f"{c}{k}") for c in around.columns])
        hits = lookup_join(hits, renamed, f"p{k}", "left", small=small)

    place = F.when((F.col("_but") == 0) | (F.col("at") + 1 == F.col("_but")), 1.0)
    weight = place.when(F.col("at") + 1 < F.col("_but"), BUT_BEFORE).otherwise(BUT_AFTER)
    per_text = ("_n", "_ep", "_qm")
    scored = _in_context(hits, idioms).select(key, "word", "at", "_v", weight.alias("_weight"), *per_text)
    by_word = scored.groupBy(key, "word").agg(
        F.min_by("_v", "at").alias("_v"),
        F.sum("_weight").alias("_weight"),
        F.count(F.lit(1)).alias("_m"),
        *[F.max(c).alias(c) for c in per_text],
    )
    total = F.col("_v") * F.col("_weight")
    joined = by_word.groupBy(key).agg(
        F.sum(total).alias("_s"),
        F.sum(F.when(F.col("_v") > 0, total + F.col("_m")).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(F.col("_v") < 0, total - F.col("_m")).otherwise(0.0)).alias("_neg"),
        F.sum(F.when(F.col("_v") != 0, F.col("_m")).otherwise(F.lit(0))).alias("_hits"),
        *[F.max(c).alias(c) for c in per_text],
    )

    emphasis = F.least(F.col("_ep"), F.lit(EXCLAMATION_LIMIT)) * F.lit(EXCLAMATION) + F.when(
        F.col("_qm") <= 1, 0.0
    ).when(F.col("_qm") <= QUESTION_LIMIT, F.col("_qm") * F.lit(QUESTION)).otherwise(QUESTION_MANY)
    s, pos, neg = F.col("_s"), F.col("_pos"), F.col("_neg")
    final = joined.select(
        key,
        "_n",
        F.when(s > 0, s + emphasis).when(s < 0, s - emphasis).otherwise(s).alias("_s"),
        F.when(pos > F.abs(neg), pos + emphasis).otherwise(pos).alias("_pos"),
        F.when(pos < F.abs(neg), neg - emphasis).otherwise(neg).alias("_neg"),
        (F.col("_n") - F.col("_hits")).alias("_neu"),
    )
    mass = F.col("_pos") + F.abs("_neg") + F.col("_neu")

    def share(part: Column) -> Column:
        return F.when(F.col("_n") > 0, F.round(F.abs(part / mass), 3)).otherwise(0.0)

    compound = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(NORMALISER))
    return final.select(
        key,
        share(F.col("_neg")).alias("lex_neg"),
        share(F.col("_neu")).alias("lex_neu"),
        share(F.col("_pos")).alias("lex_pos"),
        F.round(compound, 4).alias("lex_compound"),
    )


_PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"


def valence_sum(
    df: DataFrame, phrases: DataFrame, text: str = "review", key: str = "doc_id", phrase: str = "phrase", score: str = "score"
) -> DataFrame:
    """``(doc_id, lex_sum, lex_sum_norm)``: sum of the scores of the lexicon entries in a text.

    Entries may be several words long ("not good"); scanning left to right the longest entry
    wins and covers its words, so a word inside a matched phrase is not counted again. The
    normalised form divides by the number of white-space words.
    """
    entries = phrases.select(
        F.lower(phrase).alias("phrase"), F.col(score).cast("double").alias("score"), F.regexp_extract_all(F.lower(phrase), F.lit(_PIECE), F.lit(0)).alias("_p")
    )
    longest = entries.agg(F.max(F.size("_p"))).first()[0] or 1
    openings = entries.groupBy(F.get("_p", F.lit(0)).alias("word")).agg(
        F.array_sort(F.collect_list(F.struct((-F.size("_p")).alias("size"), "phrase", "score"))).alias("_entries")
    )

    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    pieces = df.select(
        key, word_count(text, "ws").alias("_words"), F.regexp_extract_all(lowered, F.lit(_PIECE), F.lit(0)).alias("_p")
    )
    # Separators open no entry, nor do words that no entry starts with; they never become rows. One marker per text
    # keeps texts without any match.
    opening_words = known_words(openings, "word")
    is_word = lambda word: word.rlike(r"[\p{L}\p{N}_]")
    window = _places(
        "_p",
        lambda word, i: F.struct(i.alias("at"), word.alias("word"), F.array(*[F.get("_p", i + k) for k in range(longest)]).alias("ahead")),
        lambda word: is_word(word) if opening_words is None else word.isin(opening_words) & is_word(word),
    )
    marker = F.struct(F.lit(-1).alias("at"), F.lit("").alias("word"), F.array().cast("array<string>").alias("ahead"))
    places = pieces.select(key, "_words", F.inline(F.concat(F.array(marker), window)))
    found = lookup_join(places, openings, "word", "left")
    fitting = F.filter(
        "_entries", lambda e: F.array_join(F.slice("ahead", F.lit(1), -e["size"]), "") == e["phrase"]
    )
    best = found.select(key, "_words", "at", F.get(fitting, F.lit(0)).alias("_e"))
    match = F.struct("at", (-F.col("_e.size")).alias("size"), F.col("_e.score").alias("score"))
    matches = best.where(F.col("_e").isNotNull() | (F.col("at") == -1)).select(
        key, "_words", F.when(F.col("_e").isNotNull(), match).alias("_m")
    )
    words = F.max("_words").alias("_words")
    if longest == 1:
        sums = matches.groupBy(key).agg(F.sum("_m.score").alias("_sum"), words)
    else:
        start = F.struct(F.lit(0).alias("free"), F.lit(0.0).alias("sum"))
        walk = F.aggregate(
            F.array_sort(F.collect_list("_m")),
            start,
            lambda acc, m: F.when(
                m["at"] >= acc["free"],
                F.struct((m["at"] + m["size"]).alias("free"), (acc["sum"] + m["score"]).alias("sum")),
            ).otherwise(acc),
            lambda acc: acc["sum"],
        )
        sums = matches.groupBy(key).agg(walk.alias("_sum"), words)
    total = F.coalesce(F.col("_sum"), F.lit(0.0))
    return sums.select(
        key, total.alias("lex_sum"), (total / F.col("_words")).alias("lex_sum_norm")
    )


def emotion_table(lexicon: DataFrame, emotions: Sequence[str], flag: bool = True) -> DataFrame:
    """``(word, emotion, value)`` to one row per word and one column per emotion, missing = 0.

    With ``flag`` only entries with value 1 count; without, values are averaged, which suits
    real-valued lexicons such as valence / arousal / dominance.
    """
    entries = lexicon.where(F.col("value") == 1) if flag else lexicon
    wide = entries.groupBy("word").pivot("emotion", list(emotions)).agg(F.avg(F.col("value").cast("double")))
    return wide.na.fill(0.0)


def emotion_means(
    df: DataFrame, emolex: DataFrame, emotions: Sequence[str], text: str = "review", key: str = "doc_id", prefix: str = "emo_"
) -> DataFrame:
    """``(doc_id, emo_*)``: mean of each emotion column over all white-space tokens of a text,
    unknown words counting as 0 and texts without tokens giving 0."""
    tokens = df.select(key, whitespace_tokens(text).alias("_t"))
    # The outer form keeps texts without tokens.
    words = tokens.select(key, F.greatest(F.size("_t"), F.lit(1)).alias("_n"), F.explode_outer("_t").alias("word"))
    found = lookup_join(words, emolex.select("word", *emotions), "word", "left")
    means = [(F.coalesce(F.sum(e), F.lit(0.0)) / F.max("_n")).alias(f"{prefix}{e}") for e in emotions]
    return found.groupBy(key).agg(*means)


def signature(df: DataFrame, *parts: DataFrame, columns: Sequence[str] = ("label",), key: str = "doc_id") -> DataFrame:
    """One row per document: ``columns`` of ``df`` beside the score columns of every part."""
    return reduce(lambda left, right: left.join(right, key, "left"), parts, df.select(key, *columns))


def class_means(df: DataFrame, columns: Sequence[str], label: str = "label", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Mean of each column by class, one row per column: ``(dimension, negative, positive)``
    for two classes, else one ``class_<c>`` column each."""
    names = ["negative", "positive"] if len(classes) == 2 else [f"class_{c}" for c in classes]
    means = [
        F.avg(F.when(F.col(label) == c, F.col(column))).alias(f"{column}|{name}")
        for column in columns
        for c, name in zip(classes, names)
    ]
    wide = df.agg(*means)
    rows = [
        F.struct(F.lit(column).alias("dimension"), *[F.col(f"`{column}|{name}`").alias(name) for name in names])
        for column in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def classify(df: DataFrame, score: str = "lex_compound", threshold: float = 0.0, strict: bool = True) -> DataFrame:
    """Add ``prediction``: 1 where the score is above ``threshold`` (at or above, if not strict)."""
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    return df.withColumn("prediction", hit.cast("int"))
