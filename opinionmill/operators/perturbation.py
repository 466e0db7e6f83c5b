"""Behavioural tests: how often a prediction turns when a text is changed a little.

Copies are made by column expressions. What is changed depends on (seed, key, kind, place) alone, so
the copies are the same on any cluster and for any order of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opinionmill.functions.text import bind, whitespace_tokens
from opinionmill.session import SEED

KINDS = ("negation", "typo", "swap", "drop")


def _draw(seed: int, key: str, kind: str, place: Column) -> Column:
    """A whole number below 2^32 for each (seed, key, kind, place)."""
    name = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(kind), place.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def _letters_swapped(token: Column, draw: Column) -> Column:
    """Two letters inside the word change places; the first and the last one stay."""
    at = (F.lit(2) + F.pmod(F.floor(draw / 4096), F.char_length(token) - 3)).cast("int")
    return F.concat(
        F.substr(token, F.lit(1), at - 1), F.substr(token, at + 1, F.lit(1)), F.substr(token, at, F.lit(1)), F.substr(token, at + 2)
    )


def changed(kind: str, share: int, seed: int = SEED, text: str = "review", key: str = "doc_id") -> Column:
    """The text's white-space words with about ``share`` percent of them changed, joined by blanks.

    ``negation`` puts "not" before a word, ``typo`` swaps two letters inside a word of four letters or more, ``swap``
    exchanges the two words of a pair (first and second, third and fourth, ...), ``drop`` leaves a word out.
    """
    return bind(whitespace_tokens(text), lambda tokens: _changed(kind, tokens, share, seed, key)).alias(text)


def _changed(kind: str, tokens: Column, share: int, seed: int, key: str) -> Column:
    """``tokens`` must be bound: an expression named inside a lambda would cut the text anew for every word."""
    hit = lambda place: F.pmod(_draw(seed, key, kind, place), F.lit(100)) < share
    if kind == "negation":
        parts = F.transform(tokens, lambda t, i: F.when(hit(i), F.concat(F.lit("not "), t)).otherwise(t))
    elif kind == "typo":
        parts = F.transform(
            tokens, lambda t, i: F.when(hit(i) & (F.char_length(t) >= 4), _letters_swapped(t, _draw(seed, key, kind, i))).otherwise(t)
        )
    elif kind == "swap":
        other = lambda i: i.bitwiseXOR(F.lit(1))
        parts = F.transform(tokens, lambda t, i: F.when(hit(F.floor(i / 2)), F.coalesce(F.get(tokens, other(i)), t)).otherwise(t))
    elif kind == "drop":
        parts = F.filter(tokens, lambda t, i: ~hit(i))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return F.array_join(parts, " ")


def perturbed(
    docs: DataFrame, kinds: Sequence[str] = KINDS, share: int = 10, seed: int = SEED, text: str = "review", key: str = "doc_id"
) -> DataFrame:
    """``(doc_id, kind, copy, text)`` of every row and kind; ``copy`` names the pair as ``doc_id:kind``."""
    copies = lambda tokens: F.array(*[F.struct(F.lit(k).alias("kind"), _changed(k, tokens, share, seed, key).alias("text")) for k in kinds])
    return docs.select(key, F.explode(bind(whitespace_tokens(text), copies)).alias("_e")).select(
        key, "_e.kind", F.concat_ws(":", F.col(key).cast("string"), "_e.kind").alias("copy"), F.col("_e.text").alias(text)
    )


def sign_test(up: Column, down: Column) -> Column:
    """Two-sided exact p-value that turns up and down are equally likely; 1 where there are none.

    Binomial terms are summed by their logarithms, each from the one before.
    """
    n, least = (up + down).cast("double"), F.least(up, down)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))
    steps = F.when(least > 0, F.sequence(F.lit(1).cast("long"), least.cast("long"))).otherwise(F.array().cast("array<long>"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] + F.log((n - k + 1) / k)
        return F.struct(term.alias("term"), (s["total"] + F.exp(term)).alias("total"))

    return F.least(F.lit(1.0), F.lit(2.0) * F.aggregate(steps, start, add)["total"])


def flip_rates(before: DataFrame, after: DataFrame, key: str = "doc_id", prediction: str = "prediction") -> DataFrame:
    """``(kind, n, flipped, up, down, flip_rate, p_value)`` from predictions of the texts (``doc_id``) and of
    their changed copies (``doc_id, kind``)."""
    first = before.select(F.col(key).alias("_key"), F.col(prediction).cast("int").alias("_before"))
    pairs = after.select(key, "kind", F.col(prediction).cast("int").alias("_after")).join(first, F.col(key) == F.col("_key"))
    turned = pairs.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_after") > F.col("_before")).alias("up"), F.count_if(F.col("_after") < F.col("_before")).alias("down")
    )
    flipped = F.col("up") + F.col("down")
    return turned.select(
        "kind", "n", flipped.alias("flipped"), "up", "down", (flipped / F.col("n")).alias("flip_rate"), sign_test(F.col("up"), F.col("down")).alias("p_value")
    )
