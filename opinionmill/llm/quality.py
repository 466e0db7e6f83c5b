"""Quality rules: a table of thresholds compiled into one native projection.

Every measure is a column expression over the words and lines of the whole text; every rule is a row
``(name, measure, low, high)`` of a table. ``judge`` computes the measures once and turns the table
into one boolean per rule and their conjunction. No user function, no shuffle.

Cases: a null or empty text has no words, so it fails the base rule; a text of any length is measured
whole; rows stay as they are, repeated ones too; an empty table gives an empty result; columns of the
input that carry a made name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from opinionmill.llm.storage import quoted

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the a an of to and in is that it for was on are as with his they at be this from have or by had not but "
    "der die das und ist nicht ein eine zu den mit von auf für sich dem des im es "
    "le la les de des un une et est en que qui pas pour dans sur par au avec "
    "el los las y un una es no se por con para del al su lo como"
).split()
WORD_GAP = r"[\x20\x09-\x0D]+"

#: name, measure, least, most. Null leaves that side open.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("word_length", "mean_word_length", 3.0, 10.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("letters", "letter_word_ratio", 0.8, None),
    ("stop_words", "stop_word_ratio", 0.06, None),
    ("repeated_lines", "dup_line_ratio", None, 0.4),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_stop_words", "n_lines")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also inside lambda functions."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur at least twice in the text."""

    def covered(hashes: Column) -> Column:
        tagged = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        again = let(
            F.sort_array(tagged),
            lambda s: F.transform(
                F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])),
                lambda x: x["i"],
            ),
        )
        steps = let(
            F.sort_array(again),
            lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))),
        )
        total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)

    def hashes(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))

    return let(words, lambda w: let(hashes(w), covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``COUNTS``; every count covers the whole text."""
    docs = docs.drop(*COUNTS, "_words", "_lines")
    body = F.coalesce(F.col(text), F.lit(""))
    words, lines = F.col("_words"), F.col("_lines")
    stops = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
    return (
        docs.withColumns(
            {
                "_words": words_of(body),
                "_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            }
        )
        .withColumns(
            {
                "n_words": F.size(words).cast("long"),
                "word_chars": F.length(F.array_join(words, "")).cast("long"),
                "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
                "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
                "n_repeat_words": repeat_words(words),
                "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long"),
                "n_stop_words": F.size(stops).cast("long"),
                "n_lines": F.size(lines).cast("long"),
            }
        )
        .drop("_words", "_lines")
    )


def ratios() -> dict[str, Column]:
    """The measures that rules may name, besides the counts themselves."""
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    return {
        "mean_word_length": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "letter_word_ratio": F.col("n_letter_words") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)).cast("double"),
    }


def compiled(rules: Sequence[tuple[str, str, float | None, float | None]]) -> dict[str, Column]:
    """One boolean column per rule, true when the measure lies between its bounds (null: false)."""
    known = ratios()
    out = {}
    for name, measured, low, high in rules:
        value = known[measured] if measured in known else F.col(measured)
        bounds = [value >= F.lit(low)] if low is not None else []
        bounds += [value <= F.lit(high)] if high is not None else []
        out[name] = F.coalesce(reduce(lambda a, b: a & b, bounds, F.lit(True)), F.lit(False))
    return out


def judge(docs: DataFrame, rules=RULES, min_words: int = 50, text: str = "text") -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``rule_<name>`` per rule and the verdict ``kept``."""
    checks = {f"rule_{name}": check for name, check in compiled(rules).items()}
    docs = docs.drop("base_failed", "kept", *checks)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measure(docs, text).withColumns({"base_failed": base, **checks})
    verdict = reduce(lambda a, b: a & b, [F.col(c) for c in checks], ~F.col("base_failed"))
    return judged.withColumn("kept", verdict)


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    own = docs.columns
    marked = docs.select(F.struct(*map(quoted, own)).alias("_row"), F.col("text").alias("text"))
    return judge(marked, rules).where("kept").select("_row.*")
