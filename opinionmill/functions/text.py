"""Text expressions. All are stateless and stay inside the JVM, so they also run on streams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Python's notion of white space: the Unicode property plus four control characters.
_SPACE = r"[\s\x1C-\x1F]"
_NOT_SPACE = r"[^\s\x1C-\x1F]"
# Fixed value: what counts as a URL.
URL_PATTERN = rf"(?U)https?://{_NOT_SPACE}+|www\.{_NOT_SPACE}+"
SPACE_PATTERN = rf"(?U){_SPACE}+"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def raw_text(title: Column | str, text: Column | str) -> Column:
    """Title and body as one string; a missing part counts as empty."""
    blank = F.lit("")
    return F.concat(F.coalesce(_col(title), blank), F.lit(". "), F.coalesce(_col(text), blank))


def clean_text(value: Column | str) -> Column:
    """Lower case, drop URLs, decode ``&quot;`` then ``&amp;``, collapse white space."""
    lowered = F.lower(F.coalesce(_col(value), F.lit("")))
    # Every match of the pattern holds one of these, which is cheaper to look for.
    may_match = lowered.contains("://") | lowered.contains("www.")
    no_urls = F.when(may_match, F.regexp_replace(lowered, URL_PATTERN, " ")).otherwise(lowered)
    decoded = F.replace(F.replace(no_urls, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(decoded, SPACE_PATTERN, " "))


def char_count(value: Column | str) -> Column:
    return F.char_length(F.coalesce(_col(value), F.lit(""))).cast("long")


def whitespace_tokens(value: Column | str) -> Column:
    """Runs of non-space characters; no empty items."""
    parts = F.split(F.coalesce(_col(value), F.lit("")), SPACE_PATTERN)
    return F.filter(parts, lambda token: token != "")


def word_count(value: Column | str, mode: str = "space") -> Column:
    """``space``: items when cutting at every single blank, so '' is 1 and a double blank
    adds one. ``ws``: white-space separated words, never below 1."""
    if mode == "space":
        return F.size(F.split(F.coalesce(_col(value), F.lit("")), " ", -1)).cast("long")
    if mode == "ws":
        return F.greatest(F.size(whitespace_tokens(value)), F.lit(1)).cast("long")
    raise ValueError(f"unknown mode {mode!r}")


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """One-to-one foldings as two aligned strings, and the few letters that expand."""
    source, target, expanding = [], [], {}
    for code in range(0xA0, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xF8FF:
            continue
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char or not plain:
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif plain.isalpha() and char.isalpha() and "LATIN" in unicodedata.name(char, ""):
            expanding[char] = plain
    return "".join(source), "".join(target), expanding


def _ranges(chars: Iterable[str]) -> str:
    """A regular expression for one of ``chars``, neighbours as ranges: each part of a class is tried on every letter."""
    codes = sorted(map(ord, chars))
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]"


def fold_accents(value: Column | str) -> Column:
    """Strip accents by compatibility decomposition, for every letter of the basic plane."""
    value = _col(value)
    source, target, expanding = _accent_tables()
    spelled_out = value
    for char, plain in expanding.items():
        spelled_out = F.replace(spelled_out, F.lit(char), F.lit(plain))
    single = F.when(value.rlike(_ranges(expanding)), spelled_out).otherwise(value)
    return F.regexp_replace(F.translate(single, source, target), r"\p{Mn}+", "")


def word_tokens(value: Column | str, fold: bool = True) -> Column:
    """Lower-cased runs of two or more word characters, accents folded unless told not to."""
    lowered = F.lower(F.coalesce(_col(value), F.lit("")))
    # Plain ASCII text skips the folding.
    prepared = F.when(lowered.rlike(r"[^\x00-\x7F]"), fold_accents(lowered)).otherwise(lowered) if fold else lowered
    return F.regexp_extract_all(prepared, F.lit(WORD_PATTERN), F.lit(0))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A column expression named twice is computed twice, and one named inside a lambda is computed
    for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column | str, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, joined by one blank."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")

    def runs(words: Column, n: int) -> Column:
        if n == 1:
            return words
        length = F.greatest(F.size(words) - (n - 1), F.lit(0))
        joined = F.slice(words, F.lit(1), length)
        for step in range(1, n):
            joined = F.zip_with(joined, F.slice(words, F.lit(step + 1), length), lambda a, b: F.concat(a, F.lit(" "), b))
        return joined

    def all_runs(words: Column) -> Column:
        parts = [runs(words, n) for n in range(low, high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return bind(_col(tokens), all_runs)


def truncate_tokens(tokens: Column | str, length: int = 192, pad: str | None = None) -> Column:
    """First ``length`` tokens, filled up with ``pad`` when one is given."""
    cut = F.slice(_col(tokens), 1, length)
    if pad is None:
        return cut
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def count_char(value: Column | str, char: str) -> Column:
    value = F.coalesce(_col(value), F.lit(""))
    return F.char_length(value) - F.char_length(F.replace(value, F.lit(char), F.lit("")))


