"""String column functions (all JVM-side, codegen friendly).

Python's ``str.split()`` / ``str.strip()`` use Unicode whitespace while Java's
``\\s`` is ASCII unless the ``(?U)`` flag is set, so every pattern here that
talks about whitespace or word edges carries ``(?U)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework import lexicon

#: Python also counts the four separators U+001C to U+001F as white space.
WS = r"[\s\x1c-\x1f]"
WS_SPLIT = rf"(?U){WS}+"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), rf"(?U)^{WS}+|{WS}+$", "")


def words(col) -> Column:
    """``str.split()``: whitespace-separated words, no empty strings."""
    return F.array_remove(F.split(_c(col), WS_SPLIT), "")


def word_count(col) -> Column:
    """``len(text.split())`` as BIGINT (null text -> 0)."""
    return F.coalesce(F.size(words(col)), F.lit(0)).cast("long")


def char_count(col) -> Column:
    """``len(text)`` in code points as BIGINT."""
    return F.length(_c(col)).cast("long")


def is_blank(col) -> Column:
    """True when the text is null, empty or whitespace only."""
    c = _c(col)
    return c.isNull() | (word_count(c) == 0)


def expand_contractions(col, mapping: Sequence[tuple[str, str]] = lexicon.CONTRACTIONS) -> Column:
    """Ordered, case-insensitive substring replacement of contractions."""
    src = _c(col)
    out = src
    for short, full in mapping:
        out = F.regexp_replace(out, "(?i)" + re.escape(short), full.replace("\\", "\\\\").replace("$", "\\$"))
    marks = sorted({ch for short, _ in mapping for ch in short if not ch.isalnum()})
    if not marks:
        return out
    # every pattern contains one of these characters: texts without them skip all passes
    guard = src.rlike("[" + "".join(re.escape(m) for m in marks) + "]")
    return F.when(guard, out).otherwise(src)


def strip_special(col, allowed_class: str = lexicon.ALLOWED_CHARS_CLASS) -> Column:
    """Every character outside the allowed class becomes one space."""
    return F.regexp_replace(_c(col), f"[^{allowed_class}]", " ")


def collapse_whitespace(col) -> Column:
    return F.regexp_replace(_c(col), WS_SPLIT, " ")


def clean_text(col, mapping: Sequence[tuple[str, str]] = lexicon.CONTRACTIONS,
               allowed_class: str = lexicon.ALLOWED_CHARS_CLASS) -> Column:
    """Contractions, special characters, whitespace, lower case, strip.

    Equals ``strip(lower(collapse_ws(strip_special(expand(text)))))`` in one
    regex pass: after special characters become spaces the only whitespace
    left is the space, so "replace each disallowed char, then collapse
    whitespace runs" is "replace each run of disallowed-or-space chars by one
    space", and the final strip only has spaces to remove.
    """
    if " " not in allowed_class:
        return py_strip(F.lower(collapse_whitespace(strip_special(expand_contractions(col, mapping), allowed_class))))
    keep = allowed_class.replace(" ", "")
    return F.trim(F.lower(F.regexp_replace(expand_contractions(col, mapping), f"[^{keep}]+", " ")))


def clean_tokens(col, mapping: Sequence[tuple[str, str]] = lexicon.CONTRACTIONS,
                 allowed_class: str = lexicon.ALLOWED_CHARS_CLASS) -> Column:
    """``tokens(clean_text(col))`` without rebuilding the cleaned string.

    The cleaner turns every character outside the allowed class into a space;
    of the allowed characters only ASCII letters and digits are token
    characters.  So the tokens of the cleaned text are the runs of two or more
    ``[A-Za-z0-9]`` in the contraction-expanded text, lower-cased -- one
    extraction instead of a replace over every character (3x faster on long
    texts).  Matching before lower-casing keeps characters such as the Kelvin
    sign, which lower-case to ASCII, out of tokens, as the cleaner does.
    """
    if allowed_class != lexicon.ALLOWED_CHARS_CLASS:
        return tokens(clean_text(col, mapping, allowed_class))
    runs = F.regexp_extract_all(expand_contractions(col, mapping), F.lit("[A-Za-z0-9]{2,}"), F.lit(0))
    return F.array_remove(F.split(F.lower(F.array_join(runs, " ")), " "), "")


def truncate(col, n: int) -> Column:
    """First ``n`` code points (``text[:n]``)."""
    return F.substring(_c(col), 1, n)


def contains_any(lower_col, words_: Iterable[str]) -> Column:
    """Literal substring test: any word occurs in the (already lower-cased) text."""
    ws = list(words_)
    if not ws:
        return F.lit(False)
    c = _c(lower_col)
    out = c.contains(ws[0])
    for w in ws[1:]:
        out = out | c.contains(w)
    return F.coalesce(out, F.lit(False))


def prefix_word_regex(words_: Iterable[str]) -> str:
    alts = "|".join(re.escape(w) for w in words_)
    return rf"(?U)\b(?:{alts})"


def starts_word_any(col, words_: Iterable[str]) -> Column:
    """Some word of the lower-cased text starts with one of ``words_``."""
    ws = list(words_)
    if not ws:
        return F.lit(False)
    return F.coalesce(F.lower(_c(col)).rlike(prefix_word_regex(ws)), F.lit(False))


def tokens(col, lowercase: bool = True) -> Column:
    """Word tokens of two or more letters/digits/underscores (Unicode)."""
    c = F.lower(_c(col)) if lowercase else _c(col)
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))


def drop_words(arr, stop_words: Iterable[str]) -> Column:
    """Remove stop words from a token array, keeping order and repeats (a set lookup for each token)."""
    sw = list(stop_words)
    return F.filter(_c(arr), lambda x: ~x.isin(["", *sw])) if sw else _c(arr)


def bigrams(arr) -> Column:
    """Adjacent pairs joined by one space (empty for fewer than two tokens).

    One regex pass over the space-joined tokens: every token that has a
    successor captures "token successor" in a lookahead (native, no lambda).
    """
    joined = F.array_join(_c(arr), " ")
    return F.regexp_extract_all(joined, F.lit(r"(?=(\S+ \S+))\S+"), F.lit(1))


def uni_and_bigrams(arr) -> Column:
    return F.concat(_c(arr), bigrams(arr))
