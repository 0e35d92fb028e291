"""Text quality gate: ordered checks that say why a row was rejected.

Checks run in order and the first failure wins: empty, word window, character
window, repetition, profanity and (optionally) category relevance.  The whole
chain is one ``CASE WHEN`` -- later, costlier checks are only evaluated for
rows that passed the earlier ones, and no shuffle is needed.
"""

from __future__ import annotations

import math

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework import lexicon
from casework.functions import text as T

# Reason codes, in check order.
OK = "ok"
EMPTY = "empty"
FEW_WORDS = "few_words"
MANY_WORDS = "many_words"
FEW_CHARS = "few_chars"
MANY_CHARS = "many_chars"
REPETITIVE = "repetitive"
PROFANITY = "profanity"
IRRELEVANT = "irrelevant"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_words: int = 300
    min_chars: int = 50
    max_chars: int = 1500
    repeat_share: float = 0.20
    repeat_min_len: int = 4  # only words longer than 3 characters count
    profanity: Sequence[str] = tuple(lexicon.PROFANITY)
    category_keywords: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: dict(lexicon.CATEGORY_KEYWORDS))

    def __post_init__(self):
        if self.min_words > self.max_words or self.min_chars > self.max_chars:
            raise ValueError("minimum above maximum")


def repeated_word(sorted_words: Column, n_words: Column, share: float, min_len: int) -> Column:
    """Alphabetically first word (length >= min_len) whose share of all words is
    strictly above ``share``; null if none.  ``sorted_words`` is the row's
    lower-cased words, sorted.

    Exact, per row, no shuffle and no lambda: a word with ``c / n > share``
    has ``c >= step = max(1, ceil(share * n - 1e-9))``, and in the sorted
    array such a run must cover a position that is a multiple of ``step``.
    So only ``floor(1 / share) + 1`` candidates are counted, each with two
    ``array_position`` scans.  (The 1e-9 slack only ever lowers the step,
    which adds coverage; rows here have at most ``max_words`` words.)
    """
    s, n = sorted_words, n_words
    if share <= 0:
        return F.array_min(F.filter(s, lambda x: F.length(x) >= min_len))
    step = F.greatest(F.ceil(n * F.lit(share) - F.lit(1e-9)), F.lit(1)).cast("int")
    rev = F.reverse(s)
    hits = []
    for k in range(1, int(math.floor(1.0 / share)) + 2):
        w = F.get(s, step * k - 1)
        cnt = (F.size(s) - F.array_position(rev, w) + 1) - F.array_position(s, w) + 1
        hits.append(F.when(w.isNotNull() & (F.length(w) >= min_len) & (cnt / n > F.lit(share)), w))
    return F.least(*hits) if len(hits) > 1 else hits[0]


def validate(df: DataFrame, text_col: str = "complaint_text", rules: Rules = Rules(),
             category_col: str | None = None) -> DataFrame:
    """Add ``passed``, ``reason_code``, ``reason``, ``word_count``, ``char_count``.

    Staged projections: each per-row array is built once, and the costly
    checks only run for rows inside the length window.
    """
    text = F.col(text_col)
    staged = (df.withColumn("word_count", T.word_count(text))
                .withColumn("char_count", T.char_count(text)))
    nw, nc = F.col("word_count"), F.col("char_count")
    in_window = ((nw >= rules.min_words) & (nw <= rules.max_words)
                 & (nc >= rules.min_chars) & (nc <= rules.max_chars))
    staged = staged.withColumn("_sorted", F.when(in_window, F.sort_array(T.words(F.lower(text)))))
    staged = staged.withColumn("_rep", repeated_word(F.col("_sorted"), nw, rules.repeat_share,
                                                     rules.repeat_min_len))
    rep = F.col("_rep")
    code = (F.when(text.isNull() | (nw == 0), F.lit(EMPTY))
            .when(nw < rules.min_words, F.lit(FEW_WORDS))
            .when(nw > rules.max_words, F.lit(MANY_WORDS))
            .when(nc < rules.min_chars, F.lit(FEW_CHARS))
            .when(nc > rules.max_chars, F.lit(MANY_CHARS))
            .when(rep.isNotNull(), F.lit(REPETITIVE))
            .when(T.starts_word_any(text, rules.profanity), F.lit(PROFANITY)))
    cat = None
    if category_col is not None:
        cat = F.col(category_col)
        code = code.when(~category_relevant(text, cat, rules.category_keywords), F.lit(IRRELEVANT))
    staged = staged.withColumn("reason_code", code.otherwise(F.lit(OK)))
    rc = F.col("reason_code")
    reason = (F.when(rc == EMPTY, F.lit("Text is empty"))
              .when(rc == FEW_WORDS, F.format_string("Too short: %d words (min %d)", nw, F.lit(rules.min_words)))
              .when(rc == MANY_WORDS, F.format_string("Too long: %d words (max %d)", nw, F.lit(rules.max_words)))
              .when(rc == FEW_CHARS, F.format_string("Too short: %d chars (min %d)", nc, F.lit(rules.min_chars)))
              .when(rc == MANY_CHARS, F.format_string("Too long: %d chars (max %d)", nc, F.lit(rules.max_chars)))
              .when(rc == REPETITIVE, F.format_string("Repetitive word detected: '%s'", rep))
              .when(rc == PROFANITY, F.lit("Contains explicit profanity")))
    if cat is not None:
        reason = reason.when(rc == IRRELEVANT, F.format_string("No '%s' keywords found in text", cat))
    return (staged.withColumn("reason", reason.otherwise(F.lit("")))
                  .withColumn("passed", rc == OK)
                  .drop("_sorted", "_rep"))


def category_relevant(text: Column, category: Column,
                      keywords: Mapping[str, Sequence[str]]) -> Column:
    """Text contains one of the category's keywords; unknown or missing category passes."""
    kw_map = F.create_map(*[x for k, ws in keywords.items()
                            for x in (F.lit(k), F.array(*[F.lit(w) for w in ws]))])
    kws = F.element_at(kw_map, category) if keywords else F.lit(None).cast("array<string>")
    lower = F.lower(text)
    hit = F.exists(kws, lambda w: lower.contains(w))
    return F.when(category.isNull() | (category == "") | kws.isNull(), F.lit(True)).otherwise(
        F.coalesce(hit, F.lit(False)))


def keep_rows(df: DataFrame, flag: Column) -> DataFrame:
    """Rows where ``flag`` is true, evaluating ``flag`` where it was staged.

    A ``where`` on a staged verdict is pushed below the staging projections
    with every alias inlined, so the filter re-runs the whole chain (the
    sorted word array once per reference, costly checks for rows outside the
    length window) and the fused code outgrows the 64 KB method limit: 15x
    slower at sf0.1.  A generator is not transparent to filter pushdown: each
    row emits one marker when ``flag`` holds, none otherwise (an expression
    input, so no size filter is inferred and pushed either).
    """
    cols = df.columns
    return (df.withColumn("_keep", F.explode(F.when(flag, F.array(F.lit(True)))))
              .select(*[F.col(f"`{c}`") for c in cols]))


def split_accepted(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) halves of a validated frame."""
    return keep_rows(validated, F.col("passed")), keep_rows(validated, ~F.col("passed"))


def intake_counts(validated: DataFrame) -> DataFrame:
    """One row ``stored, skipped, total_rows`` (a single aggregate, no second pass)."""
    return validated.agg(
        F.count_if(F.col("passed")).cast("long").alias("stored"),
        F.count_if(~F.col("passed")).cast("long").alias("skipped"),
        F.count(F.lit(1)).cast("long").alias("total_rows"))


def reason_breakdown(validated: DataFrame, *extra_keys: str) -> DataFrame:
    """Rows per verdict (and optional extra keys), partial aggregation before the shuffle."""
    keys = ["passed", "reason_code", *extra_keys]
    return validated.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n"))
