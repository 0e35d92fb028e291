"""Rule-based labelling: category map, severity and emotion tiers, label filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework import lexicon
from casework.functions import text as T


def mapping_frame(spark: SparkSession, mapping: Mapping[str, str],
                  key: str = "product", value: str = "category") -> DataFrame:
    """Small lookup table; its size is the mapping's, independent of the data."""
    return spark.createDataFrame(sorted(mapping.items()), f"{key} string, {value} string")


def map_category(df: DataFrame, product_col: str | None,
                 mapping: Mapping[str, str] = lexicon.CATEGORY_MAP,
                 fallback: str = "UX_ISSUES", out_col: str = "category") -> DataFrame:
    """Exact product -> category map; unmapped rows are dropped.

    The lookup has one row per mapping entry (a fixed, small size), so it is
    broadcast and the big side never shuffles.  Without a product column every
    row gets ``fallback``.
    """
    if product_col is None:
        return df.withColumn(out_col, F.lit(fallback))
    lookup = mapping_frame(df.sparkSession, mapping, "_product", out_col)
    return (df.join(F.broadcast(lookup), F.col(product_col) == F.col("_product"), "inner")
              .drop("_product"))


def tiered_label(lower_text: Column, tiers: Sequence[tuple[str, Sequence[str]]],
                 default: str) -> Column:
    """First tier whose keyword list hits the text (substring), else ``default``."""
    out = None
    for label, kws in tiers:
        cond = T.contains_any(lower_text, kws)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _flag(col: Column | None) -> Column:
    if col is None:
        return F.lit("")
    return F.lower(T.py_strip(F.coalesce(col.cast("string"), F.lit(""))))


def with_lower(df: DataFrame, text_col: str, out: str = "_lower") -> DataFrame:
    """Stage ``lower(text)`` once per row.  Keyword rules sit in CASE branches,
    where common subexpressions are not shared, so unstaged each keyword would
    lower-case the whole text again."""
    return df.withColumn(out, F.lower(F.coalesce(F.col(text_col), F.lit(""))))


def derive_severity(text_col, disputed_col=None, timely_col=None,
                    tiers: Sequence[tuple[str, Sequence[str]]] = lexicon.SEVERITY_TIERS,
                    default: str = lexicon.SEVERITY_DEFAULT, lowered: bool = False) -> Column:
    """Flags first (disputed & late: critical, disputed: high, late: medium), then keywords.
    ``lowered``: ``text_col`` is already lower-cased (see ``with_lower``)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    disputed = _flag(c(disputed_col) if disputed_col is not None else None)
    timely = _flag(c(timely_col) if timely_col is not None else None)
    lower = c(text_col) if lowered else F.lower(F.coalesce(c(text_col), F.lit("")))
    return (F.when((disputed == "yes") & (timely == "no"), F.lit("critical"))
             .when(disputed == "yes", F.lit("high"))
             .when(timely == "no", F.lit("medium"))
             .otherwise(tiered_label(lower, tiers, default)))


def derive_emotion(text_col, tiers: Sequence[tuple[str, Sequence[str]]] = lexicon.EMOTION_TIERS,
                   default: str = lexicon.EMOTION_DEFAULT, lowered: bool = False) -> Column:
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return tiered_label(c if lowered else F.lower(F.coalesce(c, F.lit(""))), tiers, default)


def is_blank(col) -> Column:
    """Null, empty or only (Unicode) whitespace -- a match test, no string rebuilt."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(r"(?U)^\s*$"), F.lit(True))


def blank_to_null(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(is_blank(c), F.lit(None).cast("string")).otherwise(c)


def fill_labels(df: DataFrame, predicted: Mapping[str, str] | None = None,
                defaults: Mapping[str, str] = lexicon.MISSING_LABEL_DEFAULTS) -> DataFrame:
    """Supplied labels win; blanks take the prediction column, else the default."""
    predicted = predicted or {}
    out = df
    for head, default in defaults.items():
        given = blank_to_null(head) if head in df.columns else F.lit(None).cast("string")
        pred = F.col(predicted[head]) if head in predicted else F.lit(None).cast("string")
        out = out.withColumn(head, F.coalesce(given, blank_to_null(pred), F.lit(default)))
    return out


def needs_prediction(df: DataFrame, heads: Sequence[str] = ("category", "severity", "emotion")) -> Column:
    """Any label blank: only these rows need the (expensive) model."""
    cond = F.lit(False)
    for h in heads:
        cond = cond | (blank_to_null(h).isNull() if h in df.columns else F.lit(True))
    return cond
