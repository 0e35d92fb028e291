"""Registered queries: text functions, validation and rule labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework import lexicon
from casework.functions import text as T
from casework.operators import labels as L
from casework.operators import validate as V
from casework.plans import sqltext as S
from casework.plans.registry import register
from casework.sources import fixtures as FX
from casework.session import read_table

DEFAULT_RULES = V.Rules()
FIXTURE_RULES = V.Rules(repeat_share=0.10, profanity=tuple(FX.FIXTURE_PROFANITY),
                        category_keywords=FX.FIXTURE_CATEGORY_KEYWORDS)

VALIDATED_COLS = ["doc_id", "passed", "reason_code", "reason", "word_count", "char_count"]


# -- V1-V6: ordered first-failure chain ---------------------------------------

def _sql_validate(rules: V.Rules) -> str:
    ctes, sel = S.validated_select("documents", "doc_id", "text", rules)
    return FX.with_views(sel, ctes=ctes)


@register("validate_reason", lambda: _sql_validate(DEFAULT_RULES))
def validate_reason(spark, sf_dir):
    """Reference thresholds and built-in lexicon over every document."""
    docs = read_table(spark, sf_dir, "documents")
    return V.validate(docs, "text", DEFAULT_RULES).select(*VALIDATED_COLS)


@register("validate_fixture_lexicon", lambda: _sql_validate(FIXTURE_RULES))
def validate_fixture_lexicon(spark, sf_dir):
    """Same chain with an injected profanity list and a 10 % repetition share."""
    docs = read_table(spark, sf_dir, "documents")
    return V.validate(docs, "text", FIXTURE_RULES).select(*VALIDATED_COLS)


def _sql_breakdown() -> str:
    ctes, sel = S.validated_select("cases", "case_id", "complaint_text", FIXTURE_RULES,
                                   extra_cols=", severity")
    ctes.append(("_v", sel))
    return FX.with_views(
        "SELECT passed, reason_code, severity, count(*) AS n FROM _v GROUP BY ALL",
        names=["cases"], ctes=ctes)


@register("triage_breakdown", _sql_breakdown)
def triage_breakdown(spark, sf_dir):
    """Flagship: verdict x derived severity over all cases (V6 + L2 + A2)."""
    v = V.validate(FX.cases(spark, sf_dir), "complaint_text", FIXTURE_RULES)
    return V.reason_breakdown(v, "severity")


def _sql_counts() -> str:
    ctes, sel = S.validated_select("documents", "doc_id", "text", DEFAULT_RULES)
    ctes.append(("_v", sel))
    return FX.with_views(
        "SELECT CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS stored, "
        "CAST(count(*) FILTER (WHERE NOT passed) AS BIGINT) AS skipped, "
        "CAST(count(*) AS BIGINT) AS total_rows FROM _v", ctes=ctes)


@register("intake_counts", _sql_counts)
def intake_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return V.intake_counts(V.validate(docs, "text", DEFAULT_RULES))


def _sql_relevance() -> str:
    ctes, sel = S.validated_select("cases", "case_id", "complaint_text", FIXTURE_RULES,
                                   category="category", extra_cols=", category")
    return FX.with_views(sel, names=["cases"], ctes=ctes)


@register("category_relevance", _sql_relevance)
def category_relevance(spark, sf_dir):
    """Chain including the optional category-keyword check (V5)."""
    c = FX.cases(spark, sf_dir)
    v = V.validate(c, "complaint_text", FIXTURE_RULES, category_col="category")
    return v.select("case_id", "passed", "reason_code", "reason", "word_count", "char_count", "category")


# -- T1-T7: text functions ------------------------------------------------------

@register("text_lengths", lambda: (
    f"SELECT doc_id, {S.word_count('text')} AS word_count, {S.char_count('text')} AS char_count, "
    f"{S.word_count(S.py_strip('text'))} AS stripped_words, {S.char_count(S.py_strip('text'))} AS stripped_chars, "
    "CAST(length(substr(text, 1, 200)) AS BIGINT) AS snippet_chars FROM documents"))
def text_lengths(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    s = T.py_strip("text")
    return d.select("doc_id", T.word_count("text").alias("word_count"),
                    T.char_count("text").alias("char_count"),
                    T.word_count(s).alias("stripped_words"), T.char_count(s).alias("stripped_chars"),
                    T.char_count(T.truncate("text", 200)).alias("snippet_chars"))


@register("clean_text", lambda: f"SELECT doc_id, {S.clean_text('text')} AS clean FROM documents")
def clean_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.clean_text("text").alias("clean"))


# -- L1-L3: rule labelling ----------------------------------------------------

@register("map_category", lambda: FX.with_views(
    "SELECT CAST(f.\"Complaint ID\" AS BIGINT) AS doc_id, f.\"Product\" AS product, m.category "
    "FROM raw_feed f JOIN " + FX.sql_values(sorted(lexicon.CATEGORY_MAP.items()), ["product", "category"])
    + " m ON f.\"Product\" = m.product", names=["raw_feed"]))
def map_category(spark, sf_dir):
    f = FX.raw_feed(spark, sf_dir)
    out = L.map_category(f, "Product")
    return out.select(F.col("Complaint ID").cast("long").alias("doc_id"),
                      F.col("Product").alias("product"), "category")


@register("derive_severity", lambda: FX.with_views(
    "SELECT CAST(\"Complaint ID\" AS BIGINT) AS doc_id, "
    + FX.sql_severity("\"Consumer complaint narrative\"", "\"Consumer disputed?\"", "\"Timely response?\"",
                      FX.FIXTURE_SEVERITY_TIERS) + " AS severity, "
    + FX.sql_severity("\"Consumer complaint narrative\"", "NULL", "NULL", lexicon.SEVERITY_TIERS)
    + " AS keyword_severity FROM raw_feed", names=["raw_feed"]))
def derive_severity(spark, sf_dir):
    """Flags, then fixture keyword tiers; plus the built-in tiers without flags."""
    f = FX.raw_feed(spark, sf_dir)
    txt = "Consumer complaint narrative"
    return f.select(F.col("Complaint ID").cast("long").alias("doc_id"),
                    L.derive_severity(txt, "Consumer disputed?", "Timely response?",
                                      FX.FIXTURE_SEVERITY_TIERS).alias("severity"),
                    L.derive_severity(txt).alias("keyword_severity"))


@register("derive_emotion", lambda: (
    "SELECT doc_id, "
    + FX.sql_tiers("lower(coalesce(text, ''))", FX.FIXTURE_EMOTION_TIERS, lexicon.EMOTION_DEFAULT)
    + " AS emotion, "
    + FX.sql_tiers("lower(coalesce(text, ''))", lexicon.EMOTION_TIERS, lexicon.EMOTION_DEFAULT)
    + " AS builtin_emotion FROM documents"))
def derive_emotion(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", L.derive_emotion("text", FX.FIXTURE_EMOTION_TIERS).alias("emotion"),
                    L.derive_emotion("text").alias("builtin_emotion"))
