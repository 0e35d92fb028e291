"""Registered queries: Structured Streaming jobs over staged copies of the
driver tables (file source, ``availableNow``), compared with their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.operators import cases as C
from casework.plans import sqltext as S
from casework.plans.q_retrieval import EMBED_DIM, INDEX_COLS, _sql_index_meta
from casework.plans.q_text import FIXTURE_RULES
from casework.plans.registry import register
from casework.session import read_table, scratch_path
from casework.sources import fixtures as FX
from casework.streaming import jobs as J

N_FILES = 4


def _stage(spark, df, name, order_col):
    """The table as a feed of ``N_FILES`` time slices: the first is delivered
    now (the source folder must exist), the rest are the job's ``feed``."""
    path = scratch_path(spark, f"src-{name}")
    first, *rest = J.feed_slices(df, path, N_FILES, order_col)
    first()
    return path, spark.read.parquet(path).schema, rest


def _sql_triage() -> str:
    ctes, sel = S.validated_select("cases", "case_id", "complaint_text", FIXTURE_RULES,
                                   extra_cols=", category, severity, emotion")
    return FX.with_views(
        "SELECT case_id, passed, reason_code, CASE WHEN passed THEN coalesce(category, 'UNKNOWN') END AS category, "
        "CASE WHEN passed THEN severity END AS severity, CASE WHEN passed THEN emotion END AS emotion FROM _v",
        names=["cases"], ctes=ctes + [("_v", sel)])


@register("stream_triage", _sql_triage)
def stream_triage(spark, sf_dir):
    """Cases arrive as files; each micro-batch is validated, labelled and split
    into accepted / rejected tables."""
    src, schema, feed = _stage(spark, FX.cases(spark, sf_dir), "cases", "case_id")
    acc, rej = J.run_triage(spark, src, schema, scratch_path(spark, "triage-out"), FIXTURE_RULES, feed=feed,
                            severity_tiers=FX.FIXTURE_SEVERITY_TIERS, emotion_tiers=FX.FIXTURE_EMOTION_TIERS)
    a = acc.select("case_id", F.lit(True).alias("passed"), F.lit("ok").alias("reason_code"),
                   "category", "severity", "emotion")
    if rej is None:
        return a
    r = rej.select("case_id", F.lit(False).alias("passed"), "reason_code",
                   *[F.lit(None).cast("string").alias(c) for c in ("category", "severity", "emotion")])
    return a.unionByName(r)


def _sql_fold() -> str:
    latest = ", ".join(f"arg_max({f}, ts) FILTER (WHERE {f} IS NOT NULL AND {f} <> '') AS {f}"
                       for f in C.UPDATE_FIELDS)
    changed = " OR ".join(f"coalesce({f}, '') <> ''" for f in C.UPDATE_FIELDS)
    return FX.with_views(f"SELECT case_id, {latest}, max(ts) FILTER (WHERE {changed}) AS last_update, count(*) AS n_updates "
                         "FROM updates GROUP BY case_id", names=["updates"])


@register("stream_status", _sql_fold)
def stream_status(spark, sf_dir):
    """Status-update events arrive in time order; the latest non-empty value per
    field is kept as streaming state (one row per case)."""
    src, schema, feed = _stage(spark, read_table(spark, sf_dir, "events"), "events", "ts")
    out = J.run_status(spark, src, schema, scratch_path(spark, "status-out"), FX.updates_from_events, feed=feed)
    return out.select("case_id", *C.UPDATE_FIELDS, "last_update", "n_updates")


@register("stream_volume", lambda: (
    "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"))
def stream_volume(spark, sf_dir):
    """Daily event counts per type with a 1-hour watermark (files replayed in time order)."""
    src, schema, feed = _stage(spark, read_table(spark, sf_dir, "events"), "volume", "ts")
    out = J.run_volume(spark, src, schema, scratch_path(spark, "volume-out"), "ts", ("event_type",), feed=feed)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@register("stream_index", lambda: FX.with_views(
    _sql_index_meta("(SELECT * FROM cases WHERE complaint_text IS NOT NULL)"), names=["cases"]))
def stream_index(spark, sf_dir):
    """Each micro-batch embeds only unseen cases and appends them to the index."""
    src, schema, feed = _stage(spark, FX.cases(spark, sf_dir), "index", "case_id")
    idx = J.run_index_refresh(spark, src, schema, scratch_path(spark, "stream-index"), EMBED_DIM, feed=feed)
    return idx.select(*INDEX_COLS, F.size("vector").cast("int").alias("vector_dim"))
