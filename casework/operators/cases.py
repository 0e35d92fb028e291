"""Case listing, counts, breakdowns, latest-wins updates and notes.

Cases are append-only tables.  A status change is an event in an update log;
the current state is a fold of that log (latest non-empty value per field),
so batch and streaming produce the same answer and nothing is rewritten in
place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST_COLUMNS = [
    ("id", None), ("complaint_text", ""), ("category", ""), ("severity", ""), ("emotion", ""),
    ("status", "open"), ("source", "unknown"), ("generation_method", "unknown"), ("created_at", None),
]
UPDATE_FIELDS = ("status", "assignee_id", "resolution_notes")


def check_page_args(page: int, limit: int, max_limit: int = 500) -> None:
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be in 1..{max_limit}")


def equality_filter(df: DataFrame, **filters: str | None) -> DataFrame:
    """Conjunctive equality filter; a filter is applied only when given (pushed to the scan)."""
    for col, value in filters.items():
        if value:
            df = df.where(F.col(col) == value)
    return df


def list_projection(df: DataFrame) -> DataFrame:
    cols = []
    for c, default in LIST_COLUMNS:
        if c not in df.columns:
            cols.append(F.lit(default).alias(c))
        elif default is None:
            cols.append(F.col(c))
        else:
            cols.append(F.coalesce(F.col(c), F.lit(default)).alias(c))
    return df.select(*cols)


def list_page(df: DataFrame, page: int = 1, limit: int = 50, category: str | None = None,
              severity: str | None = None, status: str | None = None) -> DataFrame:
    """Newest first (ties by id), skip ``(page-1)*limit``, take ``limit``.

    Plans as a bounded ``TakeOrderedAndProject`` (offset + limit rows per
    partition), never a full sort.
    """
    check_page_args(page, limit)
    f = equality_filter(df, category=category, severity=severity, status=status)
    ordered = f.orderBy(F.col("created_at").desc(), F.col("id").asc())
    if page > 1:
        ordered = ordered.offset((page - 1) * limit)
    return list_projection(ordered.limit(limit))


def page_cursor(page: DataFrame) -> tuple[str | None, object] | None:
    """Place of a page's last row, as ``list_after`` takes it; None for an empty page.

    The time travels as text (with its offset where the column has a zone), so it means the same
    instant in whatever zone it is read."""
    zoned = isinstance(page.schema["created_at"].dataType, T.TimestampType)
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX") if zoned else F.col("created_at").cast("string")
    last = (page.orderBy(F.col("created_at").asc_nulls_first(), F.col("id").desc())
                .select(at.alias("at"), "id").limit(1).collect())
    return (last[0]["at"], last[0]["id"]) if last else None


def list_after(df: DataFrame, after: tuple[str | None, object] | None = None, limit: int = 50,
               category: str | None = None, severity: str | None = None, status: str | None = None,
               day_col: str | None = None) -> DataFrame:
    """The page that follows the place ``after`` (None: the first), in the order of ``list_page``.

    Each task keeps ``limit`` rows however deep the page lies, and rows added in front do not shift
    it.  ``day_col`` names the column by which a stored case table is partitioned, the date of
    ``created_at`` or the first day of its week, month or year: later folders than the place's are
    not read.  Cases without a time come last, by id."""
    check_page_args(1, limit)
    f = equality_filter(df, category=category, severity=severity, status=status)
    if after is not None:
        at, last_id = after
        created = F.col("created_at")
        if at is None:
            f = f.where(created.isNull() & (F.col("id") > F.lit(last_id)))
            if day_col:
                f = f.where(F.col(day_col).isNull())
        else:
            place = F.lit(at).cast(df.schema["created_at"].dataType)
            f = f.where((created < place) | ((created == place) & (F.col("id") > F.lit(last_id))) | created.isNull())
            if day_col:
                f = f.where((F.col(day_col) <= F.to_date(place)) | F.col(day_col).isNull())
    return list_projection(f.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").asc()).limit(limit))


def filter_count(df: DataFrame, category: str | None = None, severity: str | None = None,
                 status: str | None = None) -> DataFrame:
    f = equality_filter(df, category=category, severity=severity, status=status)
    return f.agg(F.count(F.lit(1)).cast("long").alias("total"))


def breakdown(df: DataFrame, *keys: str) -> DataFrame:
    """``value_counts`` per key combination (partial aggregation map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n"))


def volume_by_day(df: DataFrame, ts_col: str = "created_at", keys: Sequence[str] = ()) -> DataFrame:
    day = F.date_trunc("day", F.col(ts_col)).alias("day")
    return df.groupBy(day, *keys).agg(F.count(F.lit(1)).cast("long").alias("n"))


def _latest(value: str, order: Column) -> Column:
    """Latest non-empty value of a field (null / '' mean 'no change')."""
    keep = F.col(value).isNotNull() & (F.col(value) != "")
    return F.max_by(F.col(value), F.when(keep, order))


def fold_updates(updates: DataFrame, key: str = "case_id", ts_col: str = "ts",
                 tie_col: str = "event_id", fields: Sequence[str] = UPDATE_FIELDS) -> DataFrame:
    """One row per case: latest non-empty value per field, time of the last event
    that changed a field (null: none did), number of events.

    A plain grouped aggregate (``max_by`` over ``(ts, tie)``): partial
    aggregation before the shuffle, one state row per case in streaming.
    """
    order = F.struct(F.col(ts_col), F.col(tie_col))
    given = [f for f in fields if f in updates.columns]
    aggs = [_latest(f, order).alias(f) for f in given]
    changes = F.lit(False)
    for f in given:
        changes = changes | (F.coalesce(F.col(f), F.lit("")) != "")
    return updates.groupBy(key).agg(*aggs, F.max(F.when(changes, F.col(ts_col))).alias("last_update"),
                                    F.count(F.lit(1)).cast("long").alias("n_updates"))


def partial_updates(updates: DataFrame, key: str = "case_id", ts_col: str = "ts", tie_col: str = "event_id",
                    fields: Sequence[str] = UPDATE_FIELDS) -> DataFrame:
    """``fold_updates`` in a form that can be folded again: each field as the greatest
    (ts, tie, value) of its non-empty values.  Updates may come in any order and in any batches."""
    given = [f for f in fields if f in updates.columns]
    filled = {f: F.coalesce(F.col(f), F.lit("")) != "" for f in given}
    newest = [F.max(F.when(filled[f], F.struct(F.col(ts_col).alias("ts"), F.col(tie_col).alias("tie"),
                                               F.col(f).alias("value")))).alias(f) for f in given]
    changes = F.lit(False)
    for f in given:
        changes = changes | filled[f]
    return updates.groupBy(key).agg(*newest, F.max(F.when(changes, F.col(ts_col))).alias("last_update"),
                                    F.count(F.lit(1)).alias("n_updates"))


def merge_partials(parts: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of ``partial_updates`` of several batches as one row a case."""
    newest = [F.max(c).alias(c) for c in parts.columns if c not in (key, "n_updates")]
    return parts.groupBy(key).agg(*newest, F.sum("n_updates").alias("n_updates")).select(parts.columns)


def partial_values(parts: DataFrame, key: str = "case_id") -> DataFrame:
    """Merged partials as the rows of ``fold_updates``."""
    plain = (key, "last_update", "n_updates")
    return parts.select(*[F.col(c) if c in plain else F.col(c)["value"].alias(c) for c in parts.columns])


def apply_updates(base: DataFrame, updates: DataFrame, key: str = "case_id",
                  ts_col: str = "ts", tie_col: str = "event_id",
                  fields: Sequence[str] = UPDATE_FIELDS) -> DataFrame:
    """Current case state: base row overridden by the latest non-empty update per field.

    ``updated_at`` moves to the last event that changed a field (the source application left it
    unchanged; recorded as a deliberate difference).
    """
    folded = fold_updates(updates, key, ts_col, tie_col, fields).withColumnsRenamed(
        {f: f"_new_{f}" for f in fields})
    j = base.join(folded, key, "left")
    out = j
    for f in fields:
        if f in base.columns and f"_new_{f}" in j.columns:
            out = out.withColumn(f, F.coalesce(F.col(f"_new_{f}"), F.col(f)))
    if "updated_at" in base.columns:
        out = out.withColumn("updated_at", F.coalesce(F.col("last_update"), F.col("updated_at")))
    out = out.withColumn("n_updates", F.coalesce(F.col("n_updates"), F.lit(0)).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("_new_")], "last_update")


def unknown_updates(base: DataFrame, updates: DataFrame, key: str = "case_id") -> DataFrame:
    """Updates whose case does not exist (reported, not applied)."""
    return updates.join(base.select(key), key, "left_anti")


def notes_from_updates(base: DataFrame, updates: DataFrame, key: str = "case_id",
                       ts_col: str = "ts", id_col: str = "event_id", author: Column | None = None) -> DataFrame:
    """A note may ride on any update, even one that changes no field; only
    notes for existing cases are kept (semi-join)."""
    n = updates.where(F.col("note").isNotNull() & (F.col("note") != ""))
    n = n.join(base.select(key), key, "left_semi")
    return n.select(F.col(id_col).cast("string").alias("id"), F.col(key).alias("complaint_id"),
                    (author if author is not None else F.lit("system")).alias("user_id"),
                    F.col("note").alias("content"), F.col(ts_col).alias("created_at"))


def notes_for_case(notes: DataFrame, case_id=None) -> DataFrame:
    """Notes of one case (or of all cases), oldest first, ties by id."""
    n = notes if case_id is None else notes.where(F.col("complaint_id") == case_id)
    return n.orderBy("complaint_id", "created_at", "id") if case_id is None else n.orderBy("created_at", "id")


# -- request bounds (checked on the driver before a plan is built) ---------------------

def check_text_request(text: str, min_chars: int = 10, max_chars: int = 2000) -> None:
    if text is None or not min_chars <= len(text) <= max_chars:
        raise ValueError(f"text must be {min_chars}..{max_chars} characters")


def check_batch_request(texts, max_items: int = 500) -> None:
    if not texts or len(texts) > max_items:
        raise ValueError(f"texts must hold 1..{max_items} items")


def check_similar_k(k: int, max_k: int = 10) -> None:
    if not 1 <= k <= max_k:
        raise ValueError(f"k must be in 1..{max_k}")


# -- bounded "newest n" ------------------------------------------------------------------------

NEWEST_GRAINS = ("year", "month", "day", "hour", "minute", "second")


def newest_cutoff(df: DataFrame, n: int, ts_col: str = "created_at", slack: int = 4):
    """Earliest time bucket start such that rows at or after it include the
    newest ``n`` rows, refined from years down to seconds until those rows
    number at most ``slack * n``.

    Each step collects one small histogram (buckets of a single grain inside
    an already narrowed range), never rows.  Returns None when the table holds
    no more than ``n`` rows.
    """
    lower = None
    for grain in NEWEST_GRAINS:
        sub = df if lower is None else df.where(F.col(ts_col) >= F.lit(lower))
        hist = (sub.where(F.col(ts_col).isNotNull())
                   .groupBy(F.date_trunc(grain, F.col(ts_col)).alias("b"))
                   .agg(F.count(F.lit(1)).alias("c")).collect())
        hist.sort(key=lambda r: r["b"], reverse=True)
        total, cut = 0, None
        for r in hist:
            total += r["c"]
            if total >= n:
                cut = r["b"]
                break
        if cut is None:
            return lower
        lower = cut
        if total <= slack * n:
            return lower
    return lower


def newest(df: DataFrame, n: int, ts_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """Newest ``n`` rows (ties by id).  A time cut-off found from histograms
    first removes all but about ``n`` rows, so the final bounded
    ``TakeOrdered`` merges a few rows per partition instead of
    ``partitions x n``.  Rows with a null time sort last, as in the plain form."""
    cut = newest_cutoff(df, n, ts_col)
    if cut is not None:
        df = df.where(F.col(ts_col) >= F.lit(cut))
    return df.orderBy(F.col(ts_col).desc_nulls_last(), F.col(id_col)).limit(n)
