"""Registered queries: intake, sampling, dedup, listing, updates and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework import lexicon
from casework.operators import cases as C
from casework.operators import intake as I
from casework.operators import labels as L
from casework.operators import sampling as SM
from casework.operators import validate as V
from casework.plans import sqltext as S
from casework.plans.registry import register
from casework.session import read_table, scratch_path
from casework.sources import csv as CSV
from casework.sources import fixtures as FX
from casework.sources import tables as TB

FIXED_NOW = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"
SQL_NOW = "TIMESTAMP '2024-06-01 00:00:00'"
SAMPLE_LIMIT = 400
PAGE, PAGE_LIMIT = 2, 50
LIST_FILTER = {"category": "BUILDING", "status": "open"}


def _md5_rank(id_sql: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({id_sql} AS VARCHAR))"


# -- O7-O9, A4 -------------------------------------------------------------

@register("dedup_text", lambda: (
    "SELECT doc_id, text, lang, source, n_chars FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"))
def dedup_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return SM.dedup_keep_first(d, "text", "doc_id")


@register("stratified_sample", lambda: (
    f"WITH k AS (SELECT count(*) AS n, count(DISTINCT lang) AS c FROM documents WHERE lang IS NOT NULL) "
    f"SELECT doc_id, lang FROM documents, k WHERE k.n <= {SAMPLE_LIMIT} OR (lang IS NOT NULL AND doc_id IN ("
    f"SELECT doc_id FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER "
    f"(PARTITION BY lang ORDER BY {_md5_rank('doc_id')}, doc_id) <= {SAMPLE_LIMIT} // k.c))"))
def stratified_sample(spark, sf_dir):
    """Seeded per-language sample of ``limit // n_lang`` documents (exact counts)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return SM.stratified_sample(d, "lang", SAMPLE_LIMIT, "doc_id")


@register("stratified_split", lambda: FX.with_views(
    f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_md5_rank('doc_id')}, doc_id)"
    " <= (count(*) OVER (PARTITION BY lang) * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split "
    "FROM labelled", names=["labelled"]))
def stratified_split(spark, sf_dir):
    """80/20 split of the labelled documents, stratified by language."""
    lab = FX.labelled(spark, sf_dir).select("doc_id", "lang")
    return SM.stratified_split(lab, "lang", "doc_id", test_pct=20)


# -- S2, P1-P3, L1-L3, V8, V9: prepare the raw feed -----------------------------

def _sql_prepare() -> str:
    narr = '"Consumer complaint narrative"'
    sev = FX.sql_severity(narr, '"Consumer disputed?"', '"Timely response?"', FX.FIXTURE_SEVERITY_TIERS)
    emo = FX.sql_tiers(f"lower(coalesce({narr}, ''))", FX.FIXTURE_EMOTION_TIERS, lexicon.EMOTION_DEFAULT)
    cm = FX.sql_values(sorted(lexicon.CATEGORY_MAP.items()), ["product", "category"])
    p = (f"SELECT {S.py_strip(narr)} AS complaint_text, m.category, {sev} AS severity, {emo} AS emotion, "
         f"coalesce(\"State\", '') AS location, coalesce(\"Submitted via\", '') AS channel, "
         f"coalesce(\"Complaint ID\", '') AS customer_id, CAST(\"Complaint ID\" AS BIGINT) AS _k "
         f"FROM raw_feed f JOIN {cm} m ON f.\"Product\" = m.product "
         f"WHERE {narr} IS NOT NULL AND length({S.py_strip(narr)}) >= 50")
    d = "SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY complaint_text ORDER BY _k) = 1"
    return FX.with_views(
        "SELECT complaint_text, category, severity, emotion, location, channel, customer_id FROM d "
        "WHERE length(complaint_text) >= 50",
        names=["raw_feed"], ctes=[("p", p), ("d", d)])


def _prepared(spark, sf_dir):
    raw = FX.raw_feed(spark, sf_dir)
    return I.prepare_feed(raw, order_col=F.col("`Complaint ID`").cast("long"),
                          severity_tiers=FX.FIXTURE_SEVERITY_TIERS, emotion_tiers=FX.FIXTURE_EMOTION_TIERS)


@register("prepare_feed", _sql_prepare)
def prepare_feed(spark, sf_dir):
    return _prepared(spark, sf_dir)


def _sql_seed() -> str:
    body = _sql_prepare()
    # reuse the prepare CTEs, then the seed projection
    head, _, _tail = body.rpartition("SELECT complaint_text, category, severity, emotion")
    prepared = ("SELECT complaint_text, category, severity, emotion, location, channel, customer_id FROM d "
                "WHERE length(complaint_text) >= 50")
    t = S.py_strip("complaint_text")

    def opt(c):
        return f"CASE WHEN {S.py_strip(f'coalesce({c}, {chr(39)}{chr(39)})')} = '' THEN NULL ELSE {c} END"

    seed = (f"SELECT 'seed-' || customer_id AS id, {t} AS complaint_text, "
            f"coalesce({opt('category')}, 'UX_ISSUES') AS category, coalesce({opt('severity')}, 'medium') AS severity, "
            f"coalesce({opt('emotion')}, 'frustrated') AS emotion, 'csv_upload' AS source, 'open' AS status, "
            f"{SQL_NOW} AS created_at, {SQL_NOW} AS updated_at, CAST(NULL AS VARCHAR) AS specific_issue, "
            f"{opt('location')} AS location, {opt('channel')} AS channel, {opt('customer_id')} AS customer_id, "
            f"CAST(NULL AS VARCHAR) AS customer_name, 'cfpb_dataset' AS generation_method, "
            f"{S.word_count(t)} AS word_count, {S.char_count(t)} AS character_count "
            f"FROM ({prepared}) WHERE coalesce(length({t}), 0) >= 20")
    return head + seed


@register("seed_cases", _sql_seed)
def seed_cases(spark, sf_dir):
    prep = _prepared(spark, sf_dir)
    return I.seed_cases(prep, now=F.expr(FIXED_NOW),
                        id_col=F.concat(F.lit("seed-"), F.col("customer_id")))


# -- S1, S3, S9, P4, P5, L4, V7: CSV upload round trip ---------------------------

def _upload_frame(spark, sf_dir):
    """Cases as an upload file: unmapped category, Spanish severity and German
    emotion left blank so that label filling has work to do."""
    c = FX.cases(spark, sf_dir)
    return c.select(
        "complaint_text",
        F.coalesce("category", F.lit("")).alias("category"),
        F.when(F.col("channel") == "es", F.lit("")).otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("channel") == "de", F.lit(None)).otherwise(F.col("emotion")).alias("emotion"),
        F.lit(None).cast("string").alias("customer_name"),
        F.col("id").alias("customer_id"), "channel", "location")


def _upload_sql() -> str:
    return ("SELECT complaint_text, coalesce(category, '') AS category, "
            "CASE WHEN channel = 'es' THEN '' ELSE severity END AS severity, "
            "CASE WHEN channel = 'de' THEN NULL ELSE emotion END AS emotion, "
            "CAST(NULL AS VARCHAR) AS customer_name, id AS customer_id, channel, location FROM cases")


def _roundtrip(spark, sf_dir):
    path = scratch_path(spark, "upload") + "/cases.csv"
    CSV.write_csv(_upload_frame(spark, sf_dir), path)
    return CSV.read_upload(spark, path)


@register("csv_intake", lambda: FX.with_views(
    "SELECT complaint_text, CASE WHEN category = '' THEN NULL ELSE category END AS category, "
    "CASE WHEN severity = '' THEN NULL ELSE severity END AS severity, emotion, customer_name, customer_id, "
    "channel, location FROM up", names=["cases"], ctes=[("up", _upload_sql())]))
def csv_intake(spark, sf_dir):
    """Write cases as CSV (quoted newlines, doubled quotes), read back as strings."""
    return _roundtrip(spark, sf_dir).select(*["complaint_text", *CSV.UPLOAD_OPTIONAL])


def _sql_build() -> str:
    from casework.operators.validate import Rules
    up = _upload_sql()
    t = S.py_strip("complaint_text")
    stripped = (f"SELECT {t} AS complaint_text, category, severity, emotion, customer_name, customer_id, "
                f"channel, location FROM up")
    ctes, sel = S.validated_select("st", "customer_id", "complaint_text", Rules(),
                                   extra_cols=", complaint_text, category, severity, emotion, channel, location")
    pred_sev = FX.sql_severity("complaint_text", "NULL", "NULL", FX.FIXTURE_SEVERITY_TIERS)
    pred_emo = FX.sql_tiers("lower(coalesce(complaint_text, ''))", FX.FIXTURE_EMOTION_TIERS, "frustrated")

    def blank(c):
        return f"CASE WHEN {S.py_strip(f'coalesce({c}, {chr(39)}{chr(39)})')} = '' THEN NULL ELSE {c} END"

    final = (f"SELECT 'csv-' || customer_id AS id, complaint_text, coalesce({blank('category')}, 'UNKNOWN') AS category, "
             f"coalesce({blank('severity')}, {pred_sev}, 'medium') AS severity, "
             f"coalesce({blank('emotion')}, {pred_emo}, 'neutral') AS emotion, 'csv_upload' AS source, "
             f"'open' AS status, {SQL_NOW} AS created_at, {SQL_NOW} AS updated_at, "
             f"CAST(NULL AS VARCHAR) AS customer_name, {blank('customer_id')} AS customer_id, "
             f"{blank('channel')} AS channel, {blank('location')} AS location, word_count, "
             f"char_count AS character_count, 'csv_upload' AS generation_method FROM _v WHERE passed")
    return FX.with_views(final, names=["cases"],
                         ctes=[("up", up), ("st", stripped), *ctes, ("_v", sel)])


@register("build_cases", _sql_build)
def build_cases(spark, sf_dir):
    """Upload -> validate -> fill blank labels (rule predictor) -> case records."""
    up = _roundtrip(spark, sf_dir)
    up = L.with_lower(up, "complaint_text")
    up = up.withColumn("_pred_severity", L.derive_severity("_lower", tiers=FX.FIXTURE_SEVERITY_TIERS, lowered=True)) \
           .withColumn("_pred_emotion", L.derive_emotion("_lower", FX.FIXTURE_EMOTION_TIERS, lowered=True)) \
           .drop("_lower")
    records, _rejected = I.build_cases(up, predicted={"severity": "_pred_severity", "emotion": "_pred_emotion"},
                                       now=F.expr(FIXED_NOW),
                                       id_col=F.concat(F.lit("csv-"), F.col("customer_id")))
    return records


# -- S1-S3, S6, S7, V7: files with their own headers, stored and counted in one run -------------------

def _rule_labels(up):
    """Severity and emotion by rules, for blank labels."""
    up = L.with_lower(up, "complaint_text")
    up = (up.withColumn("_pred_severity", L.derive_severity("_lower", tiers=FX.FIXTURE_SEVERITY_TIERS, lowered=True))
            .withColumn("_pred_emotion", L.derive_emotion("_lower", FX.FIXTURE_EMOTION_TIERS, lowered=True)).drop("_lower"))
    return up, {"severity": "_pred_severity", "emotion": "_pred_emotion"}


def _stored_upload(spark, sf_dir):
    """All cases as an upload of files with two header orders (German ones the other way round), stored."""
    folder = scratch_path(spark, "upload") + "/cases.csv"
    up = _upload_frame(spark, sf_dir)
    german = F.coalesce(F.col("channel") == "de", F.lit(False))
    CSV.write_csv(up.where(~german), folder)
    CSV.write_csv(up.where(german).select(*reversed(up.columns)), folder, mode="append")
    table = scratch_path(spark, "intake")
    counts = I.store_upload(spark, folder, table, _rule_labels, now=F.expr(FIXED_NOW),
                            id_col=F.concat(F.lit("csv-"), F.col("customer_id")))
    return table, counts


def _sql_judged(select: str) -> str:
    t = S.py_strip("complaint_text")
    missing = ", ".join(S.sql_str(x) for x in lexicon.CSV_NA_VALUES)
    stripped = (f"SELECT {t} AS complaint_text, customer_id FROM up WHERE complaint_text <> '' "
                f"AND complaint_text NOT IN ({missing})")
    ctes, sel = S.validated_select("st", "customer_id", "complaint_text", V.Rules(), extra_cols=", complaint_text")
    return FX.with_views(select, names=["cases"], ctes=[("up", _upload_sql()), ("st", stripped), *ctes, ("_v", sel)])


@register("store_upload", _sql_build)
def store_upload(spark, sf_dir):
    """Cases read back from the table that the upload was stored in."""
    table, _ = _stored_upload(spark, sf_dir)
    return TB.read_accepted(spark, table)


@register("store_rejects", lambda: _sql_judged(
    "SELECT customer_id, complaint_text, reason_code, reason FROM _v WHERE NOT passed"))
def store_rejects(spark, sf_dir):
    """Rejected rows of the same run, with why."""
    table, _ = _stored_upload(spark, sf_dir)
    return TB.read_rejected(spark, table).select("customer_id", "complaint_text", "reason_code", "reason")


@register("store_counts", lambda: _sql_judged(
    "SELECT count(*) FILTER (WHERE passed) AS stored, count(*) FILTER (WHERE NOT passed) AS skipped, "
    "count(*) AS total_rows FROM _v"))
def store_counts(spark, sf_dir):
    """What the run that stored the upload counted."""
    _, counts = _stored_upload(spark, sf_dir)
    return spark.createDataFrame([(counts["stored"], counts["skipped"], counts["total_rows"])],
                                 "stored long, skipped long, total_rows long")


@register("store_seeds", _sql_seed)
def store_seeds(spark, sf_dir):
    """The raw feed read from CSV, prepared, seeded, appended by day and read back."""
    folder = scratch_path(spark, "feed") + "/feed.csv"
    CSV.write_csv(FX.raw_feed(spark, sf_dir), folder)
    raw = CSV.read_checked(spark, folder)
    prep = I.prepare_feed(raw.where(F.col(CSV.UNREADABLE).isNull()).drop(CSV.UNREADABLE),
                          order_col=F.col("`Complaint ID`").cast("long"),
                          severity_tiers=FX.FIXTURE_SEVERITY_TIERS, emotion_tiers=FX.FIXTURE_EMOTION_TIERS)
    table = scratch_path(spark, "seeds")
    TB.append_cases(I.seed_cases(prep, now=F.expr(FIXED_NOW), id_col=F.concat(F.lit("seed-"), F.col("customer_id"))), table)
    return TB.read_cases(spark, table)


# -- A1-A3, O1, P7, V10: listing -------------------------------------------------

@register("list_page", lambda: FX.with_views(
    "SELECT id, coalesce(complaint_text, '') AS complaint_text, coalesce(category, '') AS category, "
    "coalesce(severity, '') AS severity, coalesce(emotion, '') AS emotion, coalesce(status, 'open') AS status, "
    "coalesce(source, 'unknown') AS source, coalesce(generation_method, 'unknown') AS generation_method, "
    f"created_at FROM vol_cases WHERE category = 'BUILDING' AND status = 'open' "
    f"ORDER BY created_at DESC, id ASC LIMIT {PAGE_LIMIT} OFFSET {(PAGE - 1) * PAGE_LIMIT}",
    names=["vol_cases"]))
def list_page(spark, sf_dir):
    return C.list_page(FX.vol_cases(spark, sf_dir), page=PAGE, limit=PAGE_LIMIT, **LIST_FILTER)


@register("list_after", lambda: FX.with_views(
    "SELECT id, coalesce(complaint_text, '') AS complaint_text, coalesce(category, '') AS category, "
    "coalesce(severity, '') AS severity, coalesce(emotion, '') AS emotion, coalesce(status, 'open') AS status, "
    "coalesce(source, 'unknown') AS source, coalesce(generation_method, 'unknown') AS generation_method, "
    f"created_at FROM vol_cases WHERE category = 'BUILDING' AND status = 'open' "
    f"ORDER BY created_at DESC, id ASC LIMIT {PAGE_LIMIT} OFFSET {(PAGE - 1) * PAGE_LIMIT}",
    names=["vol_cases"]))
def list_after(spark, sf_dir):
    """The page of ``list_page``, reached by cursor over the stored case table."""
    path = scratch_path(spark, "list-after")
    TB.append_cases(FX.vol_cases(spark, sf_dir), path, "month")
    stored = spark.read.parquet(path)
    page, after = None, None
    for _ in range(PAGE):
        page = C.list_after(stored, after, PAGE_LIMIT, day_col=TB.CASE_PARTITION, **LIST_FILTER)
        after = C.page_cursor(page)
    return page


@register("filter_count", lambda: FX.with_views(
    "SELECT count(*) AS total FROM vol_cases WHERE category = 'BUILDING' AND status = 'open'",
    names=["vol_cases"]))
def filter_count(spark, sf_dir):
    return C.filter_count(FX.vol_cases(spark, sf_dir), **LIST_FILTER)


@register("breakdown", lambda: FX.with_views(
    "SELECT category, severity, count(*) AS n FROM vol_cases GROUP BY ALL", names=["vol_cases"]))
def breakdown(spark, sf_dir):
    return C.breakdown(FX.vol_cases(spark, sf_dir), "category", "severity")


@register("volume_by_day", lambda: FX.with_views(
    "SELECT date_trunc('day', created_at) AS day, category, count(*) AS n FROM vol_cases GROUP BY ALL",
    names=["vol_cases"]))
def volume_by_day(spark, sf_dir):
    return C.volume_by_day(FX.vol_cases(spark, sf_dir), "created_at", ["category"])


# -- C1-C3, J2, J5, V11, O2, P9: updates and notes ----------------------------------

def _sql_latest(f: str) -> str:
    return f"arg_max({f}, ts) FILTER (WHERE {f} IS NOT NULL AND {f} <> '')"


@register("apply_status", lambda: FX.with_views(
    "SELECT b.case_id, coalesce(u.status, b.status) AS status, coalesce(u.assignee_id, b.assignee_id) AS assignee_id, "
    "coalesce(u.resolution_notes, b.resolution_notes) AS resolution_notes, "
    "coalesce(u.last_update, b.updated_at) AS updated_at, CAST(coalesce(u.n, 0) AS BIGINT) AS n_updates "
    "FROM base_cases b LEFT JOIN (SELECT case_id, "
    + ", ".join(f"{_sql_latest(f)} AS {f}" for f in C.UPDATE_FIELDS)
    + ", max(ts) FILTER (WHERE " + " OR ".join(f"coalesce({f}, '') <> ''" for f in C.UPDATE_FIELDS) + ") AS last_update, count(*) AS n FROM updates GROUP BY case_id) u ON b.case_id = u.case_id",
    names=["updates", "base_cases"]))
def apply_status(spark, sf_dir):
    return C.apply_updates(FX.base_cases(spark, sf_dir), FX.updates(spark, sf_dir))


@register("unknown_updates", lambda: FX.with_views(
    "SELECT event_id, case_id FROM updates u WHERE NOT EXISTS (SELECT 1 FROM base_cases b WHERE b.case_id = u.case_id)",
    names=["updates", "base_cases"]))
def unknown_updates(spark, sf_dir):
    return C.unknown_updates(FX.base_cases(spark, sf_dir), FX.updates(spark, sf_dir)).select("event_id", "case_id")


@register("append_notes", lambda: FX.with_views(
    "SELECT CAST(event_id AS VARCHAR) AS id, case_id AS complaint_id, 'system' AS user_id, note AS content, "
    "ts AS created_at FROM updates u WHERE note IS NOT NULL AND note <> '' "
    "AND EXISTS (SELECT 1 FROM base_cases b WHERE b.case_id = u.case_id)", names=["updates", "base_cases"]))
def append_notes(spark, sf_dir):
    return C.notes_from_updates(FX.base_cases(spark, sf_dir), FX.updates(spark, sf_dir))


@register("notes_for_case", lambda: FX.with_views(
    "SELECT n.id, n.complaint_id, n.user_id, n.content, n.created_at FROM notes n "
    "JOIN (SELECT DISTINCT case_id FROM cases) c ON n.complaint_id = c.case_id "
    "ORDER BY n.complaint_id, n.created_at, n.id", names=["notes", "cases"]))
def notes_for_case(spark, sf_dir):
    """Notes of every known case, oldest first within each case (J2 + O2)."""
    n = FX.notes(spark, sf_dir)
    known = FX.cases(spark, sf_dir).select(F.col("case_id").alias("complaint_id"))
    return C.notes_for_case(n.join(known, "complaint_id", "left_semi"))
