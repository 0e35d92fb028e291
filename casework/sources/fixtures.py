"""Deterministic case-shaped views over the driver's tables.

Each view has a Spark builder and the equivalent SQL (a DuckDB CTE) so that
registered queries and their oracles start from identical inputs.  The views
only rename / derive columns row by row; they never filter rows away.

* cases      <- documents   (product and flags derived from source / lang / n_chars)
* raw_feed   <- documents   (the same rows under raw-feed column names)
* labelled   <- documents JOIN labels  (heads: lang, quality, toxic)
* vol_cases  <- orders JOIN customer   (listing / volume fixture)
* updates    <- events      (status-update log; case = user_id)
* base_cases <- customer    (cases the updates apply to)
* notes      <- conversations
* vectors    <- embeddings
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework import lexicon
from casework.functions import text as T
from casework.operators import labels as L
from casework.session import read_table

# ---------------------------------------------------------------------------
# Fixture parameters (ours, not the reference's): the built-in lexicons hit
# almost nothing in the synthetic documents, so fixture queries pass these.
# ---------------------------------------------------------------------------
FIXTURE_PROFANITY = ["stupid", "idiot", "trash"]
FIXTURE_SEVERITY_TIERS = [
    ("critical", ["stupid", "idiot"]),
    ("high", ["trash"]),
    ("medium", ["license", "apache"]),
]
FIXTURE_EMOTION_TIERS = [
    ("angry", ["idiot"]),
    ("frustrated", ["trash", "stupid"]),
    ("confused", ["license"]),
    ("anxious", ["und", "que"]),
]
FIXTURE_CATEGORY_KEYWORDS = {
    "ATM_FAILURE": ["with"],
    "FRAUD_DETECTION": ["que", "und"],
    "UX_ISSUES": ["license", "apache"],
}
N_SOURCES = 20
UNMAPPED_PRODUCT = "Virtual currency"
STATUS_BY_LANG = {"en": "open", "fr": "in_progress", "de": "resolved", "es": "closed"}
CASE_EPOCH = "2024-01-01 00:00:00"


def source_products() -> list[tuple[str, str]]:
    """Rule: ``src{i}`` sells the i-th product of the category map; sources past
    the 18th sell a product the map does not know (their rows get dropped)."""
    names = list(lexicon.CATEGORY_MAP)
    return [(f"src{i}", names[i] if i < 18 else UNMAPPED_PRODUCT) for i in range(N_SOURCES)]


# ---------------------------------------------------------------------------
# SQL helpers
# ---------------------------------------------------------------------------

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_values(rows: list[tuple], cols: list[str]) -> str:
    body = ", ".join("(" + ", ".join(sql_str(v) if isinstance(v, str) else str(v) for v in r) + ")"
                     for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def sql_contains_any(expr: str, words: list[str]) -> str:
    if not words:
        return "FALSE"
    return "(" + " OR ".join(f"contains({expr}, {sql_str(w)})" for w in words) + ")"


def sql_tiers(lower_expr: str, tiers, default: str) -> str:
    parts = " ".join(f"WHEN {sql_contains_any(lower_expr, kws)} THEN {sql_str(lbl)}" for lbl, kws in tiers)
    return f"(CASE {parts} ELSE {sql_str(default)} END)"


def sql_prefix_word_any(expr: str, words: list[str]) -> str:
    import re
    alts = "|".join(re.escape(w) for w in words)
    return f"regexp_matches(lower({expr}), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({alts})')"


def sql_severity(text_expr: str, disputed: str, timely: str, tiers, default="low") -> str:
    text_lower = "lower(coalesce(" + text_expr + ", ''))"
    d = f"lower(trim(coalesce({disputed}, '')))"
    t = f"lower(trim(coalesce({timely}, '')))"
    return (f"(CASE WHEN {d} = 'yes' AND {t} = 'no' THEN 'critical' WHEN {d} = 'yes' THEN 'high' "
            f"WHEN {t} = 'no' THEN 'medium' ELSE {sql_tiers(text_lower, tiers, default)} END)")


# ---------------------------------------------------------------------------
# Spark views
# ---------------------------------------------------------------------------

def _source_products_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(source_products(), "source string, product string")


def _lang_status(col) -> F.Column:
    out = None
    for lang, st in STATUS_BY_LANG.items():
        out = F.when(col == lang, F.lit(st)) if out is None else out.when(col == lang, F.lit(st))
    return out.otherwise(F.lit("open"))


def _epoch_plus_minutes(minutes_col: str) -> F.Column:
    return F.expr(f"TIMESTAMP_NTZ '{CASE_EPOCH}' + {minutes_col} * INTERVAL '1' MINUTE")


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under raw-feed column names, in the public feed's column order."""
    docs = read_table(spark, sf_dir, "documents")
    sp = _source_products_df(spark)
    return (docs.join(F.broadcast(sp), "source", "left")
            .select(F.col("product").alias("Product"),
                    F.col("text").alias("Consumer complaint narrative"),
                    F.col("lang").alias("State"),
                    F.col("source").alias("Submitted via"),
                    F.when(F.col("n_chars") > 3000, "No").otherwise("Yes").alias("Timely response?"),
                    F.when(F.col("lang").isin("fr", "de"), "Yes").otherwise("No").alias("Consumer disputed?"),
                    F.col("doc_id").cast("string").alias("Complaint ID")))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored-case view of documents (one row per document)."""
    docs = read_table(spark, sf_dir, "documents")
    sp = _source_products_df(spark)
    cm = L.mapping_frame(spark, lexicon.CATEGORY_MAP, "product", "category")
    joined = L.with_lower(docs.join(F.broadcast(sp), "source", "left")
                          .join(F.broadcast(cm), "product", "left"), "text")
    return (joined
            .select(F.col("doc_id").alias("case_id"),
                    F.col("doc_id").cast("string").alias("id"),
                    F.col("text").alias("complaint_text"),
                    "category",
                    L.derive_severity("_lower", F.when(F.col("lang").isin("fr", "de"), "Yes").otherwise("No"),
                                      F.when(F.col("n_chars") > 3000, "No").otherwise("Yes"),
                                      FIXTURE_SEVERITY_TIERS, lowered=True).alias("severity"),
                    L.derive_emotion("_lower", FIXTURE_EMOTION_TIERS, lowered=True).alias("emotion"),
                    F.lit("fixture").alias("source"),
                    _lang_status(F.col("lang")).alias("status"),
                    F.col("lang").alias("channel"),
                    F.col("source").alias("location"),
                    _epoch_plus_minutes("doc_id").alias("created_at")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels")
    return (docs.join(lab, "doc_id", "inner")
            .select("doc_id", "text", "lang", "n_chars",
                    F.col("quality").cast("string").alias("quality"),
                    F.col("toxic").cast("string").alias("toxic")))


def vol_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    sev = (F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
            .when(F.col("o_orderpriority") == "2-HIGH", "high")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low"))
    st = (F.when(F.col("o_orderstatus") == "O", "open")
           .when(F.col("o_orderstatus") == "P", "in_progress").otherwise("closed"))
    return (o.join(c, o.o_custkey == c.c_custkey, "inner")
            .select(F.col("o_orderkey").alias("case_id"),
                    F.col("o_orderkey").cast("string").alias("id"),
                    F.concat_ws(" ", F.col("c_name"), F.lit("order"), F.col("o_orderkey").cast("string"))
                    .alias("complaint_text"),
                    F.col("c_mktsegment").alias("category"),
                    sev.alias("severity"),
                    F.lit(None).cast("string").alias("emotion"),
                    st.alias("status"),
                    F.lit("orders").alias("source"),
                    F.lit(None).cast("string").alias("generation_method"),
                    F.col("o_orderdate").alias("created_at")))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status-update log: one row per event; blank / null fields mean 'no change'."""
    return updates_from_events(read_table(spark, sf_dir, "events"))


def updates_from_events(e: DataFrame) -> DataFrame:
    """Row-wise projection (works on a batch or a streaming frame)."""
    et = F.col("event_type")
    return e.select(
        F.col("event_id"),
        F.col("user_id").alias("case_id"),
        F.col("ts"),
        F.when(et == "signup", "open").when(et == "click", "in_progress")
         .when(et == "purchase", "resolved").when(et == "error", "").alias("status"),
        F.when(et.isin("click", "purchase"),
               F.concat(F.lit("agent-"), F.get_json_object("props", "$.k"))).otherwise(F.lit(""))
         .alias("assignee_id"),
        F.when(et == "purchase", F.concat(F.lit("paid "), F.col("event_id").cast("string")))
         .alias("resolution_notes"),
        F.when(et.isin("error", "view"), F.concat(F.lit("note "), F.col("event_id").cast("string")))
         .alias("note"))


def base_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("case_id"),
                    F.lit("open").alias("status"),
                    F.lit(None).cast("string").alias("assignee_id"),
                    F.lit(None).cast("string").alias("resolution_notes"),
                    F.expr(f"TIMESTAMP_NTZ '{CASE_EPOCH}'").alias("updated_at"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = read_table(spark, sf_dir, "conversations")
    return cv.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
                     F.col("conv_id").alias("complaint_id"),
                     F.col("role").alias("user_id"),
                     F.col("text").alias("content"),
                     _epoch_plus_minutes("(conv_id * 60 + turn)").alias("created_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


# ---------------------------------------------------------------------------
# SQL twins (DuckDB CTE bodies over the pre-registered driver views)
# ---------------------------------------------------------------------------

def _sql_lang_status(col: str) -> str:
    return "(CASE " + " ".join(f"WHEN {col} = {sql_str(k)} THEN {sql_str(v)}" for k, v in STATUS_BY_LANG.items()) \
        + " ELSE 'open' END)"


def sql_cases() -> str:
    sp = sql_values(source_products(), ["source", "product"])
    cm = sql_values(sorted(lexicon.CATEGORY_MAP.items()), ["product", "category"])
    sev = sql_severity("d.text", "CASE WHEN d.lang IN ('fr','de') THEN 'Yes' ELSE 'No' END",
                       "CASE WHEN d.n_chars > 3000 THEN 'No' ELSE 'Yes' END", FIXTURE_SEVERITY_TIERS)
    emo = sql_tiers("lower(d.text)", FIXTURE_EMOTION_TIERS, lexicon.EMOTION_DEFAULT)
    return f"""SELECT d.doc_id AS case_id, CAST(d.doc_id AS VARCHAR) AS id, d.text AS complaint_text,
  cm.category AS category, {sev} AS severity, {emo} AS emotion, 'fixture' AS source,
  {_sql_lang_status('d.lang')} AS status, d.lang AS channel, d.source AS location,
  TIMESTAMP '{CASE_EPOCH}' + d.doc_id * INTERVAL 1 MINUTE AS created_at
FROM documents d LEFT JOIN {sp} sp ON d.source = sp.source LEFT JOIN {cm} cm ON sp.product = cm.product"""


def sql_raw_feed() -> str:
    sp = sql_values(source_products(), ["source", "product"])
    return f"""SELECT sp.product AS "Product", d.text AS "Consumer complaint narrative",
  d.lang AS "State", d.source AS "Submitted via",
  CASE WHEN d.n_chars > 3000 THEN 'No' ELSE 'Yes' END AS "Timely response?",
  CASE WHEN d.lang IN ('fr','de') THEN 'Yes' ELSE 'No' END AS "Consumer disputed?",
  CAST(d.doc_id AS VARCHAR) AS "Complaint ID"
FROM documents d LEFT JOIN {sp} sp ON d.source = sp.source"""


def sql_labelled() -> str:
    return """SELECT d.doc_id, d.text, d.lang, d.n_chars, CAST(l.quality AS VARCHAR) AS quality,
  CAST(l.toxic AS VARCHAR) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def sql_vol_cases() -> str:
    return """SELECT o.o_orderkey AS case_id, CAST(o.o_orderkey AS VARCHAR) AS id,
  c.c_name || ' order ' || CAST(o.o_orderkey AS VARCHAR) AS complaint_text,
  c.c_mktsegment AS category,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
       WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
  CAST(NULL AS VARCHAR) AS emotion,
  CASE o.o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'closed' END AS status,
  'orders' AS source, CAST(NULL AS VARCHAR) AS generation_method, o.o_orderdate AS created_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""


def sql_updates() -> str:
    return """SELECT event_id, user_id AS case_id, ts,
  CASE event_type WHEN 'signup' THEN 'open' WHEN 'click' THEN 'in_progress'
       WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN '' END AS status,
  CASE WHEN event_type IN ('click','purchase') THEN 'agent-' || json_extract_string(props, '$.k') ELSE '' END
    AS assignee_id,
  CASE WHEN event_type = 'purchase' THEN 'paid ' || CAST(event_id AS VARCHAR) END AS resolution_notes,
  CASE WHEN event_type IN ('error','view') THEN 'note ' || CAST(event_id AS VARCHAR) END AS note
FROM events"""


def sql_base_cases() -> str:
    return f"""SELECT c_custkey AS case_id, 'open' AS status, CAST(NULL AS VARCHAR) AS assignee_id,
  CAST(NULL AS VARCHAR) AS resolution_notes, TIMESTAMP '{CASE_EPOCH}' AS updated_at FROM customer"""


def sql_notes() -> str:
    return f"""SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, conv_id AS complaint_id,
  role AS user_id, text AS content,
  TIMESTAMP '{CASE_EPOCH}' + (conv_id * 60 + turn) * INTERVAL 1 MINUTE AS created_at FROM conversations"""


SQL_VIEWS = {
    "cases": sql_cases,
    "raw_feed": sql_raw_feed,
    "labelled": sql_labelled,
    "vol_cases": sql_vol_cases,
    "updates": sql_updates,
    "base_cases": sql_base_cases,
    "notes": sql_notes,
}


def with_views(sql: str, names=(), ctes=()) -> str:
    """Prefix ``sql`` with the named fixture views, then extra ``(name, body)`` CTEs."""
    parts = [f"{n} AS ({SQL_VIEWS[n]()})" for n in names] + [f"{n} AS ({b})" for n, b in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
