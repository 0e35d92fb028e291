"""Licence scan by canonical digest lookup.

A text is brought to a canonical form (lower case, no copyright lines, equivalent spellings
made one, only letters and digits kept, single spaces) and digested; the digest of the whole
text is joined to the digests of known licence texts, which go through the same expression.

All of it is built-in expressions in one pass over the texts.  The built-in list is a few
rows; a list given by the caller is broadcast only if it is counted to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.licence_texts import TEXTS

MAX_BROADCAST = 100_000

# Spellings held to be equal, as (pattern, replacement).
COPYRIGHT_LINE = (r"(^|\n)[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|\d{4}|<year>|\[yyyy\])|\(c\)[ \t]*\d{4}|©)[^\n]*", r"\n")
SPELLINGS = [
    (r"(authori|organi|recogni|utili|reali|initiali|capitali|customi)s(e|ation|ing)", r"$1z$2"),
    (r"(behavi|col|fav|hon|lab)our", r"$1or"),
    (r"(acknowledg|judg)ement", r"$1ment"),
    (r"(sub|non|per)[- ](licen|commercial|cent)", r"$1$2"),
]
WORDS = [
    ("licence", "license"), ("all rights reserved", " "), ("copyright holder", "copyright owner"),
    ("fulfil ", "fulfill "), ("centre", "center"), ("analyse", "analyze"), ("catalogue", "catalog"),
    ("programme", "program"), ("whilst", "while"), ("https:", "http:"),
]
NOT_TEXT = r"[^\p{L}\p{N}]+"


def canonical(text: str = "text") -> Column:
    """Canonical form of a text column; null and blank texts give ''."""
    c = F.lower(F.coalesce(F.col(text), F.lit("")))
    c = F.regexp_replace(c, COPYRIGHT_LINE[0], "\n")
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, pattern, to)
    for word, to in WORDS:
        c = F.replace(c, F.lit(word), F.lit(to))
    return F.trim(F.regexp_replace(c, NOT_TEXT, " "))


def digest(text: str = "text") -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, licence) of the known texts; of equal digests the smallest name counts.

    ``known`` has columns licence and text; default: the built-in list.
    """
    if known is None:
        known = spark.createDataFrame(list(TEXTS.items()), "licence string, text string")
    return (known.select(digest("text").alias("digest"), "licence")
            .groupBy("digest").agg(F.min("licence").alias("licence")))


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``digest`` and ``licence`` (null: no known text).

    Every row is kept; columns of those names are replaced.  Null and blank texts digest as
    the empty text, which is no licence; equal texts get equal results; an empty table gives
    an empty result.  A text matches as a whole or not at all.
    """
    table = known_digests(docs.sparkSession, known).where(F.col("digest") != F.sha2(F.lit(""), 256))
    if known is None or table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        table = F.broadcast(table)
    return docs.drop("licence").withColumn("digest", digest(text)).join(table, "digest", "left")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "digest", "licence")


def _sql(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"lower(coalesce({text}, ''))"
    c = f"regexp_replace({c}, {quoted(COPYRIGHT_LINE[0])}, chr(10), 'g')"
    for pattern, to in SPELLINGS:
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    for word, to in WORDS:
        c = f"replace({c}, {quoted(word)}, {quoted(to)})"
    return f"trim(regexp_replace({c}, {quoted(NOT_TEXT)}, ' ', 'g'))"


def oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEXTS.items())
    return f"""
WITH known AS (
  SELECT sha256({_sql('text')}) AS digest, min(licence) AS licence
  FROM (VALUES {rows}) k(licence, text) GROUP BY 1
)
SELECT doc_id, d.digest, licence
FROM (SELECT doc_id, sha256({_sql('text')}) AS digest FROM documents) d LEFT JOIN known USING (digest)
"""


ORACLE_SQL = oracle_sql()
