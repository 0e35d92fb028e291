"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (a shorter item is one window); a window is the set
of its shingles, ``SHINGLE`` words in a row with their offsets (a shorter window is one shingle).
A document holds a window where all of its shingles stand at their offsets.

1. Every shingle of every document meets the items' distinct shingles in one equality join (by
   hash, then by text), which leaves the places of known shingles; a marker row keeps each document.
2. Shingles are ordered by rarity: how many places they have in all documents.  All of a window's
   shingles must be there, so the necessary prefix of a window is its single rarest one: only
   places of that one are candidates, and a window with a shingle without any place has none.
3. Length and positional bounds: with the shingle at its offset the window must lie in the document.
4. Candidates are verified exactly: shingles at both ends of the window (which cover it) and every
   ``SHINGLE`` words between must have places at their offsets.

Equal texts are looked at once.  Words hit are the union of occurrences, from one window of interval
ends.  Items are looked up once for each distinct set of windows, not once a document, so copies of a
document or of an item make no pairs.  Only built-in expressions run.  The items' shingles, windows and ends are broadcast when
counted to be at most ``MAX_BROADCAST`` rows; above that Spark joins them by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.session import written

WINDOW, SHINGLE = 10, 5
#: Rows of a side that is broadcast, at most (a shingle of five words takes about 100 bytes).
MAX_BROADCAST = 500_000
#: What stands between words: all of ASCII but letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    parts = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), BREAK, -1)
    return F.filter(parts, lambda w: w != "")


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(item_id, words): windows of every item, item_id as a string (a null one is empty)."""
    w = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item_id"), words(text).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (w.where(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("s"))
            .select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("words")))


def shingle_texts(w: str, size: Column) -> Column:
    """Texts of the shingles of an array of words, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))


def places(docs: DataFrame, shingles: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc, row_key, n_words, pos, sid): a marker row (pos -1, sid null) for every row of ``docs`` (row_key, text), and
    the 0-based places of the known ``shingles`` (sid, n, h, shingle).  ``doc``: digest of the text."""
    w = docs.select("row_key", F.md5(F.coalesce("text", F.lit(""))).alias("doc"), words("text").alias("w"))
    def at(n: int) -> Column:
        inner = F.sequence(F.lit(0), F.size("w") - n)
        return F.when(F.size("w") >= n, F.transform(inner, lambda i: F.struct(
            i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(F.slice("w", i + 1, F.lit(n))).alias("h"))))

    none = F.expr("array(named_struct('pos', -1, 'n', 0, 'h', 0L))")
    all_at = F.concat(none, *[F.coalesce(at(n), F.slice(none, 1, 0)) for n in lengths])
    rows = w.select("row_key", "doc", "w", F.size("w").cast("long").alias("n_words"), F.explode(all_at).alias("e"))
    known = small(shingles.select("sid", F.col("n").alias("kn"), F.col("h").alias("kh"), F.col("shingle")))
    # A hash that agrees is checked by text; a row whose text does not agree falls out (sid null).
    found = rows.join(known, (F.col("e.h") == F.col("kh")) & (F.col("e.n") == F.col("kn")) & (
        F.array_join(F.slice("w", F.greatest(F.col("e.pos"), F.lit(0)) + 1, F.col("e.n")), " ") == F.col("shingle")), "left")
    return found.where((F.col("e.pos") < 0) | F.col("sid").isNotNull()).select(
        "doc", "row_key", "n_words", F.col("e.pos").alias("pos"), "sid")


def occurrences(hits: DataFrame, windows: DataFrame, in_window: DataFrame, shingle: int) -> DataFrame:
    """(doc, s, wid, size): where windows occur.  ``hits``: (doc, n_words, pos, sid); ``windows``: (wid, size);
    ``in_window``: (wid, offset, sid), all shingles of each window."""
    rarity = hits.groupBy("sid").agg(F.count(F.lit(1)).alias("places"))
    ranked = (in_window.join(rarity, "sid", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "offset", "sid")).alias("least")))
    prefix = written(ranked.where("least.places > 0").join(windows, "wid").select(
        "wid", "size", F.col("least.offset").alias("offset"), F.col("least.sid").alias("sid")), "leak-prefix")
    s = F.col("pos") - F.col("offset")
    cands = (hits.join(small(prefix), "sid").select("doc", "n_words", s.alias("s"), "wid", "size")
             .where((F.col("s") >= 0) & (F.col("s") + F.col("size") <= F.col("n_words"))))
    # Shingles that cover a window: every ``shingle`` words, and the last.
    last = Window.partitionBy("wid")
    cover = in_window.withColumn("end", F.max("offset").over(last)).where(
        (F.col("offset") % shingle == 0) | (F.col("offset") == F.col("end")))
    cover = written(cover.groupBy("wid").agg(F.collect_list(F.struct("offset", "sid")).alias("cover")), "leak-cover")
    need = cands.join(small(cover), "wid").select("doc", "s", "wid", "size", F.size("cover").alias("needed"),
                                                  F.explode("cover").alias("c"))
    need = need.select("doc", "s", "wid", "size", "needed", (F.col("s") + F.col("c.offset")).alias("pos"), F.col("c.sid").alias("sid"))
    there = need.join(hits.select("doc", "pos", "sid"), ["doc", "pos", "sid"], "left_semi")
    return there.groupBy("doc", "s", "wid", "size", "needed").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") == F.col("needed")).select("doc", "s", "wid", "size")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A null or empty text has no words and is clean; an item without words has no window; rows
    that share a key are looked at each by itself, repeated rows get the same answer; keys and
    item ids may be null (a null item id counts as the empty string) and repeated (items of one id
    count once); without items every document is clean; an empty table gives an empty result;
    other columns take no part.
    """
    per_item = written(item_windows(items, item_key, item_text, window).distinct(), "leak-items")
    distinct = per_item.select("words").distinct().withColumn("wid", F.md5(F.array_join("words", " ")))
    n = F.least(F.size("words"), F.lit(shingle))
    exploded = written(distinct.select("wid", F.size("words").alias("size"), n.alias("n"),
                                       F.posexplode(shingle_texts("words", n)).alias("offset", "shingle"))
                       .withColumn("sid", F.md5("shingle")), "leak-shingles")
    shingles = exploded.groupBy("sid", "n").agg(F.first("shingle").alias("shingle")).withColumn(
        "h", F.xxhash64(F.split("shingle", " ")))
    lengths = sorted(r["n"] for r in shingles.select("n").distinct().collect())         # at most ``shingle`` numbers
    rows = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    found = written(places(rows, shingles, lengths), "leak-places")
    # Equal texts are one document from here on.
    hits = written(found.where("pos >= 0").select("doc", "n_words", "pos", "sid").distinct(), "leak-hits")
    occ = written(occurrences(hits, exploded.select("wid", "size").distinct(), exploded.select("wid", "offset", "sid"),
                              shingle), "leak-found")
    ends = occ.groupBy("doc", "s").agg(F.max(F.col("s") + F.col("size")).alias("e"))
    upto = F.max("e").over(Window.partitionBy("doc").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("e") - F.greatest(F.col("s"), F.coalesce(upto, F.lit(0))), F.lit(0))
    covered = ends.select("doc", fresh.alias("fresh")).groupBy("doc").agg(F.sum("fresh").alias("n_hit"))
    sets = occ.groupBy("doc").agg(F.sort_array(F.collect_set("wid")).alias("wids")).withColumn("set", F.md5(F.array_join("wids", "")))
    hit = written(covered.join(sets, "doc").select("doc", "n_hit", "set", "wids"), "leak-docs")
    ids = per_item.select("item_id", F.md5(F.array_join("words", " ")).alias("wid")).distinct()
    named = (hit.groupBy("set").agg(F.first("wids").alias("wids")).select("set", F.explode("wids").alias("wid"))
             .join(small(ids), "wid").groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
             .select("set", F.size("items").cast("long").alias("n_items"),
                     F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    out = found.where("pos < 0").select("row_key", "doc", "n_words").join(
        hit.select("doc", "n_hit", "set").join(named, "set"), "doc", "left")
    return out.select(F.col("row_key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def oracle_sql(window: int = WINDOW) -> str:
    split = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
             f"'{BREAK}'), lambda w: w <> '')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {split} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {split} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS size, array_to_string(list_slice(w, s, s + {window} - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT row, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS t
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS s
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), occ AS (
  SELECT row, s, size, item_id FROM dw JOIN bw USING (size, t)
), hit AS (
  SELECT row, count(*) AS n_hit
  FROM (SELECT DISTINCT row, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT row, s, size FROM occ)) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT row, item_id FROM occ) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""


ORACLE_SQL = oracle_sql()
