"""I-Match document fingerprints.

The lexicon holds the terms whose inverse document frequency lies in a band: those in at
least ``LOW`` and at most ``HIGH`` of all documents.  Each of ``len(SHARES)`` randomised subsets
keeps a term by a seeded hash.  A fingerprint is, for every subset, a hash of the document's
distinct terms in it, sorted; the likeness of two fingerprints is the share of equal hashes
among the subsets that are not empty in both.  Small subsets still agree when part of a text
has changed, large ones only when next to nothing has.

The lexicon is broadcast: with D distinct terms in a mean document it has at most D / ``LOW``
rows, however many documents there are (and it is counted first).  Texts are shuffled once, by
ranges of keys; in a range, a document's successor, its edited text and both fingerprints
come from one window and one aggregate on the same partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.session import written

#: One text may have a third of all rows as near copies: its terms must stay below ``HIGH``.
LOW, HIGH = 0.002, 0.5
#: Of each subset, in 256ths, the share of the lexicon it keeps.
SHARES = (128, 128, 128, 128, 32, 32, 32, 32, 4, 4, 4, 4, 4, 4, 4, 4)
MAX_LEXICON = 2_000_000
SEED = 42
SPLIT = r"[^\p{L}\p{N}]+"
#: Documents of a range of keys, on average, and the quantiles the ranges are laid out by.
RANGE = 2000
QUANTILES = 64
EMPTY = "0" * 8


def terms(text: str) -> Column:
    """Distinct lower-case terms of a text, among them always ''."""
    return F.array_union(F.split(F.lower(F.col(text)), SPLIT, -1), F.array(F.lit("")))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH,
            shares=SHARES, seed: int = SEED) -> DataFrame:
    """(term, mask): terms of the band; bit k of ``mask`` tells whether subset k keeps the term.
    The empty term is always there, in no subset."""
    found = docs.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = written(found, "imatch-df")
    n = (found.where("term = ''").first() or {"df": 0})["df"]      # '' is in every document
    band = found.where(F.col("df").between(low * n, high * n) | (F.col("term") == ""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("term")))
    mask = F.lit(0)
    for k, share in enumerate(shares):
        byte = F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")
        mask = mask + F.when(byte < share, 1 << k).otherwise(0)
    return written(band.select("term", F.when(F.col("term") == "", 0).otherwise(mask).alias("mask")), "imatch-lexicon")


def fingerprint(held: str, tag: int, text_hash: str, shares=SHARES) -> Column:
    """Fingerprint from the sorted (tag, term, mask) of a document; a document without a term
    in any subset is known by a hash of its whole text."""
    own = F.filter(F.col(held), lambda x: (x["tag"] == tag) & (x["mask"] != 0))
    parts = []
    def inside(k: int):
        return lambda x: x["mask"].bitwiseAND(1 << k) != 0

    for k in range(len(shares)):
        kept = F.transform(F.filter(F.col("__own"), inside(k)), lambda x: x["term"])
        parts.append(F.when(F.size(kept) == 0, EMPTY).otherwise(F.substring(F.md5(F.array_join(kept, " ")), 1, 8)))
    bits = F.concat(*parts)
    return own, F.when(F.size("__own") == 0, F.repeat(F.substring(F.col(text_hash), 1, 8), len(shares))).otherwise(bits)


def likeness(a: str, b: str, n: int = len(SHARES)) -> Column:
    """Share of equal hashes among those not empty in both."""
    part = lambda c, k: F.substring(F.col(c), 8 * k + 1, 8)
    some = [(part(a, k) != EMPTY) | (part(b, k) != EMPTY) for k in range(n)]
    same = [(part(a, k) == part(b, k)) & s for k, s in enumerate(some)]
    total = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    return (total(same) / F.greatest(total(some), F.lit(1))).cast("double")


def ranges(docs: DataFrame, key: str) -> Column:
    """Number of a row's range of keys: higher for higher keys, null keys lowest (-1).

    Quantiles of the keys, each cut into equal widths, so that neither gaps nor dense runs of
    keys make a large range."""
    if docs.where(F.col(key).isNotNull()).isEmpty():
        return F.lit(-1).cast("long")
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    found = docs.agg(F.count(key).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"),
                     F.percentile_approx(key, steps, 10_000).alias("q")).first()
    edges = sorted({found["lo"], *found["q"], found["hi"] + 1})
    cuts = max(1, math.ceil(found["n"] / (len(edges) - 1) / RANGE))
    inner = F.array(*[F.lit(e).cast("long") for e in edges[1:]])
    at = F.size(F.filter(inner, lambda e: e <= F.col(key)))
    edge = F.array(*[F.lit(e).cast("long") for e in edges])
    lo, hi = F.element_at(edge, at + 1), F.element_at(edge, at + 2)
    sub = F.least(F.floor((F.col(key) - lo) / (hi - lo) * cuts), F.lit(cuts - 1))
    return F.when(F.col(key).isNull(), -1).otherwise(at * cuts + sub).cast("long")


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(range, pos, key, text, next_range, next_pos, next): every row with its successor in the
    order of descending keys (null last; rows of one key by a hash of the text); the last row's
    successor is the first.  A range's first rows are also sent to the end of the range before."""
    ids = docs.select(F.col(key).cast("long").alias("key"))
    number = ranges(ids, "key")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
                       ).withColumn("range", number)
    heads = ids.withColumn("range", number).groupBy("range").agg(F.max("key").alias("head"))
    order = Window.orderBy("range")                  # one row for each RANGE documents
    heads = written(heads.select("range", "head", F.lead("range").over(order).alias("above"),
                                 F.min("range").over(Window.partitionBy()).alias("lowest"))
                    .select(F.col("range").alias("r"), "head", F.coalesce("above", "lowest").alias("to")), "imatch-heads")
    ghosts = (rows.join(heads, (F.col("range") == F.col("r")) & F.col("key").eqNullSafe(F.col("head")))
              .select("key", "text", F.col("to").alias("range"), F.col("r").alias("home"), F.lit(True).alias("ghost")))
    both = rows.select("key", "text", "range", F.col("range").alias("home"), F.lit(False).alias("ghost")).unionByName(ghosts)
    w = Window.partitionBy("range").orderBy("ghost", F.col("key").desc_nulls_last(), F.xxhash64("text"))
    out = (both.withColumn("pos", F.row_number().over(w)).withColumn("next", F.lead("text").over(w))
           .withColumn("next_range", F.lead("home").over(w)).withColumn("next_ghost", F.lead("ghost").over(w)))
    return out.where(~F.col("ghost")).select(
        "range", "pos", "key", "text", "next_range",
        F.when(F.col("next_ghost"), 1).otherwise(F.col("pos") + 1).alias("next_pos"), "next")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = LOW,
                 high: float = HIGH, shares=SHARES, seed: int = SEED) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    every row; the edited text is the text with its last floor(n / 2) code points replaced by as
    many of the next document's first (or all it has).

    Keys are integers.  A null text counts as empty; rows that share a key follow one another;
    a single row follows itself; texts without a lexicon term have a fingerprint of the whole
    text; an empty table gives an empty result; other columns take no part.
    """
    words = lexicon(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), "text", low, high, shares, seed)
    if words.count() <= MAX_LEXICON:
        words = F.broadcast(words)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, key, text)
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("tag"), terms("text").alias("terms")),
                              F.struct(F.lit(1).alias("tag"), terms("edited").alias("terms")))).alias("kind")
    small = ["range", "pos", "key", "n_chars", "next_range", "next_pos", "edited_sha256", "text_hash", "edited_hash"]
    spread = (rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), F.md5("text").alias("text_hash"),
                          F.md5("edited").alias("edited_hash"))
              .select(*small, kinds).select(*small, "kind.tag", F.explode("kind.terms").alias("term")))
    held = spread.join(words, "term").groupBy("range", "pos").agg(
        *[F.first(c).alias(c) for c in small[2:]],
        F.sort_array(F.collect_list(F.when(F.col("mask") != 0, F.struct("tag", "term", "mask")))).alias("held"))
    for tag, name, whole in ((0, "fingerprint", "text_hash"), (1, "edited_fingerprint", "edited_hash")):
        own, made = fingerprint("held", tag, whole, shares)
        held = held.withColumn("__own", own).withColumn(name, made)
    done = written(held.select("range", "pos", "key", "n_chars", "next_range", "next_pos", "edited_sha256",
                               "fingerprint", "edited_fingerprint"), "imatch")
    other = done.select(F.col("range").alias("next_range"), F.col("pos").alias("next_pos"),
                        F.col("fingerprint").alias("next_fingerprint"))
    return done.join(other, ["next_range", "next_pos"]).select(
        F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", len(shares)).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", len(shares)).alias("near_next"))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    mask = " + ".join(f"CASE WHEN CAST('0x' || substr(m, {2 * k + 1}, 2) AS INTEGER) < {s} THEN {1 << k} ELSE 0 END"
                      for k, s in enumerate(SHARES))
    parts = " || ".join(
        f"CASE WHEN len(list_filter(own, lambda x: (x.mask & {1 << k}) <> 0)) = 0 THEN '{EMPTY}' ELSE "
        f"substr(md5(array_to_string(list_transform(list_filter(own, lambda x: (x.mask & {1 << k}) <> 0), "
        f"lambda x: x.term), ' ')), 1, 8) END" for k in range(len(SHARES)))
    def near(a: str, b: str) -> str:
        some = [f"(substr({a}, {8 * k + 1}, 8) <> '{EMPTY}' OR substr({b}, {8 * k + 1}, 8) <> '{EMPTY}')"
                for k in range(len(SHARES))]
        same = [f"({s} AND substr({a}, {8 * k + 1}, 8) = substr({b}, {8 * k + 1}, 8))" for k, s in enumerate(some)]
        total = lambda x: "(" + " + ".join(f"CAST({f} AS INTEGER)" for f in x) + ")"
        return f"CAST({total(same)} AS DOUBLE) / greatest({total(some)}, 1)"
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS n, count(*) OVER () AS total
  FROM documents
), pairs AS (
  SELECT d.n, d.doc_id, d.text, d.n % d.total + 1 AS next_n, CAST(length(d.text) AS BIGINT) AS n_chars,
         substr(d.text, 1, length(d.text) - length(d.text) // 2) || substr(e.text, 1, length(d.text) // 2) AS edited
  FROM docs d JOIN docs e ON e.n = d.n % d.total + 1
), df AS (
  SELECT term, count(*) AS df
  FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '{SPLIT}'))) AS term FROM docs)
  WHERE term <> '' GROUP BY term
), lexicon AS (
  SELECT term, {mask} AS mask FROM (SELECT term, md5('{SEED}:' || term) AS m FROM df, (SELECT count(*) AS n FROM docs)
                                    WHERE df BETWEEN {LOW} * n AND {HIGH} * n)
), texts AS (
  SELECT n, 0 AS tag, text FROM pairs UNION ALL SELECT n, 1, edited FROM pairs
), held AS (
  SELECT n, tag, list({{'term': term, 'mask': mask}} ORDER BY term) AS own
  FROM (SELECT n, tag, unnest(list_distinct(regexp_split_to_array(lower(text), '{SPLIT}'))) AS term FROM texts)
       JOIN lexicon USING (term) WHERE mask <> 0 GROUP BY n, tag
), made AS (
  SELECT t.n, t.tag, CASE WHEN own IS NULL THEN repeat(substr(md5(text), 1, 8), {len(SHARES)}) ELSE {parts} END AS fp
  FROM texts t LEFT JOIN held h ON t.n = h.n AND t.tag = h.tag
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
       {near('a.fp', 'b.fp')} AS near_edited, {near('a.fp', 'c.fp')} AS near_next
FROM pairs p JOIN made a ON a.n = p.n AND a.tag = 0 JOIN made b ON b.n = p.n AND b.tag = 1
     JOIN made c ON c.n = p.next_n AND c.tag = 0
"""


ORACLE_SQL = oracle_sql()
