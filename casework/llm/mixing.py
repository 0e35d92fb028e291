"""Mixing sources to target weights by capped water-filling.

Sources share ``share`` times all words by weight.  A source whose share would go beyond
``max_epochs`` times its own words is clamped there and the excess is dealt anew to the
others by weight, until no source is above its clamp (each round is one aggregate over the
table of sources).  A target of ``e`` epochs is met with ``floor(e)`` whole repetitions of
every document and one more of a seeded part of them: documents in the order of a seeded
hash (of key and text; equal rows by a row number) up to a cut, then the one further document
whose size closes most of what is left.

The cut comes from sums by hash bucket (bounded: sources x 16 ** ``DIGITS``), and only rows of
the one bucket it falls in are ranked, so a source with a third of all rows is never one
task's work.  What is decided is one row a source (times to take all, cut, closing
document); slim rows meet it by a broadcast whose rows are counted first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.session import written

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3
#: Sources up to this number are broadcast (about 100 bytes each); more are joined by key.
MAX_BROADCAST_SOURCES = 50_000


def word_count(text: str = "text") -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``: words each is to give.

    ``sources`` is read once a round, so pass a written table.  Where even all clamps
    together are below the total, every source stays at its clamp.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["size"]:
        return sources.withColumn("target", F.lit(0.0))
    amount, weight = share * total["size"], float(total["weight"])
    level, clamped = amount / weight, 0
    while True:
        over = F.lit(level) * F.col("weight") > cap
        r = sources.where(over).agg(F.count(F.lit(1)).alias("n"), F.sum(cap).alias("cap"),
                                    F.sum("weight").alias("weight")).first()
        if r["n"] == clamped:
            break
        clamped = r["n"]
        if r["weight"] >= weight:
            level = float("inf")
            break
        level = (amount - r["cap"]) / (weight - r["weight"])
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def weigh(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Weights in turn over the sources by code point, null last (one row a source)."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                     turn + 1))


def order_key(key: str, text: str, seed: int) -> Column:
    """Seeded place of a document among its source's; only rows of one key and one text share it."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), digest))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
         share: float = 1.5, weights: Sequence[float] = (3, 1, 2), max_epochs: float = 2.0,
         seed: int = 42, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, per_source): ``rows`` has key, source, size, hash and row (a number of its own) of
    every document; ``per_source`` has source, source_size, target, whole, cut, cut_row and closing.

    ``row``: a column of row numbers (``monotonically_increasing_id`` of a written table)."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
                               order_key(key, text, seed).alias("hash"), number.alias("row")), "mix-rows")
    sources = written(weigh(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights),
                      "mix-sources")
    side = small(sources)
    t = targets(sources, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    t = t.withColumn("whole", whole.cast("long"))
    t = t.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))

    bucket = F.substring("hash", 1, DIGITS)
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    at = (sums.withColumn("before", before).join(side(t.select(F.col("source").alias("s"), "extra")),
                                                  F.col("source").eqNullSafe(F.col("s")))
          .where((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("words") > F.col("extra")))
          .groupBy("source").agg(F.min(F.struct("bucket", "before", "extra")).alias("at"))
          .select(F.col("source").alias("s"), "at.*"))
    # One row a hash: rows of one hash have one text, so one size, and `copies` of them are taken.
    inside = (rows.join(side(at), F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("bucket")))
              .groupBy("source", "before", "extra", "hash").agg(F.sum("size").alias("words"), F.max("size").alias("each")))
    end = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("hash"))
    cuts = (inside.withColumn("end", end).where(F.col("end") > F.col("extra"))
            .groupBy("source").agg(F.min(F.struct("hash", (F.col("end") - F.col("words")).alias("start"), "each",
                                                  "extra")).alias("c"))
            .select(F.col("source").alias("s"), F.col("c.hash").alias("cut"), "c.start", "c.each", "c.extra"))
    cuts = cuts.withColumn("copies", F.floor((F.col("extra") - F.col("start")) / F.col("each")).cast("long"))
    taken = F.col("start") + F.col("copies") * F.col("each")
    cuts = cuts.withColumn("copies", F.col("copies") - (taken > F.col("extra")).cast("long"))
    cuts = written(cuts.withColumn("left", F.col("extra") - taken).select("s", "cut", "copies", "left"), "mix-cuts")
    last = last_copies(rows, cuts, side)
    per = (t.drop("extra").join(side(cuts.withColumnRenamed("s", "c")), F.col("source").eqNullSafe(F.col("c")), "left")
           .join(side(last), F.col("source").eqNullSafe(F.col("l")), "left").drop("c", "l", "copies"))
    per = written(per, "mix-ends")

    gap = F.abs(F.col("size") - F.col("left"))
    rest = (rows.join(side(per.select(F.col("source").alias("s"), "cut", "cut_row", "left")),
                      F.col("source").eqNullSafe(F.col("s")))
            .where(~first_part() & (F.col("size") > 0)))
    closing = (rest.groupBy("source", "left").agg(F.min(F.struct(gap.alias("gap"), "hash", "row")).alias("near"))
               .where(F.col("near.gap") < F.col("left"))
               .select(F.col("source").alias("n"), F.col("near.row").alias("closing")))
    per = per.join(side(closing), F.col("source").eqNullSafe(F.col("n")), "left").drop("n", "left")
    return rows, written(per, "mix-plan")


def last_copies(rows: DataFrame, cuts: DataFrame, side) -> DataFrame:
    """(l, cut_row) a source: row number of the last of its ``copies`` rows at the cut.

    Copies may be a third of all rows: they are counted by the partition that numbered them, and
    only those of the one partition the last one falls in are ranked."""
    tied = rows.join(side(cuts.where("copies > 0")), F.col("source").eqNullSafe(F.col("s")) & (F.col("hash") == F.col("cut")))
    tied = tied.select("source", "copies", "row", F.shiftright("row", 33).alias("part"))
    counts = tied.groupBy("source", "copies", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("part"))
    edge = (counts.withColumn("upto", upto).where(F.col("upto") >= F.col("copies"))
            .groupBy("source").agg(F.min(F.struct("part", (F.col("copies") - F.col("upto") + F.col("n")).alias("nth"))).alias("e"))
            .select(F.col("source").alias("l"), F.col("e.part").alias("at"), "e.nth"))
    inside = tied.join(side(edge), F.col("source").eqNullSafe(F.col("l")) & (F.col("part") == F.col("at")))
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("row")))
    return ranked.where(F.col("rank") == F.col("nth")).select("l", F.col("row").alias("cut_row"))


def first_part(hashed: str = "hash", row: str = "row", prefix: str = "") -> Column:
    """Is the row before the cut of its source?  ``prefix``: what the plan's column names begin with."""
    cut, cut_row = F.col(f"{prefix}cut"), F.coalesce(F.col(f"{prefix}cut_row"), F.lit(-1))
    return F.coalesce((F.col(hashed) < cut) | (F.col(hashed) == cut) & (F.col(row) <= cut_row), F.lit(False))


def small(spark_rows: DataFrame):
    """A function that marks tables with a row a source for broadcast, if ``spark_rows`` (the
    table of sources) is counted to be small enough, and else leaves them alone."""
    n = spark_rows.limit(MAX_BROADCAST_SOURCES + 1).count()
    return F.broadcast if n <= MAX_BROADCAST_SOURCES else (lambda per_source: per_source)


def repetitions(hashed: str = "hash", row: str = "row", prefix: str = "") -> Column:
    closes = F.coalesce(F.col(row) == F.col(f"{prefix}closing"), F.lit(False))
    return F.col(f"{prefix}whole") + (first_part(hashed, row, prefix) | closes).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", into: str = "mix",
        **options) -> DataFrame:
    """``docs`` with a struct column ``into`` (size, source_size, target, repetitions, taken).

    Every row stays.  A null text has size 0, a null source is a source of its own, rows that
    share a key, or have none, are placed by their texts, and of equal ones as many are taken as
    needed; an empty table gives an empty result; a column named ``into`` is replaced, other
    columns are left alone.  ``taken`` of a source differs from its target by less than one
    document.  The rows are numbered and written once, so that plan and result see the same ones.
    """
    docs = written(docs.drop(into).withColumn("__row", F.monotonically_increasing_id()), "mix-docs")
    _, per = plan(docs, key, source, text, row="__row", **options)
    p = small(per)(per.select(*[F.col(c).alias(f"__{c}") for c in per.columns]))
    out = (docs.withColumn("__size", word_count(text)).withColumn("__hash", order_key(key, text, options.get("seed", 42)))
           .join(p, F.col(source).eqNullSafe(F.col("__source")), "left")
           .withColumn("__times", repetitions("__hash", "__row", "__")))
    fields = F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), F.col("__times").alias("repetitions"),
                      (F.col("__size") * F.col("__times")).alias("taken"))
    return out.withColumn(into, fields).drop("__row", "__size", "__hash", "__times", *p.columns)


def repeat(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """The mix itself: a row of ``mix`` as often as it is to be repeated."""
    repetitions_ = F.col(into)["repetitions"]
    times = F.when(repetitions_ > 0, F.sequence(F.lit(1), repetitions_.cast("int")))
    return mixed.withColumn("__time", F.explode(times)).drop("__time", into)


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, per = plan(docs)
    joined = rows.join(small(per)(per.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    return joined.select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                         (F.col("size") * repetitions()).alias("taken"))


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT *, row_number() OVER (PARTITION BY source, hash) AS copy FROM (
    SELECT doc_id, source, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS hash,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
    FROM documents)
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM docs GROUP BY source
), total AS (
  SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS amount, sum(weight) AS weight FROM sources
), rounds(k, level, clamped) AS (
  SELECT 0, amount / weight, CAST(0 AS BIGINT) FROM total
  UNION ALL
  SELECT k + 1,
         (any_value(amount) - sum(2.0::DOUBLE * source_size) FILTER (level * s.weight > 2.0::DOUBLE * source_size))
         / (any_value(t.weight) - sum(s.weight) FILTER (level * s.weight > 2.0::DOUBLE * source_size)),
         count(*) FILTER (level * s.weight > 2.0::DOUBLE * source_size)
  FROM rounds, sources s, total t GROUP BY k, level, clamped
  HAVING count(*) FILTER (level * s.weight > 2.0::DOUBLE * source_size) > clamped
), fixed AS (
  SELECT level FROM rounds ORDER BY k DESC LIMIT 1
), goals AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target FROM sources, fixed
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goals
), summed AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS extra,
         sum(size) OVER (PARTITION BY d.source ORDER BY hash, copy ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
), lefts AS (
  SELECT source, any_value(extra) - coalesce(max(upto) FILTER (upto <= extra), 0) AS rest FROM summed GROUP BY source
), closing AS (
  SELECT s.source, rest, min({'gap': abs(size - rest), 'hash': hash, 'copy': copy}) AS near
  FROM summed s JOIN lefts l ON s.source IS NOT DISTINCT FROM l.source
  WHERE upto > extra AND size > 0 GROUP BY s.source, rest
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= extra OR (near.gap < rest AND near.hash = hash AND near.copy = copy)
                                 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed s LEFT JOIN closing c ON s.source IS NOT DISTINCT FROM c.source
"""
