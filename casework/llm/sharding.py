"""Shard placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table
(``slot_j = (offset + j * skip) mod size``; a prime size makes every skip a full cycle).
The shards take turns, each claiming its next unclaimed slot, until the table is full, so
slot counts differ by at most one and removing a shard moves few keys of the others.  A row
is placed by ``hash(key) mod size`` and one lookup.

The table is configuration: ``table_size`` rows (bounded by ``MAX_TABLE``), whatever the
data, so it is broadcast and placing a row costs no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TABLE = 1_000_003


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: Sequence[str], table_size: int) -> list[int]:
    """Owner (index into ``shards``) of every slot.

    No shards, repeated names, a size that is not prime, smaller than the number of shards
    or above ``MAX_TABLE``: ``ValueError``.
    """
    n = len(shards)
    if not n or len(set(shards)) != n:
        raise ValueError("shards need distinct names, at least one")
    if not is_prime(table_size) or not n <= table_size <= MAX_TABLE:
        raise ValueError(f"table_size must be a prime from {n} to {MAX_TABLE}")
    at = [_digest(f"offset:{s}") % table_size for s in shards]
    skip = [_digest(f"skip:{s}") % (table_size - 1) + 1 for s in shards]
    owner = [-1] * table_size
    for claim in range(table_size):
        i = claim % n
        while owner[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % table_size
        owner[at[i]] = i
    return owner


def slot_of(key, table_size: int):
    """Slot of a key column: the leading 60 bits of MD5 of its text; a null key counts as ''."""
    text = F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key, F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(table_size)


def lookup_table(spark: SparkSession, shards: Sequence[str], table_size: int) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    owners = fill_table(shards, table_size)
    return spark.createDataFrame([(s, shards[o]) for s, o in enumerate(owners)],
                                 "slot long, shard string")


def place(df: DataFrame, key, shards: Sequence[str], table_size: int = 4099) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; every row is kept, in no particular order.

    Columns of ``df`` with those names are replaced.  Null keys go where the empty text goes;
    repeated rows and equal keys go to the same shard; an empty table gives an empty result.
    """
    rows = df.withColumn("slot", slot_of(key, table_size)).drop("shard")
    return rows.join(F.broadcast(lookup_table(df.sparkSession, shards, table_size)), "slot", "left")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1, salt=None) -> None:
    """Write rows of ``place`` as one folder per shard.  ``files_per_shard`` splits a shard
    over that many tasks by ``salt`` (default: a hash of the whole row), so that a shard that
    holds a third of all rows is not one task's work."""
    part = F.pmod(F.xxhash64(*([salt] if salt is not None else placed.columns)), F.lit(files_per_shard))
    (placed.repartition(F.col("shard"), part).write.mode("overwrite")
     .partitionBy("shard").parquet(path))


SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
TABLE_SIZE = 4099


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", SHARDS, TABLE_SIZE).select("doc_id", "slot", "shard")


# The fill as a recursive query: at each turn the shard takes the first slot of its
# permutation that nobody holds.
ORACLE_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS shard FROM range({len(SHARDS)}) r(i)
), perms AS (
  SELECT i, list_transform(range({TABLE_SIZE}), lambda j:
      (CAST('0x' || substr(md5('offset:' || shard), 1, 15) AS BIGINT) % {TABLE_SIZE}
       + j * (CAST('0x' || substr(md5('skip:' || shard), 1, 15) AS BIGINT) % {TABLE_SIZE - 1} + 1))
      % {TABLE_SIZE}) AS slots
  FROM shards
), fill(turn, owner) AS (
  SELECT 0, list_transform(range({TABLE_SIZE}), lambda j: -1)
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda o, k: CASE WHEN k - 1 = took THEN CAST(i AS INTEGER) ELSE o END)
  FROM (SELECT turn, owner, i, list_filter(slots, lambda s: owner[s + 1] = -1)[1] AS took
        FROM fill JOIN perms ON i = turn % {len(SHARDS)} WHERE turn < {TABLE_SIZE})
), filled AS (
  SELECT unnest(range({TABLE_SIZE})) AS slot, unnest(owner) AS i FROM fill WHERE turn = {TABLE_SIZE}
), placed AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
                 % {TABLE_SIZE} AS slot FROM documents
)
SELECT doc_id, slot, shard FROM placed JOIN filled USING (slot) JOIN shards USING (i)
"""
