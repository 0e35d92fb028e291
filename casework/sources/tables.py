"""Append-only Parquet case tables.

Cases, notes, update logs and run logs are only ever appended; current state
is derived on read (latest-wins folds), so no table is rewritten in place and
concurrent writers never conflict.  Case tables are partitioned by creation
day so listing "newest first" and volume queries prune files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CASE_PARTITION = "created_date"


def append_cases(cases: DataFrame, path: str, grain: str = "day") -> int:
    """One distributed append (chunking is implicit in the partitions); the number of rows, from the same job.

    ``grain`` (day, week, month, year; one for a table) is what a folder holds: long histories of few cases
    want fewer and larger ones.  The folder's name is the first day in it."""
    seen = Observation("append")
    day = F.to_date("created_at")
    (cases.withColumn(CASE_PARTITION, day if grain == "day" else F.trunc(day, grain)).observe(seen, F.count(F.lit(1)).alias("stored"))
          .write.mode("append").partitionBy(CASE_PARTITION).parquet(path))
    return seen.get["stored"]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(CASE_PARTITION)


VERDICT, ACCEPTED, REJECTED = "verdict", "accepted", "rejected"
REASONS = ("reason_code", "reason")


def append_intake(judged: DataFrame, path: str) -> dict[str, int]:
    """Append both halves of an upload in one job, each under its own folder, and count them in that job.

    Returns stored, skipped and total_rows.  The counts are metrics of the tasks that write (no
    shuffle lies between), so a row is counted where it is stored and a retried task counts once.
    """
    seen = Observation("intake")
    half = F.when(F.col("passed"), F.lit(ACCEPTED)).otherwise(F.lit(REJECTED))
    rows = judged.withColumn(VERDICT, half).drop("passed").withColumn(CASE_PARTITION, F.to_date("created_at"))
    (rows.observe(seen, F.count_if(F.col(VERDICT) == ACCEPTED).alias("stored"),
                  F.count_if(F.col(VERDICT) == REJECTED).alias("skipped"), F.count(F.lit(1)).alias("total_rows"))
         .write.mode("append").partitionBy(VERDICT, CASE_PARTITION).parquet(path))
    return seen.get


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an intake table (only the folders of accepted rows are read)."""
    return spark.read.parquet(path).where(F.col(VERDICT) == ACCEPTED).drop(VERDICT, CASE_PARTITION, *REASONS)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rejected rows of an intake table, with why."""
    return spark.read.parquet(path).where(F.col(VERDICT) == REJECTED).drop(VERDICT, CASE_PARTITION)


def append_log(df: DataFrame, path: str) -> None:
    """Update / note / run logs: plain appends."""
    df.write.mode("append").parquet(path)


def compact(spark: SparkSession, src: str, dst: str, fold) -> DataFrame:
    """Rewrite a log as its folded current state into a *new* path (never in place)."""
    fold(spark.read.parquet(src)).write.mode("errorifexists").parquet(dst)
    return spark.read.parquet(dst)
