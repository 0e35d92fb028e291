"""CSV sources and sinks.

Spark's CSV defaults differ from the pandas reader the reference used: quoted
newlines need ``multiLine`` and doubled quotes need ``escape='"'``; pandas also
reads a set of spellings as missing, which are normalised here.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework import lexicon

UPLOAD_OPTIONAL = ["category", "severity", "emotion", "customer_name", "customer_id", "channel", "location"]


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line only (no schema inference over the data)."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .option("inferSchema", False).csv(path).columns


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                     na_values: Sequence[str] = lexicon.CSV_NA_VALUES) -> DataFrame:
    """Every column as a string; pandas' missing-value spellings become null."""
    cols = list(columns) if columns is not None else _header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    na = list(na_values)
    return df.select(*[F.when(F.col(f"`{c}`").isin(na), F.lit(None).cast("string"))
                       .otherwise(F.col(f"`{c}`")).alias(c) for c in cols])


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Case upload: ``.csv`` only, ``complaint_text`` required, rows without text dropped."""
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError(f"{path}: an upload is a .csv file")
    cols = _header(spark, path)
    if "complaint_text" not in cols:
        raise ValueError(f"{path}: no complaint_text column among {cols}")
    df = read_csv_strings(spark, path, cols)
    for c in UPLOAD_OPTIONAL:
        if c not in cols:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.where(F.col("complaint_text").isNotNull())


#: Column of ``read_checked``: the text of a row that does not fit its file's header, else null.
UNREADABLE = "_unreadable"


def headers(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Header -> its files.  One pass over the lines keeps the first line of each file, in the task that
    reads it; the driver gets one line a file, beside the file list it plans with anyway."""
    lines = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start")).where("start = 0 AND trim(value) <> ''")
    out = defaultdict(list)
    for r in lines.groupBy("file").agg(F.min_by("value", "at").alias("line")).collect():
        line = r["line"].lstrip("\ufeff").rstrip("\r")
        if line.count('"') % 2:
            raise ValueError(f"{r['file']}: a quote in the header line is not closed")
        names = tuple(next(csv.reader(io.StringIO(line))))
        if len({n.lower() for n in names}) < len(names) or not all(names):
            raise ValueError(f"{r['file']}: column names are missing or stand twice: {list(names)}")
        out[names].append(unquote(r["file"]))
    if not out:
        raise ValueError(f"{path}: no header line")
    return {h: sorted(files) for h, files in sorted(out.items())}


def read_checked(spark: SparkSession, path: str | Sequence[str], quoted_newlines: bool = True,
                 na_values: Sequence[str] = lexicon.CSV_NA_VALUES) -> DataFrame:
    """CSV files, columns by the name in each file's own header, every column as a string, and
    ``UNREADABLE``: null, or the whole text of a row with more or fewer fields than its header.

    Columns that a file lacks are null.  With ``quoted_newlines=False`` a file is split among tasks
    and a quote that is never closed spoils its line only; with True (the default) a file is one
    task's work and such a quote swallows the rest of its file, which comes back as one unreadable row.
    """
    na, frames = list(na_values), []
    for names, files in headers(spark, path).items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, UNREADABLE)])
        df = (spark.read.schema(schema).option("header", True).option("multiLine", quoted_newlines).option("escape", '"')
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", UNREADABLE)
              .option("columnPruning", False).csv(files))
        frames.append(df.select(*[F.when(F.col(f"`{c}`").isin(na), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                                  for c in names], UNREADABLE))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_upload_checked(spark: SparkSession, path: str, quoted_newlines: bool = True) -> DataFrame:
    """``read_checked`` of a case upload: rows with a text, and the unreadable ones."""
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError(f"{path}: an upload is a .csv file")
    df = read_checked(spark, path, quoted_newlines)
    if "complaint_text" not in df.columns:
        raise ValueError(f"{path}: no complaint_text column among {df.columns[:-1]}")
    for c in UPLOAD_OPTIONAL:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.where(F.col("complaint_text").isNotNull() | F.col(UNREADABLE).isNotNull())


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header + RFC-4180 quoting (doubled quotes), readable by ``read_csv_strings``."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True)
       .csv(path))
    return path
