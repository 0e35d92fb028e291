"""Fitted models as numbered entries of a run log: fit once, store, activate, score, report.

``<base>/models/version=<n>`` holds a saved model, ``<base>/runs`` one appended row for each fit and
``<base>/predictions/version=<n>`` that version's labels beside the true ones, a row for each case
and head.  The active version is the greatest in the log, so nothing is updated in place; a
model counts once its run is logged (a fit that dies before leaves files the next one overwrites).
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.operators import evaluate as EV
from casework.operators import models as M
from casework.session import read_if_present

RUN = ("version long, training_samples long, vocab_size long, accuracies map<string,double>, "
       "parameters map<string,string>, created_at timestamp")


def runs(spark: SparkSession, base: str) -> DataFrame:
    """The run log with ``is_active``; no rows before the first fit."""
    log = read_if_present(spark, f"{base}/runs")
    if log is None:
        return spark.createDataFrame([], f"{RUN}, is_active boolean")
    return log.withColumn("is_active", F.col("version") == F.lit(log.agg(F.max("version")).first()[0]))


def active_version(spark: SparkSession, base: str) -> int | None:
    found = runs(spark, base).where("is_active").select("version").first()
    return found["version"] if found else None


def record(spark: SparkSession, base: str, model: M.HeadsModel, parameters: dict | None = None) -> int:
    """Save a fitted model as the next version and log it, which makes it the active one."""
    version = (active_version(spark, base) or 0) + 1
    model.save(f"{base}/models/version={version}")
    row = (version, model.training_samples, model.featurizer.size, model.train_accuracy,
           {k: str(v) for k, v in (parameters or {}).items()})
    (spark.createDataFrame([row], RUN.rpartition(",")[0]).withColumn("created_at", F.current_timestamp())
          .write.mode("append").parquet(f"{base}/runs"))
    return version


def fit(df: DataFrame, id_col: str, text_col: str, heads: Sequence[str], base: str, **parameters) -> int:
    """Fit the heads, store the model and make it the active one; its version."""
    model = M.train_heads(df, id_col, text_col, heads, **parameters)
    return record(df.sparkSession, base, model, parameters)


def active(spark: SparkSession, base: str) -> tuple[int, M.HeadsModel]:
    """The active version and its model, as stored."""
    version = active_version(spark, base)
    model = None if version is None else M.HeadsModel.load(spark, f"{base}/models/version={version}")
    if model is None:
        raise RuntimeError(f"{base}: no model has been fitted and stored")
    return version, model


def score(df: DataFrame, id_col: str, text_col: str, base: str) -> DataFrame:
    """Label and confidence of every head, and the version that gave them, for each row of ``df``."""
    version, model = active(df.sparkSession, base)
    return model.predict(df, id_col, text_col).withColumn("version", F.lit(version).cast("long"))


def store_predictions(df: DataFrame, id_col: str, text_col: str, heads: Sequence[str], base: str) -> DataFrame:
    """(id, head, truth, pred, confidence) of labelled rows by the active model, written as that
    version's and read back: what every report counts."""
    spark = df.sparkSession
    scored = score(df, id_col, text_col, base)
    version = active_version(spark, base)
    told = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("pred"),
                                        F.col(f"{h}_confidence").alias("confidence")) for h in heads])).alias("p")
    truth = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).cast("string").alias("truth"))
                                for h in heads])).alias("t")
    long = scored.select(id_col, told).select(id_col, "p.*").join(
        df.select(id_col, truth).select(id_col, "t.*"), [id_col, "head"])
    path = f"{base}/predictions/version={version}"
    long.select(F.col(id_col).alias("id"), "head", "truth", "pred", "confidence").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def predictions(spark: SparkSession, base: str) -> DataFrame:
    """Stored predictions of every version."""
    return spark.read.parquet(f"{base}/predictions")


def report(predicted: DataFrame) -> DataFrame:
    """(version, head, accuracy, f1_weighted, n) from one grouped count over stored predictions."""
    named = predicted.withColumn("head", F.concat_ws("|", F.col("version").cast("string"), "head"))
    counts = EV.pair_counts(named.select("head", "truth", "pred"))
    both = EV.accuracy_from_counts(counts).join(EV.weighted_f1(counts), "head")
    part = F.split("head", "[|]", 2)
    return both.select(part[0].cast("long").alias("version"), part[1].alias("head"), "accuracy", "f1_weighted", "n")


def best(reported: DataFrame) -> DataFrame:
    """The version of the highest accuracy for each head (ties: the older one)."""
    first = F.min_by(F.struct("version", "accuracy", "f1_weighted"), F.struct(-F.col("accuracy"), F.col("version")))
    return reported.groupBy("head").agg(first.alias("b")).select("head", "b.*")
