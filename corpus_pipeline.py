"""From ``documents`` to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as
Parquet to the shared folder and read again as the next one's ``docs``, so a lost executor
costs work of one stage only.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import langid, linededup, mixing, packing, simhash
from casework.session import written

#: Rows of whole texts that go to a Python worker at once (Spark's own setting is 10,000): what a worker and its
#: executor's Arrow buffers hold follows this number times the length of a text.
BATCH_ROWS = 1000
#: Below this posterior probability no language is believed.
LEAST_SCORE = 0.5


def unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have."""
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without a letter and null texts go."""
    into = unused(docs, "langid")
    told = (F.col(into)["lang"] != langid.UNKNOWN) & (F.col(into)["score"] >= LEAST_SCORE)
    return langid.identify(docs, into=into).where(told).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in an earlier place; null and empty texts stay as
    they are, rows equal in id and text are one document."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, whatever its doc_id (null and shared ones stand for no other text)."""
    return simhash.keep_one(docs, unique=False).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix repeats them; null and empty texts have no size, rows that share
    an id or have none count one by one."""
    into = unused(docs, "mix")
    return mixing.repeat(mixing.mix(docs, into=into), into).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the training sequences; every row is packed, repeated
    ones again, null and empty texts as their one closing token."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


def in_small_batches(stage):
    """``stage`` with ``BATCH_ROWS``; the setting stays, since the stage's result runs after it has returned."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(stage.__name__, in_small_batches(stage)) for stage in (language_id, line_dedup, near_dedup, mix_sources, pack)]

#: SQL cannot say the fitted classifier, MinHash, SimHash or packing: tests/llm checks brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
