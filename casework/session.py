"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every job in the package.  Shuffle partitions are
# sized from the core count locally; on a cluster the caller's session wins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "casework",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session.  Cluster jobs should pass their own session."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("CASEWORK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """True when driver and executors are one process (``local-cluster`` is a cluster)."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` (or an already set context checkpoint dir) wins.
    Only a local master may go without: a scratch folder is created and
    registered.  On any other master a missing setting is an error, since each
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if not conf_dir:
        if not is_local(sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is not set; {sc.master} needs a folder that "
                               "the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="casework-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return (sc.getCheckpointDir() or conf_dir).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local on a cluster)."""
    return f"{ensure_checkpoint_dir(spark)}/casework-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint to the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's own switch: shuffle files of an execution go when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_end_with_the_job(spark: SparkSession) -> Iterator[None]:
    """Executions that begin in this block drop their shuffle files when they end, not when the
    driver happens to collect garbage.  For jobs whose result is a table that is read from then on."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it
    back: later plans read the table instead of re-running ``df`` (one pass,
    columnar, survives executor loss; ``checkpoint()`` runs the plan twice).
    Zstandard: these tables are read once or twice and are mostly sorted or repeated strings.
    The job's shuffle files are dropped with its end."""
    path = scratch_path(df.sparkSession, name)
    with shuffle_files_end_with_the_job(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_if_present(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None if nothing is there; other errors are raised."""
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


TEXT_TABLES = {"documents", "conversations", "benchmark", "pages"}


def spread(df: DataFrame) -> DataFrame:
    """Round-robin to the cluster's parallelism when a scan yields fewer
    partitions than cores (few large row groups) and the per-row work is CPU
    heavy.  At scale a scan has far more partitions than cores: no-op."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df
