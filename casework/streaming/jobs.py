"""Structured Streaming jobs: the live versions of intake triage, status
updates, case volume and index refresh.

The transformations are the batch operators themselves (validation, label
rules, the latest-wins fold, the embedder), so a stream and a batch run over
the same rows agree.  Sinks are ``foreachBatch`` writes into
``<path>/batch=<id>`` folders with overwrite, so a replayed micro-batch
replaces its own output (idempotent), and every query checkpoints under the
cluster's shared checkpoint folder.

Status and volume keep no state in the stream: a batch writes what its own rows
come to, in a form that can be folded again, and a ``BatchLog`` folds the batches
on read and, from time to time, into one table.  State would hold one row for each
case that ever had an update, for good.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from casework.operators import caseindex as CI
from casework.operators import cases as C
from casework.operators import labels as L
from casework.operators import modelruns as MR
from casework.operators import retrieve as R
from casework.operators import validate as V
from casework.session import read_if_present, scratch_path


def feed_slices(df: DataFrame, path: str, n_slices: int,
                order_col: str | None = None) -> list[Callable[[], None]]:
    """Replay ``df`` as a file feed: one step per slice of ``order_col`` (oldest
    first), each appending its slice to ``path`` as one parallel write (as many
    files as the slice has partitions; no task ever holds a whole slice).

    Write the first slice, define the stream, then pass the other steps as the
    ``feed`` of a job: a run with ``availableNow`` takes all new files as one
    micro-batch, so batches follow the slices whatever the files'
    modification times.
    """
    if order_col is None:
        return [lambda: df.write.mode("append").parquet(path)]
    bounds = df.select(F.percentile_approx(order_col, [i / n_slices for i in range(1, n_slices)], 10000)
                       .alias("q")).first()["q"]
    if not bounds:
        # no row has an order value: one delivery of whatever is there
        return [lambda: df.write.mode("append").parquet(path)]
    edges = [None, *bounds, None]

    def step(lo, hi):
        def write() -> None:
            part = df
            if lo is not None:
                part = part.where(F.col(order_col) > F.lit(lo))
            if hi is not None:
                # rows without an order value are delivered first: none is dropped
                keep = F.col(order_col) <= F.lit(hi)
                part = part.where(keep | F.col(order_col).isNull() if lo is None else keep)
            part.write.mode("append").parquet(path)
        return write
    return [step(lo, hi) for lo, hi in zip(edges, edges[1:])]


def stage_files(df: DataFrame, path: str, n_files: int, order_col: str | None = None) -> str:
    """Write every slice of ``feed_slices`` up front (for jobs that are not run per slice)."""
    for write in feed_slices(df, path, n_files, order_col):
        write()
    return path


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def _source(spark: SparkSession, path: str, schema, feed) -> DataFrame:
    """Fed runs take each slice whole (one micro-batch per run)."""
    return file_stream(spark, path, schema, None if feed else 1)


def _versioned_sink(path: str, prepare: Callable[[DataFrame], dict[str, DataFrame]] | None = None):
    """foreachBatch writer: each output under ``<path>/<name>/batch=<id>`` (overwrite = idempotent)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        outs = prepare(batch) if prepare else {"out": batch}
        if len(outs) > 1:
            batch.persist()
        for name, out in outs.items():
            out.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        if len(outs) > 1:
            batch.unpersist()
    return write


def run_available(query_builder, name: str, spark: SparkSession,
                  feed: Sequence[Callable[[], None]] = ()) -> StreamingQuery:
    """Run with ``availableNow`` (process what is there, then stop) and wait;
    with a ``feed``, once more after each step has written its files, on one
    checkpoint, as a job scheduled after each delivery would."""
    ckpt = scratch_path(spark, f"ckpt-{name}")
    q = None
    for deliver in [None, *feed]:
        if deliver is not None:
            deliver()
        q = query_builder.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return q


def _read_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """What the batches so far have written; None before the first output."""
    return read_if_present(spark, path)


class BatchLog:
    """What a stream's batches came to: ``<path>/out/batch=<id>``, folded every ``every`` batches.

    ``fold`` maps rows of several batches to fewer rows of the same columns, and must not mind in
    which order or how often it is applied.  A fold is a new table, ``<path>/folded/upto=<id>``; it counts
    from the moment ``<path>/folds`` names it, so a job that dies while folding leaves the log as it
    was.  Folders that the fold before already covered are removed then (readers that began earlier
    than that fold must be done), so what is listed and read on each turn stays bounded by the
    folded rows and ``2 * every`` batches.
    """

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], every: int = 64):
        if every < 1:
            raise ValueError("every must be at least 1")
        self.spark, self.path, self.fold, self.every = spark, path, fold, every

    def folds(self) -> list[int]:
        """Last batch of each fold so far (a row for each fold)."""
        named = read_if_present(self.spark, f"{self.path}/folds")
        return [] if named is None else sorted({r["upto"] for r in named.collect()})

    def rows(self, before: int | None = None) -> DataFrame | None:
        """Rows of all batches (below ``before``), earlier ones folded; None before the first output."""
        out = read_if_present(self.spark, f"{self.path}/out")
        if out is None:
            return None
        if before is not None:
            out = out.where(F.col("batch") < before)
        folds = self.folds()
        if not folds:
            return out.drop("batch")
        earlier = self.spark.read.parquet(f"{self.path}/folded/upto={folds[-1]}")
        return out.where(F.col("batch") > folds[-1]).drop("batch").unionByName(earlier)

    def read(self) -> DataFrame | None:
        """All batches folded; None before the first output."""
        rows = self.rows()
        return None if rows is None else self.fold(rows)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch; the batches before it are folded first where it is their turn."""
        if batch_id and batch_id % self.every == 0:
            self.fold_upto(batch_id - 1)
        rows.write.mode("overwrite").parquet(f"{self.path}/out/batch={batch_id}")

    def fold_upto(self, batch_id: int) -> None:
        folds = self.folds()
        if folds and folds[-1] >= batch_id:
            return
        rows = self.rows(batch_id + 1)
        if rows is None:
            return
        self.fold(rows).write.mode("overwrite").parquet(f"{self.path}/folded/upto={batch_id}")
        self.spark.createDataFrame([(batch_id,)], "upto long").write.mode("append").parquet(f"{self.path}/folds")
        if folds:
            covered = range(folds[-2] + 1 if len(folds) > 1 else 0, folds[-1] + 1)
            remove_folders(self.spark, [f"{self.path}/out/batch={b}" for b in covered]
                           + [f"{self.path}/folded/upto={folds[-1]}"])


def remove_folders(spark: SparkSession, paths: Sequence[str]) -> None:
    """Remove folders on whatever file system they lie; one that is not there is passed over."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


# -- ST1: triage -----------------------------------------------------------------------------

def triage_stream(stream: DataFrame, rules: V.Rules, text_col: str = "complaint_text",
                  severity_tiers=None, emotion_tiers=None) -> DataFrame:
    """Validate each incoming case and fill blank labels from the rules (stateless)."""
    v = L.with_lower(V.validate(stream, text_col, rules), text_col)
    sev = dict(tiers=severity_tiers) if severity_tiers else {}
    emo = dict(tiers=emotion_tiers) if emotion_tiers else {}
    pred_sev = L.derive_severity("_lower", lowered=True, **sev)
    pred_emo = L.derive_emotion("_lower", lowered=True, **emo)
    return L.fill_labels(v.withColumn("_ps", pred_sev).withColumn("_pe", pred_emo),
                         {"severity": "_ps", "emotion": "_pe"}).drop("_ps", "_pe", "_lower")


def run_triage(spark: SparkSession, source_path: str, schema, out_path: str, rules: V.Rules,
               key: str = "case_id", feed: Sequence[Callable[[], None]] = (),
               **tiers) -> tuple[DataFrame, DataFrame]:
    """accepted / rejected tables written per micro-batch; returns both, read back."""
    s = triage_stream(_source(spark, source_path, schema, feed), rules, **tiers)
    # a batch is kept for its two tables: without the texts, which neither has
    s = s.select(key, "passed", "category", "severity", "emotion", "word_count", "char_count", "reason_code", "reason")

    def split(b: DataFrame) -> dict[str, DataFrame]:
        return {"accepted": b.where("passed").select(key, "category", "severity", "emotion", "word_count",
                                                     "char_count"),
                "rejected": b.where("NOT passed").select(key, "reason_code", "reason")}
    run_available(s.writeStream.foreachBatch(_versioned_sink(out_path, split)), "triage", spark, feed)
    return _read_versions(spark, f"{out_path}/accepted"), _read_versions(spark, f"{out_path}/rejected")


# -- ST2: latest status per case --------------------------------------------------------------

def run_status(spark: SparkSession, source_path: str, schema, out_path: str,
               project: Callable[[DataFrame], DataFrame],
               feed: Sequence[Callable[[], None]] = (), fold_every: int = 64) -> DataFrame | None:
    """Fold of the update log as it grows: each micro-batch writes the newest value it holds of each
    field of each case it touches; the current table is the fold of the batches (``C.fold_updates``
    over all updates, whatever the order they came in).  None before the first batch."""
    log = BatchLog(spark, out_path, C.merge_partials, fold_every)
    updates = project(_source(spark, source_path, schema, feed))
    run_available(updates.writeStream.foreachBatch(lambda b, i: log.append(C.partial_updates(b), i)),
                  "status", spark, feed)
    rows = log.read()
    return None if rows is None else C.partial_values(rows)


# -- ST3: windowed volume with a watermark -------------------------------------------------------

ON_TIME, LATE, UNTIMED = "on_time", "late", "untimed"


def volume_log(spark: SparkSession, path: str, keys: Sequence[str] = (), fold_every: int = 64) -> BatchLog:
    """(window_start, _kind, keys, n, _newest) of a volume job's batches."""
    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("window_start", "_kind", *keys).agg(F.sum("n").alias("n"), F.max("_newest").alias("_newest"))
    return BatchLog(spark, path, fold, fold_every)


def volume_of_batch(batch: DataFrame, frontier: int | None, ts_col: str, keys: Sequence[str], window: str,
                    watermark: str) -> DataFrame:
    """Counts of a batch by window and keys, each window of one kind: on time, late (it had ended
    ``watermark`` before ``frontier``, the newest event of the batches before, in milliseconds) or
    untimed (null start).  One aggregate: an event is in exactly one count."""
    ts = F.col(ts_col).cast("timestamp")
    timed = batch.select(ts.alias("_ts"), *keys)
    # F.window drops null times: they go through it under a stand-in, kept apart by the flag
    stand_in = F.coalesce("_ts", F.timestamp_millis(F.lit(0))).alias("_at")
    counts = (timed.select(stand_in, "_ts", F.col("_ts").isNull().alias("_none"), *keys)
              .groupBy(F.window("_at", window).alias("_w"), "_none", *keys)
              .agg(F.count(F.lit(1)).alias("n"), F.max("_ts").alias("_newest")))
    late = F.lit(False)
    if frontier is not None:
        late = F.col("_w.end") <= F.timestamp_millis(F.lit(frontier)) - F.expr(f"INTERVAL {watermark}")
    kind = F.when(F.col("_none"), UNTIMED).when(late, LATE).otherwise(ON_TIME)
    return counts.select(F.when(~F.col("_none"), F.col("_w.start")).alias("window_start"), kind.alias("_kind"),
                         *keys, "n", "_newest")


def run_volume(spark: SparkSession, source_path: str, schema, out_path: str, ts_col: str = "ts",
               keys: tuple[str, ...] = (), window: str = "1 day", watermark: str = "1 hour",
               feed: Sequence[Callable[[], None]] = (), fold_every: int = 64, kinds: bool = False) -> DataFrame:
    """Event-time counts per window: (window_start, keys, n), events without a time under a null window.

    Every batch counts its own rows in one pass.  A row whose window ended ``watermark`` or longer before
    the newest event of the batches before is late and not in the counts; it is counted beside
    them.  With ``kinds`` the result has a column ``kind`` and all three: on time, late and untimed
    add up to the input.  An empty feed gives an empty result."""
    log = volume_log(spark, out_path, keys, fold_every)
    s = _source(spark, source_path, schema, feed)

    def count(batch: DataFrame, batch_id: int) -> None:
        earlier = log.rows(batch_id)
        frontier = None if earlier is None else earlier.agg(F.max(F.unix_millis("_newest"))).first()[0]
        log.append(volume_of_batch(batch, frontier, ts_col, keys, window, watermark), batch_id)
    run_available(s.writeStream.foreachBatch(count), "volume", spark, feed)
    rows = log.read()
    if rows is None:
        rows = volume_of_batch(spark.createDataFrame([], s.schema), None, ts_col, keys, window, watermark)
    if kinds:
        return rows.drop("_newest").withColumnRenamed("_kind", "kind")
    return rows.where(F.col("_kind") != LATE).drop("_kind", "_newest")


# -- ST1, M12: scoring with the active model ----------------------------------------------------

def run_scoring(spark: SparkSession, source_path: str, schema, base: str, out_path: str, id_col: str = "id",
                text_col: str = "complaint_text", feed: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Score each micro-batch with the model that is active when it begins (``modelruns``), so a new
    version is picked up between batches; a replayed batch rewrites its own folder as a whole."""
    def score(batch: DataFrame, batch_id: int) -> None:
        batch.persist()         # term counts and ids both read it
        MR.score(batch, id_col, text_col, base).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        batch.unpersist()
    run_available(_source(spark, source_path, schema, feed).writeStream.foreachBatch(score), "score", spark, feed)
    return spark.read.parquet(out_path)


# -- ST4: index refresh per micro-batch -----------------------------------------------------------

def run_index_refresh(spark: SparkSession, source_path: str, schema, index_path: str, dim: int = 64,
                      feed: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Grow the case index at ``index_path`` (``caseindex``) by the cases of each micro-batch that it does not hold.

    A batch reads only the id buckets that its cases fall into, whatever the index holds by then, and can be
    searched from its commit on.  One that is replayed after its commit adds nothing; one that
    died before it is written again, and its half-written folders are never read.  An empty feed
    gives an empty result."""
    def refresh(batch: DataFrame, batch_id: int) -> None:
        CI.append(spark, batch, index_path, dim)         # reads the batch twice (ids, texts), which is less than keeping it
    run_available(_source(spark, source_path, schema, feed).writeStream.foreachBatch(refresh), "index", spark, feed)
    m = CI.manifest(spark, index_path)
    if m is None or not m.batches:
        return R.build_index(R.index_rows(spark.createDataFrame([], schema)), dim, "double")
    return CI.read(spark, index_path).drop("cell", "far", "norm", "block")
