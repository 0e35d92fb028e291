"""Streaming jobs agree with batch; late data beyond the watermark is dropped."""

from pyspark.sql import functions as F

from casework.operators import cases as C
from casework.session import scratch_path
from casework.streaming import jobs as J

from .conftest import rows


def _events(spark, data):
    return spark.createDataFrame(data, "event_id long, case_id long, t string, status string") \
                .withColumn("ts", F.to_timestamp("t")).drop("t")


def test_status_stream_equals_batch(spark):
    data = [(i, i % 3, f"2024-01-01 {i:02d}:00:00", ["open", "in_progress", "", None][i % 4]) for i in range(20)]
    ev = _events(spark, data)
    src = scratch_path(spark, "t-st")
    J.stage_files(ev, src, 4, "ts")
    schema = spark.read.parquet(src).schema
    stream = J.run_status(spark, src, schema, scratch_path(spark, "t-st-out"), lambda d: d)
    batch = C.fold_updates(ev)
    cols = ["case_id", "status", "n_updates"]
    assert sorted(rows(stream, *cols)) == sorted(rows(batch, *cols))


def test_watermark_drops_rows_of_evicted_windows(spark):
    """Rows within the watermark are always counted; a row arriving after its
    window's state was evicted is dropped."""
    import time
    src = scratch_path(spark, "t-wm")
    batches = [
        [(1, 1, "2024-01-01 10:00:00", "a"), (2, 1, "2024-01-03 10:00:00", "a")],
        [(4, 1, "2024-01-03 09:30:00", "a")],          # 30 min late, within the 1-hour watermark
        [(3, 1, "2024-01-01 11:00:00", "a")],          # two days late, its window already closed
    ]
    for b in batches:
        _events(spark, b).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)                                  # file source replays by modification time
    schema = spark.read.parquet(src).schema
    out = J.run_volume(spark, src, schema, scratch_path(spark, "t-wm-out"), "ts", (), "1 day", "1 hour")
    got = {str(r["window_start"])[:10]: r["n"] for r in out.collect()}
    assert got == {"2024-01-01": 1, "2024-01-03": 2}


def test_fed_deliveries_are_whole_micro_batches(spark):
    """Each delivery is written by several tasks (several files) and taken as
    one micro-batch, so a later delivery's old row is judged against the
    watermark of the deliveries before it, never against its own files."""
    src = scratch_path(spark, "t-feed")
    batches = [
        [(1, 1, "2024-01-01 10:00:00", "a"), (2, 1, "2024-01-03 10:00:00", "a"), (5, 1, "2024-01-01 12:00:00", "a")],
        [(4, 1, "2024-01-03 09:30:00", "a"), (6, 1, "2024-01-05 10:00:00", "a")],
        [(3, 1, "2024-01-01 11:00:00", "a")],          # its window closed two deliveries ago
    ]

    def deliver(b):
        return lambda: _events(spark, b).repartition(3).write.mode("append").parquet(src)
    first, *rest = [deliver(b) for b in batches]
    first()
    schema = spark.read.parquet(src).schema
    out = J.run_volume(spark, src, schema, scratch_path(spark, "t-feed-out"), "ts", (), "1 day", "1 hour",
                       feed=rest)
    got = {str(r["window_start"])[:10]: r["n"] for r in out.collect()}
    assert got == {"2024-01-01": 2, "2024-01-03": 2, "2024-01-05": 1}


def test_volume_counts_events_without_a_time(spark):
    src = scratch_path(spark, "t-null")
    batches = [
        [(1, 1, "2024-01-01 10:00:00", "a"), (2, 1, None, "a"), (3, 1, None, None)],
        [(4, 1, "2024-01-01 11:00:00", None), (5, 1, None, "a")],
    ]

    def deliver(b):
        return lambda: _events(spark, b).write.mode("append").parquet(src)
    first, *rest = [deliver(b) for b in batches]
    first()
    schema = spark.read.parquet(src).schema
    for keys, want in ((("status",), {("2024-01-01", "a"): 1, ("2024-01-01", None): 1, (None, "a"): 2, (None, None): 1}),
                       ((), {("2024-01-01",): 2, (None,): 3})):
        out = J.run_volume(spark, src, schema, scratch_path(spark, "t-null-out"), "ts", keys, feed=rest)
        rest = []
        got = {(r["window_start"] and str(r["window_start"])[:10], *[r[k] for k in keys]): r["n"] for r in out.collect()}
        assert got == want


def test_empty_and_untimed_feeds(spark):
    schema = "event_id long, ts timestamp, kind string"
    for data, want in (([], []), ([(1, None, "a"), (2, None, "a")], [(None, "a", 2)])):
        src = scratch_path(spark, "t-empty-src")
        first, *rest = J.feed_slices(spark.createDataFrame(data, schema), src, 4, "ts")
        first()
        out = J.run_volume(spark, src, schema, scratch_path(spark, "t-empty-out"), keys=("kind",), feed=rest)
        assert [tuple(r) for r in out.collect()] == want


def _status_feed(n_batches, per_batch):
    """Updates dealt over deliveries out of time order, with ties, blanks and null keys."""
    states = ["open", "in_progress", "", None, "resolved"]
    out = []
    for b in range(n_batches):
        out.append([(b * per_batch + i, None if i == 7 else (b * 3 + i) % 5,
                     f"2024-01-{1 + (b * 7 + i * 3) % 9:02d} 10:00:00", states[(b + 2 * i) % 5]) for i in range(per_batch)])
    return out


def test_status_log_is_folded_and_stays_bounded(spark):
    """Batches in any order fold to what one fold over all updates gives; folders already folded go."""
    src, out = scratch_path(spark, "t-fold"), scratch_path(spark, "t-fold-out")
    batches = _status_feed(9, 9)
    first, *rest = [(lambda b=b: _events(spark, b).write.mode("append").parquet(src)) for b in batches]
    first()
    schema = spark.read.parquet(src).schema
    got = J.run_status(spark, src, schema, out, lambda d: d, feed=rest, fold_every=2)
    want = C.fold_updates(_events(spark, [r for b in batches for r in b]))
    cols = ["case_id", "status", "last_update", "n_updates"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(rows(got, *cols), key=key) == sorted(rows(want, *cols), key=key)
    log = J.BatchLog(spark, out, C.merge_partials, 2)
    assert log.folds() == [1, 3, 5, 7]
    left = {r["batch"] for r in spark.read.parquet(f"{out}/out").select("batch").distinct().collect()}
    assert left == {6, 7, 8}
    assert spark.read.parquet(f"{out}/folded/upto=7").count() == 6     # a row a case, one of them null


def test_unnamed_fold_does_not_count(spark):
    """A job that died after it wrote a fold, before it named it, leaves the log as it was; the fold is written again."""
    path = scratch_path(spark, "t-torn")
    log = J.BatchLog(spark, path, C.merge_partials, 2)
    for i, batch in enumerate(_status_feed(3, 9)[:2]):
        log.append(C.partial_updates(_events(spark, batch)), i)
    before = sorted(rows(log.read().where("case_id IS NOT NULL"), "case_id", "n_updates"))
    log.read().limit(1).write.parquet(f"{path}/folded/upto=1")
    assert sorted(rows(log.read().where("case_id IS NOT NULL"), "case_id", "n_updates")) == before
    log.fold_upto(1)
    log.fold_upto(1)
    assert log.folds() == [1]
    assert sorted(rows(log.read().where("case_id IS NOT NULL"), "case_id", "n_updates")) == before


def test_replayed_batch_replaces_its_own_rows(spark):
    log = J.BatchLog(spark, scratch_path(spark, "t-replay"), C.merge_partials, 1)
    for i, batch in [(0, 0), (1, 1), (1, 1), (2, 2), (2, 2)]:
        log.append(C.partial_updates(_events(spark, _status_feed(3, 9)[batch])), i)
    assert log.read().agg({"n_updates": "sum"}).first()[0] == 27


def test_on_time_late_and_untimed_add_up_to_the_input(spark):
    batches = [
        [(1, 1, "2024-01-01 10:00:00", "a"), (2, 1, "2024-01-03 10:00:00", "a"), (3, 1, None, "b")],
        [(4, 1, "2024-01-03 09:30:00", "a"), (5, 1, "2024-01-02 23:59:00", "b"), (6, 1, "2024-01-09 00:00:00", "a")],
        [(7, 1, "2024-01-01 11:00:00", "a"), (8, 1, None, None), (9, 1, "2024-01-09 05:00:00", None)],
        [(10, 1, "2024-01-03 11:00:00", "a"), (11, 1, "2024-01-03 11:00:00", "a")],
    ]
    for every in (1, 2, 64):
        src = scratch_path(spark, "t-kinds")
        first, *rest = [(lambda b=b: _events(spark, b).write.mode("append").parquet(src)) for b in batches]
        first()
        out = J.run_volume(spark, src, spark.read.parquet(src).schema, scratch_path(spark, "t-kinds-out"), "ts",
                           ("status",), feed=rest, fold_every=every, kinds=True)
        got = {(r["kind"], r["window_start"] and str(r["window_start"])[:10], r["status"]): r["n"] for r in out.collect()}
        assert got == {
            ("on_time", "2024-01-01", "a"): 1, ("on_time", "2024-01-03", "a"): 2, ("on_time", "2024-01-09", "a"): 1,
            ("on_time", "2024-01-09", None): 1, ("late", "2024-01-01", "a"): 1, ("late", "2024-01-02", "b"): 1,
            ("late", "2024-01-03", "a"): 2, ("untimed", None, "b"): 1, ("untimed", None, None): 1}
        assert sum(got.values()) == 11


def test_a_triage_batch_is_kept_without_its_texts(spark, monkeypatch):
    from pyspark.sql import functions as F
    from casework.operators import validate as V
    from casework.session import scratch_path
    from casework.streaming import jobs as J
    src = scratch_path(spark, "t-triage-src")
    df = spark.range(4).select(F.col("id").alias("case_id"), F.lit("too short").alias("complaint_text"))
    df.write.parquet(src)
    kept, sink = [], J._versioned_sink
    def spied(path, prepare):
        return lambda b, i: (kept.append(b.columns), sink(path, prepare)(b, i))
    monkeypatch.setattr(J, "_versioned_sink", spied)
    _, rejected = J.run_triage(spark, src, df.schema, scratch_path(spark, "t-triage-out"), V.Rules())
    assert rejected.count() == 4 and kept and all("complaint_text" not in c for c in kept)
