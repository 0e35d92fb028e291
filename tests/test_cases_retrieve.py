"""Listing, updates, notes and retrieval."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.operators import cases as C
from casework.operators import retrieve as R
from casework.session import scratch_path
from casework.sources import tables as TB

from .conftest import rows


def _cases(spark, n=23):
    data = [(str(i), f"text {i}", "A" if i % 2 else "B", "open", f"2024-01-{1 + i % 5:02d} 00:00:00")
            for i in range(n)]
    return spark.createDataFrame(data, "id string, complaint_text string, category string, status string, ts string") \
                .withColumn("created_at", F.to_timestamp("ts")).drop("ts")


def test_page_args():
    with pytest.raises(ValueError):
        C.check_page_args(0, 10)
    with pytest.raises(ValueError):
        C.check_page_args(1, 501)


def test_pages_concatenate_to_full_order(spark):
    df = _cases(spark)
    full = [r[0] for r in df.orderBy(F.col("created_at").desc(), "id").select("id").collect()]
    pages = []
    for p in range(1, 4):
        pages += [r[0] for r in C.list_page(df, page=p, limit=10).collect()]
    assert pages == full
    assert C.filter_count(df, category="A").first()["total"] == 11


def test_updates_latest_non_empty_per_field(spark):
    base = spark.createDataFrame([(1, "open", None, None), (2, "open", None, None)],
                                 "case_id long, status string, assignee_id string, resolution_notes string")
    ups = spark.createDataFrame([
        (1, 1, "2024-01-01 00:00:00", "in_progress", "agent-1", None, None),
        (2, 1, "2024-01-02 00:00:00", "", None, None, "only a note"),          # empty status ignored
        (3, 1, "2024-01-03 00:00:00", None, "", "done", None),
        (4, 9, "2024-01-03 00:00:00", "closed", None, None, "ghost"),          # unknown case
    ], "event_id long, case_id long, t string, status string, assignee_id string, resolution_notes string, note string"
    ).withColumn("ts", F.to_timestamp("t")).drop("t")
    cur = {r["case_id"]: r for r in C.apply_updates(base, ups).collect()}
    assert (cur[1]["status"], cur[1]["assignee_id"], cur[1]["resolution_notes"]) == ("in_progress", "agent-1", "done")
    assert cur[2]["status"] == "open" and cur[2]["n_updates"] == 0
    assert rows(C.unknown_updates(base, ups), "event_id") == [(4,)]
    notes = rows(C.notes_from_updates(base, ups), "complaint_id", "content")
    assert notes == [(1, "only a note")]


def _vecs(n, d, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m


def test_blocked_dense_topk_equals_brute_force(spark):
    m = _vecs(60, 8, 1)
    df = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(60)], "id long, vector array<double>")
    got = rows(R.topk_dense(df, df, 3, exclude_self=True, q_block_rows=16, i_block_rows=7)
               .orderBy("qid", "rank"), "qid", "nid", "rank")
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    want = []
    for q in range(60):
        order = sorted(range(60), key=lambda j: (-round(s[q, j], 9), j))[:3]
        want += [(q, j, r + 1) for r, j in enumerate(order)]
    assert got == want


def test_similar_to_one_unknown_id_is_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    assert R.similar_to_one(df, 99).count() == 0
    assert rows(R.similar_to_one(df, 1, 1), "id") == [(2,)]


def test_embedder_plugin_normalises(spark):
    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    df = spark.createDataFrame([(1, "abc"), (2, "")], "id long, t string")
    out = {r["id"]: r["vector"] for r in R.embed_with(df, "id", "t", factory, 2).collect()}
    assert abs(sum(v * v for v in out[1]) - 1) < 1e-6


def test_request_bounds():
    C.check_text_request("x" * 10)
    with pytest.raises(ValueError):
        C.check_text_request("short")
    with pytest.raises(ValueError):
        C.check_batch_request([])
    with pytest.raises(ValueError):
        C.check_similar_k(11)


def test_append_and_read_cases(spark):
    from casework.session import scratch_path
    from casework.sources import tables
    path = scratch_path(spark, "t-cases")
    tables.append_cases(_cases(spark, 5), path)
    tables.append_cases(_cases(spark, 3), path)
    assert tables.read_cases(spark, path).count() == 8


def test_newest_matches_plain_sort(spark):
    df = _cases(spark, 40)
    want = [r[0] for r in df.orderBy(F.col("created_at").desc(), "id").limit(7).select("id").collect()]
    assert [r[0] for r in C.newest(df, 7).select("id").collect()] == want
    assert C.newest(df, 100).count() == 40


def test_updated_at_moves_only_with_a_change(spark):
    from casework.operators import cases as C
    base = spark.createDataFrame([("a", "open", 1), ("b", "open", 1)], "case_id string, status string, updated_at int")
    ups = spark.createDataFrame([("a", "", 5, 1), ("a", "closed", 3, 2), ("b", None, 9, 3)],
                                "case_id string, status string, ts int, event_id int")
    got = {r.case_id: (r.status, r.updated_at, r.n_updates) for r in C.apply_updates(base, ups, fields=["status"]).collect()}
    assert got == {"a": ("closed", 3, 2), "b": ("open", 1, 1)}


def test_every_case_is_indexed_with_its_whole_text(spark):
    from casework.operators import retrieve as R
    df = spark.range(10_050).selectExpr("id", "cast(id as string) case_id", "'' category", "'' severity", "'' emotion", "'' status",
                                        "repeat('word ', 100) complaint_text", "timestamp_seconds(id) created_at")
    rows = R.index_rows(df)
    assert rows.count() == 10_050 and rows.first().complaint_text == "word " * 100


def test_pages_by_cursor_equal_pages_by_offset(spark):
    """Ties, null times, several pages past the end; both kinds of time column; only days up to the cursor are read."""
    data = [(f"{i:03d}", None if i % 11 == 0 else f"2024-01-{1 + i % 6:02d} {i % 3:02d}:00:00.000{i % 2}", "AB"[i % 2])
            for i in range(95)]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(data, "id string, t string, category string").selectExpr(
            "id", f"CAST(t AS {kind}) AS created_at", "category", "'x' AS complaint_text")
        path = scratch_path(spark, "t-keyset")
        assert TB.append_cases(df, path, "week" if kind == "timestamp" else "day") == 95
        stored = spark.read.parquet(path)
        for filters in ({}, {"category": "A"}):
            after, n = None, 0
            for page in range(1, 12):
                got = C.list_after(stored, after, 10, day_col=TB.CASE_PARTITION, **filters)
                assert [r["id"] for r in got.collect()] == [
                    r["id"] for r in C.list_page(df, page, 10, **filters).collect()]
                n += got.count()
                at = C.page_cursor(got)
                if at is None:
                    break
                after = at
            assert n == C.filter_count(df, **filters).first()["total"]
        plan = C.list_after(stored, ("2024-01-02 00:00:00", "5"), 10, day_col=TB.CASE_PARTITION) \
            ._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [((created_date" in plan and "TakeOrderedAndProject" in plan
    assert C.page_cursor(stored.where("false")) is None


def test_dense_scores_are_held_a_slice_at_a_time():
    import tracemalloc

    import pandas as pd
    g = np.random.default_rng(7)
    q = pd.DataFrame({"qid": np.arange(1500), "v": list(g.normal(size=(1500, 16)))})
    x = pd.DataFrame({"nid": np.arange(6000), "v": list(g.normal(size=(6000, 16)))})
    tracemalloc.start()
    got = R._dense_scorer(3, True, False)(q, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * 6000 * 8                       # less than the whole matrix of scores once
    s = np.stack(q["v"]) @ np.stack(x["v"]).T
    s[np.arange(1500), np.arange(1500)] = -np.inf
    assert got["nid"].to_numpy().reshape(-1, 3).tolist() == np.argsort(-s, axis=1)[:, :3].tolist()
