"""CSV intake, raw-feed preparation, sampling, splitting and dedup."""

import hashlib

import pytest
from pyspark.sql import functions as F

from casework.operators import intake as I
from casework.operators import sampling as SM
from casework.session import scratch_path
from casework.sources import csv as CSV

from .conftest import rows


def test_csv_quotes_newlines_and_missing_spellings(spark):
    path = scratch_path(spark, "t-csv") + "/upload.csv"
    import os
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/part-0.csv", "w") as f:
        f.write('complaint_text,category,severity\n'
                '"He said ""stop"", then left",ATM_FAILURE,high\n'
                '"line one\nline two",N/A,None\n'
                'plain,,low\n'
                ',FRAUD_DETECTION,high\n')
    df = CSV.read_upload(spark, path)
    got = sorted(rows(df, "complaint_text", "category", "severity", "emotion"), key=str)
    assert got == sorted([('He said "stop", then left', "ATM_FAILURE", "high", None),
                          ("line one\nline two", None, None, None),
                          ("plain", None, "low", None)], key=str)


def test_upload_requires_csv_and_text_column(spark):
    with pytest.raises(ValueError):
        CSV.read_upload(spark, "/nowhere/file.txt")
    path = scratch_path(spark, "t-csv2") + "/x.csv"
    spark.createDataFrame([("a",)], "other string").write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        CSV.read_upload(spark, path)


def _file(folder, name, text):
    import os
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def _local(spark, name):
    path = scratch_path(spark, name) + "/up load.csv"
    return path[len("file:"):] if path.startswith("file:") else path


def test_files_are_read_by_their_own_headers(spark):
    folder = _local(spark, "t-heads")
    _file(folder, "a.csv", 'complaint_text,category\n"one, ""two""\nlines",A\nshort\nx,y,z\n')
    _file(folder, "b.csv", 'category,extra,complaint_text\nB,9,NULL\nC,8,third\n')
    _file(folder, "c.csv", "")
    got = {tuple(r) for r in CSV.read_checked(spark, folder).select("complaint_text", "category", "extra", CSV.UNREADABLE).collect()}
    assert {g for g in got if g[3] is None} == {('one, "two"\nlines', "A", None, None), (None, "B", "9", None), ("third", "C", "8", None)}
    assert {g[3] for g in got if g[3] is not None} == {"short", "x,y,z"}
    assert CSV.read_checked(spark, folder).count() == 5
    assert CSV.read_checked(spark, folder).select("category").where("category = 'y'").count() <= 1


def test_an_unclosed_quote_spoils_its_line_or_the_rest_of_its_file(spark):
    folder = _local(spark, "t-quote")
    _file(folder, "a.csv", 'complaint_text,category\nfirst,A\n"never closed,B\nthird,C\nfourth,D\n')
    _file(folder, "b.csv", 'complaint_text,category\nother,E\n')
    whole = CSV.read_checked(spark, folder).collect()
    assert {r.category for r in whole if r[CSV.UNREADABLE] is None} == {"A", "E"}
    assert ["never closed" in r[CSV.UNREADABLE] and "fourth" in r[CSV.UNREADABLE] for r in whole if r[CSV.UNREADABLE]] == [True]
    lines = CSV.read_checked(spark, folder, quoted_newlines=False).collect()
    assert {r.category for r in lines if r[CSV.UNREADABLE] is None} == {"A", "C", "D", "E"}
    assert [r[CSV.UNREADABLE] for r in lines if r[CSV.UNREADABLE]] == ['"never closed,B']


def test_headers_that_cannot_be_used_are_refused(spark):
    for text in ("", "a,a\n1,2\n", "a,,b\n", '"a\nb",c\n1,2\n'):
        folder = _local(spark, "t-odd")
        _file(folder, "a.csv", text)
        with pytest.raises(ValueError):
            CSV.read_checked(spark, folder)


GOOD = "My card was charged twice for the same purchase last week and the bank has not answered any letter."


def test_an_upload_is_stored_and_counted_in_one_run(spark):
    from casework.sources import tables as TB
    folder, table = _local(spark, "t-store"), scratch_path(spark, "t-table")
    _file(folder, "a.csv", f'complaint_text,category,customer_id\n"{GOOD}",FRAUD_DETECTION,1\ntoo short,,2\n,X,3\nbroken\n')
    _file(folder, "b.csv", f'customer_id,complaint_text,channel\n4,"{GOOD} Again.",web\n')
    want = {"stored": 2, "skipped": 2, "total_rows": 4}
    assert I.store_upload(spark, folder, table) == want
    stored = {r.customer_id: r for r in TB.read_accepted(spark, table).collect()}
    assert set(stored) == {"1", "4"} and stored["1"].category == "FRAUD_DETECTION" and stored["4"].category == "UNKNOWN"
    assert stored["4"].channel == "web" and stored["4"].complaint_text == GOOD + " Again."
    assert {(r.complaint_text, r.reason_code) for r in TB.read_rejected(spark, table).collect()} == {
        ("too short", "few_words"), ("broken", I.UNREADABLE)}
    records, rejected = I.build_cases(CSV.read_upload(spark, folder + "/b.csv"))
    assert set(records.columns) == set(TB.read_accepted(spark, table).columns)
    assert I.store_upload(spark, folder, table) == want and TB.read_accepted(spark, table).count() == 4


def test_an_upload_without_a_row_is_refused(spark):
    folder, table = _local(spark, "t-none"), scratch_path(spark, "t-none")
    _file(folder, "a.csv", "complaint_text,category\n,A\nNULL,B\n")
    with pytest.raises(ValueError, match="no valid rows"):
        I.store_upload(spark, folder, table)
    _file(_local(spark, "t-col"), "a.csv", "text\na\n")
    with pytest.raises(ValueError):
        I.store_upload(spark, folder + "/missing.txt", table)


def test_csv_round_trip(spark):
    src = spark.createDataFrame([("a \"quoted\"\nmulti-line, text", "x"), ("plain", None)],
                                "complaint_text string, category string")
    path = scratch_path(spark, "t-rt") + "/r.csv"
    CSV.write_csv(src, path)
    back = CSV.read_upload(spark, path)
    assert sorted(rows(back, "complaint_text", "category"), key=str) == sorted(rows(src), key=str)


def test_column_resolution():
    cols = ["Date", "Product", "Consumer complaint narrative", "State", "Complaint ID"]
    assert I.resolve_narrative(cols) == "Consumer complaint narrative"
    assert I.resolve_product(cols) == "Product"
    assert I.resolve_optional(cols) == [("location", "State"), ("customer_id", "Complaint ID")]
    with pytest.raises(ValueError):
        I.resolve_narrative(["a", "b"])


def _rank(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_mark_lowest_equals_brute_force(spark):
    # one hot stratum holding most rows, plus small ones; tiny bucket width forces boundary buckets
    data = [(i, "hot" if i % 10 < 7 else ("b" if i % 10 < 9 else "c")) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, g string")
    got = {r[0] for r in SM.mark_lowest(df, "g", 137, "id", bucket_digits=2).where("selected").select("id").collect()}
    want = set()
    for g in ("hot", "b", "c"):
        ids = sorted((i for i, gg in data if gg == g), key=lambda i: (_rank(i), i))
        want |= set(ids[:137])
    assert got == want


def test_stratified_sample_only_above_limit(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(90)], "id long, g string")
    assert SM.stratified_sample(df, "g", 100, "id").count() == 90
    s = SM.stratified_sample(df, "g", 40, "id")
    assert dict(rows(s.groupBy("g").count())) == {"x": 20, "y": 20}


def test_stratified_split_counts(spark):
    df = spark.createDataFrame([(i, "x" if i < 15 else "y") for i in range(40)], "id long, g string")
    out = SM.stratified_split(df, "g", "id", 20)
    c = {(g, s): n for g, s, n in rows(out.groupBy("g", "split").count())}
    assert c == {("x", "test"): 3, ("x", "train"): 12, ("y", "test"): 5, ("y", "train"): 20}


def test_dedup_keeps_smallest_order(spark):
    df = spark.createDataFrame([(3, "a", "p"), (1, "a", "q"), (2, "b", "r")], "id long, t string, v string")
    assert sorted(rows(SM.dedup_keep_first(df, "t", "id"))) == [(1, "a", "q"), (2, "b", "r")]


def test_prepare_feed_without_product_column(spark):
    raw = spark.createDataFrame([("x" * 60, "No", "No"), ("short", "No", "No")],
                                "narrative string, `Consumer disputed?` string, `Timely response?` string")
    out = rows(I.prepare_feed(raw, limit=0), "category", "severity")
    assert out == [("UX_ISSUES", "medium")]


def test_null_strata_are_sampled_and_split_like_any_other(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(100)], "id long, g string")
    split = SM.stratified_split(df, "g", "id", 20)
    got = {(r.g, r.split): r["count"] for r in split.groupBy("g", "split").count().collect()}
    assert got == {("a", "test"): 10, ("a", "train"): 40, (None, "test"): 10, (None, "train"): 40}
    small = {(r.g): r["count"] for r in SM.stratified_sample(df, "g", 99, "id").groupBy("g").count().collect()}
    assert small == {"a": 49, None: 49}
    assert SM.stratified_sample(df, "g", 1000, "id").count() == 100


def test_long_texts_are_kept_whole(spark):
    text = "a long story about a card and a branch " * 200
    raw = spark.createDataFrame([(text, "Credit card", "1")], "`Consumer complaint narrative` string, `Product` string, `Complaint ID` string")
    prepared = I.prepare_feed(raw)
    assert [r.complaint_text for r in prepared.collect()] == [text.strip()]
    assert [r.complaint_text for r in I.seed_cases(prepared).collect()] == [text.strip()]
