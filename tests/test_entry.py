"""Driver contract: entry runs, every oracle has a query, names are unique."""

import __spark_entry__ as E

from .conftest import SF_SMOKE


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"passed", "reason_code", "severity", "n"}
    assert df.count() > 0


def test_oracles_have_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_cheap_queries_run_at_smoke_scale(spark):
    q = E.queries()
    for name in ("validate_reason", "apply_status", "list_page", "similar_dense", "decode_heads"):
        assert q[name](spark, SF_SMOKE).count() >= 0
