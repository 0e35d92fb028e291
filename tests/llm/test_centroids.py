"""Ptolemaic clustering against plain k-means in Python integers and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from casework.llm import centroids

from ..conftest import SF_SMOKE

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int, near int, x string"


def brute(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(e * scale) for e in v]) for i, v in rows
            if v is not None and len(v) == dim and all(e is not None and math.isfinite(e) for e in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in c]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        done = assign()
        for j in range(len(c)):
            own = [v for _, v, a, _ in done if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    done = assign()
    total = {j: sum(d for *_, a, d in done if a == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, a, d, total[a], sum(total.values()), sha[a]) for i, _, a, d in done), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_vectors_against_plain_integers(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 8))
    rows = [(i, (middle[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(200)]                      # a third of the rows are one vector
    rows += [(1, [0.25] * 8), (1, [0.25] * 8), (None, [0.1] * 8), (None, None), (2000, [0.1] * 7), (2001, []),
             (2002, [None] + [0.1] * 7), (2003, [float("nan")] + [0.1] * 7), (2004, [float("inf")] + [0.1] * 7),
             (2005, [0.0] * 8), (2006, [-1 / 64 - 1e-9] * 8)]
    df = spark.createDataFrame([(i, v, "c", 1, 2, "x") for i, v in rows], SCHEMA).repartition(7)
    assert got(centroids.cluster(df, dim=8, k=6, pivots=4)) == brute(rows, 6, 3, 8, 64)
    few = df.where("vec_id >= 2005 or vec_id = 1")
    assert got(centroids.cluster(few, dim=8)) == brute([r for r in rows if r[0] == 1 or (r[0] or 0) >= 2005], 16, 3, 8, 64)
    same = df.where("vec_id >= 1000 and vec_id < 1200")                      # no pair of pivots is apart
    assert {r.distance for r in centroids.cluster(same, dim=8).collect()} == {0}
    assert centroids.cluster(df.limit(0), dim=8).count() == 0
    assert centroids.cluster(df.where("vec_id = 2001"), dim=8).columns == centroids.cluster(df, dim=8).columns


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 4), (2, [0.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit"):
        centroids.cluster(df, dim=4).collect()


def test_bounds_never_exceed_distances_and_spare_work():
    rng = np.random.default_rng(1)
    spots = rng.integers(-4000, 4000, (8, 16))
    x = (spots[rng.integers(0, 8, 500)] + rng.integers(-30, 30, (500, 16))).astype(np.int64)
    pivots, c = x[:8], x[8:24]
    pairs = centroids.pivot_pairs(pivots, 8)
    near = centroids.distances(x, pivots)
    low = centroids.bounds(near, centroids.distances(c, pivots), pivots, pairs)
    assert (low <= centroids.distances(x, c)).all()
    cluster, best, done = centroids.nearest(x, near, c, pivots, pairs)
    exact = np.stack([centroids.squared(x, m) for m in c], axis=1)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert done < 0.5 * exact.size


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMOKE}/embeddings.parquet'")
    cur = con.execute(centroids.ORACLE_SQL)
    cols = [d[0] for d in cur.description]
    assert got(centroids.embeddings_query(spark, SF_SMOKE).select(cols)) == sorted(cur.fetchall(), key=repr)
