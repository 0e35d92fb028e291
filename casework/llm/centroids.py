"""Exact k-means on integer vectors with Ptolemaic pivots.

Every vector keeps its distances to ``PIVOTS`` fixed pivots.  For any vector x, centroid c and pair
of pivots (p, s), Ptolemy's inequality gives

    d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|

so fixed pivot pairs bound all distances of a vector from below at a few multiplications a
centroid, whatever the number of components.  The bounds are lowered by more than the rounding
of the floating-point numbers that they come from.  A vector is first compared with the centroid of
its least bound; only centroids whose bound does not exceed that distance are compared too, in
integers, so the assignment is the exact one.

Vectors and pivot distances are written once; a round reads them, assigns and sums in a task, and
only (cluster, component) sums leave it, so neither a large cluster nor copies of a vector meet in
one task.  Centroids (``k`` x ``dim`` numbers) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.session import written

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Fixed pivots, and how many of their pairs give bounds.
PIVOTS, PAIRS = 8, 8
#: Components beyond this are refused: a squared distance of 64 of them must fit 63 bits.
MOST = 1 << 27
#: Rows that are worked through at once.
CHUNK = 4096
#: Share by which a bound is lowered; the rounding it covers is under 1e-14.
SLACK = 1e-11


def whole_vectors(vectors: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(key, x): integer floor(scale * component) of the vectors with ``dim`` finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    big = F.exists(v, lambda x: F.abs(x.cast("double") * scale) >= MOST)
    told = F.raise_error(F.lit(f"a component beyond {MOST} / {scale}: its squared distances do not fit 64 bits"))
    return (vectors.where(v.isNotNull() & (F.size(v) == dim)).where(~bad)
            .select(F.col(key).alias("key"), F.when(big, told.cast("array<int>")).otherwise(ints.cast("array<int>")).alias("x")))


def seeds(rows: DataFrame, k: int) -> np.ndarray:
    """Up to ``k`` vectors with the smallest sha256 of ``1:<key>``, in that order; null keys come last,
    vectors of one key by their components."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("key").cast("string")), 256)
    first = rows.select(h.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def pivot_pairs(pivots: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The pairs of pivots farthest apart; pivots at the same place are no pair."""
    apart = [(float(((pivots[p] - pivots[s]) ** 2).sum()), p, s) for p, s in combinations(range(len(pivots)), 2)]
    return [(p, s) for d, p, s in sorted(apart, key=lambda a: (-a[0], a[1:])) if d > 0][:most]


def matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, dim)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``c``, in 64-bit integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p) for p in points], axis=1).astype(float)) if len(points) else np.zeros((len(x), 0))


def with_pivots(pivots: np.ndarray):
    """Arrow function: (key, x) -> (key, x, near): distances to the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), pivots.shape[1]).astype(np.int64)
            near = distances(x, pivots)
            arrays = [b.column("key"), b.column("x"),
                      pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * near.shape[1], pa.int32()),
                                               pa.array(near.reshape(-1)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "x", "near"])

    return run


def bounds(near: np.ndarray, at: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Lower bounds of the distances (rows x centroids), from the distances to pivots of the rows
    (``near``) and of the centroids (``at``)."""
    low = np.zeros((len(near), len(at)))
    for p, s in pairs:
        a = near[:, [p]] * at[:, s]
        b = near[:, [s]] * at[:, p]
        base = float(np.sqrt(float(((pivots[p] - pivots[s]) ** 2).sum())))
        np.maximum(low, (np.abs(a - b) - SLACK * (a + b)) / base, out=low)
    return low * (1 - SLACK)


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray,
            pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row (ties: the smaller number), its squared distance, and how many
    exact distances that took."""
    low = bounds(near, distances(centroids, pivots), pivots, pairs)
    first = low.argmin(axis=1)
    diff = x - centroids[first]
    best, cluster = np.einsum("ij,ij->i", diff, diff), first.copy()
    done = len(x)
    for c in range(len(centroids)):
        # a squared distance is rounded when it becomes a float: SLACK covers that too
        rows = np.flatnonzero((low[:, c] ** 2 * (1 - SLACK) <= best) & (first != c))
        if len(rows):
            d = squared(x[rows], centroids[c])
            less = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            best[rows[less]], cluster[rows[less]] = d[less], c
            done += len(rows)
    return cluster, best, done


def _parts(batches: Iterator[pa.RecordBatch], centroids, pivots, pairs):
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            part = b.slice(at, CHUNK)
            x = matrix(part.column("x"), centroids.shape[1]).astype(np.int64)
            near = part.column("near").flatten().to_numpy().reshape(len(x), len(pivots))
            yield part, x, *nearest(x, near, centroids, pivots, pairs)


def summed(centroids: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int]]):
    """Arrow function: rows -> (cluster, i, total) of the task; i = -1 holds the count, -2 the exact
    distances taken."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        totals, counts, done = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for _, x, cluster, _, n in _parts(batches, centroids, pivots, pairs):
            counts += np.bincount(cluster, minlength=k)
            done += n
            for c in np.unique(cluster):
                totals[c] += x[cluster == c].sum(axis=0)
        used = np.flatnonzero(counts)
        columns = [np.repeat(used, dim + 1), np.tile(np.arange(-1, dim), len(used)),
                   np.concatenate([counts[used, None], totals[used]], axis=1).reshape(-1)]
        columns = [np.append(c, v) for c, v in zip(columns, (0, -2, done))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["cluster", "i", "total"])

    return run


def assigned(centroids: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int]]):
    """Arrow function: rows -> (key, cluster, distance)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, best, _ in _parts(batches, centroids, pivots, pairs):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(cluster.astype(np.int32)), pa.array(best)],
                                             names=["key", "cluster", "distance"])

    return run


def moved(rows: DataFrame, centroids: np.ndarray, pivots: np.ndarray, pairs: list) -> tuple[np.ndarray, int]:
    """Centroids after one round (empty clusters stay), and the exact distances it took."""
    parts = rows.mapInArrow(summed(centroids, pivots, pairs), "cluster long, i long, total long")
    total = parts.groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    sums: dict[tuple[int, int], int] = {}
    for r in total.collect():                        # at most k * (dim + 1) + 1 rows
        sums[r["cluster"], r["i"]] = int(r["total"])
    new = centroids.copy()
    for c in range(len(centroids)):
        if n := sums.get((c, -1)):
            new[c] = [sums[c, i] // n for i in range(centroids.shape[1])]      # floor, also below zero
    return new, sums[0, -2] if sums else 0


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dim: int = DIM, scale: int = SCALE, pivots: int = PIVOTS, pairs: int = PAIRS) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for every vector with
    exactly ``dim`` components, none null or non-finite.

    A row without a key takes part, but is chosen as a first centroid only where too few rows have
    one; repeated keys are rows of their own; fewer than ``k`` vectors make as many clusters, equal
    first vectors leave the later of them empty; no vector left, or an empty table, gives an empty
    result; other columns take no part.  A component of ``MOST`` / ``scale`` or more is an error.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    out = f"key {kind}, cluster int, distance long"
    rows = whole_vectors(vectors, key, vector, dim, scale)
    centroids = seeds(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string"
                                     ).withColumnRenamed("key", key)
    fixed = centroids[:pivots]
    chosen = pivot_pairs(fixed, pairs)
    table = written(rows.mapInArrow(with_pivots(fixed), f"key {kind}, x array<int>, near array<double>"), "centroid-vectors")
    for _ in range(rounds):
        centroids, _ = moved(table, centroids, fixed, chosen)
    done = written(table.mapInArrow(assigned(centroids, fixed, chosen), out), "centroid-clusters")
    digests = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    per = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    facts = (per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))     # k rows
             .join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster"))
    return done.join(F.broadcast(facts), "cluster").select(                            # k rows
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def embeddings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def oracle_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> str:
    parts = [f"""WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {scale}) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dim}
   AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS cluster, x AS c
  FROM kept QUALIFY cluster < {k}
)"""]
    far = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT row, vec_id, x, cluster, CAST(d AS BIGINT) AS distance
  FROM (SELECT row, vec_id, x, cluster, {far} AS d FROM kept CROSS JOIN c{r})
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1
)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT cluster, list(v ORDER BY i) AS c
  FROM (SELECT cluster, i, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
        FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, {dim} + 1)) AS i FROM a{r}) GROUP BY cluster, i)
  GROUP BY cluster
), c{r + 1} AS (
  SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster)
)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


ORACLE_SQL = oracle_sql()
