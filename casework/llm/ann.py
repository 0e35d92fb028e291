"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: a vector's residual to its cluster's centre is normalised, rotated by a random
orthogonal matrix and kept as one sign bit a dimension, packed, with two correction scalars:
the residual's length and the inner product of the rotated residual with its own code.
Query: the inner product with a code comes from the packed bytes (one 256-entry table a
byte), is divided by the correction scalar and gives an estimate of the distance with a bound
on its error.  Vectors whose lower bound reaches the k-th smallest upper bound are reranked
by exact distances in double precision on the original vectors.

Centres are fitted on at most ``FIT`` vectors; every vector is indexed.  The index is dealt
into blocks of about ``BLOCK_ROWS`` vectors within a cluster and the stated queries into
blocks of about ``BLOCK_QUERIES``; a task holds one pair of blocks, and of each query at most
k rows leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.session import written

FIT = 8192
CLUSTERS = 16
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
#: Standard deviations of the estimate that the error bound allows.
SAFETY = 4.0


def rotation(dims: int, seed: int) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of the sample; fewer if it has fewer distinct vectors."""
    distinct = np.unique(sample, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = nearest_centre(sample, c)
        c = np.stack([sample[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2.0 * (x @ c.T)).argmin(axis=1)


def encode(residual: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, lengths, inner products of the unit residuals with their codes)."""
    length = np.sqrt((residual * residual).sum(axis=1))
    turned = residual @ rot.T / np.where(length > 0, length, 1.0)[:, None]
    own = np.abs(turned).sum(axis=1) / math.sqrt(rot.shape[0])
    return np.packbits(turned >= 0, axis=1, bitorder="little"), length, own


def tables(turned: np.ndarray) -> np.ndarray:
    """For a rotated query, the share of the inner product that each value of each byte gives."""
    d = len(turned)
    padded = np.zeros(-(-d // 8) * 8)
    padded[:d] = turned / math.sqrt(d)
    signs = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), 1.0, -1.0)
    return padded.reshape(-1, 8) @ signs.T


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, centre: np.ndarray,
           rot: np.ndarray, k: int, safety: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector number, distance) of each query's k nearest in one block."""
    codes, length, own = encode(x - centre, rot)
    dims = rot.shape[0]
    spread = np.where(own > 0, np.sqrt(np.maximum(0.0, 1 - own * own)) / np.where(own > 0, own, 1), 1.0)
    out_q, out_x, out_d = [], [], []
    byte = np.arange(codes.shape[1])
    for n, q in enumerate(queries):
        r = q - centre
        far = math.sqrt(float(r @ r))
        table = tables(rot @ r)
        inner = table[byte, codes].sum(axis=1) / np.where(own > 0, own, 1.0)
        error = safety * spread * far / math.sqrt(max(1, dims - 1))
        near2 = length * length + far * far
        low, high = near2 - 2 * length * (inner + error), near2 - 2 * length * (inner - error)
        other = ids != query_ids[n]
        m = min(k, int(other.sum()))
        if not m:
            continue
        limit = np.partition(high[other], m - 1)[m - 1]
        at = np.flatnonzero(other & (low <= limit + 1e-9 * (1 + abs(limit))))
        diff = x[at] - q
        d = np.sqrt((diff * diff).sum(axis=1))
        best = np.lexsort((ids[at], d))[:k]
        out_q.append(np.full(len(best), n))
        out_x.append(at[best])
        out_d.append(d[best])
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, without null or non-finite components,
    not zero, with an id.  All must have one length (checked)."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0)))


def nearest(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            clusters: int = CLUSTERS, fit: int = FIT, safety: float = SAFETY, seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row for which ``is_query``
    (a column over ``id``) holds, nearest first, ties to the smaller id; all, if fewer.

    score: Euclidean distance in double precision.  Vectors that are null, zero or hold null or
    non-finite components take no part, as query or candidate; a query's own id is no candidate;
    rows of one id and vector count once; no usable vector gives no rows.  Vectors of several
    lengths: ValueError.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector).dropDuplicates(["id", "v"])
    span = rows.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if span["lo"] is None:
        return spark.createDataFrame([], empty)
    if span["lo"] != span["hi"]:
        raise ValueError(f"vectors of {span['lo']} and of {span['hi']} components")
    dims = span["lo"]
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(fit).select("v").toArrow()["v"]
    centre = centres(np.array(sample.to_pylist(), float), clusters, seed)
    shared = spark.sparkContext.broadcast((rotation(dims, seed), centre))

    @F.pandas_udf("int")
    def cluster_of(v: pd.Series) -> pd.Series:
        return pd.Series(nearest_centre(np.stack(v.to_list()), shared.value[1]).astype(np.int32))

    index = written(rows.withColumn("cluster", cluster_of("v")), "ann-index")
    sizes = {r["cluster"]: r["n"] for r in index.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, math.ceil(n / BLOCK_ROWS))])
    asked = index.where(is_query)
    deals = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    salt = F.xxhash64(F.lit("block"), "id")
    spread = F.array(*[F.struct(F.lit(c).alias("cluster"), F.lit(math.ceil(n / BLOCK_ROWS)).alias("parts"))
                       for c, n in sizes.items()])
    to_rows = (index.withColumn("part", F.pmod(salt, parts[F.col("cluster")]).cast("int"))
               .withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))))
    to_queries = (asked.drop("cluster").withColumn("deal", F.pmod(salt, F.lit(deals)).cast("int"))
                  .withColumn("to", F.explode(spread))
                  .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1)))
                  .select("id", "v", "deal", "to.cluster", "part"))

    def pair(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64"})
        rot, c = shared.value
        ids, query_ids = x["id"].to_numpy(), q["id"].to_numpy()
        qn, xn, d = search(np.stack(q["v"].to_list()), query_ids, np.stack(x["v"].to_list()), ids,
                           c[x["cluster"].iloc[0]], rot, k, safety)
        return pd.DataFrame({"query_id": query_ids[qn], "vec_id": ids[xn], "score": d})

    found = (to_rows.groupBy("deal", "cluster", "part").cogroup(to_queries.groupBy("deal", "cluster", "part"))
             .applyInPandas(pair, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def embeddings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)
