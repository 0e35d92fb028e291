"""Similar-case retrieval: exact top-k of dense vectors by inner product (cosine on unit
vectors), plus the case-index snapshot (``lexical`` has the search by terms).

Exact all-pairs scoring without materialising pairs: both sides are hashed
into blocks, each query row is replicated once per index block and each index
row once per query block, and ``cogroup`` hands every (query block, index
block) pair to one task that does a single matrix multiply and keeps only a
per-query top-k.  No cross join, no pair rows, and per-task memory is bounded
by the block sizes (parameters), not by the data.  A final top-k across index
blocks runs over at most ``k x index_blocks`` candidates per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.functions import text as T
from casework.session import read_if_present

HIT_SCHEMA = "qid long, nid long, score double, rank int"
RANK_DECIMALS = 9
#: Scores that a task holds at once.
SCORES = 1 << 21


def _blocks(n: int, rows_per_block: int) -> int:
    return max(1, int(math.ceil(n / max(rows_per_block, 1))))


def _block_of(col: str, n_blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n_blocks)).cast("int")


def _top_rows(S: np.ndarray, qids: np.ndarray, nids: np.ndarray, k: int) -> pd.DataFrame:
    """Per row of ``S``: the k best columns by (score desc, id asc); -inf entries are never returned."""
    out_q, out_n, out_s, out_r = [], [], [], []
    n = S.shape[1]
    if n == 0:
        return _empty()
    kk = min(k, n)
    # scores equal to 9 decimals are ties (broken by id): summation order must not decide ranks
    S = np.round(S, RANK_DECIMALS)
    part = np.argpartition(-S, kk - 1, axis=1)[:, :kk]
    kth = np.take_along_axis(S, part, axis=1).min(axis=1)
    for r in range(S.shape[0]):
        cand = np.nonzero(S[r] >= kth[r])[0]
        cand = cand[np.isfinite(S[r, cand])]
        order = np.lexsort((nids[cand], -S[r, cand]))[:kk]
        sel = cand[order]
        out_q.append(np.full(len(sel), qids[r], dtype="int64"))
        out_n.append(nids[sel])
        out_s.append(S[r, sel])
        out_r.append(np.arange(1, len(sel) + 1, dtype="int32"))
    if not out_q:
        return _empty()
    return pd.DataFrame({"qid": np.concatenate(out_q), "nid": np.concatenate(out_n).astype("int64"),
                         "score": np.concatenate(out_s).astype("float64"),
                         "rank": np.concatenate(out_r).astype("int32")})


def _empty() -> pd.DataFrame:
    return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "nid": pd.Series([], dtype="int64"),
                         "score": pd.Series([], dtype="float64"), "rank": pd.Series([], dtype="int32")})


def _dense_scorer(k: int, exclude_self: bool, positive_only: bool) -> Callable:
    def score(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or ipdf.empty:
            return _empty()
        Q = np.stack(qpdf["v"].to_numpy()).astype("float64")
        X = np.stack(ipdf["v"].to_numpy()).astype("float64")
        all_qids, nids = qpdf["qid"].to_numpy("int64"), ipdf["nid"].to_numpy("int64")
        out, step = [], max(1, SCORES // len(X))
        for at in range(0, len(Q), step):
            S, qids = Q[at:at + step] @ X.T, all_qids[at:at + step]
            if exclude_self:
                S[qids[:, None] == nids[None, :]] = -np.inf
            if positive_only:
                S[S <= 0] = -np.inf
            out.append(_top_rows(S, qids, nids, k))
        return pd.concat(out, ignore_index=True)
    return score


def _cogroup_topk(q: DataFrame, x: DataFrame, n_qb: int, n_ib: int, scorer: Callable, k: int) -> DataFrame:
    q = q.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_ib - 1))))
    x = x.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))))

    def run(_key, qpdf, ipdf):
        return scorer(qpdf, ipdf)

    hits = q.groupBy("qb", "ib").cogroup(x.groupBy("qb", "ib")).applyInPandas(run, HIT_SCHEMA)
    if n_ib == 1:
        return hits        # each query met the whole index in one task: already final
    # merge per-block winners: at most k x index_blocks candidates per query
    w = Window.partitionBy("qid").orderBy(F.round("score", RANK_DECIMALS).desc(), F.col("nid"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_dense(queries: DataFrame, index: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "vector",
               exclude_self: bool = False, q_block_rows: int = 4096, i_block_rows: int = 16384) -> DataFrame:
    """(qid, nid, score, rank): exact top-k neighbours by inner product."""
    nq, ni = queries.count(), index.count()
    n_qb, n_ib = _blocks(nq, q_block_rows), _blocks(ni, i_block_rows)
    q = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vec_col).alias("v")) \
               .withColumn("qb", _block_of("qid", n_qb))
    x = index.select(F.col(id_col).cast("long").alias("nid"), F.col(vec_col).alias("v")) \
             .withColumn("ib", _block_of("nid", n_ib))
    return _cogroup_topk(q, x, n_qb, n_ib, _dense_scorer(k, exclude_self, False), k)


def score_against(index: DataFrame, query_vec: list[float], id_col: str = "id", vec_col: str = "vector") -> F.Column:
    """Inner product with one known vector as an unrolled column expression (codegen, no lambda)."""
    v = F.col(vec_col)
    terms = [v.getItem(i).cast("double") * F.lit(float(x)) for i, x in enumerate(query_vec)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def similar_to_one(index: DataFrame, case_id, k: int = 5, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Top-k for one case: its vector is looked up (one row), then every index
    row is scored by a projection and a bounded ``TakeOrdered``.  An unknown
    id gives an empty result."""
    row = index.where(F.col(id_col) == F.lit(case_id)).select(vec_col).limit(1).collect()
    if not row:
        return index.limit(0).select(F.col(id_col).alias("nid"), F.lit(0.0).alias("score"))
    qv = [float(x) for x in row[0][0]]
    scored = index.where(F.col(id_col) != F.lit(case_id)).withColumn("score", score_against(index, qv, id_col, vec_col))
    return scored.orderBy(F.round("score", RANK_DECIMALS).desc(), F.col(id_col)).limit(k)


# -- built-in embedder (R1) ----------------------------------------------------------------

def hashed_embedding_long(docs: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, dim_idx, value): token counts hashed into ``dim`` buckets by md5,
    sublinear weight ``1 + ln(count)``, L2-normalised.  Whole text, counted where it is read."""
    tok = docs.select(id_col, F.explode_outer(T.tokens(text_col)).alias("t")).where(F.col("t").isNotNull())
    b = F.pmod(F.conv(F.substring(F.md5(F.col("t")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    c = tok.groupBy(id_col, b.alias("dim_idx")).agg(F.count(F.lit(1)).alias("n"))
    w = F.lit(1.0) + F.log(F.col("n").cast("double"))
    c = c.withColumn("_w", w)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return c.select(id_col, "dim_idx", (F.col("_w") / norm).alias("value"))


def to_dense(long: DataFrame, id_col: str, dim: int, out_col: str = "vector", kind: str = "float") -> DataFrame:
    """Long (id, dim_idx, value) -> (id, array of ``kind``, of length dim)."""
    g = long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim_idx", "value"))).alias("_m"))
    return g.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                        lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)).cast(kind))
                    .alias(out_col))


def row_vector(text_col: str, dim: int = 64) -> F.Column:
    """The built-in embedding of one text as an array of ``dim`` doubles, made in its row: what ``hashed_embedding_long``
    and ``to_dense`` come to where every row has an id of its own.  A text without tokens gives zeros."""
    hashed = F.transform(T.tokens(text_col), lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))

    @F.pandas_udf("array<double>")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            rows = [np.zeros(0, np.int32) if h is None else np.asarray(h) for h in hashes]
            n = np.stack([np.bincount(h, minlength=dim) for h in rows]).astype(float) if rows else np.zeros((0, dim))
            w = np.where(n > 0, 1.0 + np.log(np.maximum(n, 1.0)), 0.0)
            norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
            yield pd.Series(list(np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)))

    return weigh(hashed)


def embed_with(df: DataFrame, id_col: str, text_col: str, embedder_factory: Callable, dim: int,
               batch_size: int = 64) -> DataFrame:
    """Plug-in embedder: ``embedder_factory()`` -> ``f(list[str]) -> ndarray (n, dim)``,
    built once per task; rows are L2-normalised.  Arrow batches, no per-row calls."""
    def run(batches):
        f = embedder_factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            vecs = []
            for s in range(0, len(texts), batch_size):
                vecs.append(np.asarray(f(texts[s:s + batch_size]), dtype="float64").reshape(-1, dim))
            m = np.vstack(vecs) if vecs else np.zeros((0, dim))
            nrm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, nrm, out=np.zeros_like(m), where=nrm > 0)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "vector": list(m.astype("float32"))})
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, vector array<float>"
    return df.select(id_col, text_col).mapInPandas(run, schema)


# -- case index (R2, R6, R7, S5, S11, O4, P8) ----------------------------------------------------

SNIPPET_CHARS = 200


def index_rows(cases: DataFrame, newest_n: int | None = None) -> DataFrame:
    """Index metadata and whole text of every case with a text; ``newest_n`` asks for the
    newest that many only.  ``snippet`` is for display."""
    c = cases.where(F.col("complaint_text").isNotNull())
    if newest_n:
        from casework.operators.cases import newest
        c = newest(c, newest_n, "created_at", "id")
    blank = lambda x, d: F.coalesce(F.when(F.col(x) != "", F.col(x)), F.lit(d))
    out = c.select("id", "case_id", blank("category", "").alias("category"),
                   blank("severity", "").alias("severity"), blank("emotion", "").alias("emotion"),
                   blank("status", "open").alias("status"),
                   T.truncate("complaint_text", SNIPPET_CHARS).alias("snippet"), "complaint_text", "created_at")
    return out


def build_index(rows: DataFrame, dim: int = 64, kind: str = "float") -> DataFrame:
    """Metadata + built-in embedding (rows without tokens get a zero vector)."""
    vec = to_dense(hashed_embedding_long(rows, "case_id", "complaint_text", dim), "case_id", dim, kind=kind)
    zero = F.array_repeat(F.lit(0.0).cast(kind), dim)
    return (rows.join(vec, "case_id", "left")
                .withColumn("vector", F.coalesce(F.col("vector"), zero)))


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    index.write.mode(mode).parquet(path)


def load_or_build(spark, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Saved snapshot, or a new one where there is none; any other read error is raised."""
    df = read_if_present(spark, path)
    if df is not None:
        return df
    write_index(build(), path)
    return spark.read.parquet(path)
