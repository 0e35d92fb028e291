"""Exact lexical search over an inverted index whose term lists carry maximum weights per area and block.

Documents are numbered in the order of their heaviest term, so that like documents lie together, and
cut into blocks of ``BLOCK``, which lie in areas of about the square root of the number of documents.
Beside the postings (area, block, term, document, weight) the index keeps the largest weight of every term in
every area.

A query's score in an area or block is at most the sum of its weights times the largest weights there.
The best blocks of the best areas are opened first and give the k-th best score so far; then only areas whose
bound reaches it are looked into, and in them only blocks whose bound does.  Whatever is left out
holds no better document, so the result is that of comparing all pairs.  An area's postings meet the
queries that look into it in one task: block bounds and scores are sums over arrays there, and only
its k best documents for each query leave it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.operators import features as FE
from casework.operators.features import dense_index
from casework.session import written

#: Documents of a block, and of an area at least.
BLOCK, AREA = 8, 256
#: Areas that a query opens before its k-th score is known, and blocks in each of them.
FIRST_AREAS, FIRST_BLOCKS = 2, 24
#: Queries that meet the postings of an area at once.
QUERIES = 2048
#: Scores equal to so many decimals are ties, broken by id.
DECIMALS = 9
#: What a bound may fall short of a score by rounding, and a tie by decimals.
SLACK = 1e-8


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame      # area, block, idx, id, weight
    areas: DataFrame         # idx, area, top: the largest weight of a term in an area


def build(weights: DataFrame, id_col: str = "doc_id", block: int = BLOCK, area: int = AREA) -> LexicalIndex:
    """Index of long-form weights (id, idx, weight), all of them positive."""
    w = weights.select(F.col(id_col).cast("long").alias("id"), "idx", "weight")
    main = w.groupBy("id").agg((-F.max(F.struct("weight", (-F.col("idx")).alias("m")))["m"]).alias("main"))
    number = dense_index(main, ["main", "id"], "lexical-order", "n")
    inside = max(area, math.isqrt(number.count())) // block
    place = number.select("id", F.floor(F.col("n") / block).cast("long").alias("block"))
    at = F.floor(F.col("block") / inside).cast("long").alias("area")
    postings = written(w.join(place, "id").select(at, "block", "idx", "id", "weight"), "lexical-postings")
    areas = written(postings.groupBy("idx", "area").agg(F.max("weight").alias("top")), "lexical-areas")
    return LexicalIndex(postings, areas)


def placed(found: DataFrame) -> DataFrame:
    """Bounds with their place in a query's order, 1 for the highest."""
    part = found.columns[1]
    order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), part)
    return found.withColumn("place", F.row_number().over(order))


def area_bounds(index: LexicalIndex, q: DataFrame) -> DataFrame:
    """(qid, area, bound, place): upper bounds of a query's scores in every area that shares a term with it."""
    found = q.join(index.areas, "idx").groupBy("qid", "area").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    return written(placed(found), "lexical-area-bounds")


def summed(found: np.ndarray, w: np.ndarray, starts: np.ndarray, counts: np.ndarray, at: np.ndarray, x: np.ndarray,
           size: int) -> np.ndarray:
    """For each place below ``size``: the sum of w * x over the entries (``at``, ``x``) of the terms ``found``,
    whose entries begin at ``starts``, ``counts`` of them."""
    n = counts[found]
    entries = np.repeat(starts[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.bincount(at[entries], weights=np.repeat(w, n) * x[entries], minlength=size)


def opened_in_area(k: int, blocks_only: bool):
    """Function of an area's queries (qid, kth, limit, idx, w) and postings (block, idx, id, weight): the k best
    (qid, nid, score) of each query in the blocks it opens, or only these blocks (qid, block).  A query opens the
    ``limit`` blocks of the highest bounds, or, where it has no limit, those whose bound reaches ``kth``."""
    columns = ["qid", "block"] if blocks_only else ["qid", "nid", "score"]

    def run(_key, queries: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(postings):
            postings = postings.sort_values(["idx", "block"], kind="stable")
            idx, x = postings["idx"].to_numpy(), postings["weight"].to_numpy()
            blocks, block = np.unique(postings["block"].to_numpy(), return_inverse=True)
            nids, first, doc = np.unique(postings["id"].to_numpy(), return_index=True, return_inverse=True)
            home = block[first]                                           # the block of each document
            terms, starts = np.unique(idx, return_index=True)
            counts = np.diff(np.append(starts, len(idx)))
            heads = np.flatnonzero(np.r_[True, (idx[1:] != idx[:-1]) | (block[1:] != block[:-1])])
            tops, top_at = np.maximum.reduceat(x, heads), block[heads]      # largest weight of a term in a block
            top_starts = np.searchsorted(idx[heads], terms)
            top_counts = np.diff(np.append(top_starts, len(heads)))
        else:
            queries = queries.iloc[:0]
        for qid, kth, limit, q_idx, q_w in queries[["qid", "kth", "limit", "idx", "w"]].itertuples(index=False):
            found = np.minimum(np.searchsorted(terms, q_idx), len(terms) - 1)
            here = terms[found] == q_idx
            found, w = found[here], np.asarray(q_w)[here]
            bounds = summed(found, w, top_starts, top_counts, top_at, tops, len(blocks))
            if limit:
                wanted = np.zeros(len(blocks), bool)
                wanted[np.argsort(-bounds, kind="stable")[:int(limit)]] = True
            else:
                wanted = bounds >= kth - SLACK
            wanted &= bounds > 0
            if blocks_only:
                out.append(pd.DataFrame({"qid": qid, "block": blocks[wanted]}))
                continue
            score = summed(found, w, starts, counts, doc, x, len(nids))
            hits = np.flatnonzero(wanted[home] & (score > 0))
            if len(hits) > k:
                order = -np.round(score[hits], DECIMALS)
                last = order <= np.partition(order, k - 1)[k - 1]
                hits = hits[last][np.argsort(order[last], kind="stable")[:k]]   # ids ascend: ties to the smaller
            out.append(pd.DataFrame({"qid": qid, "nid": nids[hits], "score": score[hits]}))
        found = [o for o in out if len(o)]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in columns})

    return run


def opened(index: LexicalIndex, q: DataFrame, areas: DataFrame, k: int, blocks_only: bool = False) -> DataFrame:
    """What ``opened_in_area`` finds in the ``areas`` (qid, area, kth, limit) that each query looks into."""
    vectors = q.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("_e"))
    asked = areas.join(vectors, "qid")
    chunks = max(1, -(-q.select("qid").distinct().count() // QUERIES))
    chunk = F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int").alias("chunk")
    asked = asked.select("area", chunk, "qid", "kth", "limit", F.col("_e.idx").alias("idx"), F.col("_e.w").alias("w"))
    postings = index.postings.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    schema = "qid long, block long" if blocks_only else "qid long, nid long, score double"
    return asked.groupBy("area", "chunk").cogroup(postings.groupBy("area", "chunk")).applyInPandas(
        opened_in_area(k, blocks_only), schema)


def scores(index: LexicalIndex, q: DataFrame, opened: DataFrame) -> DataFrame:
    """(qid, nid, score) of all documents that share a term with the query in its ``opened`` blocks (qid, block)."""
    wanted = opened.select("qid", "block").join(q, "qid")
    return (wanted.join(index.postings, ["block", "idx"]).groupBy("qid", F.col("id").alias("nid"))
            .agg(F.sum(F.col("w") * F.col("weight")).alias("score")))


def best(hits: DataFrame, k: int) -> DataFrame:
    """(qid, nid, score, rank): the k best of each query by (score, smaller id)."""
    w = Window.partitionBy("qid").orderBy(F.round("score", DECIMALS).desc(), "nid")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kth_score(hits: DataFrame, k: int) -> DataFrame:
    """(qid, kth): a query's k-th best score so far; 0 where it has fewer hits."""
    return best(hits, k).groupBy("qid").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).select(
        "qid", F.when(F.col("n") >= k, F.col("kth")).otherwise(0.0).alias("kth"))


def reaching(index: LexicalIndex, q: DataFrame, k: int, own) -> tuple[DataFrame, DataFrame]:
    """Hits of the blocks opened first, and (qid, area, kth, limit) of all areas whose bound reaches the k-th score."""
    areas = area_bounds(index, q)
    near = areas.where(F.col("place") <= FIRST_AREAS).select("qid", "area", F.lit(0.0).alias("kth"),
                                                             F.lit(FIRST_BLOCKS).alias("limit"))
    first = written(opened(index, q, near, k + 1).where(own), "lexical-first")         # k + 1: it may be its own
    kth = q.select("qid").distinct().join(kth_score(first, k), "qid", "left").select("qid", F.coalesce("kth", F.lit(0.0)).alias("kth"))
    inside = areas.join(kth, "qid").where(F.col("bound") >= F.col("kth") - SLACK)
    return first, written(inside.select("qid", "area", "kth", F.lit(0).alias("limit")), "lexical-inside")


def open_blocks(index: LexicalIndex, q: DataFrame, k: int, own) -> tuple[DataFrame, DataFrame]:
    """Hits of the blocks opened first, and (qid, block) of all whose bound reaches the k-th score."""
    first, inside = reaching(index, q, k, own)
    return first, written(opened(index, q, inside, k, blocks_only=True), "lexical-rest")


def search(index: LexicalIndex, q_weights: DataFrame, k: int = 5, id_col: str = "doc_id",
           exclude_self: bool = False) -> DataFrame:
    """(qid, nid, score, rank): for every query of long-form weights (id, idx, weight) the k documents of the
    highest inner product, ties (to 9 decimals) to the smaller id; only documents that share a term."""
    q = written(q_weights.select(F.col(id_col).cast("long").alias("qid"), "idx", F.col("weight").alias("w")), "lexical-queries")
    own = F.col("qid") != F.col("nid") if exclude_self else F.lit(True)
    _, inside = reaching(index, q, k, own)
    return best(opened(index, q, inside, k + 1).where(own), k)


def known_weights(counts: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(id, idx, weight): TF-IDF weights of the terms that have a number in ``vocab`` (term, idf, idx); the norms
    are over all terms.  Terms are dropped before the rows of a document meet."""
    w = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    rows = written(counts.join(vocab, "term").select(id_col, "idx", w.alias("w")), "lexical-terms")
    norms = rows.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.where(F.col("idx").isNotNull()).join(norms, id_col).select(id_col, "idx", (F.col("w") / F.col("norm")).alias("weight"))


def search_texts(docs: DataFrame, queries: DataFrame, spec: FE.TermSpec, k: int = 5, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``search`` for a batch of texts: TF-IDF cosine with document frequencies and norms over all terms of
    ``docs``; only terms that some query has are indexed, since no other adds to a score."""
    counts = written(FE.doc_term_counts(docs, id_col, text_col, spec), "term-counts")
    asked = written(FE.doc_term_counts(queries, id_col, text_col, spec), "query-terms")
    number = dense_index(asked.select("term").distinct(), ["term"], "query-vocabulary")
    vocab = FE.fit_vocabulary(counts, docs.count(), None, id_col=id_col, numbered=False).drop("idx")
    vocab = written(vocab.join(number, "term", "left").select("term", "idf", "idx"), "vocabulary")
    of_docs = written(known_weights(counts, vocab, id_col), "lexical-weights")
    of_queries = known_weights(asked, vocab.where(F.col("idx").isNotNull()), id_col)
    return search(build(of_docs, id_col), of_queries, k, id_col)
