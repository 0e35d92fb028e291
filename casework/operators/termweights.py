"""TF-IDF weights over an uncapped vocabulary without a row for each document and term in a shuffle.

Documents go in chunks: compressed boxes of their ids and tokens, written once.

1. A chunk sends each of its distinct terms as a 96-bit digest with the number of its documents that have it, many
   terms of one part of the digests in a row.
2. A part adds up the document frequencies and sends each chunk its own back, in the chunk's order.
3. A chunk meets its frequencies and gives its weights.

Terms themselves are never shuffled but in the boxes.  Rows that share an id are counted together first, as rows
(id, term, count), and their norms are a window over them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from casework.operators import features as FE
from casework.session import written

#: Bytes of tokens in a chunk, weights that leave a task at once, and parts of the digests for each shuffle partition.
CHUNK, ROWS, PARTS = 2 << 20, 1 << 16, 4
_SENT = "part int, chunk long, high binary, low binary, n binary"


def _spans(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: rows -> (chunk, box), about ``CHUNK`` bytes of rows in a compressed box."""
    task, n = TaskContext.get(), 0
    first = task.partitionId() << 33 if task else 0

    def box(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, some[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            for b in some:
                to.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                          ["chunk", "box"])

    some, size = [], 0
    for batch in batches:
        step = max(1, len(batch) * CHUNK // max(CHUNK, batch.nbytes))
        for at in range(0, len(batch), step):
            some.append(batch.slice(at, step))
            size += some[-1].nbytes
            if size >= CHUNK:
                yield box(some)
                some, size, n = [], 0, n + 1
    if some:
        yield box(some)


def counted(box: bytes, bigrams: bool) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, distinct terms, and of each pair of an id's place and a term's place how often it is."""
    rows = pa.ipc.open_stream(box).read_all().combine_chunks()
    ids = rows["id"].combine_chunks()
    if "tf" in rows.column_names:
        term = rows["term"].combine_chunks().dictionary_encode()
        return (ids, term.dictionary, np.arange(len(ids)), term.indices.to_numpy().astype(np.int64), rows["tf"].to_numpy())
    split = pc.split_pattern(pc.fill_null(rows["toks"].combine_chunks(), ""), " ")
    of, token = pc.list_parent_indices(split).to_numpy().astype(np.int64), pc.list_flatten(split)
    told = pc.not_equal(token, "").to_numpy(zero_copy_only=False)
    of, token = of[told], token.filter(pa.array(told)).dictionary_encode()
    terms, code = token.dictionary, token.indices.to_numpy().astype(np.int64)
    if bigrams:
        v = max(1, len(terms))
        next_to = of[1:] == of[:-1]
        pairs, pair = np.unique((code[:-1] * v + code[1:])[next_to], return_inverse=True)
        two = pc.binary_join_element_wise(terms.take(pa.array(pairs // v)), terms.take(pa.array(pairs % v)), " ")
        code, of = np.concatenate((code, len(terms) + pair)), np.concatenate((of, of[:-1][next_to]))
        terms = pa.concat_arrays([terms, two])
    both, tf = np.unique(of * max(1, len(terms)) + code, return_counts=True)
    return ids, terms, both // max(1, len(terms)), both % max(1, len(terms)), tf


def digests(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 and 32 bits of each term's digest, and the order of the digests."""
    raw, terms = bytearray(), terms.cast(pa.binary())
    for s in range(0, len(terms), ROWS):
        raw += b"".join([md5(t, usedforsecurity=False).digest() for t in terms.slice(s, ROWS).to_numpy(zero_copy_only=False).tolist()])
    raw = np.frombuffer(raw, np.uint8).reshape(-1, 16)
    high, low = raw[:, :8].copy().view(np.uint64).reshape(-1), raw[:, 8:12].copy().view(np.uint32).reshape(-1)
    return high, low, np.lexsort((low, high))


def sent(bigrams: bool, parts: int) -> Callable:
    """Arrow function: (chunk, box) -> (part, chunk, high, low, n): a chunk's terms, in the order of their digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, box in zip(batch.column("chunk").to_pylist(), batch.column("box")):
                _, terms, _, code, _ = counted(box.as_py(), bigrams)
                high, low, order = digests(terms)
                n = np.bincount(code, minlength=len(terms)).astype(np.uint32)[order]
                high, low = high[order], low[order]
                part = ((high >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                starts, sizes = _spans(part)
                cut = [pa.array([a[s:s + m].tobytes() for s, m in zip(starts.tolist(), sizes.tolist())], pa.binary())
                       for a in (high, low, n)]
                yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(np.full(len(starts), chunk, np.int64)), *cut],
                                                 ["part", "chunk", "high", "low", "n"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """All rows of one key, from batches sorted by ``key``."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        for s, m in zip(*(a.tolist() for a in _spans(batch.column(key).to_numpy(zero_copy_only=False)))):
            some = batch.slice(s, m)
            if kept and kept[0].column(key)[0].as_py() != some.column(key)[0].as_py():
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(some)
    if kept:
        yield pa.Table.from_batches(kept)


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: ``sent`` rows sorted by part -> (part, chunk, df): the corpus's frequencies of a chunk's terms."""
    for table in _groups(batches, "part"):
        high, low, n = (np.concatenate([np.frombuffer(b, kind) for b in table[c].to_pylist()])
                        for c, kind in (("high", np.uint64), ("low", np.uint32), ("n", np.uint32)))
        sizes = np.array([len(b) // 4 for b in table["n"].to_pylist()])
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        fresh = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(fresh))
        df = np.empty(len(order), np.int64)
        df[order] = total[np.cumsum(fresh) - 1]
        boxes = [a.tobytes() for a in np.split(df, np.cumsum(sizes)[:-1])]
        yield pa.RecordBatch.from_arrays([table["part"].combine_chunks(), table["chunk"].combine_chunks(),
                                          pa.array(boxes, pa.binary())], ["part", "chunk", "df"])


def weighed(bigrams: bool, n_docs: int, whole: bool, names: list[str]) -> Callable:
    """Arrow function: a chunk's box and its frequencies, sorted by chunk and part -> (id, term, weight), normalised
    where an id's terms are ``whole`` in its chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "chunk"):
            ids, terms, doc, code, tf = counted(table["box"].drop_null()[0].as_py(), bigrams)
            if not len(terms):
                continue
            df = np.empty(len(terms))
            df[digests(terms)[2]] = np.concatenate([np.frombuffer(b, np.int64) for b in table["df"].drop_null().to_pylist()])
            w = (1.0 + np.log(tf.astype(float))) * (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0)[code]
            if whole:
                w /= np.sqrt(np.bincount(doc, w * w, len(ids)))[doc]
            for s in range(0, len(w), ROWS):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[s:s + ROWS])), terms.take(pa.array(code[s:s + ROWS])),
                                                  pa.array(w[s:s + ROWS])], names)

    return run


def corpus_weights(docs: DataFrame, id_col: str, text_col: str, spec: FE.TermSpec) -> DataFrame:
    """(id, term, weight): the weights of ``features.corpus_tfidf`` over all terms."""
    n_docs, many = docs.count(), FE.repeated_ids(docs, id_col)
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs if many is None else FE.by_id(docs, many, id_col, "left_anti")
    rows = own.select(F.col(id_col).alias("id"), F.array_join(spec.tokens(text_col), " ").alias("toks"))
    if many is None:
        return _weights(rows, id_col, spec, n_docs, parts, None)[0]
    shared = (FE.row_term_counts(FE.by_id(docs, many, id_col, "left_semi"), id_col, text_col, spec)
              .groupBy(F.col(id_col).alias("id"), "term").agg(F.sum("tf").cast("long").alias("tf")))
    alone, together = _weights(rows, id_col, spec, n_docs, parts, shared)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id_col)))
    return alone.unionByName(together.withColumn("weight", F.col("weight") / norm))


def _weights(rows: DataFrame, id_col: str, spec: FE.TermSpec, n_docs: int, parts: int,
             shared: DataFrame | None) -> list[DataFrame]:
    """Weights of rows (id, toks), and those of rows (id, term, tf) before they are normalised."""
    kinds = [rows] if shared is None else [rows, shared]
    chunks = [written(k.mapInArrow(chunked, "chunk long, box binary"), "term-chunks") for k in kinds]
    # Written, so that the digests are gone before the chunks travel.
    dfs = None
    for kind, c in enumerate(chunks):
        s = c.mapInArrow(sent(spec.bigrams, parts), _SENT).withColumn("chunk", F.col("chunk") * len(kinds) + kind)
        dfs = s if dfs is None else dfs.unionByName(s)
    dfs = written(dfs.repartition("part").sortWithinPartitions("part").mapInArrow(
        frequencies, "part int, chunk long, df binary"), "term-frequencies")
    schema = StructType().add(id_col, rows.schema["id"].dataType).add("term", StringType()).add("weight", DoubleType())
    out = []
    for kind, c in enumerate(chunks):
        box = c.select(F.lit(-1).alias("part"), "chunk", "box", F.lit(None).cast("binary").alias("df"))
        back = dfs.where(F.pmod("chunk", F.lit(len(kinds))) == kind).select(
            "part", F.expr(f"chunk div {len(kinds)}").alias("chunk"), F.lit(None).cast("binary").alias("box"), "df")
        met = box.unionByName(back).repartition("chunk").sortWithinPartitions("chunk", "part")
        out.append(met.mapInArrow(weighed(spec.bigrams, n_docs, kind == 0, schema.names), schema))
    return out
