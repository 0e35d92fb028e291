"""Vector best-fit packing of tokenised documents into training sequences.

A document is its token ids and one end id.  One longer than a sequence is cut into pieces
of full length, the first of which may be shorter.  Pieces go, longest first, into the open
sequence that fits best under every capacity: residual tokens, residual documents and
residual attention cost (the sum of squared lengths, what block-diagonal attention costs).
"Best" is the smallest weighted norm of the residual that would be left, or the largest
weighted dot-product of demand and residual; ties go to the sequence opened first.

Pieces are dealt by hash into groups of about ``GROUP`` pieces (so a task holds one
bounded group), each packed on its own; what that costs over one global packing is at most
the last, partly filled sequence of a group.  Only (document, piece, length) and the columns
derived from a piece's ids are shuffled.
"""

from __future__ import annotations

import json
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.session import written

CAPACITY = 2048
GROUP = 8192
SPECIAL = "<|endoftext|>"
WEIGHTS = (1.0, 1e-3, 1e-3)
#: How text is split before merges; the usual pattern of this kind of vocabulary, written so
#: that runs are never tried again at shorter lengths.
SPLIT = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte strings of a byte-level BPE vocabulary, whose tokens spell bytes as printable
    characters: those that print stand for themselves, the others count up from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}


def encoder(path: str):
    """Function text -> token ids as little-endian unsigned 32-bit bytes, for the tokenizer
    file at ``path`` (byte-level BPE whose ids are in the order of its merges).

    The ids are those of the tokenizers library; the same vocabulary runs in tiktoken, at a
    fourth of the time.  Texts that hold a special token go to the library itself."""
    import tiktoken
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    fast = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=byte_ranks(vocabulary), special_tokens={})
    library = Tokenizer.from_file(path)

    def encode(text: str) -> bytes:
        ids = (library.encode(text, add_special_tokens=False).ids if SPECIAL in text
               else fast.encode_ordinary(text))
        return array("I", ids).tobytes()

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; the first may be shorter."""
    first = n - capacity * (math.ceil(n / capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECE = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                   ("length", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """(row, key, piece, start, length, ids) of every document; ``ids`` as little-endian
    unsigned 32-bit bytes, ``row`` a number that tells rows of one key apart."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            columns: list[list] = [[] for _ in PIECE]
            held = 0
            for row, k, t in zip(*(c.to_pylist() for c in batch.columns)):
                ids = (encode(t) if t else b"") + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for c, v in zip(columns, (row, k, n, start, length, ids[4 * start:4 * (start + length)])):
                        c.append(v)
                held += len(ids)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)
                    columns, held = [[] for _ in PIECE], 0
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"),
                       F.col(text).alias("text"))
    return rows.mapInArrow(run, "row long, key long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float,
             rule: str = "norm", weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; every bin keeps all three capacities.

    An item that alone exceeds a capacity raises ValueError."""
    caps = np.array([capacity, max_docs, max_cost], float)
    weights = np.asarray(weights, float)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((n + 1, 3))                      # residuals of the open bins, as shares of the capacities
    number = np.zeros(n + 1, np.int64)               # their bins
    used = np.zeros(n, np.int64)
    opened = live = 0
    least = np.array([1, 1, 1], float) / caps
    slack = 1e-12
    for i in np.argsort(-lengths, kind="stable"):
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size]) / caps
        if (need > 1 + slack).any():
            raise ValueError(f"a piece of {int(size)} tokens exceeds a capacity")
        room = left[:live]
        fits = np.flatnonzero((room[:, 0] >= need[0] - slack) & (room[:, 1] >= need[1] - slack)
                              & (room[:, 2] >= need[2] - slack))
        if len(fits):
            r = room[fits]
            score = (((r - need) ** 2) @ weights) if rule == "norm" else -(r @ (weights * need))
            at = fits[score.argmin()]
        else:
            at = live
            left[at], number[at] = 1.0, opened
            live, opened = live + 1, opened + 1
        b = bins[i] = number[at]
        offsets[i], used[b] = used[b], used[b] + lengths[i]
        left[at] -= need
        if (left[at] < least - slack).any():         # nothing fits any more: close it, keep the order
            left[at:live - 1], number[at:live - 1] = left[at + 1:live], number[at + 1:live]
            live -= 1
    return bins, offsets


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm",
         weights=WEIGHTS, end_id: int = 0, group: int = GROUP,
         columns: dict[str, Column] | None = None) -> DataFrame:
    """Pieces with their place: key, piece, start, length, the ``columns`` (expressions over a
    piece's ``ids``; default: the ids), sequence_id and offset (gapless from 0).

    ``max_docs`` and ``max_cost`` default to what ``capacity`` implies, so that only tokens bind.
    Null and empty texts are a piece of the end id; rows that share a key are packed each; a
    null key stays null; an empty table gives an empty result.  Keys are integers.  ``rule``:
    "norm" or "dot".
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    max_docs = capacity if max_docs is None else max_docs
    max_cost = float(capacity) ** 2 if max_cost is None else float(max_cost)
    columns = {"ids": F.col("ids")} if columns is None else columns
    cut_up = written(pieces(docs, key, text, path, capacity, end_id).select(
        "row", "key", "piece", "start", "length", *[c.alias(n) for n, c in columns.items()]), "pieces")
    groups = max(1, math.ceil(cut_up.count() / group))
    number = F.pmod(F.xxhash64("row", "piece"), F.lit(groups))

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["row", "piece"])
        bins, offsets = best_fit(g["length"].to_numpy(), capacity, max_docs, max_cost, rule, weights)
        return pd.DataFrame({"row": g["row"], "piece": g["piece"], "sequence_id": g["group"] * (1 << 32) + bins,
                             "offset": offsets})

    placed = (cut_up.select("row", "piece", "length", number.alias("group"))
              .groupBy("group").applyInPandas(place, "row long, piece int, sequence_id long, offset long"))
    return cut_up.join(placed, ["row", "piece"]).select(
        F.col("key").alias(key), "piece", "start", "length", *columns, "sequence_id", "offset")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


def packed(docs: DataFrame, path: str) -> DataFrame:
    """``pack`` with a checksum in place of the ids."""
    return pack(docs, path, columns={"ids_crc32": F.crc32("ids")})
