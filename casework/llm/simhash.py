"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: lower-case A-Z, words, w-word shingles (repeats count), XXH64 of each; a bit is
1 if it is set in over half the hashes.  Two fingerprints link at ``max_bits`` or fewer
differing bits.

Search: distinct fingerprints are cut into ``cut`` segments and every choice of ``take`` of
them is indexed with one bit left out in turn ("one-wildcard variants").  ``cut`` and
``take`` are such that some choice differs by at most one bit (checked), so linked
fingerprints share a variant: an equality on (choice, wildcard, remaining bits) finds every
pair.  The default, 3 segments, gives 64 variants a fingerprint and keys of 20 bits; for
billions of fingerprints take 2 of 5 (260 variants, 24 bits).

Within a variant's bucket the fingerprints are compared as arrays in a task, as a
breadth-first walk that takes out what it has reached, and only the links of the walk
leave the task: n - 1 for a group of n copies, not n squared.  A bucket of more than
``BUCKET`` fingerprints is dealt over tasks as pairs of blocks, so that no task holds more
than two blocks and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.blocks import spans, whole_groups
from casework.llm.components import components
from casework.session import written

SEED = 42
BUCKET = 20_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """Fingerprint of one text (unsigned); null and wordless texts: 0."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters, ASCII white space
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    n = max(1, len(w) - words + 1)
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[min(words, len(w)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):                              # a bounded part of the bits at once
        h = np.array([digest(joined[s:e], SEED) for s, e in
                      zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int((total * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4):
    """Column of fingerprints (signed 64-bit) for a text column."""
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return of(F.col(text))


def choices(cut: int, take: int, max_bits: int) -> list[int]:
    """Bit masks of every choice of ``take`` of ``cut`` segments of 64 bits.

    ValueError unless, however ``max_bits`` differing bits fall, some choice has at most one."""
    # Worst case: bits dealt as evenly as possible; the choice takes the emptiest segments.
    even = sorted(max_bits // cut + (i < max_bits % cut) for i in range(cut))
    if sum(even[:take]) > 1:
        raise ValueError(f"{take} of {cut} segments may differ by more than one bit in {max_bits}")
    edges = [round(i * 64 / cut) for i in range(cut + 1)]
    segment = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(cut)]
    return [sum(c) for c in combinations(segment, take)]


def variants(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(key, fp) for every one-wildcard variant of every row of ``fps`` (fp)."""
    cells = [signed(m & ~(1 << b)) for m in masks for b in range(64) if m >> b & 1]
    numbered = F.posexplode(F.array(*[F.lit(c) for c in cells])).alias("n", "mask")
    return (fps.select("fp", numbered)
            .select(F.xxhash64("n", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp"))


def signed(mask: int) -> int:
    return int(np.uint64(mask).view(np.int64))


def large_buckets(fps: DataFrame, masks: list[int], bucket: int) -> DataFrame:
    """(key, blocks) of variants whose bucket may hold more than ``bucket`` fingerprints.

    A variant's bucket is the union of two exact values of its choice, so it is enough to
    count those (a row a choice and fingerprint, combined map-side)."""
    exact = F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("c", "mask")
    many = (fps.select("fp", exact)
            .groupBy("c", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("fp"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket // 2))
    cells, at = [], 0
    for m in masks:
        bits = [b for b in range(64) if m >> b & 1]
        cells.append(F.array(*[F.struct(F.lit(at + i).alias("n"), F.lit(signed(m & ~(1 << b))).alias("mask"))
                               for i, b in enumerate(bits)]))
        at += len(bits)
    cell = F.explode(F.element_at(F.array(*cells), F.col("c") + 1)).alias("cell")
    return (many.select("fp", F.col("n").alias("rows"), cell)
            .groupBy(F.xxhash64("cell.n", F.col("fp").bitwiseAND(F.col("cell.mask"))).alias("key"))
            .agg((F.floor(F.sum("rows") * 2 / bucket) + 1).cast("int").alias("blocks")))


def deal(index: DataFrame, large: DataFrame) -> DataFrame:
    """``index`` (key, fp) with the rows of large buckets copied to pairs of blocks: block i of
    a bucket meets every block j in the part (i, j), each a key of its own."""
    block = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    hot = (index.join(large, "key").withColumn("i", block).withColumn("j", other)
           .select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp"))
    return index.join(large, "key", "left_anti").unionByName(hot)


def _reach(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (positions) of a walk over the fingerprints that spans every component."""
    links, left = [], np.arange(len(fp))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= max_bits
            found = left[near]
            links += [(at, x) for x in found]
            front += found.tolist()
            left = left[~near]
    return links


def bucket_links(max_bits: int):
    """Arrow function: rows (key, fp) sorted by key -> links (a, b), a < b, of each bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    small = 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, fp = table["key"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
            starts, sizes = spans(key)
            out = []
            for d in range(1, small):                            # buckets of up to 8 rows, all at once
                at = starts[(sizes > d) & (sizes <= small)]
                n = sizes[(sizes > d) & (sizes <= small)]
                for k in range(small - d):
                    i = at[n > d + k] + k
                    i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
                    out.append(np.stack([fp[i], fp[i + d]], axis=1))
            for s, n in zip(starts[sizes > small], sizes[sizes > small]):
                group = np.unique(fp[s:s + n])
                links = np.array(_reach(group, max_bits), np.int64).reshape(-1, 2)
                out.append(group[links])
            pairs = np.concatenate(out).view(np.int64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return run


def links(fps: DataFrame, max_bits: int = 4, cut: int = 3, take: int = 1, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints that span every component of them.

    ``fps`` has one row for each fingerprint (fp); it is read more than once."""
    masks = choices(cut, take, max_bits)
    index = variants(fps, masks)
    large = written(large_buckets(fps, masks, bucket), "simhash-large")
    if not large.isEmpty():
        index = deal(index, large)
    found = (index.repartition("key").sortWithinPartitions("key")
             .mapInArrow(bucket_links(max_bits), "a long, b long"))
    return found.distinct()


def groups(rows: DataFrame, first: Column, max_bits: int, cut: int, take: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Components of ``rows`` (fp and the columns of ``first``): (fp, component), one row for each
    fingerprint, and (component, least), the least ``first`` of its rows."""
    fps = written(rows.groupBy("fp").agg(F.min(first).alias("least")), "simhash-fps")
    parts = components(links(fps.select("fp"), max_bits, cut, take, bucket))
    named = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    return named.select("fp", "component"), named.groupBy("component").agg(F.min("least").alias("least"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4,
                    max_bits: int = 4, cut: int = 3, take: int = 1, bucket: int = BUCKET) -> DataFrame:
    """(key, fingerprint, component_id), one row for each row of ``docs``.

    ``fingerprint``: 16 lowercase hex digits; ``component_id``: the smallest key reachable by
    links, itself included.  Null, empty and wordless texts have fingerprint zero, which links
    like any other; a null key never is a component's id unless all its keys are null; repeated
    rows stay; an empty table gives an empty result.
    """
    rows = written(docs.select(F.col(key).alias("key"), fingerprints(docs, text, words).alias("fp")), "simhash")
    named, least = groups(rows, F.col("key"), max_bits, cut, take, bucket)
    ids = named.join(least, "component").select("fp", F.col("least").alias("component_id"))
    return rows.join(ids, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4,
             cut: int = 3, take: int = 1, bucket: int = BUCKET, unique: bool = True) -> DataFrame:
    """One row of ``docs`` for each component: its least by (key, digest of the text), null keys last.

    A row is known by key and digest, so a key may stand in several components and null keys are
    kept apart; of rows equal in both one stays.  With ``unique``, of components whose least rows
    share a key that is not null only one is kept: no key comes twice, but a text may be lost."""
    digest = F.unhex(F.md5(F.col(text)))
    rows = written(docs.select(F.col(key).alias("key"), digest.alias("digest"),
                               fingerprints(docs, text, words).alias("fp")), "simhash")
    first = F.struct(F.col("key").isNull().alias("none"), "key", "digest")
    least = groups(rows, first, max_bits, cut, take, bucket)[1].select("least.key", "least.digest")
    if unique:
        least = (least.where("key is not null").groupBy("key").agg(F.min("digest").alias("digest"))
                 .unionByName(least.where("key is null")))
    least = least.select(F.col("key").alias("__key"), F.col("digest").alias("__digest"))

    def known(key: Column, digest: Column) -> Column:
        return key.eqNullSafe(F.col("__key")) & digest.eqNullSafe(F.col("__digest"))

    kept = written(rows.join(least, known(rows["key"], rows["digest"]))
                   .groupBy("__key", "__digest").agg(F.count(F.lit(1)).alias("__rows")), "simhash-kept")
    again = kept.where("__rows > 1")
    if again.isEmpty():
        return docs.join(kept, known(docs[key], digest), "left_semi")
    once = docs.join(kept.where("__rows = 1"), known(docs[key], digest), "left_semi")
    more = docs.join(again, known(docs[key], digest), "left_semi").withColumn("__digest", digest)
    return once.unionByName(more.dropDuplicates([key, "__digest"]).drop("__digest"))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
