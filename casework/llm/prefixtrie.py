"""Prefix trie of conversations with a depth-band rollup.

Turns.  Conversations are ranked without a window over a conversation: rows are sorted by ranges
of (conversation, turn), counted by (range, conversation), and a row's rank is its place in the range
plus the counts of the ranges before, so one conversation may hold any share of all rows.

Nodes.  A node is a prefix of turns and is known by a digest.  Turns are cut into blocks of
``BAND``; the digest of a prefix hashes the digest of its whole blocks with the turns after them,
and the whole blocks are a sequence of digests themselves, treated the same way one level up.
So no task ever sees more than ``BAND`` turns of a conversation, and a conversation of n turns
takes log(n) / log(``BAND``) levels.

Rollup.  A depth band holds ``BAND`` depths from a band root on.  A node explodes only to its
ancestors in its band, which completes the sums of bands; band roots are a trie of their own (one
level up, where they are banded again), and completed band roots explode to the ancestors of
the band above.  Rows grow at most ``BAND``-fold and rounds are the levels, however deep a trie is.

Member lists.  The digest of a node's ends hashes their numbers in order: ranges of (node, number) are
joined to pieces of text where they lie, and only pieces meet in a task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.llm.blocks import spans
from casework.session import written

BAND = 8
#: Digest of the empty prefix.
ROOT = "0" * 32
#: Original turns that a conversation takes from the first of its five, at most: hash modulo HEAD.
FAMILY, HEAD = 5, 9


def ranked(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(conv, rank, x, bytes, range) and (range, conv, n): turns with their number from 1, and how many of a
    conversation a range holds.  Null turns come first; turns of one number are ordered by role and text."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    x = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))
    rows = rows.select("conv", "turn", "role", "text", x.alias("x"), F.octet_length("text").cast("long").alias("bytes"))
    keys = ["conv", "turn", "role", "text"]
    ordered = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                      .select("conv", "x", "bytes", F.monotonically_increasing_id().alias("at"))
                      .withColumn("range", F.shiftright("at", 33)), "trie-turns")
    parts = written(ordered.groupBy("range", "conv").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "trie-parts")
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)   # ranges, not rows
    offsets = parts.select("range", "conv", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = ordered.join(offsets, ["range", "conv"]).select(
        "range", "conv", (F.col("before") + F.col("at") - F.col("first") + 1).alias("rank"), "x", "bytes")
    return out, parts


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
            ) -> tuple[DataFrame, DataFrame]:
    """(conv, i, x, bytes, last), the rebuilt turns from i = 0, and (conv, turns): every conversation and
    its rebuilt length.

    A conversation c takes the first h original turns of c - c % 5, then its own after the first h."""
    rows, parts = ranked(turns, conv, turn, role, text)
    rows = written(rows, "trie-ranked")
    convs = parts.groupBy("conv").agg(F.sum("n").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD
    convs = convs.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(base, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    convs = written(convs.withColumn("turns", F.col("taken") + F.col("own")), "trie-convs")
    end = (F.col("i") + 1 == F.col("turns")).alias("last")
    heads = rows.where(F.col("rank") < HEAD).select(F.col("conv").alias("base"), "rank", "x", "bytes")
    taken = (convs.select("conv", "base", "h", "turns").join(heads, "base").where(F.col("rank") <= F.col("h"))
             .select("conv", (F.col("rank") - 1).alias("i"), "x", "bytes", "turns"))
    own = (rows.select("conv", "rank", "x", "bytes").join(convs.select("conv", "h", "taken", "turns"), "conv")
           .where(F.col("rank") > F.col("h"))
           .select("conv", (F.col("taken") + F.col("rank") - F.col("h") - 1).alias("i"), "x", "bytes", "turns"))
    return taken.unionByName(own).select("conv", "i", "x", "bytes", end), convs.select("conv", "turns")


def prefixes(seq: DataFrame, band: int = BAND) -> list[DataFrame]:
    """Levels of (conv, depth, id, anc, bytes, last): for every element i of a sequence the prefix of
    depth i + 1, with the ids of its ancestors from the band root on.  Level 0 is the sequence's;
    level l + 1 has the prefixes of whole blocks of level l, with the ids that these have there too."""
    q = F.floor(F.col("i") / band).cast("long")
    blocks = written(seq.groupBy("conv", q.alias("q")).agg(
        F.array_sort(F.collect_list(F.struct("i", "x", "bytes", "last"))).alias("xs")), "trie-blocks")
    xs = F.transform("xs", lambda e: e["x"])
    full = blocks.where(F.size("xs") == band).select(
        "conv", F.col("q").alias("i"), F.md5(F.array_join(xs, "")).alias("x"), F.lit(0).cast("long").alias("bytes"),
        F.lit(False).alias("last"))
    above = [] if full.isEmpty() else prefixes(full, band)
    if above:
        done = above[0].select("conv", "depth", "id")
        blocks = blocks.join(done.select("conv", F.col("depth").alias("q"), F.col("id").alias("start")), ["conv", "q"], "left")
        blocks = blocks.join(done.select("conv", (F.col("depth") - 1).alias("q"), F.col("id").alias("end")), ["conv", "q"], "left")
    else:
        blocks = blocks.withColumn("start", F.lit(None).cast("string")).withColumn("end", F.lit(None).cast("string"))
    blocks = blocks.withColumn("start", F.coalesce("start", F.lit(ROOT)))
    def made(r: Column) -> Column:
        whole = F.concat(F.col("start"), F.array_join(F.slice(xs, F.lit(1), r), ""))
        return F.when(r == band, F.col("end")).otherwise(F.md5(whole))

    ids = F.concat(F.array("start"), F.transform(F.sequence(F.lit(1), F.size("xs")), made))
    rows = blocks.withColumn("ids", ids).select("conv", "q", "ids", F.posexplode("xs").alias("r", "e"))
    rows = rows.select("conv", (F.col("q") * band + F.col("r") + 1).alias("depth"), F.get("ids", F.col("r") + 1).alias("id"),
                       F.slice("ids", F.lit(1), F.col("r") + 1).alias("anc"), F.col("e.bytes").alias("bytes"),
                       F.col("e.last").alias("last"))
    return [written(rows, "trie-prefixes"), *above]


def total(rows: DataFrame, sums: list[str]) -> DataFrame:
    return rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in sums])


def rollup(weights: DataFrame, levels: list[DataFrame], sums: list[str], band: int = BAND) -> DataFrame:
    """(id, *sums): for every node the sums over its subtree.

    ``weights``: (id, *sums) of the nodes of ``levels[0]`` and of the root; ``levels``: tables (id, depth, anc)
    of distinct nodes, each the band roots of the one before."""
    inner = levels[0].where(F.col("depth") % band != 0).select("id", "anc")
    carried = weights.join(inner, "id").select(F.explode("anc").alias("id"), *sums)
    inside = total(weights.select("id", *sums).unionByName(carried), sums)
    if len(levels) == 1:
        return written(inside, "trie-sums")
    inside = written(inside, "trie-bands")
    roots = levels[0].where(F.col("depth") % band == 0).select("id", "anc")
    tops = inside.join(roots.select("id"), "id", "left_semi").unionByName(inside.where(F.col("id") == ROOT))
    done = rollup(tops, levels[1:], sums, band)
    down = done.join(roots, "id").select(F.explode("anc").alias("id"), *sums)
    return written(total(inside.unionByName(down), sums), "trie-sums")


_CHUNKS = pa.schema([("id", pa.string()), ("first", pa.int64()), ("chunk", pa.string())])
_ENDS = pa.schema([("id", pa.string()), ("ends_sha256", pa.string())])


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, conv), sorted -> the numbers of each run of a batch as one text."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("id")
        code = ids.dictionary_encode().indices.to_numpy()
        starts, sizes = spans(code)
        numbers = b.column("conv").to_numpy()
        chunks = [",".join(map(str, numbers[s:s + n].tolist())) for s, n in zip(starts, sizes)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), pa.array(numbers[starts]), pa.array(chunks, pa.string())],
                                         schema=_CHUNKS)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, first, chunk), sorted -> sha256 of each id's chunks, holding one chunk at a time."""
    here, digest = None, None
    for b in batches:
        out = []
        for i, chunk in zip(b.column("id").to_pylist(), b.column("chunk")):
            if i != here:
                if here is not None:
                    out.append((here, digest.hexdigest()))
                here, digest = i, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(chunk.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.string()) for j in (0, 1)], schema=_ENDS)
    if here is not None:
        yield pa.RecordBatch.from_arrays([pa.array([here]), pa.array([digest.hexdigest()])], schema=_ENDS)


def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of rows (id, conv): sha256 of an id's numbers, ascending, joined by commas."""
    chunks = (ends.select("id", "conv").repartitionByRange("id", "conv").sortWithinPartitions("id", "conv")
              .mapInArrow(chunked, "id string, first long, chunk string"))
    return chunks.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashed, "id string, ends_sha256 string")


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         band: int = BAND) -> DataFrame:
    """One row for every node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Conversation numbers are integers; rows without one take no part.  A null role or text is
    empty; null turns come first; repeated rows are turns of their own; a conversation that loses
    all turns is a member of the root; an empty table gives an empty result; other columns take
    no part.
    """
    seq, convs = rebuilt(turns, conv, turn, role, text)
    levels = prefixes(seq, band)
    nodes = (levels[0].groupBy("id", "anc", "depth", "bytes").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
             .withColumn("parent", F.element_at("anc", -1)))
    top = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("id"), F.expr("cast(null as array<string>)").alias("anc"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("bytes"), "conv", "n_convs", F.lit(None).cast("string").alias("parent"))
    nodes = written(nodes.unionByName(top), "trie-nodes")
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    weights = written(nodes.join(kids, "id", "left").select(
        "id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "trie-weights")
    distinct = [nodes.where("depth > 0")] + [written(t.groupBy("id", "depth", "anc").agg(F.lit(1)).select("id", "depth", "anc"),
                                                     "trie-level") for t in levels[1:]]
    sums = rollup(weights.select("id", "n_leaves", "saved_tokens"), distinct, ["n_leaves", "saved_tokens"], band)
    ended = levels[0].where("last").select("id", "conv").unionByName(
        convs.where("turns = 0").select(F.lit(ROOT).alias("id"), "conv"))
    digests = end_digests(ended)
    whole = (nodes.join(weights.select("id", "n_children"), "id").join(sums, "id").join(digests, "id", "left"))
    # A child looks up its parent by an equality join with an exchange on both sides, so that
    # adaptive execution can split the children of a hot node.
    whole = written(whole.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                 F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie-whole")
    above = written(nodes.join(kids.select("id"), "id", "left_semi")
                    .select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv_id")), "trie-parents")
    return whole.join(above, "parent", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
