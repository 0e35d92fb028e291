"""Fuzzy line deduplication by MinHash.

Lines are compared in lower case, without white space around them, as sets of ``shingle``
characters in a row (a shorter line is one shingle); blank lines take no part.  Lines link
at a Jaccard similarity of ``similarity`` or more; of each component of links one line stays,
the first by (document, line number).

1. Equal lines are grouped by a 128-bit digest (an aggregate, combined map-side).
2. Every line gets ``BANDS`` x ``ROWS`` minima; lines that agree on all of a band's minima are
   candidates.  With 20 bands of 5 rows a pair at similarity 0.8 is found with probability
   0.9996, one at 0.85 with 0.99999.  A band travels as its key and the line's 64-bit handle, many
   bands of one part of the keys in a row.  Texts travel twice, to their handle and to their buckets,
   in compressed boxes of many lines of one part of the handles or buckets.
3. Buckets with the same first and last handle are merged, and each is verified in a task:
   pairs that a bound on the similarity leaves are compared as exact shingle sets; in larger
   buckets a walk takes out the lines it has reached, and only the links of the walk leave the
   task.  Still larger buckets are dealt as pairs of blocks.
4. The links' components come from ``components``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from casework.llm.blocks import spans, whole_groups
from casework.llm.components import components
from casework.session import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Code points whose shingles are hashed at once.
CHUNK = 1 << 17
#: Groups up to this size are compared pair by pair, larger ones as a walk.
FEW = 30
#: Bits of a line's sketch, from which the similarity of a pair is bounded.
SKETCH = 2048
#: Code points that a line counts for at least where lines are compared ``CHUNK`` at a time.
SHORT = 64
#: Bytes of text that are split into lines at once.
SPLIT = 8 << 20
#: Lines whose bands go out together, and parts of the band keys for each shuffle partition.
DEALT, PARTS = 1 << 16, 8
#: Bytes of rows that go out together, boxed.
BOXED = 32 << 20
#: Lines of a bucket that one task compares.
BUCKET = 2000
_SEED = 42


def split_lines(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(text's place, line number, line without white space around it) of lower-case texts, some texts
    at a time.  A null text is one blank line."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + SPLIT, side="right")))
        split = pc.split_pattern(pc.fill_null(texts.slice(first, last - first), ""), "\n")
        of = pc.list_parent_indices(split).to_numpy().astype(np.int64)
        number = np.arange(len(of)) - np.searchsorted(of, of)
        yield of + first, number.astype(np.int32), pc.ascii_trim(pc.list_flatten(split), " \t\r\x0b\x0c")
        first = last


def objects(column: pa.Array) -> list:
    """``to_pylist`` for texts and bytes, in a third of the time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def digests(norm: pa.Array) -> list[bytes]:
    return [md5(line, usedforsecurity=False).digest() for line in objects(norm.cast(pa.binary()))]


def handles(keys: list[bytes]) -> np.ndarray:
    """64-bit handles of lines, from their digests."""
    return np.frombuffer(b"".join(keys), np.int64)[::2]


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: (key, version, low) -> (key, version, line_no, line_key), null for a blank line."""
    for batch in batches:
        for of, number, norm in split_lines(batch.column("low")):
            blank = pc.equal(norm, "").to_numpy(zero_copy_only=False)
            line_key = [None if no else d for no, d in zip(blank.tolist(), digests(norm))]
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("version").take(at), pa.array(number),
                                              pa.array(line_key, pa.binary())], ["key", "version", "line_no", "line_key"])


def handled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: (low) -> (h, line_key, norm) of the lines that are not blank, equal ones of some texts once, so that a
    line of many documents is no heap of rows where handles meet."""
    for batch in batches:
        for _, _, norm in split_lines(batch.column("low")):
            norm = norm.filter(pc.not_equal(norm, ""))
            line_key = digests(norm)
            h, at = np.unique(handles(line_key), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([line_key[i] for i in at.tolist()], pa.binary()),
                                              norm.take(pa.array(at))], ["h", "line_key", "norm"])


def boxed(rows: Iterable[pa.RecordBatch], key: str, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, box): the rows of each part of the 64-bit numbers ``key``, about ``BOXED`` bytes of rows together,
    as one compressed Arrow stream."""
    def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some).combine_chunks()
        part = ((table[key].to_numpy().view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        starts, sizes = spans(part[order])
        table, out = table.take(pa.array(order)).combine_chunks(), []
        for s, n in zip(starts.tolist(), sizes.tolist()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(table.slice(s, n))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(part[order][starts]), pa.array(out, pa.binary())], ["part", "box"])

    some, size = [], 0
    for batch in rows:
        if len(batch):
            some.append(batch)
            size += batch.nbytes
        if size >= BOXED:
            yield packed(some)
            some, size = [], 0
    if some:
        yield packed(some)


def unboxed(boxes: pa.ChunkedArray) -> pa.Table:
    """The rows of some boxes."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in boxes.to_pylist()])


def by_handle(parts: int) -> Callable:
    """Arrow function: (low) -> (part, box, pairs): boxes of lines by part of their handles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in boxed(handled(batches), "h", parts):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.binary())], ["part", "box", "pairs"])

    return run


def pairs_by_handle(parts: int) -> Callable:
    """Arrow function: (gid, h) -> (part, box, pairs): the same boxes for the lines of buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in boxed(batches, "h", parts):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(len(b), pa.binary()), b.column(1)], ["part", "box", "pairs"])

    return run


def bucketed(parts: int) -> Callable:
    """Arrow function: boxes sorted by part -> (part, box): every line of a bucket with its text, boxed by part
    of the buckets.  A line stands once in a bucket."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            for s, n in zip(*(a.tolist() for a in spans(table["part"].to_numpy()))):
                boxes, pairs = (table[c].slice(s, n).drop_null() for c in ("box", "pairs"))
                if not len(boxes) or not len(pairs):
                    continue
                pairs = unboxed(pairs).sort_by("h").combine_chunks()
                asked = pairs["h"].to_numpy()
                texts = []
                for box in boxes.to_pylist():
                    rows = pa.ipc.open_stream(box).read_all()
                    at = np.searchsorted(asked, h := rows["h"].to_numpy())
                    texts.append(rows.filter(pa.array(asked[np.minimum(at, len(asked) - 1)] == h)))
                texts = pa.concat_tables(texts).combine_chunks()
                if not len(texts):
                    continue
                keys = np.array(objects(texts["line_key"].combine_chunks()), object)
                texts = texts.take(pa.array(np.unique(keys, return_index=True)[1]))       # equal lines once
                h = texts["h"].to_numpy()
                first, last = np.searchsorted(asked, h), np.searchsorted(asked, h, side="right")
                n_gids = last - first
                at = np.repeat(first - (np.cumsum(n_gids) - n_gids), n_gids) + np.arange(n_gids.sum())
                gids, of = pairs["gid"].to_numpy()[at], np.repeat(np.arange(len(h)), n_gids)
                size = max(1, len(of) * BOXED // max(1, BOXED, int(np.repeat(
                    pc.binary_length(texts["norm"]).to_numpy(), n_gids).sum())))          # rows of about ``BOXED`` bytes
                for i in range(0, len(of), size):
                    some = texts.take(pa.array(of[i:i + size]))
                    yield pa.RecordBatch.from_arrays([pa.array(gids[i:i + size]), some["line_key"].combine_chunks(),
                                                      some["norm"].combine_chunks()], ["gid", "line_key", "norm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return boxed(joined(batches), "gid", parts)

    return run


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, version, line_no, line_key): lines of every document; ``version`` tells texts of one key
    apart, ``line_key`` is the digest of the line as it is compared, null for a blank one."""
    schema = StructType().add("key", docs.schema[key].dataType).add("version", LongType()) \
        .add("line_no", IntegerType()).add("line_key", BinaryType())
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("version"),
                       F.lower(text).alias("low")).mapInArrow(keyed, schema)


def hashed(texts: list[str], sizes: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of texts of ``sizes`` code points, one text after the other, where
    each text begins and how many it has."""
    padded = np.maximum(sizes, shingle)
    chars = "".join(t.ljust(shingle, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(chars, np.uint32).astype(np.uint64)
    m = len(points) - shingle + 1
    code = np.zeros(m, np.uint64)
    for j in range(shingle):
        code *= np.uint64(0x100000001B3)
        code += points[j:j + m]
    code ^= code >> np.uint64(31)
    code *= np.uint64(0x9E3779B97F4A7C15)
    x = (code >> np.uint64(32)).astype(np.uint32)
    counts = padded - shingle + 1                              # shingles of each line
    begin = np.cumsum(padded) - padded
    keep = np.ones(len(x) + shingle, bool)                     # without those that run over a line's end
    for j in range(1, shingle):
        keep[(begin + counts + j - 1)[:-1]] = False
    return x[keep[:len(x)]], np.cumsum(counts) - counts, counts


def band_keys(texts: list[str], sizes: np.ndarray, bands: int, rows: int, shingle: int) -> np.ndarray:
    """bands x lines array of 64-bit band keys.  ``sizes``: lengths of the texts, in code points."""
    rng = np.random.default_rng(_SEED)
    factor = rng.integers(1 << 31, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    out = np.empty((bands, len(texts)), np.uint64)
    padded = np.maximum(sizes, shingle)
    ends = np.cumsum(padded)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, side="right")))
        x, starts, _ = hashed(texts[first:last], sizes[first:last], shingle)
        y, least = np.empty_like(x), np.empty((bands, rows, last - first), np.uint32)
        for r, minima in enumerate(least.reshape(bands * rows, -1)):
            np.multiply(x, factor[r], out=y)
            np.add(y, shift[r], out=y)
            np.minimum.reduceat(y, starts, out=minima)
        key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], last - first, axis=1)
        for r in range(rows):
            key ^= least[:, r]
            key *= np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, first:last] = key
        first = last
    return out


def banded(bands: int, rows: int, shingle: int, parts: int):
    """Arrow function: (low) -> (part, keys, handles), the bands of about ``DEALT`` lines in a row for
    each part of the band keys: 32 bits of each key, 64 bits of each handle."""
    names = ["part", "keys", "handles"]

    def packed(some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = np.concatenate([k.reshape(-1) for k, _ in some])
        h = np.concatenate([np.tile(h, bands) for _, h in some])
        part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        starts, sizes = spans(part[order])
        low, h = keys.astype(np.uint32)[order].tobytes(), h[order].tobytes()
        return pa.RecordBatch.from_arrays([
            pa.array(part[order][starts]),
            pa.array([low[4 * s:4 * (s + n)] for s, n in zip(starts.tolist(), sizes.tolist())], pa.binary()),
            pa.array([h[8 * s:8 * (s + n)] for s, n in zip(starts.tolist(), sizes.tolist())], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for batch in batches:
            for _, _, norm in split_lines(batch.column("low")):
                norm = norm.filter(pc.not_equal(norm, ""))
                h, at = np.unique(handles(digests(norm)), return_index=True)
                if not len(h):
                    continue
                for s in range(0, len(h), DEALT):
                    each = norm.take(pa.array(at[s:s + DEALT]))
                    sizes = pc.utf8_length(each).to_numpy().astype(np.int64)
                    some.append((band_keys(objects(each), sizes, bands, rows, shingle), h[s:s + DEALT]))
                    n += len(each)
                    if n >= DEALT:
                        yield packed(some)
                        some, n = [], 0
        if some:
            yield packed(some)

    return run


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: rows (part, keys, handles) sorted by part -> (x, y, h): every handle of a bucket
    of different handles, with the bucket's first and last."""
    for table in whole_groups(batches, "part"):
        for s, n in zip(*(a.tolist() for a in spans(table["part"].to_numpy()))):
            key = np.frombuffer(b"".join(table["keys"].slice(s, n).to_pylist()), np.uint32)
            h = np.frombuffer(b"".join(table["handles"].slice(s, n).to_pylist()), np.int64)
            order = np.argsort(key)
            starts, sizes = spans(key[order])
            if len(starts) == len(key):
                continue
            h = h[order][np.repeat(sizes > 1, sizes)]
            sizes = sizes[sizes > 1]
            starts = np.cumsum(sizes) - sizes
            x, y = np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts)
            several = np.repeat(x != y, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, sizes)[several]), pa.array(np.repeat(y, sizes)[several]),
                                              pa.array(h[several])], ["x", "y", "h"])


def numbered(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted numbers, one text after the other, and how many each
    has.  Within a call numbers are equal where shingles are, and only there."""
    lengths = np.array([len(t) for t in texts], np.int64)
    padded = np.maximum(lengths, size)
    points = np.frombuffer("".join(t.ljust(size, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.flatnonzero(np.bincount(points))
    rank = np.zeros(int(used[-1]) + 1, np.uint64)
    rank[used] = np.arange(len(used), dtype=np.uint64)
    points = rank[points]
    counts = padded - size + 1
    starts = np.cumsum(counts) - counts
    m = len(points) - size + 1
    code, top = np.zeros(m, np.uint64), 1
    for j in range(size):
        if top * len(used) >= 1 << 60:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            top = int(code.max()) + 1
        code *= np.uint64(len(used))
        code += points[j:j + m]
        top *= len(used)
    keep = np.ones(m + size, bool)                     # without those that run over a text's end
    for j in range(1, size):
        keep[(np.cumsum(padded) - size + j)[:-1]] = False
    code = code[keep[:m]]
    if int(lengths.min()) < size:                      # padding is no text
        if top * (size + 1) >= 1 << 64:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
        code *= np.uint64(size + 1)
        code += np.repeat(np.minimum(lengths, size), counts).astype(np.uint64)
    for s, n in zip(starts.tolist(), counts.tolist()):
        code[s:s + n].sort()
    fresh = np.ones(len(code), bool)
    fresh[1:] = code[1:] != code[:-1]
    fresh[starts] = True
    return code[fresh], np.add.reduceat(fresh.astype(np.int64), starts)


def reach(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a walk over sets of numbers (``sizes`` of them, one after the other in ``flat``) that
    spans every component at ``similarity``."""
    names, flat = np.unique(flat, return_inverse=True)
    ids = np.split(flat, np.cumsum(sizes)[:-1])
    links, left = [], np.arange(len(ids))
    starts = np.cumsum(sizes) - sizes
    here, front = left, []                             # ``flat`` holds the lines ``here``
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            if not len(left):
                break
        if 2 * len(left) < len(here):
            here = left
            flat = np.concatenate([ids[i] for i in here])
            starts = np.cumsum(sizes[here]) - sizes[here]
        at = front.pop()
        flag = np.zeros(len(names), np.int32)
        flag[ids[at]] = 1
        both = np.add.reduceat(flag[flat], starts)
        near = here[both >= similarity * (sizes[here] + sizes[at] - both)]
        found = near[np.isin(near, left)]
        links += [(at, int(x)) for x in found]
        front += found.tolist()
        left = np.setdiff1d(left, found, assume_unique=True)
    return links


def likely(texts: list[str], i: np.ndarray, j: np.ndarray, similarity: float, shingle: int) -> np.ndarray:
    """Which pairs (i, j) of texts may reach ``similarity``: never wrong about one that does.

    A sketch has a bit for each of ``SKETCH`` slots that a shingle of the text falls into, so a bit that
    only one of two texts has stands for a shingle, or more, that the other lacks."""
    x, _, counts = hashed(texts, np.array([len(t) for t in texts], np.int64), shingle)
    slots = np.zeros((len(texts), SKETCH), bool)
    slots[np.repeat(np.arange(len(texts)), counts), x % np.uint32(SKETCH)] = True
    bits = np.packbits(slots, axis=1).view(np.uint64)
    possible = np.empty(len(i), bool)
    for s in range(0, len(i), 1 << 14):
        a, b = i[s:s + (1 << 14)], j[s:s + (1 << 14)]
        both = bits[a] & bits[b]
        only_a = np.bitwise_count(bits[a] ^ both).sum(axis=1, dtype=np.int64)
        only_b = np.bitwise_count(bits[b] ^ both).sum(axis=1, dtype=np.int64)
        shared = np.minimum(counts[a] - only_a, counts[b] - only_b)
        possible[s:s + (1 << 14)] = shared >= similarity * (shared + only_a + only_b) * (1 - 1e-9)
    return possible


def pair_links(texts: list[str], groups: list[int], similarity: float, shingle: int) -> list[tuple[int, int]]:
    """``group_links`` for small groups: the pairs that ``likely`` leaves, but those linked already."""
    n = np.array(groups)
    begin = np.cumsum(n) - n
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(n[n > 1]).tolist():
        a, b = np.triu_indices(size, 1)
        i.append((begin[n == size][:, None] + a).reshape(-1))
        j.append((begin[n == size][:, None] + b).reshape(-1))
    i, j = np.concatenate(i), np.concatenate(j)
    if not len(i):
        return []
    possible = likely(texts, i, j, similarity, shingle)
    i, j = i[possible], j[possible]
    if not len(i):
        return []
    used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    flat, sizes = numbered([texts[t] for t in used], shingle)
    sets = np.split(flat, np.cumsum(sizes)[:-1])
    root, links = list(range(len(used))), []

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(at[:len(i)].tolist(), at[len(i):].tolist()):
        x, y = top(a), top(b)
        if x != y:
            both = np.sort(np.concatenate((sets[a], sets[b])))
            shared = np.count_nonzero(both[1:] == both[:-1])
            if shared >= similarity * (len(both) - shared):
                links.append((int(used[a]), int(used[b])))
                root[y] = x
    return links


def group_links(texts: list[str], groups: list[int], similarity: float, shingle: int) -> list[tuple[int, int]]:
    """Links (positions in ``texts``) within groups of texts that stand in a row, ``groups`` of them each."""
    links, small, sizes, at = [], [], [], 0
    for n in groups:
        if n <= FEW:
            small += range(at, at + n)
            sizes.append(n)
        else:
            flat, size = numbered(texts[at:at + n], shingle)
            links += [(at + i, at + j) for i, j in reach(flat, size, similarity)]
        at += n
    if small:
        links += [(small[i], small[j]) for i, j in pair_links([texts[i] for i in small], sizes, similarity, shingle)]
    return links


def verified(similarity: float, shingle: int):
    """Arrow function: boxes (part, box) of rows (gid, line_key, norm), sorted by part -> links (a, b) of line keys.

    Groups are compared some at a time: together about ``CHUNK`` code points, or one group."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for table in whole_groups(batches, "part"):
            for s, n in zip(*(a.tolist() for a in spans(table["part"].to_numpy()))):
                yield unboxed(table["box"].slice(s, n)).sort_by("gid").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in parts(batches):
            starts, sizes = spans(table["gid"].to_numpy())
            length = np.add.reduceat(np.maximum(pc.utf8_length(table["norm"]).to_numpy().astype(np.int64), SHORT), starts)
            ends = np.cumsum(length)
            first = 0
            while first < len(starts):
                done = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
                part = table.slice(starts[first], sizes[first:last].sum())
                pairs = group_links(objects(part["norm"].combine_chunks()), sizes[first:last].tolist(), similarity, shingle)
                keys = part["line_key"]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array([p[end] for p in pairs], pa.int64())).combine_chunks().cast(pa.binary())
                     for end in (0, 1)], schema=schema)
                first = last

    return run


def deal(rows: DataFrame, sizes: DataFrame, bucket: int) -> DataFrame:
    """``rows`` (gid, h) with the groups of over ``bucket`` rows (``sizes``: gid, n) copied to pairs of
    blocks, so that every two lines of a group still meet."""
    big = sizes.where(F.col("n") > bucket).select("gid", F.ceil(2 * F.col("n") / bucket).cast("int").alias("blocks"))
    i = F.pmod(F.xxhash64(F.lit("block"), "h"), F.col("blocks")).cast("int")
    hot = (rows.join(big, "gid").withColumn("i", i)
           .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select(F.xxhash64("gid", F.least("i", "j"), F.greatest("i", "j")).alias("gid"), "h"))
    return rows.join(big, "gid", "left_anti").unionByName(hot)


def line_links(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
               shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between digests of different lines that span every component of them."""
    low = docs.select(F.lower(text).alias("low"))
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = (low.mapInArrow(banded(bands, rows, shingle, parts), "part int, keys binary, handles binary")
               .repartition("part").sortWithinPartitions("part").mapInArrow(met, "x long, y long, h long"))
    cands = written(buckets.select(F.xxhash64("x", "y").alias("gid"), "h").distinct(), "line-candidates")
    # Written, so that the shuffles above are gone before texts travel.
    sizes = cands.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    if not sizes.where(F.col("n") > bucket).isEmpty():
        cands = deal(cands, sizes, bucket)
    boxes = (low.mapInArrow(by_handle(parts), "part int, box binary, pairs binary")
             .unionByName(cands.mapInArrow(pairs_by_handle(parts), "part int, box binary, pairs binary"))
             .repartition("part").sortWithinPartitions("part").mapInArrow(bucketed(parts), "part int, box binary"))
    # Not written: the job that reads the links drops both kinds of boxes with its end.
    return (boxes.repartition("part").sortWithinPartitions("part")
            .mapInArrow(verified(similarity, shingle), "a binary, b binary"))


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, version, line_no, line_key, first_key, first_line, kept), one row for each line.

    ``first_key`` and ``first_line``: the component's first line, by (key, line number); it is the
    one kept.  A blank line has no class and is kept; a null text is one blank line; keys may be
    null (null first); rows equal in key and text are one document, whose lines are kept or
    dropped alike; an empty table gives an empty result.
    """
    table = written(lines(docs, key, text), "lines")
    place = F.struct("key", "version", "line_no")
    exact = written(table.where(F.col("line_key").isNotNull()).groupBy("line_key").agg(F.min(place).alias("first")),
                    "line-groups")
    parts = components(line_links(docs, key, text, **options))
    member = written(parts.join(exact, parts["node"] == exact["line_key"]).select("line_key", "component", "first"),
                     "line-members")
    least = written(member.groupBy("component").agg(F.min("first").alias("least")), "line-least")
    fuzzy = written(member.join(least, "component").select(F.col("line_key").alias("k"), "least"), "line-components")
    # A union has no partitioning, so both sides of the join to all lines get an exchange of
    # their own and adaptive execution can split a line that a third of all documents hold.
    best = (exact.join(fuzzy, exact["line_key"] == fuzzy["k"], "left_anti").select("line_key", "first")
            .unionByName(fuzzy.select(F.col("k").alias("line_key"), F.col("least").alias("first"))))
    out = table.join(best, "line_key", "left")
    kept = F.col("line_key").isNull() | place.eqNullSafe(F.col("first"))
    return out.select("key", "version", "line_no", "line_key", F.col("first.key").alias("first_key"),
                      F.col("first.line_no").alias("first_line"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; rows and other columns stay (a text
    that loses every line is empty; a null text stays null)."""
    dropped = (line_classes(docs, key, text, **options).where(~F.col("kept"))
               .groupBy("key", "version").agg(F.collect_list("line_no").alias("__dropped"))
               .select(F.col("key").alias("__key"), F.col("version").alias("__version"), "__dropped"))
    split = F.split(F.col(text), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__dropped"))
    rest = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n")
    joined = docs.withColumn("__v", F.xxhash64(F.col(text))).join(
        dropped, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__v") == F.col("__version")), "left")
    return (joined.withColumn("__lines", split)
            .withColumn(text, F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(rest))
            .drop("__v", "__key", "__version", "__dropped", "__lines"))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_classes(docs).select(
        F.col("key").alias("doc_id"), "line_no", F.lower(F.hex("line_key")).alias("line_key"),
        F.col("first_key").alias("first_doc_id"), "first_line", "kept")
