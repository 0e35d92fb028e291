"""SimHash, fuzzy lines, I-Match and language identification against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from casework.llm import components as CC
from casework.llm import imatch, langid, linededup, simhash

from ..conftest import SF_CHECK, SF_SMOKE
from .conftest import LONG, ODD, SCHEMA, row

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(fps, ids):
    n = len(fps)
    pairs = [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = union_find(n, pairs)
    least = defaultdict(list)
    for i, r in enumerate(root):
        least[r].append(ids[i])
    return [min((x for x in least[r] if x is not None), default=None) for r in root]


def test_components_of_a_long_chain_a_hub_and_a_loop(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(999, i) for i in range(1000, 1100)] + [(50, 1050)]
    df = spark.createDataFrame(chain + hub + hub + [(7, 7), (8, None)], "a long, b long")
    got = {r.node: r.component for r in CC.components(df).collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[i] == 50 for i in [50, 999, *range(1000, 1100)])
    assert got[7] == 7 and 8 not in got
    assert CC.components(df.limit(0)).count() == 0


def test_simhash_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMOKE}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash.documents_query(spark, SF_SMOKE).collect()}
    fps = [brute_fingerprint(r.text) for r in rows]
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [got[r.doc_id].component_id for r in rows] == brute_groups(fps, [r.doc_id for r in rows])


def test_simhash_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    fps = [brute_fingerprint(r[1]) for r in ODD]
    want = sorted(zip([str(r[0]) for r in ODD], [f"{f:016x}" for f in fps], map(str, brute_groups(fps, [r[0] for r in ODD]))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids))


def test_near_dedup_keeps_exactly_one_row_of_every_group(spark):
    import corpus_pipeline
    table = ODD + [row(None, "quite some other words that have no id either"), row(None, "été à la mer \U0001F600 naïve"),
                   row(None, "a text without an id"), row(0, "another text under the same id"),
                   row(0, "a third text, of an id that heads two groups"), row(None, None)]
    fps = [brute_fingerprint(r[1]) for r in table]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    group = {r[:2]: g for r, g in zip(table, union_find(len(fps), pairs))}
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(table, SCHEMA), SF_SMOKE).collect()
    assert sorted(group[(r.doc_id, r.text)] for r in kept) == sorted(set(group.values()))
    least = {g: min((k for (k, _), x in group.items() if x == g and k is not None), default=None) for g in group.values()}
    assert all(r.doc_id == least[group[(r.doc_id, r.text)]] for r in kept)


@pytest.mark.parametrize("cut,take", [(3, 1), (5, 2)])
def test_simhash_links_span_dense_groups(spark, cut, take):
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(40)}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), cut=cut, take=take, bucket=30).collect()
    at = {f: i for i, f in enumerate(signed)}
    assert all(((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4 for a, b in links)
    true = [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & (2 ** 64 - 1)).bit_count() <= 4]
    assert union_find(len(signed), [(at[a], at[b]) for a, b in links]) == union_find(len(signed), true)
    assert len(links) < len(true)
    with pytest.raises(ValueError):
        simhash.choices(2, 1, 4)


def shingles(text, size):
    return {text[i:i + size] for i in range(len(text) - size + 1)} or {text}


def test_shingle_numbers_are_exact():
    rng = np.random.default_rng(3)
    texts = ["ab", "ab\0\0\0", "ab\0", "a", "\0", "abcabcabcabc", "x" * 40, "\U0001F600\u2019\u00e9" * 9]
    texts += ["".join(rng.choice(list("ab\0"), n)) for n in range(1, 30)]
    texts += ["".join(map(chr, rng.integers(0x100, 0x9000, 9000))), "".join(map(chr, rng.integers(0x100, 0x120, 500)))]
    for size in (1, 3, 5, 9):
        sets = [shingles(t, size) for t in texts]
        flat, sizes = linededup.numbered(texts, size)
        assert sizes.tolist() == [len(x) for x in sets]
        got = [set(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1])]
        assert all(len(got[i] & got[j]) == len(sets[i] & sets[j]) for i in range(len(sets)) for j in range(i + 1))


def test_groups_of_lines_link_as_brute_force():
    rng = np.random.default_rng(4)
    texts, groups = [], []
    for n in (1, 2, 2, 2, 5, 2, 1, 3, 40):
        base = "".join(rng.choice(list("abcdefgh "), 60))
        texts += [base[:k] + "#" * int(rng.integers(1, 5)) + base[k:] for k in rng.integers(0, 60, n)]
        groups.append(n)
    sets, of = [shingles(t, 5) for t in texts], np.repeat(range(len(groups)), groups)
    true = [(i, j) for i in range(len(sets)) for j in range(i)
            if of[i] == of[j] and len(sets[i] & sets[j]) >= .8 * len(sets[i] | sets[j])]
    found = linededup.group_links(texts, groups, .8, 5)
    assert union_find(len(sets), found) == union_find(len(sets), true) and set(map(frozenset, found)) <= set(map(frozenset, true))


def test_bands_find_nearly_every_pair_at_the_threshold():
    rng = np.random.default_rng(5)
    texts = []
    while len(texts) < 8000:
        base = "".join(rng.choice(list("abcdefghijklmnop "), 120))
        near = base
        for _ in range(3):
            k = int(rng.integers(0, len(near)))
            near = near[:k] + "#" + near[k + 1:]
        a, b = shingles(base, 5), shingles(near, 5)
        if .8 <= len(a & b) / len(a | b) < .82:
            texts += [base, near]
    sizes = np.array([len(t) for t in texts])
    keys = linededup.band_keys(texts, sizes, linededup.BANDS, linededup.ROWS, linededup.SHINGLE)
    found = (keys[:, ::2] == keys[:, 1::2]).any(axis=0).mean()
    assert found >= .998, found


def test_lines_travel_as_parts_of_the_band_keys():
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdefgh "), 80)) for _ in range(150)]
    base += [b[:40] + "#" + b[41:] for b in base[:50]]
    docs = pa.array(["\n".join(base[k:k + 20]) for k in range(0, 200, 10)] + [None, "", "\n \t\n"])
    rows = list(linededup.banded(20, 5, 5, 16)(iter([pa.RecordBatch.from_arrays([docs], ["low"])])))
    assert sum(r.num_rows for r in rows) <= 16                        # not 20 for each line
    norm = sorted({b.strip(" \t") for b in base})
    h = linededup.handles(linededup.digests(pa.array(norm))).tolist()
    keys = linededup.band_keys(norm, np.array([len(b) for b in norm]), 20, 5, 5)
    want = set()
    for k in np.unique(keys):
        bucket = [h[i] for i in np.flatnonzero((keys == k).any(axis=0))]
        want |= {(min(bucket), max(bucket), x) for x in bucket if len(bucket) > 1}
    table = pa.Table.from_batches(rows).sort_by("part").to_batches()
    got = {tuple(r.values()) for b in linededup.met(iter(table)) for r in b.to_pylist()}
    assert len(want) >= 100 and got == want
    sent = pa.Table.from_batches(linededup.handled(iter([pa.RecordBatch.from_arrays([docs], ["low"])])))
    assert sorted(sent["norm"].to_pylist()) == norm                   # a repeated line goes once


def test_texts_of_lines_travel_in_compressed_boxes(monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    norm = [" ".join(rng.choice(words, 12)) for _ in range(400)]
    docs = [pa.array(["\n".join(norm[k:k + 40]) for k in range(0, 400, 20)]) for _ in range(3)]
    keys = linededup.digests(pa.array(norm))
    h = linededup.handles(keys)
    gids = rng.integers(-1 << 62, 1 << 62, 60)
    want = {(int(gids[i % 60]), keys[i], norm[i]) for i in range(300)} | {(int(gids[i % 7]), keys[i], norm[i]) for i in range(50)}
    cands = sorted({(g, int(h[keys.index(k)])) for g, k, _ in want})
    for most in (1, 32 << 20):
        monkeypatch.setattr(linededup, "BOXED", most)
        sent = list(linededup.by_handle(8)(pa.RecordBatch.from_arrays([d], ["low"]) for d in docs))
        asked = pa.RecordBatch.from_arrays([pa.array([c[i] for c in cands], pa.int64()) for i in (0, 1)], ["gid", "h"])
        sent += linededup.pairs_by_handle(8)(iter([asked]))
        met = list(linededup.bucketed(8)(iter(pa.Table.from_batches(sent).sort_by("part").to_batches(max_chunksize=3))))
        rows = linededup.unboxed(pa.Table.from_batches(met)["box"])
        got = list(zip(*(rows[c].to_pylist() for c in ("gid", "line_key", "norm"))))
        assert len(got) == len(want) and set(got) == want             # a line once in a bucket
        for b in met:                                                 # a bucket in one part
            for part, box in zip(b["part"].to_pylist(), b["box"].to_pylist()):
                g = pa.ipc.open_stream(box).read_all()["gid"].to_numpy().view(np.uint64)
                assert set((g >> np.uint64(32)) * np.uint64(8) >> np.uint64(32)) == {part}
    assert sum(b.nbytes for b in met) < .7 * rows.nbytes


def test_texts_of_lines_are_gone_with_their_links(spark, monkeypatch):
    names, write = [], linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, name: names.append(name) or write(df, name))
    text = "a line of some length that two documents nearly share"
    docs = spark.createDataFrame([(1, text), (2, text + "s"), (3, "another one")], "doc_id long, text string")
    assert linededup.line_links(docs).count() == 1
    assert names == ["line-candidates"]                               # no table of texts stays on disk


def test_texts_split_into_lines_as_in_python():
    texts = ["", None, "a", "\n", " a\t\r\n\x0b\n\u00a0b \n", "\u2028\U0001F600\r\r\n\x0c"] * 3
    want = [(t, n, line.strip(" \t\r\x0b\x0c")) for t, x in enumerate(texts) for n, line in enumerate((x or "").split("\n"))]
    for size in (1, 8, 1 << 20):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(linededup, "SPLIT", size)
            got = [r for of, number, line in linededup.split_lines(pa.array(texts).slice(0))
                   for r in zip(of.tolist(), number.tolist(), line.to_pylist())]
        assert got == want


def test_sketches_leave_every_pair_that_reaches_the_similarity():
    rng = np.random.default_rng(7)
    texts = ["ab", "ab\0", "a", "aaaaaaaaaaaa", "aaaaaaa"]
    for n in rng.integers(5, 4000, 20).tolist():
        base = rng.choice(list("abcdefgh "), n)
        texts += ["".join(np.where(rng.random(n) < share, "#", base)) for share in (0, 0, .01, .02, .03, .05, .2)]
    sets = [shingles(t, 5) for t in texts]
    i, j = np.triu_indices(len(texts), 1)
    likeness = np.array([len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in zip(i, j)])
    for similarity in (.5, .8, 1):
        possible = linededup.likely(texts, i, j, similarity, 5)
        assert possible[likeness >= similarity].all()
        short = (np.array([len(t) for t in texts]) < 1000)[i] & (likeness < .3)
        assert similarity < .8 or possible[short].mean() < .01        # long texts fill their sketches


def test_fuzzy_lines_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMOKE}/documents.parquet").select("doc_id", "text").collect()
    first = {}
    for r in sorted(rows):
        for n, line in enumerate((r.text or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c").lower()
            if line:
                first.setdefault(line, (r.doc_id, n))
    texts = list(first)
    sets = [shingles(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)
             if min(len(sets[i]), len(sets[j])) >= .8 * max(len(sets[i]), len(sets[j]))
             and len(sets[i] & sets[j]) >= .8 * len(sets[i] | sets[j])]
    root = union_find(len(texts), pairs)
    want = sorted(first[t] for i, t in enumerate(texts) if root[i] == i)
    got = linededup.documents_query(spark, SF_SMOKE)
    kept = sorted((r.doc_id, r.line_no) for r in got.where("kept and line_key is not null").collect())
    assert len(pairs) > 10 and len(set(kept) ^ set(want)) <= 2       # MinHash finds nearly all links
    assert got.count() == sum(len((r.text or "").split("\n")) for r in rows)


def test_walk_over_large_buckets_spans_all_links():
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abcdefgh "), 150)) for _ in range(6)]
    sets = [shingles(b[:k] + c + b[k + 1:], 5) for b in base for c in "xyz" for k in (0, 60, 149)]
    true = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= .8 * len(sets[i] | sets[j])]
    number = {s: n for n, s in enumerate(sorted(set().union(*sets)))}
    flat = np.array([number[s] for x in sets for s in sorted(x)])
    walk = linededup.reach(flat, np.array([len(x) for x in sets]), .8)
    assert union_find(len(sets), walk) == union_find(len(sets), true) and len(walk) < len(true)


def test_fuzzy_lines_dealt_buckets_and_odd_rows(spark, odd, none):
    base = "".join(np.random.default_rng(2).choice(list("abcdefghijklmnop "), 300))
    near = [base[:k] + "#" + base[k + 1:] for k in range(0, 300, 6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near)], "doc_id long, text string")
    classes = linededup.line_classes(docs, bucket=10)
    assert classes.where("kept").count() == 1 and classes.count() == 50
    out = linededup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (2, None) in texts and (3, "") in texts and (1, "One plain text of a few words.\nAnd a second line of it.") in texts
    assert linededup.line_classes(none).count() == 0 and linededup.dedup_lines(none).count() == 0


def test_imatch_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMOKE}/documents.parquet'")
    want = sorted(con.execute(f"SELECT * FROM ({imatch.ORACLE_SQL}) ORDER BY doc_id").fetchall())
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(tuple(r) for r in imatch.documents_query(spark, SF_SMOKE).select(cols).collect()) == want


def test_imatch_of_a_text_with_a_third_of_all_rows_as_near_copies(spark):
    """The real band: copies with one word changed are alike, other documents are not."""
    rnd = random.Random(3)
    voc, weights = [f"w{i}" for i in range(3000)], [1 / (i + 3) for i in range(3000)]
    base, rows = rnd.choices(voc, weights, k=200), []
    for i in range(400):
        words = list(base) if 100 <= i < 250 else rnd.choices(voc, weights, k=200)
        if 100 <= i < 250:
            words[rnd.randrange(200)] = f"changed{i}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.near_next for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in range(101, 250)) >= 0.4
    assert max(got[i] for i in [*range(1, 100), *range(251, 400)]) <= 0.2


def test_imatch_odd_rows_in_the_real_band(spark, odd, none):
    got = imatch.fingerprints(odd).collect()
    assert len(got) == len(ODD) and imatch.fingerprints(none).count() == 0
    same = {r.fingerprint for r in got if r.doc_id == 1 and r.n_chars == len(ODD[0][1])}
    assert len(same) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_imatch_odd_rows(spark, odd, none):
    got = imatch.fingerprints(odd, low=0.0, high=1.0).collect()
    assert len(got) == len(ODD) and imatch.fingerprints(none).count() == 0
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    # rows of distinct ids have one possible successor
    by_id = {r.doc_id: r for r in got}
    for a, b in zip(order, order[1:]):
        if a[0] in (9, 8, 7, 6, 5, 4, 3):
            t, nxt = a[1] or "", b[1] or ""
            half = len(t) // 2
            edited = t[:len(t) - half] + nxt[:half]
            assert by_id[a[0]].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), a[0]
            assert by_id[a[0]].n_chars == len(t)
    same = {r.fingerprint for r in got if r.doc_id == 1 and r.n_chars == len(ODD[0][1])}
    assert len(same) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = imatch.fingerprints(odd.where("doc_id = 8")).collect()[0]
    assert one.near_next == 1.0


def test_language_id_learns_outside_the_held_out_quarter(spark, odd, none):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = langid.documents_query(spark, SF_CHECK).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert 150 < len(test) < 350 and sum(r.lang == r.lang_pred for r in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got)
    out = {(r.doc_id, r.text): r.langid for r in langid.identify(odd.drop("mix")).collect()}
    for key in ((2, None), (3, ""), (4, " \t\n"), (5, "12 34 !!")):
        assert out[key].lang == "und" and out[key].score == 0
    assert out[(6, LONG)].lang in ("en", "fr")
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(odd.withColumn("lang", odd["lang"].substr(100, 1)).where("lang is null"))
    assert unlabelled.where("langid.lang != 'und'").count() == 0


def test_language_scores_do_not_depend_on_blocks(monkeypatch):
    m = langid.Model(("a", "b"), np.log([.5, .5]), np.log(np.random.default_rng(1).random((langid.BUCKETS, 2))))
    texts = ["abc def", None, "", "12", "xyz é" * 50]
    whole = m.scores(texts)
    monkeypatch.setattr(langid, "BLOCK", 7)
    monkeypatch.setattr(langid, "PART", 3)
    parts = m.scores(texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])
