"""Packing, neighbours, mixing, tool calls, sharding, licences, the pipeline and the guard."""

import json
import os
import shutil
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casework.llm import ann, catalogue, licences, mixing, packing, sharding, toolcalls

from ..conftest import SF_SMOKE
from .conftest import ODD

BPE = public_tokenizers.path("byte_bpe_50k.json")


def sql(query, sf=SF_SMOKE):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return con.execute(query)


def same(spark, module):
    cur = sql(module.ORACLE_SQL)
    cols = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    assert sorted((tuple(r) for r in module.documents_query(spark, SF_SMOKE).select(cols).collect()), key=repr) == want


def check_packing(pieces, texts, capacity=2048):
    library = Tokenizer.from_file(BPE)
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}
    seen, bins = {}, {}
    for r in pieces:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, parts in seen.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert [p[1] for p in parts] == np.cumsum([0, *(p[2] for p in parts)])[:-1].tolist()
        assert sum(p[2] for p in parts) == len(ids[k]) and all(p[2] == capacity for p in parts[1:])
    for b in bins.values():
        b.sort()
        assert [x[0] for x in b] == np.cumsum([0, *(x[1] for x in b)])[:-1].tolist() and sum(x[1] for x in b) <= capacity
    assert set(seen) == set(texts)
    return len(bins), -(-sum(map(len, ids.values())) // capacity)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    used, bound = check_packing(packing.documents_query(spark, SF_SMOKE).collect(),
                                {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert used <= bound + 2


def test_packing_odd_rows_and_real_ids(spark, odd, none):
    unique = odd.where("doc_id > 1")
    check_packing(packing.packed(unique, BPE).collect(), {r[0]: r[1] for r in ODD if r[0] and r[0] > 1})
    got = packing.pack(odd, BPE, group=3).collect()
    assert sum(r.piece == 0 for r in got) == len(ODD) and all(len(r.ids) == 4 * r.length for r in got)
    assert packing.packed(none, BPE).count() == 0


def test_encoder_equals_the_library():
    library, encode = Tokenizer.from_file(BPE), packing.encoder(BPE)
    for t in ["", " ", "a  b", " a", "a ", "\n a\n\n  b \t c", "it's  'll x", "1 2 ,3", "\t x", "é ñ\r\n z", "a 　b",
              "x <|endoftext|> y", "don't  \n\n c", "😀 naïve Ⅷ ² 漢字", "a" * 3000]:
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(5).integers(1, 100, 400)
    bins, offsets = packing.best_fit(lengths, 128, 4, 12000.0, rule, (1, 1, 1))
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 128 and len(mine) <= 4 and (mine ** 2).sum() <= 12000
        o = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][o] == np.r_[0, np.cumsum(mine[o])[:-1]]).all()
    loose, _ = packing.best_fit(lengths, 128, 128, 128.0 ** 2, rule)
    assert loose.max() + 1 <= -(-lengths.sum() // 128) * 1.05 + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([200]), 128, 4, 1e9)


def brute_nearest(rows, k):
    use = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = set()
    for q in (i for i in use if i % 100 == 0):
        near = sorted((float(np.sqrt(((use[i] - use[q]) ** 2).sum())), i) for i in use if i != q)[:k]
        out |= {(q, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(near)}
    return out


def test_neighbours_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMOKE}/embeddings.parquet").collect()]
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.embeddings_query(spark, SF_SMOKE).collect()}
    want = brute_nearest(rows, 10)
    assert len(got & want) >= 0.95 * len(want) and len(got) == len(want)


def test_neighbours_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 1)
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(95, 205)]
    rows += [(0, None), (1, [0.0] * 5), (2, [1.0, None, 1.0, 1.0, 1.0]), (3, [1.0, float("nan"), 0.0, 0.0, 0.0]),
             (300, rows[0][1]), (301, rows[0][1]), (400, [float("inf")] * 5)]
    schema = "vec_id long, embedding array<double>, score string, rank string"
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], schema)
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df, _asked()).collect()}
    assert got == brute_nearest(rows, 10)
    assert ann.nearest(df.limit(0), _asked()).count() == 0
    few = spark.createDataFrame([(100, [1.0, 2.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(few, _asked()).collect()] == [(100, 1, 7, 0.0)]
    with pytest.raises(ValueError):
        ann.nearest(few.unionByName(spark.createDataFrame([(9, [1.0])], few.schema)), _asked())


def _asked():
    from pyspark.sql import functions as F
    return F.col("id") % 100 == 0


def test_mixing_matches_sql(spark):
    same(spark, mixing)


def test_mixing_odd_rows(spark, odd, none):
    got = mixing.mix(odd.drop("mix")).collect()
    assert len(got) == len(ODD)
    by_source = {}
    for r in got:
        assert r.mix.size == len((r.text or "").split()) and r.mix.taken <= 2 * r.mix.size
        by_source.setdefault(r.source, []).append(r.mix)
    for rows in by_source.values():
        assert abs(sum(m.taken for m in rows) - rows[0].target) <= max(m.size for m in rows)
        assert rows[0].target <= 2 * rows[0].source_size
    again = mixing.mix(odd.drop("mix")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixing.repeat(mixed).count() == sum(r.mix.repetitions for r in got)


def test_mixing_of_shared_and_missing_ids(spark, tmp_path):
    """Rows that share an id, or have none, are placed one by one, equal ones counted."""
    texts = [f"w{i} a b c d e f g h i" for i in range(300)]
    rows = ([(i, texts[i % 300], "a") for i in range(400)] + [(None, t, "a") for t in texts] + [(None, "the same words " * 4, "a")] * 600
            + [(7, "one shared id", "b")] * 50 + [(7, None, "b"), (None, "", "b")] + [(None, f"x {i}", None) for i in range(90)])
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.documents_query(spark, str(tmp_path)).collect()
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = sql(mixing.ORACLE_SQL, tmp_path)
    assert [d[0] for d in want.description] == cols
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == sorted(want.fetchall(), key=repr)
    mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet"), into="m")
    for source in ("a", "b", None):
        mine = [r.m for r in mixed.collect() if r.source == source]
        assert abs(sum(m.taken for m in mine) - mine[0].target) <= max(m.size for m in mine)
    assert sorted((r.doc_id or -1, r.m.size, r.m.taken) for r in mixed.collect()) == sorted((r.doc_id or -1, r.size, r.taken) for r in got)
    assert mixing.repeat(mixed, "m").count() == sum(r.m.repetitions for r in mixed.collect())


def test_water_filling_redistributes_until_feasible(spark):
    s = spark.createDataFrame([("a", 10, 1.0), ("b", 100, 10.0), ("c", 1000, 1.0)], "source string, source_size long, weight double")
    t = {r.source: r.target for r in mixing.targets(s, 1.5, 2.0).collect()}
    assert t == {"a": 20.0, "b": 200.0, "c": 1445.0}
    t = {r.source: r.target for r in mixing.targets(s, 9.0, 2.0).collect()}
    assert t == {"a": 20.0, "b": 200.0, "c": 2000.0}


CALLS = "conv long, call_id string, at long, name string, arguments string, after array<string>"
TOOLS = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}, "required": ["n"],
               "additionalProperties": False}}


def test_tool_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame([
        (1, "late", 1, "f", '{"n": 1.0}', ["early"]), (1, "early", 5, "f", '{"n":2}', None), (1, "x", 6, "f", '{"n":-1,"z":0}', ["gone"]),
        (1, "a", 7, "g", "[", None), (2, "p", 1, "f", '{"n":1}', ["q"]), (2, "q", 2, "f", '{"n":1}', ["p"]), (2, "p", 9, "f", "{}", None),
        (3, None, 1, "f", None, None), (None, "n", 1, "f", '{"n":NaN}', ["n0"]), (None, "n0", 2, "f", '{"n":3}', [])], CALLS)
    results = spark.createDataFrame([(1, "late", 2, "é\n"), (1, "lost", 3, "r"), (1, "x", 4, "early"), (1, "x", 8, "again"), (None, "n", 9, None)],
                                    "conv long, call_id string, at long, content string")
    linked = toolcalls.link(calls, results, TOOLS).collect()
    got = {(r.conv, r.call_id): r for r in linked if not r.status.startswith("repeated")}
    assert len(got) == 10
    assert sorted((r.conv, r.call_id, r.at, r.status, json.loads(r.json)["result"], json.loads(r.json)["arguments"])
                  for r in linked if r.status.startswith("repeated")) == [
        (1, "x", 8, "repeated result", "again", None), (2, "p", 9, "repeated call", None, {})]
    r = got[(1, "late")]
    assert (r.status, r.depth, r.valid) == ("linked", 1, True)
    assert r.json == '{"after":["early"],"arguments":{"n":1},"id":"late","name":"f","result":"é\\n"}'
    assert got[(1, "early")].depth == 0 and got[(1, "early")].status == "no result"
    assert got[(1, "x")].status == "result first" and got[(1, "x")].results == 2
    assert got[(1, "x")].errors == ["$.n: out of range", "$.z: not known", "unknown call gone"]
    assert got[(1, "a")].errors == ["unknown tool", "arguments are no JSON"]
    assert got[(1, "lost")].status == "no call" and not got[(1, "lost")].valid
    assert got[(2, "p")].status == got[(2, "q")].status == "cycle" and got[(2, "p")].depth is None and got[(2, "p")].calls == 2
    assert got[(3, "")].errors == ["no arguments"]
    assert got[(None, "n")].depth == 1 and got[(None, "n0")].depth == 0 and got[(None, "n")].errors == ["arguments are no JSON"]
    assert toolcalls.link(calls.limit(0), results.limit(0), TOOLS).count() == 0


def test_tool_calls_with_one_identifier_are_all_kept(spark):
    """Null identifiers and one identifier for many rows: every call and every content comes back once."""
    calls = spark.createDataFrame([(1, None, i, "f", f'{{"n":{i}}}', None) for i in range(30)] + [(None, "k", 1, "f", '{"n":1}', None)] * 4, CALLS)
    results = spark.createDataFrame([(1, None, 40 + i, f"content {i}") for i in range(20)], "conv long, call_id string, at long, content string")
    got = toolcalls.link(calls, results, TOOLS).collect()
    bodies = [json.loads(r.json) for r in got]
    assert sorted(b["arguments"]["n"] for b in bodies if b["arguments"]) == sorted([*range(30), 1, 1, 1, 1])
    assert sorted(b["result"] for b in bodies if b["result"]) == sorted(f"content {i}" for i in range(20))
    assert sum(r.valid for r in got) == 2 and len(got) == 30 + 4 + 19


def test_tool_schemas_and_lone_surrogates(spark):
    calls = spark.createDataFrame([(1, "a", 1, "f", '{"n":1,"s":"\\ud800x"}', None), (1, "b", 2, "f", '{"n":true}', None),
                                   (1, "c", 3, "f", '{"n":1.0,"\\udfff":2,"k":"z"}', None)], CALLS)
    results = spark.createDataFrame([], "conv long, call_id string, at long, content string")
    tool = {"type": "object", "properties": {"n": {"enum": [1]}, "s": {"type": "string"}, "k": {"const": "v"}}, "additionalProperties": False}
    got = {r.call_id: r for r in toolcalls.link(calls, results, {"f": tool}).collect()}
    assert got["a"].valid and '"s":"\\ud800x"' in got["a"].json and json.loads(got["a"].json)["arguments"]["s"] == "\ud800x"
    assert got["b"].errors == ["$.n: not one of the listed values"]
    assert got["c"].errors == ["$.k: not one of the listed values", "$.\\udfff: not known"]
    for odd in ({"pattern": "^a$"}, {"type": "date"}, {"properties": {"x": {"anyOf": []}}}, {"items": {"format": "uri"}},
                {"additionalProperties": {}}):
        with pytest.raises(ValueError):
            toolcalls.link(calls, results, {"f": odd})


def test_every_user_turn_is_a_call(spark):
    turns = spark.read.parquet(f"{SF_SMOKE}/conversations.parquet").collect()
    got = toolcalls.conversations_query(spark, SF_SMOKE).collect()
    assert sum(bool(r.calls) for r in got) == sum(t.role != "assistant" for t in turns)
    assert {(r.conv_id, r.call_id) for r in got if r.calls} == {(t.conv_id, f"call_{t.turn}") for t in turns if t.role != "assistant"}
    for r in got:
        if r.calls:
            assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def test_sharding_table_and_sql(spark, odd, none):
    same(spark, sharding)
    owners = sharding.fill_table(sharding.SHARDS, 4099)
    counts = np.bincount(owners)
    assert counts.max() - counts.min() <= 1 and -1 not in owners
    fewer = sharding.fill_table(sharding.SHARDS[:-1], 4099)
    moved = sum(a != b for a, b in zip(owners, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * 4099
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)
    placed = sharding.place(odd.withColumnRenamed("size", "slot"), "doc_id", ["a", "b", "c"], 101)
    assert placed.count() == len(ODD) and placed.where("shard is null").count() == 0
    assert sharding.place(none, "doc_id", ["a"], 7).count() == 0


def test_shards_are_written_whole(spark, odd, tmp_path):
    placed = sharding.place(odd, "doc_id", ["a", "b"], 101)
    sharding.write_shards(placed, str(tmp_path / "out"), files_per_shard=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


def test_licences(spark, none):
    same(spark, licences)
    mit = licences.TEXTS["MIT"]
    texts = [mit, "The " + mit, mit.upper().replace("SOFTWARE", "  software\n"), "// Copyright (c) 2024 A. Person\n" + mit,
             "Copyright 2020 X\n(c) 2021 Y\n" + mit.replace("MIT License", "* MIT Licence *"), None, "", "...", mit + " and more"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licence string")
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    assert got == {0: "MIT", 1: None, 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: None, 7: None, 8: None}
    own = spark.createDataFrame([("b", "Some terms."), ("a", "some TERMS"), ("nothing", "--")], "licence string, text string")
    few = spark.createDataFrame([(1, "SOME terms!"), (2, "")], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan(few, own).collect()} == {1: "a", 2: None}
    assert licences.scan(none).count() == 0


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    before, frames = docs, []
    for name, stage in C.STAGES:
        after = C.written(stage(spark, before, SF_SMOKE), f"test-{name}")
        frames.append(after)
        if name != C.STAGES[-1][0]:
            assert after.columns == docs.columns
        before = after
    lang, lines, near, mixed, packed = frames
    assert lang.count() == lines.count() == docs.where("text rlike '[A-Za-z]'").count()
    ids = [r.doc_id for r in near.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) < lines.count()
    assert set(r.doc_id for r in mixed.select("doc_id").distinct().collect()) <= set(ids)
    assert packed.where("piece = 0").count() == mixed.count()
    odd_docs = odd.select(docs.columns)
    for name, stage in C.STAGES:
        odd_docs = C.written(stage(spark, odd_docs, SF_SMOKE), f"odd-{name}")
    assert odd_docs.count() > 0


def test_pipeline_keeps_columns_named_like_its_own(spark, odd):
    import corpus_pipeline as C
    docs = odd.withColumnRenamed("kept", "langid")
    for name, stage in C.STAGES:
        if name in ("language_id", "mix_sources"):
            got = stage(spark, docs, SF_SMOKE)
            assert got.schema == docs.schema
            assert {(r.mix, r.langid) for r in got.collect()} == {("m", "k")}


def test_the_rest_works_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr
    names = catalogue.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(catalogue.oracle_sql()) <= set(names)
