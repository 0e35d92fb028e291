"""Uncapped vocabulary, term numbers and the lexical index, against plain counting."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.operators import features as FE
from casework.operators import lexical as LX


def corpus(n, seed=1, words=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    # a few topics, so that blocks of like documents differ in their bounds
    topics = [rng.sample(vocab, 25) for _ in range(max(4, n // 40))]
    return [(i, " ".join(rng.choice(topics[i % len(topics)]) for _ in range(rng.randint(1, 40)))) for i in range(n)]


def weighted(docs):
    tf = {i: Counter(w for w in t.split() if len(w) > 1) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    out = {}
    for i, c in tf.items():
        if not c:
            continue
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {t: x / norm for t, x in w.items()}
    return out, sorted(df)


def test_terms_have_dense_numbers_in_term_order(spark):
    docs = corpus(60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    vocab, w = FE.corpus_tfidf(df, "doc_id", "text", FE.TermSpec())
    want, terms = weighted(docs)
    assert [(r.term, r.idx) for r in vocab.orderBy("term").collect()] == [(t, i) for i, t in enumerate(terms)]
    got = {(r.doc_id, r.term): r.weight for r in w.collect()}
    assert got.keys() == {(i, t) for i, c in want.items() for t in c}
    assert all(abs(got[i, t] - x) < 1e-12 for i, c in want.items() for t, x in c.items())
    assert not w.where("idx is null").count()


def test_dense_index_of_ties_and_of_nothing(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(500)], "a int, b int").repartition(4)
    got = FE.dense_index(df, ["a", "b"], "t").orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(500)) and [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)
    assert FE.dense_index(df.limit(0), ["a"], "t").count() == 0


def index_of(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    _, w = FE.corpus_tfidf(df, "doc_id", "text", FE.TermSpec())
    return LX.written(w.select("doc_id", "idx", "weight"), "t-weights")


@pytest.mark.parametrize("exclude_self", [False, True])
def test_search_equals_all_pairs(spark, exclude_self, monkeypatch):
    monkeypatch.setattr(LX, "FIRST_BLOCKS", 2)
    docs = corpus(150) + [(1000 + i, "the same few words") for i in range(80)] + [(2000, ""), (2001, "w0 of its own")]
    w = index_of(spark, docs)
    got = {(r.qid, r.rank): (r.nid, round(r.score, 9)) for r in
           LX.search(LX.build(w, block=4, area=16), w, 4, exclude_self=exclude_self).collect()}
    vec, _ = weighted(docs)
    want = {}
    for q, a in vec.items():
        hits = sorted((-round(s, 9), n) for n, b in vec.items() if (n != q or not exclude_self)
                      if (s := sum(x * b.get(t, 0.0) for t, x in a.items())) > 0)
        want |= {(q, r): (n, -s) for r, (s, n) in enumerate(hits[:4], 1)}
    assert got.keys() == want.keys()
    for key, (n, s) in want.items():
        assert abs(got[key][1] - s) < 2e-9 and (got[key][0] == n or got[key][1] == pytest.approx(s, abs=2e-9))


def test_work_grows_slower_than_the_square(spark):
    """Documents scored for all queries, at two sizes four times apart."""
    done = []
    for n in (200, 800):
        w = index_of(spark, corpus(n, seed=n))
        q = LX.written(w.select(F.col("doc_id").alias("qid"), "idx", F.col("weight").alias("w")), "t-q")
        index = LX.build(w, area=32)
        first, rest = LX.open_blocks(index, q, 5, F.lit(True))
        done.append(first.count() + LX.scores(index, q, rest).count())
    assert done[1] < 8 * done[0]          # the square would be 16


def test_an_area_sends_out_k_hits_a_query_and_no_blocks(spark):
    """400 copies of one text: every block of theirs reaches the k-th score, yet no more than k hits leave an area."""
    docs = [(i, "the same few words") for i in range(400)] + [(900, "few of them")]
    w = index_of(spark, docs)
    q = LX.written(w.where("doc_id in (3, 900)").select(F.col("doc_id").alias("qid"), "idx", F.col("weight").alias("w")), "t-q")
    index = LX.build(w, block=4, area=64)
    _, inside = LX.reaching(index, q, 3, F.lit(True))
    hits = LX.opened(index, q, inside, 3).collect()
    assert hits and max(Counter(r.qid for r in hits).values()) <= 3 * index.areas.select("area").distinct().count()
    got = sorted((r.qid, r["rank"], r.nid) for r in LX.search(index, w.where("doc_id in (3, 900)"), 3).collect())
    assert got == [(3, 1, 0), (3, 2, 1), (3, 3, 2), (900, 1, 900), (900, 2, 0), (900, 3, 1)]


def test_weights_in_chunks_equal_the_long_form(spark, monkeypatch):
    from casework.operators import termweights as TW
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)] + ["the", "naïve", "_x"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(80)]
    odd = [(200, None), (201, ""), (202, "the a"), (None, "w1 w2 w1"), (7, "w1 w2 again"), (7, None), (7, "w59 again")]
    spread = [(i, f"w1 w2 only{i}") for i in range(300, 330)]
    monkeypatch.setattr(TW, "ROWS", 7)
    clean = rows + spread                                             # its rows are not shuffled as (id, term)
    for chunk, data in ((300, rows + odd), (8 << 20, rows + odd + [(None, "w3 w1")]), (300, clean), (300, odd[:3])):
        monkeypatch.setattr(TW, "CHUNK", chunk)
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        for spec in (FE.TermSpec(stop_words=FE.stop_words(), bigrams=True, clean=True), FE.TermSpec()):
            _, want = FE.corpus_tfidf(df, "doc_id", "text", spec, numbered=False)
            want = {(r.doc_id, r.term): r.weight for r in want.collect()}
            out = TW.corpus_weights(df, "doc_id", "text", spec)
            assert out.dtypes == [("doc_id", "bigint"), ("term", "string"), ("weight", "double")]
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert data is not clean or ("hashpartitioning(chunk" in plan and "Join" not in plan and "Window" not in plan)
            got = out.collect()
            assert len(got) == len(want) and {(r.doc_id, r.term) for r in got} == want.keys()
            assert all(abs(r.weight - want[r.doc_id, r.term]) < 1e-12 for r in got)
