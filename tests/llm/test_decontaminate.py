"""Benchmark leaks against a plain search and against SQL."""

import hashlib
import random
import re

import duckdb

from casework.llm import decontaminate

from ..conftest import SF_SMOKE

BREAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return BREAK.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = set()
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.add(("" if i is None else str(i), tuple(w[s:s + window])))
    out = []
    for k, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    ids.add(i)
        out.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(COLS).collect()), key=repr)


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["été", "naïve", "Ünder"]          # few words, so that shingles repeat
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 9, 10, 11, 25]))) for i in range(30)] + [(30, "same " * 14)]
    items += [(None, "no id for this item of words"), (5, "a second item of the same id"), (40, None), (41, " ?! "),
              (42, "a a a"), (43, "a a a"), (44, "a a a")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    for i in range(60, 90):
        t = items[rng.randrange(31)][1].split()
        cut = rng.randrange(len(t))
        docs.append((i, f"{text(5)}, {' '.join(t[cut:cut + 12]).upper().replace('É', 'é').replace('Ï', 'ï').replace('Ü', 'Ü')}! {text(3)}"))
    docs += [(100 + i, docs[70][1]) for i in range(45)]                          # a third are copies of one text
    docs += [(None, None), (200, ""), (201, "same " * 40), (None, "A a-A a"), (70, "another text under the same id"),
             (202, items[3][1]), (202, items[3][1]), (203, "word " * 3000 + items[7][1] + " word" * 3000)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_hit int, item_id string").repartition(5),
            spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"))


def test_against_plain_search(spark, monkeypatch):
    docs, items = cases(3)
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert got(decontaminate.contamination(d, i)) == want
    assert sum(r[-1] for r in want) > 40 and not all(r[-1] for r in want)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)                       # the joins by shuffle
    assert got(decontaminate.contamination(d, i)) == want
    assert got(decontaminate.contamination(d, i, window=7, shingle=3)) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs, items = cases(4)
    d, i = frames(spark, docs[:3], items)
    assert got(decontaminate.contamination(d, i.limit(0))) == brute(docs[:3], [])
    assert decontaminate.contamination(d.limit(0), i).count() == 0


def test_same_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMOKE}/{t}.parquet'")
    cur = con.execute(decontaminate.ORACLE_SQL)
    assert [c[0] for c in cur.description] == COLS
    assert got(decontaminate.documents_query(spark, SF_SMOKE)) == sorted(cur.fetchall(), key=repr)
