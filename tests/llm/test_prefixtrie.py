"""The trie against a plain one built in a dictionary."""

import hashlib
import zlib
from collections import defaultdict

from casework.llm import prefixtrie

from ..conftest import SF_SMOKE

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    member, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            member[t[:d]].append(c)
        ends[t].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in member:
        if p:
            kids[p[:-1]] += 1
    for p in member:
        gain = (len(member[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not kids[p]
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(member[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends[p]))
                   for p, m in member.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(COLS).collect()), key=repr)


def test_given_table(spark):
    table = spark.read.parquet(f"{SF_SMOKE}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(prefixtrie.conversations_query(spark, SF_SMOKE)) == brute(rows)


def test_odd_conversations(spark):
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t} {'x' * (c % 3)}") for c in range(12) for t in range(c)]
    rows += [(20, None, None, None), (20, None, "user", "a"), (20, 1, "user", "é\U0001F600"), (20, 1, "user", "é\U0001F600"),
             (21, 5, "user", ""), (-3, 1, "user", "minus"), (-4, 1, "user", "minus"), (None, 1, "user", "lost")]
    # one conversation with a third of all rows, far over the bands, and copies of it that differ late
    long = [("bot", "again" if t % 7 else f"word {t}") for t in range(300)]
    rows += [(40, t, r, x) for t, (r, x) in enumerate(long)] + [(41, t, r, x) for t, (r, x) in enumerate(long[:290])]
    rows += [(45, t, r, x) for t, (r, x) in enumerate(long + [("user", "end")])] + [(50, t, r, x) for t, (r, x) in enumerate(long)]
    df = spark.createDataFrame([(*r, "i", 1, 2) for r in rows],
                               "conv_id long, turn long, role string, text string, id string, depth int, n_convs int")
    want = brute(rows)
    assert got(prefixtrie.trie(df.repartition(5))) == want
    assert got(prefixtrie.trie(df, band=3)) == want
    assert prefixtrie.trie(df.limit(0)).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "short")], "conv_id long, turn long, role string, text string")
    assert got(prefixtrie.trie(gone)) == brute([(7, 1, "user", "short")])


def test_digests_of_long_member_lists(spark):
    numbers = [*range(-30_000, 60_000, 3)]
    ends = spark.createDataFrame([("a", n) for n in numbers] + [("b", 5)], "id string, conv long").repartition(6)
    got = dict(tuple(r) for r in prefixtrie.end_digests(ends).collect())
    assert got == {"a": hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest(), "b": hashlib.sha256(b"5").hexdigest()}
