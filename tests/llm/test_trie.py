import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from riskpanel.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.01"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        ends[path].add(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def conversations(seed, n=60, longest=14):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([0, 100, 200]) + rng.randrange(40)
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", rng.choice(["a", "é🙂", "longer text"]) if rng.random() < 0.4 else f"t{t}"))
    return rows


SMALL = [trie.TrieParams(), trie.TrieParams(segment=4, block=10, piece=2), trie.TrieParams(segment=1, block=1, piece=1), trie.TrieParams(segment=3, block=10**6)]


@pytest.mark.parametrize("params", [SMALL[1], SMALL[3]])
def test_random_conversations(spark, params):
    rows = conversations(1)
    got = rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), params))
    assert got == brute(rows)


@pytest.mark.parametrize("params", SMALL[:2])
def test_awkward_rows(spark, params, same_as_sql):
    rows = [(c, t, "user", f"t{t}") for c in (1, 2) for t in range(12)] + [(3, t, "user", f"t{t}") for t in range(8)]  # copies, and a prefix that ends at a segment's end
    rows += [(5, None, "user", "x"), (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", None), (5, 1, "assistant", ""), (None, 0, "user", "lost")]
    rows += [(104, 0, "user", "x"), (-7, 0, "user", "neg"), (-7, 1, "user", "neg"), (-7, 1, "user", "neg"), (300, 0, None, None)]
    rows += [(c, 0, "system", "s") for c in range(401, 420)]  # some become turnless
    rows += [(500, t, "user", f"deep{t % 3}") for t in range(40)] + [(501, t, "user", f"deep{t % 3}") for t in range(40)] + [(502, t, "user", f"deep{t % 3}") for t in range(33)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS n", "'y' AS root", "2 AS k", "3 AS seg", "4 AS block").repartition(3)
    got = trie.prefix_trie(df, params)
    assert rows_of(got) == brute(rows)
    if params is SMALL[0]:
        same_as_sql(got, trie.prefix_trie_sql(), conversations=df.select("conv_id", "turn", "role", "text"))


def test_empty_and_lost(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0


def test_conversations_match_sql(spark, same_as_sql):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = trie.prefix_trie(df)
    assert rows_of(got) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    same_as_sql(got, trie.prefix_trie_sql(), conversations=f"{SF}/conversations.parquet")
