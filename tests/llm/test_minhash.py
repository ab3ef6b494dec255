import random

import pytest

from riskpanel.llm import minhash as M
from riskpanel.llm.components import components


def brute(rows, words, percent):
    """Component and size by comparing all pairs of sets."""
    def shingles(text):
        found = (text or "").encode().lower().split()
        if not found:
            return frozenset()
        return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1)))

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, a) in enumerate(named):
        for j, b in named[:n]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(str((i, len(s), root(i) if i is not None else None, i is None or root(i) == i)) for i, s in sets)


def near_copies(n, length=60, base=40, seed=1):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    rows = []
    for i in range(n):
        copy = list(words)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(length)] = f"c{rng.randrange(10**6)}"
        rows.append((base + i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("words, percent, block", [(3, 85, 128), (5, 80, 4)])
def test_groups_of_near_copies(spark, words, percent, block):
    rows = near_copies(70) + near_copies(30, 25, 500, 2) + [(1000 + i, f"only text {i} of its own kind here") for i in range(20)]
    rows += [(2000 + i, rows[i % 5][1]) for i in range(200)]  # exact copies
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(str(tuple(r)) for r in M.near_duplicates(df, M.NearParams(words=words, percent=percent, block=block)).collect())
    assert got == brute(rows, words, percent)


def test_awkward_rows(spark, awkward, clashing, empty):
    params = M.NearParams(words=3, percent=85)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(str(tuple(r)) for r in M.near_duplicates(clashing, params).collect()) == brute(rows, 3, 85)
    assert M.near_duplicates(empty, params).count() == 0
    kept = M.keep(clashing, params)
    assert kept.columns == clashing.columns and 2 not in {r.doc_id for r in kept.collect()} and kept.where("doc_id IS NULL").count() == 2


def test_an_id_with_two_texts_links_both(spark):
    a, b = near_copies(2, 40, 0, 5), near_copies(2, 40, 0, 6)
    rows = [(5, a[0][1]), (5, b[0][1]), (7, a[1][1]), (9, b[1][1]), (5, ""), (7, None)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), M.NearParams(words=2, percent=40)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (9, 5), (7, 7)}  # a text without words is linked with nothing


def test_sample_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(str(tuple(r)) for r in M.near_duplicates(docs, M.NearParams(words=3, percent=85)).collect())
    assert got == brute([tuple(r) for r in docs.collect()], 3, 85)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
