import hashlib
import zlib

from riskpanel.llm import merkle

SF = "/root/testdata/sf0.01"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    n_chars = r.n_chars if r.n_chars is None else r.n_chars + more
    return sha(*map(told, (r.doc_id, r.source, r.lang, n_chars, r.text)))


def tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    """(siblings, fold) of node i: the fold takes a digest to the root."""
    steps = []
    for level in levels[:-1]:
        run = level[i - i % 2:i - i % 2 + 2]
        steps.append((i % 2, run[:i % 2] + run[i % 2 + 1:]))
        i //= 2
    return steps


def brute(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted((r for r in rows if r.lang == x), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r))) for x in langs}
    trees = {x: tree([leaf_of(r) for r in members[x]]) for x in langs}
    upper = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(members[x]):
            steps = path(trees[x], i) + path(upper, k)
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf_of(r, 1 if tampered else 0)
            for side, others in steps:
                node = sha(*others, node) if side else sha(node, *others)
            root = upper[-1][0]
            out.append((r.doc_id, leaf_of(r), trees[x][-1][0], root, sha(*[d for _, o in steps for d in o]), node, node == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_awkward_rows(awkward, clashing, empty, same_as_sql):
    want = brute(awkward.collect())
    for bits in (1, 2, 12):
        assert rows_of(merkle.report(clashing.withColumns({c: clashing["lang"] for c in ("tree", "idx", "n", "digest", "part", "row")}), bits)) == want
    assert merkle.report(empty).count() == 0
    same_as_sql(merkle.report(awkward), merkle.report_sql(), documents=awkward)


def test_one_row_and_one_language(spark, awkward):
    one = awkward.where("doc_id = 4")
    assert rows_of(merkle.report(one)) == brute(one.collect())
    english = awkward.where("lang = 'en'")
    assert rows_of(merkle.report(english, 2)) == brute(english.collect())


def test_documents(spark, same_as_sql):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = merkle.report(docs.repartition(7), 4)
    assert rows_of(got) == brute(docs.collect())
    rows = same_as_sql(merkle.report(docs), merkle.report_sql(), documents=f"{SF}/documents.parquet")
    assert 0 < sum(r[-1] for r in rows) < len(rows)  # columns are sorted by name


def test_a_proof_is_checked_by_itself(awkward):
    from pyspark.sql import functions as F

    good = merkle.manifest(awkward, bits=3).withColumn("again", merkle.fold(F.col("leaf"), F.col("proof")))
    assert good.where("again <> root OR again IS NULL").count() == 0 and "tampered" not in good.columns
