import math
from collections import defaultdict

from riskpanel.llm import mixing as X

SF = "/root/testdata/sf0.01"


def test_awkward_rows_match_sql(spark, awkward, same_as_sql):
    for i, params in enumerate((X.MixParams(), X.MixParams(entropy=0.999, repeat=2.0, budget=5000, block_docs=2))):
        got = X.report(awkward, params)
        assert same_as_sql(got, X.report_sql(params), documents=awkward if i == 0 else awkward.withColumnRenamed("lang", "language")) if i == 0 else got.count()


def test_small_blocks_match_sql(spark, same_as_sql):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    params = X.MixParams(entropy=0.999, repeat=3.0, block_docs=5)
    assert same_as_sql(X.report(docs, params), X.report_sql(params), documents=f"{SF}/documents.parquet")


def test_targets_are_met(spark):
    rows = [(i, "w " * 10, "big") for i in range(800)] + [(1000 + i, "w " * 10, f"small{i % 4}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    params = X.MixParams(entropy=0.9, repeat=10.0, block_docs=10)
    weight = {r.source: r.weight for r in X.report(docs, params).select("source", "weight").distinct().collect()}
    entropy = -sum(w * math.log(w) for w in weight.values())
    assert abs(entropy - 0.9 * math.log(5)) < 1e-4
    drawn = defaultdict(int)
    for r in X.report(docs, params).collect():
        drawn[r.source] += r.n_tokens * r.n_rows
    assert all(0 <= w * 10000 - drawn[s] <= 10 for s, w in weight.items())
    limited = X.report(docs, X.MixParams(entropy=1.0, repeat=1.5, block_docs=10)).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in limited) == 2


def test_epochs_are_permutations(spark):
    docs = spark.createDataFrame([(i, "a b c", "s" if i < 30 else "t") for i in range(330)], "doc_id long, text string, source string")
    rows = X.report(docs, X.MixParams(entropy=0.95, repeat=8.0, block_docs=4)).where("source = 's'").collect()
    epochs = defaultdict(list)
    for r in rows:
        epochs[r.epoch].append(r)
    last = max(epochs)
    assert last >= 1
    for e, got in epochs.items():
        assert len({r.doc_id for r in got}) == len(got) and (e == last or len(got) == 30)
        assert all(len({r.block for r in got if r.turn == t}) == 1 for t in {r.turn for r in got})
    assert len({tuple(r.block for r in sorted(got, key=lambda r: r.turn)) for e, got in epochs.items() if e < last}) == last


def test_hot_repeated_row_is_one_unit(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 500 + [(i, "a b", "t") for i in range(2, 300)], "doc_id long, text string, source string")
    rows = X.report(docs, X.MixParams(entropy=0.5)).where("source = 's'").collect()
    assert [r.n_rows for r in rows] == [500] * len(rows)


def test_stage(spark, clashing, empty):
    out = X.mix(clashing)
    assert not [c for c in clashing.columns[5:] if out.where(f"`{c}` IS DISTINCT FROM 'extra {c}'").count()]
    drawn = X.report(clashing).collect()
    assert out.columns == clashing.columns and out.count() == sum(r.n_rows for r in drawn)
    assert X.mix(empty).count() == 0 and X.report(empty).count() == 0
