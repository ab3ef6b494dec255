import re
from collections import Counter

import pytest

from riskpanel.llm import sharding as S


def test_table_is_full_even_and_stable():
    params = S.ShardParams()
    owners = S.fill(params)
    counts = Counter(owners)
    assert len(owners) == params.slots and max(counts.values()) - min(counts.values()) <= 1
    fewer = S.fill(S.ShardParams(shards=params.shards[:-1]))
    moved = sum(a != b and a != len(params.shards) - 1 for a, b in zip(owners, fewer, strict=True))
    assert moved < 0.35 * params.slots


def test_bad_tables():
    for shards, slots in (((), 7), (("a", "b", "c"), 2), (("a",), 9), (("a",), 1)):
        with pytest.raises(ValueError):
            S.fill(S.ShardParams(shards, slots))


def test_awkward_rows_match_sql(spark, awkward, clashing, empty, same_as_sql):
    for params in (S.ShardParams(), S.ShardParams(("x", "y", "z"), 31)):
        got = S.place(awkward.select("doc_id"), params=params)
        con_rows = got.collect()
        assert len(con_rows) == awkward.count() and all(r.shard in params.shards for r in con_rows)
    assert same_as_sql(S.place(awkward.select("doc_id")), S.place_sql(), documents=awkward)
    assert S.place(clashing).count() == clashing.count() and S.place(empty).count() == 0
    assert not re.search("Python|Pandas|Arrow", S.place(awkward)._jdf.queryExecution().executedPlan().toString())


def test_written_shards(spark, awkward, tmp_path):
    params = S.ShardParams(("x", "y", "z"), 31)
    S.write(awkward, str(tmp_path / "out"), params=params, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard) for r in S.place(awkward, params=params).collect()}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want and back.count() == awkward.count()
