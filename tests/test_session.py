"""Intermediate tables."""

import os

from riskpanel.session import materialize, scratch_scope, shared_dir


def test_scope_removes_what_was_written_inside(spark):
    outside = materialize(spark.range(3), "outside")
    folder = os.path.join(shared_dir(spark).removeprefix("file:"), "riskpanel")
    before = set(os.listdir(folder))
    with scratch_scope(spark):
        assert materialize(spark.range(5), "inside").count() == 5
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before and outside.count() == 3
