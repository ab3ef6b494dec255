"""Sources and cleaning plans on small hand-made inputs."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from riskpanel.operators import joins as J
from riskpanel.plans import area_panels as AP
from riskpanel.plans.daily import CleaningRules
from riskpanel.plans.state_panel import hospital_features, statewide_patch
from riskpanel.sources import schemas as SC
from riskpanel.sources import tables as IO


def test_patch_from_a_file_with_byte_order_mark(spark, tmp_path):
    lines = ["OBJECTID,ReportDate,Statewide"]
    day = date(2021, 11, 20)
    for i in range(45):
        lines.append(f"{i + 1},{(day + timedelta(days=i)).strftime('%Y/%m/%d')} 14:00:00+00,{i / 10}")
    (tmp_path / "patch.csv").write_bytes("﻿".encode() + "\n".join(lines).encode())
    raw = IO.read_csv(spark, str(tmp_path / "patch.csv"), SC.STATEWIDE_PATCH)
    assert raw.count() == 45
    patch = statewide_patch(raw, "Maryland", "2021-12-05", "2021-12-19")
    assert patch.count() == 15 and {r.state for r in patch.collect()} == {"Maryland"}
    assert patch.where("ymd = DATE '2021-12-05'").first().Statewide == pytest.approx(1.5)


def test_lines_that_do_not_fit_are_set_apart(spark, tmp_path):
    """A text in a number, a short and a long line are kept whole; the same target filled again holds only the new run."""
    head = ",".join(SC.STATE_CASES.names)
    files, target = tmp_path / "csv", str(tmp_path / "out")
    files.mkdir()
    (files / "a.csv").write_text(f"{head}\n2021-01-01,A,1.5,0.5\n2021-01-02,A,pending,0.5\n2021-01-03,A\n2021-01-04,A,,0.5\n")
    (files / "b.csv").write_text(f"{head}\n2022-01-01,A,2.5,0.5\n2022-01-02,A,1,2,3\n")
    IO.ingest_csv(spark, str(files), SC.STATE_CASES, target)
    good = IO.read_ingested(spark, target, SC.STATE_CASES)
    assert sorted((r.date, r.cases_avg_per_100k) for r in good.collect()) == [("2021-01-01", 1.5), ("2021-01-04", None), ("2022-01-01", 2.5)]
    assert good.select("state").where("state = 'A'").count() == 3  # whatever is read, a line is judged by all fields
    bad = IO.read_quarantine(spark, target, SC.STATE_CASES).collect()
    assert sorted((r.source_file[-5:], r.broken_line) for r in bad) == [
        ("a.csv", "2021-01-02,A,pending,0.5"), ("a.csv", "2021-01-03,A"), ("b.csv", "2022-01-02,A,1,2,3")]
    IO.ingest_csv(spark, str(files / "b.csv"), SC.STATE_CASES, target)
    assert IO.read_ingested(spark, target, SC.STATE_CASES).count() == 1 and IO.read_quarantine(spark, target, SC.STATE_CASES).count() == 1
    (files / "b.csv").write_text(f"{head}\n")
    IO.ingest_csv(spark, str(files / "b.csv"), SC.STATE_CASES, target)
    assert IO.read_ingested(spark, target, SC.STATE_CASES).isEmpty() and IO.read_quarantine(spark, target, SC.STATE_CASES).isEmpty()
    (files / "c.csv").write_text("day,state\n2021-01-01,A\n")
    with pytest.raises(Exception, match="header"):
        IO.ingest_csv(spark, str(files / "c.csv"), SC.STATE_CASES, target)


def test_crosswalk_maps_fifteen_codes_to_five_units(spark):
    cw = AP.crosswalk(spark)
    assert cw.count() == 15 and cw.select("unit").distinct().count() == 5
    assert cw.groupBy("unit").agg(F.count_if("keep").alias("k")).where("k <> 1").count() == 0
    codes = spark.createDataFrame([(36005,), (36085,), (36061,), (1,), (None,)], "fips int")
    assert sorted(r.fips or 0 for r in J.remap_codes(codes, "fips", cw).collect()) == [0, 1, 36998, 36998, 36998]
    assert sorted(r.fips or 0 for r in J.representatives(codes, "fips", cw).collect()) == [0, 1, 36998]


def test_unit_populations_are_merged_and_named(spark):
    census = spark.createDataFrame(
        [("36005", "New York", "Bronx", 10), ("36061", "New York", "NY", 20), ("01001", "Alabama", "Autauga", 5)], SC.COUNTY_CENSUS.fieldNames())
    got = {r.fips: (r.CTYNAME, r.POPESTIMATE2019) for r in AP.member_populations(census, AP.crosswalk(spark)).collect()}
    assert got == {36998: ("New York City", 30), 1001: ("Autauga", 5)}


def test_missing_key_meets_missing_key(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (None, 20)], "k2 int, m int")
    assert {(r.v, r.m) for r in J.lookup_null_safe(a, b, {"k": "k2"}, ["m"]).collect()} == {("x", 10), ("y", 20)}
    assert {(r.v, r.m) for r in J.lookup_left(a, b, {"k": "k2"}, ["m"]).collect()} == {("x", 10), ("y", None)}


def test_confirmed_share_of_beds(spark):
    """Unknown, zero and reversed totals count as fully confirmed."""
    cases = [(10.0, 5.0), (-999999.0, 5.0), (0.0, 0.0), (4.0, 8.0), (None, 1.0), (10.0, 5.0), (10.0, 5.0)]
    rows = [("S", (date(2021, 1, 1) + timedelta(days=i)).strftime("%Y/%m/%d"), 1.0, 1.0, 7.0, 0.5, den, 0.0, num, 0.0)
            for i, (den, num) in enumerate(cases)]
    h = hospital_features(spark.createDataFrame(rows, SC.HOSPITAL_DAILY), CleaningRules())
    got = [r.factor for r in h.orderBy("date").collect()]
    assert got == [0.5, 1.0, 1.0, 1.0, 1.0, 0.5, 0.5]
    last = h.orderBy(F.desc("date")).first()
    assert last.perc_covid == pytest.approx(0.5 * sum(got) / 7) and last.admits_confirmed_avg == 2.0


def _county_inputs(spark, days=70):
    d0 = date(2021, 1, 1)
    text = [(d0 + timedelta(days=i)).isoformat() for i in range(days)]
    cases = [(t, f"USA-{c}", f"C{c}", "X", float(k + i), 0.0, float(k), 0.0)
             for i, t in enumerate(text) for k, c in enumerate(("01001", "01003", "36998"))]
    cases += [(t, "USA-99999", "Unknown", "X", 1000.0, 0.0, 9.0, 0.0) for t in text]
    hosp = [(c, (d0 + timedelta(days=7 * i)).strftime("%Y/%m/%d"), -999999.0, None, 14.0, -999999.0, 10.0, -999999.0)
            for i in range(days // 7) for c in ("01001", "01003", "36005", "36061")]
    areas = [("2022-05-05", "", c, "X", "A" + str(h), h, 100, 1000) for c, h in
             (("01001", 1), ("01003", 1), ("36005", 2), ("36061", 2), ("36085", 2), ("36047", 2), ("36081", 2))]
    census = [("01001", "X", "a", 400), ("01003", "X", "b", 600), ("36005", "X", "c", 500), ("36061", "X", "d", 500), ("36085", "X", "e", 0)]
    lookup = spark.createDataFrame(areas, SC.SERVICE_AREAS.fieldNames()).withColumn("fips", F.col("county_fips").cast("int"))
    return (spark.createDataFrame(hosp, SC.HOSPITAL_WEEKLY), spark.createDataFrame(cases, SC.COUNTY_CASES), lookup,
            spark.createDataFrame(census, SC.COUNTY_CENSUS.fieldNames()))


def test_group_and_member_panels(spark):
    hosp, cases, areas, census = _county_inputs(spark)
    rules = CleaningRules(weekly_start="2021-01-01")
    group = AP.clean_group_panel(hosp, cases, areas, rules).where("ymd = DATE '2021-01-06'").toPandas().set_index("state")
    # Two counties, each one suppressed adult report (2) and no paediatric report, over 7 days and 1000 residents.
    assert group.loc[1].admits_weekly == pytest.approx(2 * 2 / 1000 * 100000)
    assert group.loc[1].perc_covid == pytest.approx(2 * 14 / 7 / 20)
    assert group.loc[1].icu_weekly == pytest.approx(2 * 0.5 / 7 / 1000 * 100000)
    assert group.loc[1].cases_avg_per_100k == pytest.approx((5 + 6) / 1000 * 100000)
    assert group.loc[2].cases_avg_per_100k == pytest.approx(7 / 1000 * 100000)
    assert group.weight.sum() == pytest.approx(1) and set(group.weight_alt) == {0.5}
    member = AP.clean_member_panel(hosp, cases, areas, census, rules).toPandas()
    first = member[member.ymd == date(2021, 1, 6)].set_index("state")
    assert set(first.index) == {1001, 1003, 36998}
    assert first.loc[1001].admits_weekly == first.loc[1003].admits_weekly == pytest.approx(group.loc[1].admits_weekly)
    assert first.loc[36998].POPESTIMATE2019 == 1000 and first.loc[36998].county_rank < first.loc[1003].county_rank
    # Member weights are set per date before areas without a group are dropped.
    assert first.weight.sum() == pytest.approx(1)
    dup = member.groupby(["state", "ymd"]).size()
    assert (dup == 1).all()


def test_lookup_publication(spark):
    df = spark.createDataFrame([(date(2022, 5, 5), "new"), (date(2022, 4, 28), "old")], "p date, v string")
    assert [r.v for r in J.snapshot(df, F.col("p"), date(2022, 5, 6)).collect()] == ["new"]


def test_hot_customer_is_split_and_counted_whole(spark, tmp_path):
    """A customer with a third of all orders: the join splits its partition and no order is lost."""
    from riskpanel.sources.commerce import order_facts

    n = 600_000
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    day = F.expr("timestamp_ntz'2000-01-03 00:00:00' + make_dt_interval(cast(id % 300 as int))")
    spark.range(n).select(
        key.alias("o_custkey"), day.alias("o_orderdate"), F.lit("F").alias("o_orderstatus"),
        F.uuid().alias("o_orderpriority")).repartition(16).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
                             F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        facts = order_facts(spark, str(tmp_path), "state", lambda d: d)
        rows = facts.collect()
        plan = facts._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r.cases for r in rows) == sum(r.deaths for r in rows) == n
    assert "skew=true" in plan
