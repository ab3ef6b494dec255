import re

import pytest
from pyspark.sql import functions as F

from riskpanel.llm import pii

SF = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def changed(spark, *texts, key="k"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymize(rows, pii.PiiParams(key)).orderBy("doc_id").collect()]


@pytest.mark.parametrize("a, b", [(17, 43), (1, 9), (10, 10)])
def test_the_network_is_a_permutation(spark, a, b):
    pairs = spark.range(a * b).select(F.floor(F.col("id") / b).alias("l"), (F.col("id") % b).alias("r"))
    got = {tuple(r[0]) for r in pairs.select(pii.feistel(F.col("l"), F.col("r"), F.lit(a), F.lit(b), "k", "t")).collect()}
    assert got == {(i, j) for i in range(a) for j in range(b)}


def test_letters_are_permuted_among_their_like(spark):
    rows = spark.range(26 * 10).select(F.char((F.col("id") % 26 + 97).cast("int")).alias("l"), F.floor(F.col("id") / 26).cast("string").alias("r"))
    got = {tuple(r[0]) for r in rows.select(pii.feistel_letters(F.col("l"), F.col("r"), "k", "t")).collect()}
    assert len(got) == 260 and all(re.fullmatch("[a-z]", x) and re.fullmatch("[0-9]", y) for x, y in got)


def test_formats_stay_valid(spark):
    card, spaced, phone, ip, ssn, iso, german, mail = changed(
        spark, "4111111111111111", "4111 1111 1111 1111", "+1 (722) 555-6978", "79.36.208.206", "123-45-6789", "1980-02-29", "29.02.1980", "Jo.48+x@mail8.example.com")
    assert re.fullmatch(r"4\d{15}", card) and luhn(card) and card != "4111111111111111" and spaced.replace(" ", "") == card
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", phone) and phone != "+1 (722) 555-6978"
    assert all(0 <= int(x) <= 255 for x in ip.split(".")) and ip.count(".") == 3 and ip != "79.36.208.206"
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", ssn) and ssn != "123-45-6789"
    y, m, d = iso.split("-")
    assert f"{d}.{m}.{y}" == german and 1900 <= int(y) <= 2099
    assert re.fullmatch(r"[A-Z][a-z]\.\d\d\+[a-z]@mail8\.example\.com", mail) and mail != "Jo.48+x@mail8.example.com"


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112", "1.2.3.4.5", "300.1.1.1", "01.2.3.4", "2021-02-30", "1899-01-01", "666-12-1234", "722-555-69781", "a0cab398dc11d1a4111111111111111f",
             "x4111111111111111", "no numbers", "", "@", "3.14 and 2024"]
    assert changed(spark, *texts) == texts


def test_values_inside_longer_runs(spark):
    alone = dict(zip(("10.0.0.1", "10.0.0.9", "2020-01-01", "2020-02-01", "123-45-6789", "4111111111111111"), changed(
        spark, "10.0.0.1", "10.0.0.9", "2020-01-01", "2020-02-01", "123-45-6789", "4111111111111111")))
    texts = ["http://{10.0.0.1}/index", "{10.0.0.1}/24", "{2020-01-01}T10:00", "{2020-01-01}/{2020-02-01}", "{10.0.0.1}-{10.0.0.9}", "id/{123-45-6789}/x",
             "{4111111111111111}.jpg"]
    fill = lambda t, new: re.sub("{([^}]*)}", lambda m: new(m[1]), t)
    assert changed(spark, *[fill(t, str) for t in texts]) == [fill(t, alone.get) for t in texts]
    stay = ["2020-01-01abc", "x2020-01-01T10", "1.2.3.4.5/x", "2021-02-30/a", "550e8400-e29b-41d4-a716-446655440000"]
    assert changed(spark, *stay) == stay


def test_equal_values_stay_linked_and_keys_differ(spark):
    a, b = changed(spark, "call 722-555-6978 or 79.36.208.206.", "(722) 555-6978; 79.36.208.206")
    assert re.findall(r"\d+", a) == re.findall(r"\d+", b)
    assert changed(spark, "79.36.208.206", key="k") != changed(spark, "79.36.208.206", key="other")


def test_many_values_in_one_text(spark):
    values = [f"10.0.{i // 256}.{i % 256}" for i in range(500)]
    (text,) = changed(spark, "é " + " und ".join(values) + " ñ")
    found = text[2:-2].split(" und ")
    assert len(set(found)) == 500 and not set(found) & set(values)


def test_awkward_rows_and_native_plan(spark, awkward, clashing, empty):
    out = pii.pseudonymize(clashing)
    assert not [c for c in clashing.columns[5:] if out.where(f"`{c}` IS DISTINCT FROM 'extra {c}'").count()]
    assert out.columns == clashing.columns and pii.report(empty).count() == 0
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(r.doc_id), str(r.text)) for r in awkward.collect())
    plan = pii.report(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = ({r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in (docs, pii.pseudonymize(docs)))
    patterns = [r"[a-z]+\.\d\d@mail\d\.example\.com", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\+1 \(\d{3}\) \d{3}-\d{4}"]
    seen = 0
    for i, text in before.items():
        values = [v for p in patterns for v in re.findall(p, text)] + [v for v in re.findall(r"\b\d{16}\b", text) if luhn(v)]
        seen += len(values)
        assert not [v for v in values if v in after[i]]
        assert len(values) > 0 or after[i] == text or re.search(r"\d", text)
        for p in patterns:
            assert len(re.findall(p, text)) == len(re.findall(p, after[i]))
    assert seen > 20


def test_report_matches_sql(spark, awkward, same_as_sql):
    texts = ["4111111111111111 and 4111 1111 1111 1111 or 4111-1111-1111-1111", "+1 (722) 555-6978, 152.555.6978 x", "79.36.208.206", "123-45-6789 700-45-6789",
             "1980-02-29 29.02.1980 31/12/1999 1980/02/29", "Jo.48+x@mail8.example.com a@b.co", "4111111111111112 1.2.3.4.5",
             "http://10.0.0.1/index 10.0.0.0/24 2020-01-01T10:00 2020-01-01/2020-02-01 10.0.0.1-10.0.0.9", "a/b-1.2/2021-02-30T1 31/12/1999/x"]
    rows = awkward.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert same_as_sql(pii.report(rows), pii.report_sql(), documents=rows)
