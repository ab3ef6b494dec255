import re

from riskpanel.llm import lines

SF = "/root/testdata/sf0.01"


def test_awkward_rows_match_sql(spark, awkward, same_as_sql):
    got = same_as_sql(lines.report(awkward), lines.report_sql(), documents=awkward)
    assert len(got) == awkward.count()


def test_repeated_chunks_go_once(spark, awkward):
    rows = {r.doc_id: r for r in lines.report(awkward).collect() if r.doc_id is not None}
    assert rows[6].n_cut_lines == 0 and rows[7].n_cut_lines > 18000  # chunks of one line and the last stay
    assert rows[1].n_cut_lines == 0 and rows[2].n_cut_lines == 0  # one line is no chunk
    assert rows[3].text is None and rows[4].text == "" and rows[3].n_lines == 0


def test_hot_passage_stays_in_one_document(spark):
    passage = [f"passage line {i} that all documents share" for i in range(40)]
    texts = ["\n".join([f"head {i}", f"of {i * i}", *passage, f"end {i}", f"tail {i + 7}"]) for i in range(300)]
    rows = lines.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).orderBy("doc_id").collect()
    assert rows[0].n_cut_lines == 0 and all(r.n_cut_lines > 15 for r in rows[5:])
    assert all(f"head {i}\nof {i * i}" in r.text and f"end {i}\ntail {i + 7}" in r.text for i, r in enumerate(rows))


def test_an_inserted_line_shifts_no_boundary(spark):
    common = [f"common line {i * i} with some words" for i in range(60)]
    texts = ["\n".join(common), "\n".join(["something else"] + common[:30] + ["inserted"] + common[30:])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    second = lines.report(rows).where("doc_id = 1").first()
    assert second.n_cut_lines > 35 and "inserted" in second.text and "something else" in second.text


def test_divisors_and_windows_match_sql(spark, same_as_sql, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for i, params in enumerate((lines.LineParams(), lines.LineParams(window=3, divisor=2, min_lines=1, min_chars=1))):
        got = same_as_sql(lines.report(docs, params), lines.report_sql(params), documents=f"{SF}/documents.parquet")
        assert sum(r[1] for r in got) > 0 or i == 0


def test_stage_keeps_rows_and_columns(spark, clashing, empty):
    out = lines.dedup(clashing)
    assert not [c for c in clashing.columns[5:] if out.where(f"`{c}` IS DISTINCT FROM 'extra {c}'").count()]
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert lines.dedup(empty).count() == 0 and lines.report(empty).count() == 0
    assert {r.doc_id: r.n_chars for r in out.collect()}[7] == len({r.doc_id: r.text for r in out.collect()}[7])
    assert not re.search("Python|Pandas|Arrow", lines.report(clashing)._jdf.queryExecution().executedPlan().toString())
