import hashlib
import struct

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskpanel.llm import bpe, lines, minhash, mixing, quality

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.llm.QUERIES)
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert names <= set(entry.queries()) and set(entry.llm.ORACLES) <= names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(spark.createDataFrame(stage(spark, tables[-1], SF).collect(), docs.schema))
        assert tables[-1].columns == columns
    good, cut, single, mixed = tables[1:]
    verdict = {r.doc_id for r in quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdict and 0 < len(verdict) < docs.count()
    texts = {r.doc_id: r.text for r in lines.report(good).collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == texts
    kept = {r.doc_id for r in minhash.near_duplicates(cut).where("kept").collect()}
    assert {r.doc_id for r in single.collect()} == kept
    drawn = {r.doc_id: r["count"] for r in mixing.report(single).groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == drawn


def test_run_encodes_what_is_left(spark):
    library = Tokenizer.from_file(bpe.default_path())
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").where(F.lit(False)).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
