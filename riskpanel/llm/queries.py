"""The registered queries of the subpackage: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from pyspark.sql import functions as F

from riskpanel.llm import bpe, chat, lines, merkle, minhash, mixing, pii, quality, sharding, tokenfiles, topk, toxicity, trie
from riskpanel.llm.common import table

QUERIES = {}
ORACLES = {}


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules")
def op1(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_bpe_round_trip")
def op2(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_top_k_search", TOP_K_SQL)
def op4(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op5_pii_pseudonyms", pii.report_sql())
def op5(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query("op6_line_dedup", lines.report_sql())
def op6(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


@query("op7_sharding", sharding.place_sql())
def op7(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"))).select("doc_id", "slot", "shard")


@query("op8_minhash_near_dedup")
def op8(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.NearParams(words=3, percent=85))


@query("op9_source_mixing", mixing.report_sql())
def op9(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op10_chat_formatting", chat.render_sql())
def op10(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op11_token_files")
def op11(spark, sf_dir):
    return tokenfiles.report(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", merkle.report_sql())
def op12(spark, sf_dir):
    return merkle.report(table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", trie.prefix_trie_sql())
def op13(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
