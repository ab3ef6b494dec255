import re

import numpy as np
import pytest

from riskpanel.llm import quality as Q
from riskpanel.llm.common import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute(text):
    words = WORD.findall(text or "")
    windows, covered = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(3))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


CASES = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "a b c a b c a b", "x y é\x1cz\x0bq", "l\nl\n\nl\n \n", "#*$%&|<> ##", "a a a a"]


@pytest.mark.parametrize("text", CASES)
def test_counts(text):
    assert Q.word_counts(text, WordHashes())[0] == brute(text)


def test_query_counts_and_verdicts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        n = brute(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed and r.p_quality >= 0.5)
    marked = [(got[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None and not got[r.doc_id].base_failed]
    assert np.mean([g.kept == bool(q) for g, q in marked]) > 0.97


def test_training_is_calibrated_on_other_rows():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine", "text", "here"] if y else ["%%%", "$$$", "buy", "text"], 60)) for y in (0, 1) * 100]
    y, held = np.array([0, 1] * 100, float), np.arange(200) % 4 == 0
    model = Q.train(texts, y, held, Q.QualityParams(bits=12, steps=40))
    p = np.array([Q.judge(t, WordHashes(), model, Q.QualityParams(bits=12, max_repeat_percent=100))[-2] for t in texts])
    assert ((p > 0.5) == (y == 1)).mean() > 0.98 and 0 < p.min() and p.max() < 1


def test_awkward_rows(spark, awkward, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (6, None, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = Q.quality(clashing, labels).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_words == 0 and by_id[3].base_failed and not by_id[4].kept and by_id[6].n_words == 200000 - 20000
    kept = Q.keep(clashing, labels)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert Q.quality(empty, labels).count() == 0 and Q.keep(awkward, labels.limit(0)).count() == sum(not r.base_failed for r in rows)


def test_an_id_with_very_many_texts_counts_once(spark):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "concat('text ', id) AS text").unionAll(spark.range(50).selectExpr("id + 100 AS doc_id", "concat('other ', id) AS text"))
    labels = spark.range(150).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    plain = Q.fit(docs.where("doc_id <> 7 OR text = 'text 1'"), labels)
    first = docs.where("doc_id = 7").selectExpr("min_by(text, xxhash64(text)) AS text").first()["text"]
    again = Q.fit(docs.where("doc_id <> 7").unionAll(docs.where(f"doc_id = 7 AND text = '{first}'")), labels)
    whole = Q.fit(docs, labels)
    assert (whole.weights == again.weights).all() and whole.bias == again.bias and plain.weights.shape == whole.weights.shape
