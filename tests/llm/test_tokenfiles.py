import random
import struct
import zlib
from pathlib import Path

import pytest
from pyarrow import orc
from tokenizers import Tokenizer

from riskpanel.llm import bpe, tokenfiles


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return tokenfiles.Encoder(f.read())


def brute(rows, library):
    """(doc_id, start, n_tokens, crc) in ascending doc_id; for unique doc_ids."""
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_encoder_is_the_library(encoder, library):
    assert encoder.fast is not None  # every vocabulary string ends as its own id
    rng = random.Random(5)
    signs = "abcXYZ 'stredllvm 012½ \n\t\r\x0b\x1c\x85  éßñ漢字🙂.,;!?#*́ﬁ​"
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", " <|endoftext|> it's"])
        assert encoder.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    for text in ("a" * 3000, " " * 2500 + "x", "ab" * 1500 + " " * 500, "\x1c" * 2000):
        assert encoder.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_vocabulary_that_tiktoken_cannot_take():
    import json

    byte = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    n = len(byte)
    # "abc" is made of a and bc, but ab comes first: alone it ends as ab, c.
    vocab = byte | {"ab": n, "bc": n + 1, "abc": n + 2}
    content = json.dumps({"model": {"vocab": vocab, "merges": ["a b", "b c", "a bc"]}, "added_tokens": []})
    encoder = tokenfiles.Encoder(content)
    assert encoder.fast is None and encoder.encode("abc").tolist() == [n, byte["c"], 0]


def test_awkward_rows(spark, awkward, clashing, empty, library):
    got = tokenfiles.report(clashing.withColumns({c: clashing["lang"] for c in ("ids", "shard", "start", "place", "n_tokens", "_last")})).collect()
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert tokenfiles.report(empty).count() == 0 and len(got) == len(rows)
    plain = sorted((str(d), n, crc) for d, _, n, crc in brute(rows, library))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == plain
    got.sort(key=lambda r: r.start)  # the files leave no gap and keep the order
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))


def test_documents_match_brute_force(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in tokenfiles.report(docs.repartition(5)).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], library)


def test_files_are_pruned(spark, tmp_path):
    docs = spark.range(0, 40000, 2).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    path = str(tmp_path / "orc")
    tokenfiles.write(docs, path, tokenfiles.TokenFileParams(stripe_bytes=1 << 16, index_rows=1000))
    files = [orc.ORCFile(p) for p in sorted(Path(path).glob("*.orc"))]
    assert sum(f.nstripes for f in files) > len(files) and sum(f.nrows for f in files) == 20000

    def rows_read(frame):
        frame.collect()
        node = frame._jdf.queryExecution().executedPlan()
        while not node.nodeName().startswith("Scan"):
            node = node.children().apply(0)
        return node.metrics().apply("numOutputRows").value()

    scan = spark.read.schema(tokenfiles.FILE).orc(path).select("doc_id", "ids")
    assert rows_read(scan) == 20000
    assert rows_read(scan.where("doc_id BETWEEN 100 AND 200")) <= 2000  # statistics
    assert rows_read(scan.where("doc_id = 20001")) <= 1000  # inside the range, but not in the Bloom filters
    assert [r.doc_id for r in tokenfiles.read(spark, path, [4, 5, 39998]).orderBy("doc_id").collect()] == [4, 39998]
