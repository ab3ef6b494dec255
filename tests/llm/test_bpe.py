import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from riskpanel.llm import bpe


@pytest.fixture(scope="module")
def codec():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def test_ids_match_the_library(codec, library):
    rng = random.Random(4)
    signs = "abcXYZ 'stredllvm 012½ \n\t\r\x0b\x1c\x85  éßñ漢字🙂.,;!?#*́ﬁ​"
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", " <|endoftext|> it's"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.unpack(codec.encode(text)).tolist() == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_every_white_space(codec, library):
    for code in (*range(33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF):
        for text in (f"a{chr(code)}b", f"{chr(code) * 3}x", f"x{chr(code)}", f" {chr(code)} y"):
            assert bpe.unpack(codec.encode(text)).tolist() == library.encode(text, add_special_tokens=False).ids, code


def test_long_pieces_and_lone_bytes(codec, library):
    for text in ("a" * 3000, "ab" * 1500 + " " * 500, "é" * 999):
        assert bpe.unpack(codec.encode(text)).tolist() == library.encode(text, add_special_tokens=False).ids
    for ids in ([codec.byte_ids[0xE9]], [codec.byte_ids[b] for b in b"\xf0\x9f\x99"]):
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_of_awkward_rows(spark, awkward, clashing, empty, library):
    got = bpe.round_trip(clashing).collect()
    assert len(got) == awkward.count() and bpe.round_trip(empty).count() == 0
    want = []
    for r in awkward.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, got)) and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_encode_then_decode(spark, awkward):
    back = bpe.decode(bpe.encode(awkward))
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in awkward.collect())
