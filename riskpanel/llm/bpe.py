"""Byte-pair encoding and decoding with the files of a public tokenizer.

A text is cut by the pattern of byte-level tokenizers; each piece becomes a doubly linked list of byte symbols, and a priority
queue of merge ranks joins neighbours until none is left, skipping entries whose pair has changed meanwhile. Decoding
concatenates the vocabulary strings of the ids. Nothing is trained, and the vocabulary file stays where it is: its path is a
parameter, its content (a fixed size) is broadcast.

Defined cases: a NULL text counts as empty and has no ids; the strings of special tokens in a text become their ids; any other
text decodes to itself; bytes that are not UTF-8 after decoding arbitrary ids become U+FFFD; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import slices

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed by the published byte-level tokenizers, with white space spelled out (Unicode White_Space).
PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
CACHE = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, content: str):
        spec = json.loads(content)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.byte_ids = [0] * 256
        for i, s in enumerate(self.strings):
            if len(s) == 1:
                self.byte_ids[s[0]] = i
        self.ranks: dict[int, int] = {}  # left << 32 | right -> rank
        self.joined: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.joined.append(vocab[left + right])
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, bytes] = {}  # packed ids of recent pieces, in two generations of at most CACHE each
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = list(map(self.byte_ids.__getitem__, piece))
        n, rank_of, joined = len(ids), self.ranks.get, self.joined
        ids.append(-1)  # ends the list: no pair has a negative symbol
        after, before = list(range(1, n + 1)), list(range(-1, n))
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            left = ids[i]
            if left < 0 or rank_of(left << 32 | ids[j := after[i]]) != rank:
                continue  # stale: the symbol was swallowed, or its pair changed; a rank names one pair
            ids[i] = left = joined[rank]
            ids[j] = -1
            k = after[i] = after[j]
            before[k] = i
            if (r := rank_of(left << 32 | ids[k])) is not None:
                heappush(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] << 32 | left)) is not None:
                heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        packed = array("I", self.merge(piece.encode()))
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts, at = [], 0
        for hit in self.cut.finditer(text) if self.cut else ():
            parts += [self._ordinary(text[at:hit.start()]), self.special[hit.group()].to_bytes(4, "little")]
            at = hit.end()
        parts.append(self._ordinary(text[at:] if at else text))
        return b"".join(parts)

    def _ordinary(self, text: str) -> bytes:
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        known, pieces = self.known, self.pieces.findall(text)
        out = list(map(known.get, pieces))
        if None in out:
            for i, piece in enumerate(pieces):
                if out[i] is None:
                    out[i] = found = known.get(piece) or self.older.get(piece) or self._packed(piece)
                    if len(piece) <= 64:
                        known[piece] = found
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def unpack(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_codecs: dict[int, Codec] = {}


class SharedCodec:
    """A vocabulary sent once to every executor and parsed once in each of its Python processes."""

    def __init__(self, df: DataFrame, path: str):
        with open(path, encoding="utf-8") as f:
            self.content = df.sparkSession.sparkContext.broadcast(f.read())

    def get(self) -> Codec:
        key = hash(self.content.value)
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(self.content.value)
        return _codecs[key]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) of every whole text."""
    shared = SharedCodec(docs, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for batch in slices(batches, "text"):
            ids = [unpack(codec.encode(t or "")).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` from ``ids``; NULL ids count as none."""
    shared = SharedCodec(encoded, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                texts = [codec.decode(x or ()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass and returns digests of both, so that neither ids nor texts are stored."""
    shared = SharedCodec(docs, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for batch in slices(batches, "text"):
            n, ids, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                packed = codec.encode(text or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(unpack(packed)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROUND_TRIP)
