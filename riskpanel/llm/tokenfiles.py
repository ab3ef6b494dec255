"""Token ids as ORC files that can be read by stripes and by document.

Documents are dealt out by ranges of ``doc_id`` and encoded in that order; every task writes one file (a shard), so the files in the order of their
shards hold all documents in ascending order. Spark's ORC writer keeps the ids as run-length encoded integers in stripes, with statistics for every
stripe and every ``index_rows`` rows, and Bloom filters on ``doc_id``. A filter on ``doc_id`` is pushed down to these, so a reader skips stripes and row
groups, and a large file is read by several tasks, each with its own stripes. A row also holds its place in its shard; the first id of
a shard is the sum of the shards before it, one row each, read from the column of counts alone.

Ids are those of the tokenizers library. They are computed by tiktoken, which looks up the joined string instead of the pair of symbols. The two agree
on every text if each vocabulary string, encoded alone, ends as its own id: as long as only merges inside the string's bytes happen, they happen in the same
order as alone, so its pair is the one the file names. ``Encoder`` tests this for the whole vocabulary and otherwise uses ``bpe.Codec``, which also takes texts
with very long pieces.

Defined cases: a NULL or empty text has only the end id; rows with a NULL ``doc_id`` come first; rows with the same ``doc_id`` follow each other in the
order of a hash of their texts, and equal rows repeat; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.llm.bpe import PIECES, WHITE, Codec, default_path, unpack
from riskpanel.llm.common import slices
from riskpanel.llm.order import in_order
from riskpanel.session import materialize, scratch_path

LONG = 1000  # characters; longer pieces go to the heap of the codec
FILE = "doc_id long, shard int, place long, n_tokens long, ids array<int>"


@dataclass(frozen=True)
class TokenFileParams:
    end_id: int = 0
    stripe_bytes: int = 16 << 20
    index_rows: int = 1000
    false_positives: float = 0.01
    compression: str = "zstd"


class Encoder:
    def __init__(self, content: str, end_id: int = 0):
        self.codec = Codec(content)
        special = set(self.codec.special.values())
        ranks = {s: i for i, s in enumerate(self.codec.strings) if i not in special}
        self.end = np.array([end_id], "<u4")
        self.spaces = re.compile(f"[{WHITE}]{{{LONG}}}")
        self.fast = None
        ordered = self.codec.joined == sorted(self.codec.joined)
        if ordered and len(ranks) == len(self.codec.strings) - len(special) and all(self.codec.merge(s) == [i] for s, i in ranks.items()):
            self.fast = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.codec.special)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text and the end id."""
        words = text.encode().split()  # at ASCII white space, so a piece that is not white space lies within a word
        if self.fast and max(map(len, words), default=0) < LONG and not self.spaces.search(text):
            ids = self.fast.encode_to_numpy(text, allowed_special="all")
        else:
            ids = unpack(self.codec.encode(text))
        return np.concatenate([np.asarray(ids, "<u4"), self.end])


_encoders: dict[int, Encoder] = {}


def write(docs: DataFrame, path: str, params: TokenFileParams = TokenFileParams(), vocabulary: str | None = None) -> None:
    """Writes the ids of all ``docs`` as ORC files, a shard each."""
    with open(vocabulary or default_path(), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((content.value, params.end_id))
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(content.value, params.end_id)
        encoder, place = _encoders[key], 0
        for batch in slices(batches, "text"):
            ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), pa.array(place + ends[:-1]), pa.array(n), lists],
                                             ["doc_id", "shard", "place", "n_tokens", "ids"])
            place += int(ends[-1])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = in_order(texts, [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]).withColumn("shard", F.spark_partition_id())
    (
        texts.mapInArrow(run, FILE).write.option("compression", params.compression).option("orc.stripe.size", params.stripe_bytes)
        .option("orc.row.index.stride", params.index_rows).option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", params.false_positives).orc(path)
    )


def read(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``; with ``doc_ids`` only these documents, found by the
    statistics and Bloom filters of the files. Runs jobs when called: the sums before the shards are written, so that their size is known."""
    files = spark.read.schema(FILE).orc(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    shards = materialize(shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")), "token_shards")
    rows = files if doc_ids is None else files.where(F.col("doc_id").isin(list(doc_ids)))
    return rows.join(shards, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def checksums(read_back: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_back.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, params: TokenFileParams = TokenFileParams(), vocabulary: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and returns what is read back from them. Runs jobs when called."""
    path = scratch_path(docs.sparkSession, "token_files")
    write(docs, path, params, vocabulary)
    return checksums(read(docs.sparkSession, path))
