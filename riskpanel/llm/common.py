"""What the operators share: reading a table, walking Arrow batches in small slices, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

SLICE_ROWS = 256
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text_column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``SLICE_ROWS`` rows and, unless one row alone is longer, ``SLICE_BYTES`` of text,
    so that the memory of a task does not depend on how long the texts of a batch are."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text_column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or total + size > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < len(sizes):
            yield batch.slice(start)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no frame has such a column (names are compared without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordHashes(dict):
    """64-bit hashes of words, kept while they last: the most recent ``limit`` distinct words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
