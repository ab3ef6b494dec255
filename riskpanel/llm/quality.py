"""Quality rules: counts that reject plain junk, then a hashed n-gram logistic regression for the rest.

The classifier sees relative frequencies of hashed word 1- and 2-grams and character 3- and 4-grams of the whole text. It is
trained on a bounded sample of labelled rows, calibrated to probabilities on rows it was not trained on, and scored in Arrow
batches against a fixed threshold.

Defined cases: a NULL or empty text has no words and fails the base rules; a NULL label is not used; a label without a document is
ignored; repeated rows get the same result each; tables without usable labels give a model that keeps what passes the base rules.
Only ``doc_id`` and ``text`` of a document are read, so further columns cannot clash with the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import WordHashes, mix64, slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
SCALE = 30.0  # a slot met c times in n grams of its kind has the value SCALE * c / n
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
         "base_failed boolean, p_quality double, kept boolean"


@dataclass(frozen=True)
class QualityParams:
    """``max_labelled`` bounds the rows the classifier is trained on; everything else covers all data."""

    bits: int = 16
    max_labelled: int = 2500
    calibration_share: int = 4  # one labelled row in so many calibrates instead of training
    steps: int = 80
    rate: float = 0.5
    l2: float = 1e-6
    threshold: float = 0.5  # reject below this calibrated probability of good quality
    min_words: int = 50
    max_repeat_percent: int = 50


@dataclass
class QualityModel:
    weights: np.ndarray  # float32, two blocks of 2^bits: word n-grams, character n-grams
    bias: float
    scale: float  # calibration: p = sigmoid(scale * z + shift)
    shift: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def word_counts(text: str | None, hashes: WordHashes) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """The five base counts of a text and the hashes of its words."""
    if not text:
        return (0, 0, 0, 0, 0), np.zeros(0, np.uint64)
    words = text.encode().split()  # of bytes: splits at the six ASCII white space characters only
    h = hashes.of(words)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = 0
    if n > 3:
        ids = np.unique(h, return_inverse=True)[1].astype(np.int64)
        size = int(ids.max()) + 1
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:] if size < 2_000_000 else mix64(
            mix64(h[:-2]) + np.uint64(3) * mix64(h[1:-1] + np.uint64(1)) + np.uint64(5) * h[2:])
        _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= twice
        repeats = int(covered.sum())
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats), h


def word_ngrams(h: np.ndarray, bits: int) -> np.ndarray:
    """Slots of the 1- and 2-grams."""
    shift = np.uint64(64 - bits)
    return np.concatenate([mix64(h) >> shift, mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> shift]).astype(np.int64)


def char_ngrams(text: str, bits: int) -> np.ndarray:
    """Slots of the 3- and 4-grams of characters; the text is framed by a zero on either side."""
    c = np.frombuffer(f"\0{text}\0".encode("utf-32-le", "surrogatepass"), np.uint32)
    p, shift = np.uint32(0x01000193), np.uint32(32 - bits)
    three = (c[:-2] * p + c[1:-1]) * p + c[2:]
    four = three[:-1] * p + c[3:] + np.uint32(0x9E3779B9)
    return np.concatenate([(x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> shift for x in (three, four)]).astype(np.int64)


def train(texts: list[str], y: np.ndarray, held: np.ndarray, params: QualityParams) -> QualityModel:
    """Full-batch gradient steps with class weights on the rows not ``held``; the held rows calibrate."""
    size = 2 << params.bits
    if len(set(y[~held])) < 2:
        return QualityModel(np.zeros(size, np.float32), 0.0, 1.0, 30.0)
    hashes, index, value, start = WordHashes(), [], [], [0]
    for text in texts:
        parts = [(word_ngrams(hashes.of(text.encode().split()), params.bits), 0), (char_ngrams(text, params.bits), 1 << params.bits)]
        for slots, offset in parts:
            slot, count = np.unique(slots, return_counts=True)
            index.append((slot + offset).astype(np.int32))
            value.append((SCALE * count / max(1, len(slots))).astype(np.float32))
        start.append(start[-1] + len(index[-1]) + len(index[-2]))
    idx, val = np.concatenate(index), np.concatenate(value)
    row = np.repeat(np.arange(len(texts)), np.diff(start))
    use = ~held
    weight = np.where(y == 1, 0.5 / max(1, (y[use] == 1).sum()), 0.5 / max(1, (y[use] == 0).sum())) * use
    w, bias, g2 = np.zeros(size), 0.0, np.full(size, 1e-8)
    for _ in range(params.steps):
        z = np.bincount(row, w[idx] * val, len(texts)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        gradient = np.bincount(idx, val * error[row], size) + params.l2 * w
        g2 += gradient * gradient
        w -= params.rate * gradient / np.sqrt(g2)
        bias -= params.rate * float(error.sum())
    z = np.bincount(row, w[idx] * val, len(texts)) + bias
    scale, shift = platt(z[held], y[held])
    return QualityModel(w.astype(np.float32), float(bias), scale, shift)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic calibration, by damped Newton steps towards smoothed targets."""
    if len(set(y)) < 2:
        return 1.0, 0.0
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    size = float(np.std(z)) or 1.0
    x, b = np.stack([z / size, np.ones_like(z)]), np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        u = b @ x
        return float((np.logaddexp(0, u) - t * u).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - t))
        rate, now = 1.0, loss(b)
        while rate > 1e-6 and loss(b - rate * step) > now:
            rate /= 2
        b = b - rate * step
    return float(b[0]) / size, float(b[1])


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Trains on at most ``max_labelled`` labelled rows, those with the smallest hashes of ``doc_id``. One task on an executor does
    it, on that bounded sample; only the weights, of fixed size, come to the driver."""
    order = F.xxhash64(F.col("doc_id"), F.lit(1))
    sample = (
        labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
        .orderBy(order, "doc_id", "quality").limit(params.max_labelled)
    )
    rows = (
        docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")  # bounded by max_labelled
        .groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text of an id that repeats, so the bound holds
        .select("doc_id", "text", "quality", (F.pmod(order, F.lit(params.calibration_share)) == 0).alias("held"))
        .repartition(1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        got.sort(key=lambda r: (r["doc_id"], r["text"]))
        model = train([r["text"] for r in got], np.array([r["quality"] for r in got], float), np.array([r["held"] for r in got], bool), params)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    found = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0), np.zeros(0, bool), params)


def judge(text: str | None, hashes: WordHashes, model: QualityModel, params: QualityParams) -> tuple:
    """The five counts, ``base_failed``, the probability (None where the base rules decide) and ``kept`` of one text."""
    counts, h = word_counts(text, hashes)
    if counts[0] < params.min_words or 100 * counts[4] > params.max_repeat_percent * counts[0]:
        return *counts, True, None, False
    z, block = model.bias, 1 << params.bits
    for slots, offset in ((word_ngrams(h, params.bits), 0), (char_ngrams(text, params.bits), block)):
        z += SCALE * float(model.weights[offset + slots].sum(dtype=np.float64)) / max(1, len(slots))
    p = float(model.probability(np.array(z)))
    return *counts, False, p, p >= params.threshold


def score(docs: DataFrame, model: QualityModel, params: QualityParams = QualityParams()) -> DataFrame:
    """One row per document row: the base counts, ``base_failed``, the calibrated probability (NULL where the base rules
    decide) and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two blocks of 2^bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            judged = [judge(t, hashes, shared.value, params) for t in batch.column("text").to_pylist()]
            columns = list(zip(*judged, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    return score(docs, fit(docs, labels, params), params)


def keep(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns: the stage of a pipeline. The verdict is attached to each
    row in the same pass, without a join."""
    model = fit(docs, labels, params)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            verdicts = [judge(t, hashes, shared.value, params)[-1] for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
