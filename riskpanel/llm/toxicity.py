"""Toxicity by compression distance.

Two zstandard dictionaries share a part trained on ordinary text and differ in the rest: one goes on with text that sets the toxic training
documents apart, the other with as much ordinary text. These parts are lists of single words, chosen by how many texts of a class have them (``distinctive``):
dictionaries trained on windows of the two classes detect less (figures in the README). A text is cut into windows of words, each window is compressed with both, and the
difference of the lengths is its gain: how much shorter toxic text makes it. What both dictionaries know cancels out. How often each gain occurs in a
text, and the largest gains, are calibrated to a probability by a logistic regression on labelled texts that no dictionary was trained on.

Everything is fitted on a bounded sample of labelled rows; all windows of all texts are scored. Only texts are inputs of a score.

Defined cases: NULL, empty and word-less texts have no windows and get the score of that evidence; NULL labels are not used; repeated rows get equal
results; without labelled texts of both classes every score is 0. Further columns are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import slices

LOW, HIGH = -3, 9  # gains are counted from LOW or less to HIGH or more


@dataclass(frozen=True)
class ToxicityParams:
    """``max_toxic`` and ``max_ordinary`` bound the labelled rows that are used; all texts are scored whole."""

    max_toxic: int = 2500
    max_ordinary: int = 5000
    window: int = 12  # words
    level: int = 12
    shared_bytes: int = 65536
    own_bytes: int = 32768
    least_texts: int = 5  # distinctive: in so many texts of its class,
    least_share: float = 0.015  # and in such a share of them,
    ratio: float = 30.0  # and there so many times as frequent as in the other class
    folds: int = 3
    l2: float = 1e-3


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    params: ToxicityParams


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def windows(found: list[bytes], size: int) -> list[bytes]:
    return [b" " + b" ".join(found[i:i + size]) + b" " for i in range(0, len(found), size)]


class Distance:
    """Gains of windows under the dictionaries of a model."""

    def __init__(self, ordinary: bytes, toxic: bytes, params: ToxicityParams):
        def compressor(content: bytes):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=params.level)
            return zstandard.ZstdCompressor(level=params.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.ordinary, self.toxic, self.size = compressor(ordinary), compressor(toxic), params.window

    def features(self, text: str | None) -> np.ndarray:
        pieces = windows(words(text), self.size)
        n = len(pieces)
        first, second = self.ordinary, self.toxic
        gains = np.fromiter((len(first(w)) - len(second(w)) for w in pieces), np.int64, n)
        bins = np.bincount(np.clip(gains, LOW, HIGH) - LOW, minlength=HIGH - LOW + 1)
        top = np.sort(gains)[-3:] if n else np.zeros(1)
        clipped = np.clip(gains, -6, 12)
        return np.array([*np.sqrt(bins / max(1, n)), np.log1p(n), top.max(), top.mean(), clipped.mean() if n else 0.0, bins[5 - LOW:].sum() / max(4, n)])


def distinctive(own: Counter, n_own: int, other: Counter, n_other: int, params: ToxicityParams) -> list[bytes]:
    """Words that set texts of a class apart, the most frequent last: zstandard finds the end of a dictionary at the least cost."""
    found = [(c, w) for w, c in own.items() if c >= max(params.least_texts, params.least_share * n_own) and c * n_other >= params.ratio * (other[w] + 0.5) * n_own]
    return [w for _, w in sorted(found)]


def cut(listed: list[bytes], size: int) -> bytes:
    return (b" " + b" ".join(listed) + b" ")[-size:]


def dictionaries(found: list[list[bytes]], toxic: np.ndarray, params: ToxicityParams) -> tuple[bytes, bytes]:
    """(ordinary, toxic) content from the words of labelled texts."""
    counts = {label: Counter() for label in (0, 1)}
    for w, label in zip(found, toxic, strict=True):
        counts[int(label)].update(set(w))
    n = {label: int((toxic == label).sum()) for label in (0, 1)}
    listed = distinctive(counts[1], n[1], counts[0], n[0], params)
    toxic_part = cut(listed, params.own_bytes)
    ordinary_part = cut(distinctive(counts[0], n[0], counts[1], n[1], params)[-len(listed):] if listed else [], params.own_bytes)
    # zstandard's trainer picks the shared part from ordinary words, one sample for each text that has the word.
    samples = [b" " + w + b" " for f, label in zip(found, toxic, strict=True) if label == 0 for w in dict.fromkeys(f)]
    try:
        shared = zstandard.train_dictionary(params.shared_bytes, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: the samples themselves
        shared = b"".join(samples)[-params.shared_bytes:]
    fill = b" " * max(0, len(toxic_part) - len(ordinary_part))
    return shared + fill + ordinary_part, shared + toxic_part


def train(texts: list[str], toxic: np.ndarray, fold: np.ndarray, params: ToxicityParams) -> ToxicityModel:
    """Each fold is scored with dictionaries trained on the others, which calibrates; the dictionaries of the model are trained on all."""
    found = [words(t) for t in texts]
    xs, ys = [], []
    for f in sorted(set(fold.tolist())):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(set(toxic[rest].tolist())) == 2:
            distance = Distance(*dictionaries([found[i] for i in rest], toxic[rest], params), params)
            xs += [distance.features(texts[i]) for i in own]
            ys += [toxic[i] for i in own]
    if len(set(ys)) < 2:
        return ToxicityModel(b" ", b" ", np.array([-1e9]), np.zeros(0), np.ones(0), params)
    x, y = np.array(xs), np.array(ys, float)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.hstack([(x - centre) / spread, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps, damped by the penalty
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        ridge = params.l2 * len(x) * np.eye(len(b))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ b)
        b -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return ToxicityModel(*dictionaries(found, toxic, params), b, centre, spread, params)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.distance = model, Distance(model.ordinary, model.toxic, model.params)

    def score(self, text: str | None) -> float:
        m = self.model
        if not len(m.centre):
            return 0.0
        z = float(((self.distance.features(text) - m.centre) / m.spread) @ m.weights[:-1] + m.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is in the fold that nothing is learnt from. A NULL id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Trains on the labelled rows with the smallest hashes of ``doc_id``, at most the bounded number of each class, in one task on an
    executor; the model, of bounded size, comes to the driver."""
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    sample = None
    for label, most in ((1, params.max_toxic), (0, params.max_ordinary)):
        part = usable.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)
        sample = part if sample is None else sample.unionAll(part)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")  # bounded by the parameters
        .groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text of an id that repeats, so the bound holds
        .select("text", "toxic", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(params.folds)).alias("fold")).distinct().repartition(1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        got.sort(key=lambda r: (r["fold"], r["text"], r["toxic"]))
        model = train([r["text"] for r in got], np.array([r["toxic"] for r in got]), np.array([r["fold"] for r in got]), params)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    found = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0, int), np.zeros(0, int), params)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score``, ``predicted``: one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, "text"):
            scores = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                                             ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``; learns only from labels outside the held-out fold."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), params)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
