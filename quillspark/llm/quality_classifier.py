"""Quality classifier: zstandard dictionaries of good and of bad text, and how much better each compresses.

From labelled documents (at most `rows_a_class` of each label, chosen by a hash of the id) one part
builds two dictionaries, the other calibrates. A text is compressed piece by piece with each
dictionary; the difference of the two sizes over the larger is its normalised difference, and a
logistic curve over it (with the text's own compressibility, which says how far the difference
can be trusted) gives the score.

Defined results: null and empty texts score what the labels' share gives; a text of any length is
compressed whole; if a label is missing from the training rows, all scores are the share of label 1
(0.5 without any row); repeated rows are scored separately; an empty table gives no rows; null
labels are not learned from; other columns are ignored by `score_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_sample, labelled_fold, small_batches, table

PIECE = 1_024
LEVEL = 3


@dataclass
class CompressionModel:
    good: bytes | None
    bad: bytes | None
    weights: np.ndarray
    prior: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        return tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
                     for d in (self.good, self.bad))


def pieces(text: str) -> list[bytes]:
    """The whole text in pieces, so that the dictionary counts throughout."""
    data = text.encode("utf-8", "surrogatepass")
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def compressed_sizes(text: str | None, compressors: tuple) -> tuple[int, int, int]:
    """Bytes of the text, and compressed with each dictionary (without what an empty piece takes)."""
    if not text:
        return 0, 0, 0
    parts = pieces(text)
    good, bad = compressors
    frame = len(good.compress(b"")) * len(parts)
    return sum(map(len, parts)), max(0, sum(len(good.compress(p)) for p in parts) - frame), max(0, sum(len(bad.compress(p)) for p in parts) - frame)


def _features(sizes: np.ndarray) -> np.ndarray:
    """Columns: 1, normalised difference, the same by compressibility, compressibility and its square."""
    raw, good, bad = sizes.T.astype(np.float64)
    d = (bad - good) / np.maximum(np.maximum(bad, good), 1)
    r = np.minimum(good, bad) / np.maximum(raw, 1)
    sure = raw / (raw + 100)  # a few words say little
    d, r = 10 * d * sure, 4 * (r - 0.4) * sure
    return np.stack([np.ones(len(raw)), d, d * r, r, r * r], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(documents: DataFrame, labels: DataFrame, rows_a_class: int = 1_500, dictionary_bytes: int = 65_536) -> CompressionModel:
    """From documents (doc_id, text) and labels (doc_id, quality 0 or 1); the sample's ids are few enough to broadcast."""
    usable = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    shares = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    ids = bounded_sample(usable, "doc_id", rows_a_class, "quality")
    some = documents.filter(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    kept: dict[int, list[str]] = {0: [], 1: []}
    for r in some.toLocalIterator():
        kept[r.quality].append(r.text)
    for texts in kept.values():
        texts.sort()  # whatever order the rows came in
        np.random.default_rng(11).shuffle(texts)
    if min(map(len, kept.values())) < 8:
        return CompressionModel(None, None, np.zeros(5), prior)
    halves = {k: (v[::2], v[1::2]) for k, v in kept.items()}
    dictionaries = []
    for k in (1, 0):
        samples = [p for t in halves[k][0] for p in pieces(t)]
        size = min(dictionary_bytes, max(1_024, sum(map(len, samples)) // 8))
        try:
            dictionaries.append(zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too few samples to train on: their own bytes
            dictionaries.append(b"".join(samples)[-dictionary_bytes:])
    model = CompressionModel(*dictionaries, np.zeros(5), prior)
    two = model.compressors()
    sizes, y = [], []
    for k, (_, texts) in halves.items():
        sizes += [compressed_sizes(t, two) for t in texts]
        y += [k] * len(texts)
    x, y = _features(np.array(sizes)), np.array(y, np.float64)
    model.weights = _logistic(x, y)
    # the sample is even, the labels are not: shift the odds to the labels' shares
    if 0 < prior < 1:
        model.weights[0] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return model


def score_quality(documents: DataFrame, model: CompressionModel, good_from: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, and the three sizes the score comes from."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        two = model.compressors() if model.good else None
        for pdf in batches:
            sizes = np.array([compressed_sizes(t, two) if two else (0, 0, 0) for t in pdf["text"]], np.int64).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(_features(sizes) @ model.weights, -30, 30)))
            score = np.where(sizes[:, 0] > 0, score, model.prior)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "predicted": (score >= good_from).astype(np.int32),
                                "bytes": sizes[:, 0], "bytes_good": sizes[:, 1], "bytes_bad": sizes[:, 2]})

    return small_batches(documents.select("doc_id", "text")).mapInPandas(
        scan, "doc_id long, score double, predicted int, bytes long, bytes_good long, bytes_bad long")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    train = table(spark, sf_dir, "labels").filter(labelled_fold(F.col("doc_id"), 5) != 0).select("doc_id", "quality")
    model = fit_quality(documents, train)
    return score_quality(documents, model).select(
        "doc_id", (labelled_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
