"""Text quality by compression: which of two dictionaries makes a text smaller."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.scratch import Scratch

#: Labelled documents of each class that the model is fitted on, at most about.
FIT_DOCS = 8_000
#: Bytes that are compressed at once, so that a long text is judged by the dictionary
#: throughout and not by what it has said before.
CHUNK_BYTES = 512
DICTIONARY_BYTES = 1 << 16
LEVEL = 3


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves if they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of texts under the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.compressors = [self._compressor(d) for d in (good, bad, b"")]

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
        if len(dictionary) < 8:
            return zstandard.ZstdCompressor(**options)
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, **options)

    def features(self, text: bytes | None) -> tuple[float, ...]:
        """Size difference bad - good by plain size: of the text, least and most of a chunk;
        plain size by length; log of the length. All are zero for null and empty texts."""
        if not text:
            return 0.0, 0.0, 0.0, 0.0, 0.0
        chunks = range(0, len(text), CHUNK_BYTES)
        sizes = [[len(c.compress(text[k : k + CHUNK_BYTES])) for c in self.compressors] for k in chunks]
        good, bad, plain = np.array(sizes, float).T
        difference = (bad - good) / plain
        whole = (bad.sum() - good.sum()) / plain.sum()
        return whole, difference.min(), difference.max(), plain.sum() / len(text), np.log(len(text))


@dataclass
class Model:
    good: bytes
    bad: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_design(features, self.center, self.scale) @ self.weights))


def _design(features: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their products, and one."""
    x = np.clip((features - center) / scale, -8, 8)
    k = x.shape[1]
    products = [x[:, i] * x[:, j] for i in range(k) for j in range(i, k)]
    return np.column_stack([np.ones(len(x)), x, *products])


def _calibrate(features: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logistic regression by Newton steps, with a ridge."""
    center, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = _design(features, center, scale)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1e-3 * weight.sum())
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (labels - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return center, scale, w


_FEATURES = T.ArrayType(T.DoubleType())


def _features(text: Column, good: bytes, bad: bytes) -> Column:
    @F.pandas_udf(_FEATURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = Sizes(good, bad)
        for batch in batches:
            yield pd.Series([list(sizes.features(text)) for text in batch])

    return measured(text.cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """A model of ``docs(doc_id, text)`` with ``labels(doc_id, quality)``, 1 good and 0 bad.

    Drawn by hash, at most about ``fit_docs`` documents of each class. Half of them give one
    chunk each to the dictionary of their class, the others calibrate the score, weighted by
    how often their class occurs among all labels. Null labels, ids and texts are passed over.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    counts = {row.quality: row.n for row in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    share = F.lit(0.0)
    for quality, n in counts.items():
        share = F.when(F.col("quality") == quality, F.lit(min(1.0, fit_docs / n) * (1 << 30))).otherwise(share)
    drawn = known.withColumn("draw", draw).where(F.col("draw") < share)
    texts = docs.where("text <> ''").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    # About 2 * fit_docs rows of three numbers at any size of the corpus, so no text is moved.
    sample = texts.join(F.broadcast(drawn), F.col("id") == F.col("doc_id"))
    sample = sample.select("doc_id", "quality", "draw", "text")
    sample = Scratch(docs.sparkSession).table(sample, "labelled")
    number = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.ceil(F.length("text") / CHUNK_BYTES))
    chunk = F.substring("text", (number * CHUNK_BYTES + 1).cast("int"), F.lit(CHUNK_BYTES))
    rows = sample.where("draw % 2 = 0").select("doc_id", "quality", chunk.alias("chunk")).orderBy("doc_id", "chunk").collect()
    good, bad = (_dictionary([bytes(row.chunk) for row in rows if row.quality == q]) for q in (1, 0))
    rest = sample.where("draw % 2 = 1").select("doc_id", "quality", _features(F.col("text"), good, bad).alias("x"))
    rows = rest.orderBy("doc_id", "quality").collect()
    if not rows:
        prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        weights = np.zeros(21)
        weights[0] = np.log(prior / (1 - prior))
        return Model(good, bad, np.zeros(5), np.ones(5), weights)
    y = np.array([row.quality for row in rows], float)
    seen = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    weight = np.array([counts[row.quality] / seen[row.quality] for row in rows])
    return Model(good, bad, *_calibrate(np.array([row.x for row in rows]), y, weight / weight.mean()))


def score(text: Column, model: Model) -> Column:
    """How likely label 1 is for a whole text, 0 to 1. Null counts as an empty text, for
    which all features are zero."""

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            features = np.array([sizes.features(text) for text in batch]).reshape(-1, 5)
            yield pd.Series(model.scores(features))

    return scored(F.coalesce(text, F.lit("")).cast("binary"))
