"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_table, small_batches, text_bytes

FEATURES = ("size", "word_length", "symbols", "capitals", "digits", "breaks", "repeats", "runs", "variety")
#: Shrinkage of a class covariance towards its scaled identity, and a floor of the variances.
SHRINKAGE, FLOOR = 0.1, 1e-3
THRESHOLD = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER, _DIGIT, _SYMBOL, _PLAIN = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_PLAIN[list(b".,;:'\"()-")] = True
_SYMBOL[0x21:0x7F] = True
_SYMBOL &= ~(_UPPER | _DIGIT | _PLAIN)
_SYMBOL[0x61:0x7B] = False


def statistics(data: bytes) -> tuple[float, ...]:
    """The features of a text's UTF-8 bytes. Ratios go through log((a + c) / (n + k)), so that short and empty texts stand
    near the middle instead of at 0 or 1."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n, m = len(data), len(words)
    share = lambda a, b, c: math.log((a + c) / (b + 40 * c))
    kinds = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    dense = int(counts[~_SPACE].sum())
    return (
        math.log1p(m),
        math.log((dense + 10) / (m + 2)),
        share(int(counts[_SYMBOL].sum()), dense, 1.0),
        share(int(counts[_UPPER].sum()), dense, 1.0),
        share(int(counts[_DIGIT].sum()), dense, 1.0),
        share(int(counts[10]), m, 0.5),
        share(m - kinds, m, 0.5),
        share(same, m, 0.25),
        math.log((kinds + 3) / (math.sqrt(m) + 3)) if n else 0.0,
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each whole text; null counts as empty. Row-wise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in rows.T]], ["doc_id", *FEATURES])

    return small_batches(docs).select(F.col("doc_id").cast("long"), text_bytes().alias("data")).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass(frozen=True)
class Gaussian:
    """A class: log prior minus half the log determinant, mean, and the inverse of the covariance's Cholesky factor."""

    offset: float
    mean: tuple[float, ...]
    whiten: tuple[tuple[float, ...], ...]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", shrinkage: float = SHRINKAGE, floor: float = FLOOR, by_fold: bool = True, measured: DataFrame | None = None) -> dict[int, Gaussian]:
    """Class Gaussians from all labelled rows outside the held-out fold.

    Rows of a doc_id with several labels count once with the largest; null ids and null labels teach nothing. Only the
    sums of the features and of their products come to the driver: two rows. The features are logarithms of a few units, so the
    sums cancel little. Repeated documents count as often as they stand. ``measured``: the features of ``docs``, if known.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    if by_fold:
        known = known.where(~held_out(F.col("l_id")))
    rows = (measured if measured is not None else features(docs)).join(known, F.col("doc_id") == F.col("l_id"))
    d = len(FEATURES)
    sums = [F.sum(f).alias(f"s_{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1)]
    found = rows.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect()
    total = sum(r.n for r in found)
    model = {}
    for r in found:
        mean = np.array([r[f"s_{i}"] for i in range(d)]) / r.n
        cov = np.empty((d, d))
        for i in range(d):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = r[f"p_{i}_{j}"] / r.n - mean[i] * mean[j]
        # with few rows the class leans more on the identity
        gamma = shrinkage + (1 - shrinkage) * min(1.0, d / (r.n + 1))
        cov = (1 - gamma) * cov + (gamma * np.trace(cov) / d + floor) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten = np.linalg.inv(factor)
        offset = math.log(r.n / total) - float(np.log(np.diag(factor)).sum())
        model[r.label] = Gaussian(offset, tuple(mean.tolist()), tuple(tuple(w) for w in whiten.tolist()))
    return model


def density(gaussian: Gaussian, prefix: str = "") -> Column:
    """Log density plus log prior, up to a constant: the offset minus half the squared Mahalanobis distance."""
    centred = [F.col(prefix + f) - F.lit(m) for f, m in zip(FEATURES, gaussian.mean, strict=True)]
    square = F.lit(0.0)
    for i, row in enumerate(gaussian.whiten):
        z = sum((c * F.lit(w) for c, w in zip(centred[: i + 1], row[: i + 1], strict=True)), F.lit(0.0))
        square = square + F.pow(z, 2)
    return F.lit(gaussian.offset) - square / 2


def score_column(model: dict[int, Gaussian], prefix: str = "") -> Column:
    """Probability of label 1. With one class in the labels its own label is certain; with none, 0.5."""
    if 0 in model and 1 in model:
        gap = F.least(F.greatest(density(model[0], prefix) - density(model[1], prefix), F.lit(-700.0)), F.lit(700.0))
        return 1 / (1 + F.exp(gap))
    return F.lit(1.0 if 1 in model else 0.0 if 0 in model else 0.5)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; the score uses the text alone.

    Null, empty and very long texts are scored like any other, whole; null ids are not held out; repeated rows stay; ties at
    the threshold are accepted; an empty table gives an empty result. Other columns are dropped.
    """
    # texts are read once: what is measured is a table of numbers, which both the fit and the scores read
    measured = as_table(features(docs), "features")
    model = fit(docs, labels, measured=measured)
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` predicts as 1, all columns as they are. No shuffle: rows are scored where
    they stand."""

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics((t or "").encode()) for t in texts], columns=FEATURES, dtype=float)

    model = fit(docs, labels)
    name = "measured"
    while name in docs.columns:
        name += "_"
    return small_batches(docs).withColumn(name, measure("text")).where(score_column(model, f"{name}.") >= threshold).drop(name)
