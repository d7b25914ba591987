"""Document quality by a regularised quadratic discriminant.

Each whole text gives a vector of transformed statistics (log-odds of smoothed
shares, so that a short text sits near the middle instead of at an extreme).
Each class is a Gaussian whose covariance is shrunk towards the pooled
diagonal; the score is the logistic function of the difference of the two
log densities plus the log prior odds.  Mahalanobis distances come from the
Cholesky factors, inverted once when the model is fitted.

Class moments are sums over partial sums of batches, so the labelled rows are
never gathered.  ``MAX_TRAIN`` bounds the rows whose statistics are computed
for fitting (a hash sample); every text is scored.

Defined results: null and empty texts have the statistics of no words and get
a score; a null label is no label; where a class has no labelled row its
Gaussian is the pooled one and the score is the prior; without any labelled
row every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import is_remainder, unit_hash

MAX_TRAIN = 40_000   # labelled rows the class moments are taken from, about
SHRINKAGE = 0.3       # weight of the pooled diagonal in a class covariance
THRESHOLD = 0.3       # least score of a kept document
SEED = 23

#: character classes by byte: 0 white space, 1 letter, 2 capital, 3 digit, 4 plain punctuation, 5 symbol, 6 continuation byte
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASS[0x80:0xC0] = 6
_CLASS[0xC0:] = 1

N_FEATURES = 11


def _odds(part: float, whole: float, share: float, weight: float) -> float:
    """Log-odds of a share that ``weight`` imagined trials pull towards ``share``."""
    p = (part + weight * share) / (whole + weight)
    return float(np.log(p / (1.0 - p)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    text = text or ""
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)], minlength=7)
    chars = int(kinds[1:6].sum())
    letters = int(kinds[1] + kinds[2])
    words = text.split()
    m = len(words)
    top = max(Counter(words).values()) if m else 0
    pairs = len(set(zip(words, words[1:]))) if m > 1 else 0
    same = sum(map(eq, words, words[1:])) if m > 1 else 0
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    lonely = sum(len(w) == 1 and not w.isalnum() for w in words)
    # a distinct word is rarer in a longer text: compare with a power of the length
    growth = np.log((len(set(words)) + 10.0) / (m + 10.0) ** 0.95)
    return [
        float(np.log(m + 20.0)),
        _odds(letters, chars, 0.97, 60.0),
        _odds(int(kinds[2]), letters, 0.04, 60.0),
        _odds(int(kinds[5]), chars, 0.002, 60.0),
        _odds(int(kinds[3]), chars, 0.005, 200.0),
        float(np.log((chars + 60.0) / (m + 10.0))),
        float(growth),
        _odds(same, max(0, m - 1), 0.004, 40.0),
        _odds(top, m, 0.08, 40.0),
        _odds(len(lines) - len(set(lines)), len(lines), 0.02, 12.0),
        _odds(max(0, m - 1) - pairs + lonely, max(m, 1) + m, 0.02, 40.0),
    ]


def statistics_column(text: str | Column) -> Column:
    @pandas_udf("array<double>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return compute(text)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log constants of the two classes."""

    means: np.ndarray      # 2 x d
    whiten: np.ndarray     # 2 x d x d, inverse of the Cholesky factor
    constants: np.ndarray  # 2, log prior less half the log determinant

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        log_density = []
        for mean, whiten, constant in zip(self.means, self.whiten, self.constants):
            z = (x - mean) @ whiten.T
            log_density.append(constant - 0.5 * (z * z).sum(axis=1))
        # rounded: a row's last bits depend on the rows it is multiplied with
        return np.round(1.0 / (1.0 + np.exp(-np.clip(log_density[1] - log_density[0], -60.0, 60.0))), 12)


def fit_moments(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From each class's row count (2), sums (2 x d) and sums of products (2 x d x d)."""
    d = sums.shape[1]
    total = float(n.sum())
    if total == 0:
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    mean_all = sums.sum(axis=0) / total
    pooled = np.diag(np.maximum(np.diag(squares.sum(axis=0)) / total - mean_all ** 2, 1e-4))
    means, whiten, constants = [], [], []
    for k in (0, 1):
        if n[k] >= 2:
            mean = sums[k] / n[k]
            cov = (1.0 - shrinkage) * (squares[k] / n[k] - np.outer(mean, mean)) + shrinkage * pooled
        else:
            mean, cov = mean_all, pooled
        lower = np.linalg.cholesky((cov + cov.T) / 2.0 + 1e-9 * np.eye(d))
        means.append(mean)
        whiten.append(np.linalg.inv(lower))
        constants.append(np.log((n[k] + 1.0) / (total + 2.0)) - np.log(np.diag(lower)).sum())
    return Discriminant(np.round(means, 9), np.round(whiten, 9), np.round(constants, 9))


def _batch_moments(batches):
    """One row a batch and class: count, sums and sums of products, flattened."""
    for pdf in batches:
        for label, part in pdf.groupby("y"):
            x = np.stack(part["x"].to_numpy())
            flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
            yield pd.DataFrame({"y": [label], "m": [flat]})


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> Discriminant:
    """Fit on the labelled rows of ``docs`` (the caller leaves out held-out ones)."""
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y"))
    n = marks.count()
    share = min(1.0, MAX_TRAIN / n) if n else 0.0
    # at most about MAX_TRAIN ids: a broadcast of bounded size, and statistics of the sample only
    chosen = marks.where(unit_hash(SEED, "i") < share)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i")
    parts = rows.select("y", statistics_column("t").alias("x")).mapInPandas(_batch_moments, "y int, m array<double>")
    flat = parts.select("y", F.posexplode("m").alias("pos", "v")).groupBy("y", "pos").agg(F.sum("v").alias("v"))
    d = N_FEATURES
    moments = np.zeros((2, 1 + d + d * d))
    for r in flat.collect():  # 2 x (1 + d + d * d) numbers
        moments[r["y"], r["pos"]] = r["v"]
    return fit_moments(moments[:, 0], moments[:, 1:1 + d], moments[:, 1 + d:].reshape(2, d, d))


def score(docs: DataFrame, model: Discriminant, text: str = "text") -> Column:
    """Probability that the text is of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.scores(np.array([statistics(t) for t in texts])))

    return predict(F.col(text))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn outside the held-out fold (crc32 of the id mod 5 is 0), score every text."""
    held_out = is_remainder("doc_id", 5, 0)
    model = train(docs.where(~held_out), labels)
    out = docs.select("doc_id", held_out.alias("held_out"), score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    model = train(docs.where(~is_remainder("doc_id", 5, 0)), labels)
    return docs.where(score(docs, model) >= THRESHOLD)
