"""What the two vector searches share: valid vectors, packing, and ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


def valid(vector: str | Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(rows, width: int, dtype=np.float64) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(rows), width), dtype=dtype)
    for k, v in enumerate(rows):
        out[k, :len(v)] = v
    return out


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpacked(data: bytes, width: int | None = None, dtype=np.float64) -> np.ndarray:
    a = np.frombuffer(data, dtype=dtype)
    return a if width is None else a.reshape(-1, width)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of what its blocks gave."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
