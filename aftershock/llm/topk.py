"""Exact top-k inner products of norm-sorted integer vectors.

Components become ``floor(scale * x)``.  A rotation to the principal axes of
all vectors (eigenvectors of the sum of outer products, the right singular
vectors of the table) moves most of a product into the first few coordinates.
Vectors are dealt into blocks by descending length.  Queries, in blocks, first
meet the block of the longest vectors, which gives each a threshold, its k-th
best product there; then every block.  Within a block, vectors go by
descending length; a run of them is skipped when length times the query's
length is below the threshold, and a vector when its partial product over the
first coordinates plus the product of both residual lengths is.  Survivors get
their exact integer product.  Bounds carry a slack for rounding, so nothing
that could tie the k-th best is pruned.

Defined results: null vectors, null ids and vectors with a null or non-finite
component take no part; a shorter vector counts as filled with zeros; rows of
the query's own id are not its candidates; fewer candidates than k give all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .vectors import best, matrix, packed, ranked, unpacked, valid

BLOCK = 4096        # candidates in a block
QUERY_BLOCK = 512   # queries in a block
RUN = 512           # candidates between two looks at the threshold
HEAD = 0.25         # share of the coordinates in the partial product
EXACT = 2.0 ** 53   # integers below are exact as doubles
DENSE = 0.02        # share of a run's pairs from which one matrix product is cheaper


def _outer_products(batches, width: int):
    for pdf in batches:
        x = matrix(pdf["v"], width)
        if len(x):
            yield pd.DataFrame({"g": [(x.T @ x).ravel()]})


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns: principal axes of all vectors, largest first."""
    parts = vectors.select("v").mapInPandas(lambda it: _outer_products(it, width), "g array<double>")
    sums = parts.select(F.posexplode("g").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    gram = np.zeros(width * width)
    for r in sums.collect():  # width * width numbers
        gram[r["pos"]] = r["x"]
    gram = gram.reshape(width, width)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


class Search:
    """Scans a block of candidates for a block of queries."""

    def __init__(self, axes: np.ndarray, k: int):
        self.axes, self.k = axes, k
        self.head = max(1, int(np.ceil(axes.shape[0] * HEAD)))

    def lengths(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated first coordinates, residual length, length."""
        y = x.astype(np.float64) @ self.axes
        return (y[:, :self.head], np.sqrt((y[:, self.head:] ** 2).sum(axis=1)), np.sqrt((y * y).sum(axis=1)))

    def exact(self, q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Integer products of the pairs q[row], x[col].

        As doubles all sums are exact below 2 ** 53; one matrix product is
        then cheaper than many pairs.  Larger components go pair by pair.
        """
        most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
        if most < EXACT and len(row) > DENSE * len(q) * len(x):
            return (q.astype(np.float64) @ x.astype(np.float64).T)[row, col].astype(np.int64)
        if most < 2.0 ** 62:
            return np.einsum("ij,ij->i", q[row], x[col])
        return (q[row].astype(object) * x[col].astype(object)).sum(axis=1)

    def scan(self, qids, q, floors, ids, x):
        """For each query: (ids, scores) of its best k in the block that reach its floor.

        ``x`` and ``ids`` are in order of descending length.
        """
        qh, qr, ql = self.lengths(q)
        xh, xr, xl = self.lengths(x)
        floors = floors.copy()
        slack = 1e-9 * (1.0 + ql * (xl[0] if len(xl) else 0.0)) + 1e-6
        got_ids: list[list[np.ndarray]] = [[] for _ in qids]
        got: list[list[np.ndarray]] = [[] for _ in qids]
        for a in range(0, len(ids), RUN):
            live = np.flatnonzero(ql * xl[a] >= floors - slack)
            if not len(live):
                break
            b = min(len(ids), a + RUN)
            bound = qh[live] @ xh[a:b].T + np.outer(qr[live], xr[a:b])
            row, col = np.nonzero(bound >= (floors - slack)[live][:, None])
            other = qids[live[row]] != ids[a + col]
            row, col = row[other], col[other]
            scores = self.exact(q[live], x[a:b], row, col)
            reach = scores >= floors[live[row]]
            row, col, scores = row[reach], col[reach], scores[reach]
            cuts = np.searchsorted(row, np.arange(len(live) + 1))
            for j, k in enumerate(live):
                if cuts[j] == cuts[j + 1]:
                    continue
                got_ids[k].append(ids[a + col[cuts[j]:cuts[j + 1]]])
                got[k].append(scores[cuts[j]:cuts[j + 1]])
                all_ids, all_scores = np.concatenate(got_ids[k]), np.concatenate(got[k])
                at = best(all_scores, all_ids, self.k)
                got_ids[k], got[k] = [all_ids[at]], [all_scores[at]]
                if len(at) == self.k:
                    floors[k] = max(floors[k], float(all_scores[at[-1]]))
        empty = np.zeros(0, dtype=np.int64)
        return [(got_ids[k][0], got[k][0]) if got[k] else (empty, empty) for k in range(len(qids))]


def _pack(batches, width: int, size: int, groups: int):
    """Rows of at most ``size`` vectors of a partition, longest first, and one of ``groups`` numbers."""
    from pyspark import TaskContext

    group = TaskContext.get().partitionId() % groups
    frames = list(batches)
    if not frames:
        return
    pdf = pd.concat(frames)
    x, ids = matrix(pdf["v"], width, np.int64), pdf["i"].to_numpy(dtype=np.int64)
    length = (x.astype(np.float64) ** 2).sum(axis=1)
    order = np.lexsort((ids, -length))
    for a in range(0, len(order), size):
        at = order[a:a + size]
        yield pd.DataFrame({"ids": [packed(ids[at])], "x": [packed(x[at])], "longest": [float(np.sqrt(length[at[0]]))], "c": [group]})


def top_products(vectors: DataFrame, k: int, is_query: Column, scale: float = 256.0,
                 vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of every query's k highest products."""
    spark = vectors.sparkSession
    rows = vectors.where(valid(vector) & F.col(vec_id).isNotNull())
    quantised = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = rows.select(F.col(vec_id).cast("long").alias("i"), quantised.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = materialize(rows, "quantised")
    size = rows.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    width, n, n_queries = size["w"] or 0, size["n"], size["q"]
    schema = "query_id long, vec_id long, score long"
    if not n_queries:
        return ranked(spark.createDataFrame([], schema), k)
    width = max(width, 1)
    search = spark.sparkContext.broadcast(Search(rotation(rows, width), k))

    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n_blocks, n_query_blocks = -(-n // BLOCK), -(-n_queries // QUERY_BLOCK)
    dealt = rows.select("i", "v", squares.alias("s")).repartitionByRange(n_blocks, F.desc("s"), "i")
    shape = "ids binary, x binary, longest double, c int"
    blocks = materialize(dealt.select("i", "v").mapInPandas(lambda it: _pack(it, width, 2 * BLOCK, n_blocks), shape), "vector-blocks")
    asked = rows.where("asked").select("i", "v").repartition(n_query_blocks, "i")
    queries = asked.mapInPandas(lambda it: _pack(it, width, QUERY_BLOCK, 1), shape)

    def start(batches):
        """Thresholds of query blocks from the block of the longest vectors."""
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                qids, ids = unpacked(r.ids, dtype=np.int64), unpacked(r.head_ids, dtype=np.int64)
                found = search.value.scan(qids, unpacked(r.x, width, np.int64), np.full(len(qids), -np.inf), ids,
                                          unpacked(r.head_x, width, np.int64))
                out.append(packed(np.array([float(s[-1]) if len(s) == k else -np.inf for _, s in found])))
            yield pd.DataFrame({"ids": pdf["ids"], "x": pdf["x"], "floors": out})

    # one block, at most 2 * BLOCK vectors: a broadcast of bounded size
    head = blocks.orderBy(F.desc("longest")).limit(1).select(F.col("ids").alias("head_ids"), F.col("x").alias("head_x"), F.lit(0).alias("one"))
    begun = queries.withColumn("one", F.lit(0)).join(F.broadcast(head), "one").drop("one")
    begun = materialize(begun.mapInPandas(start, "ids binary, x binary, floors binary"), "query-blocks")

    def scan(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qids, ids = unpacked(r.ids, dtype=np.int64), unpacked(r.c_ids, dtype=np.int64)
                found = search.value.scan(qids, unpacked(r.x, width, np.int64), unpacked(r.floors), ids, unpacked(r.c_x, width, np.int64))
                yield pd.DataFrame({"query_id": np.repeat(qids, [len(i) for i, _ in found]),
                                    "vec_id": np.concatenate([i for i, _ in found]),
                                    "score": np.concatenate([s for _, s in found])})

    # every query block goes to every candidate block: the stated queries against all rows
    candidates = blocks.select("c", F.col("ids").alias("c_ids"), F.col("x").alias("c_x"))
    pairs = begun.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = pairs.join(candidates.hint("merge"), "c").select("ids", "x", "floors", "c_ids", "c_x").mapInPandas(scan, schema)
    return ranked(found, k)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def top_table(vectors: DataFrame) -> DataFrame:
    """Queries: ids divisible by 50; five products each."""
    return top_products(vectors, 5, F.col("vec_id") % 50 == 0)
