"""Approximate nearest neighbours by inner product: stable projections in kd-trees.

Inner products become distances: a vector gets one more component that brings
its length to the greatest length of all, a query is scaled to that length and
gets a zero; the nearest vector is then the one of the largest product.
Distances are preserved, up to a chi-square factor, by ``DIMS`` Gaussian
(2-stable) projections.

The projected space is cut by a kd-tree fitted on a bounded sample; all rows
are dealt to its leaves, a leaf with more than ``BLOCK`` rows to several
blocks.  Each block is a kd-tree of its own with small leaves.  A query visits
leaves in order of their projected distance and compares all their vectors
with itself, exactly, until the chance that a nearer one lies farther out in
the projection is small: with k-th best squared distance d and projected
squared distance r of the next leaf, until the chi-square distribution with
``DIMS`` degrees of freedom has at least ``SURE`` of its mass below r / d.
Queries search their own block first; the k-th distance found there rules most
other blocks out by the same test on the block's box.

Defined results: vectors that are null, zero, without an id or with a null or
non-finite component take no part; a shorter vector counts as filled with
zeros; rows of the query's own id are not its candidates; fewer candidates
than k give all.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import unit_hash
from .vectors import best, matrix, packed, ranked, unpacked, valid

DIMS = 8              # projections; even, so that the chi-square has a closed form
SURE = 0.985          # mass of the chi-square at which a search stops
SAMPLE = 20_000       # vectors the top of the tree is fitted on, about
BLOCK = 4096          # vectors in a leaf of the top tree, about, and in a block
LEAF = 32             # vectors in a leaf of a block's tree, at most
FIRST_LEAVES = 4      # leaves looked at before the first stopping test; then twice as many each time
BOXES = 1024          # blocks whose boxes a group of queries is tested against at once
QUERY_GROUP = 256     # queries that travel together
SEED = 5


def chi_square_mass(x: np.ndarray) -> np.ndarray:
    """Distribution function of the chi-square with DIMS degrees of freedom."""
    half = np.minimum(np.asarray(x, dtype=float) / 2, 700.0)
    return 1.0 - np.exp(-half) * sum(half ** i / factorial(i) for i in range(DIMS // 2))


def _ratio_at(mass: float) -> float:
    """The chi-square quantile."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_mass(np.array(mid)) < mass else (lo, mid)
    return hi


@dataclass(frozen=True)
class Projection:
    """Lengthens vectors to the greatest length and projects them."""

    normal: np.ndarray   # (width + 1) x DIMS
    greatest: float      # length of the longest vector
    splits: np.ndarray   # of the top tree, level by level: axis, place
    depth: int

    def vectors(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.greatest ** 2 - (x * x).sum(axis=1), 0.0))
        return x @ self.normal[:-1] + rest[:, None] * self.normal[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.greatest / np.sqrt((q * q).sum(axis=1)))[:, None]) @ self.normal[:-1]

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), dtype=np.int64)
        for level in range(self.depth):
            axis, place = self.splits[(1 << level) - 1 + node].T
            node = 2 * node + (p[np.arange(len(p)), axis.astype(int)] > place)
        return node


def fit_splits(p: np.ndarray, depth: int) -> np.ndarray:
    """A kd-tree of medians over the sample: the axis of largest spread, and where it is cut."""
    splits = np.zeros(((1 << depth) - 1, 2))
    nodes = [p]
    for level in range(depth):
        below = []
        for j, part in enumerate(nodes):
            axis = int(part.var(axis=0).argmax()) if len(part) else 0
            place = float(np.median(part[:, axis])) if len(part) else 0.0
            splits[(1 << level) - 1 + j] = axis, place
            below += [part[part[:, axis] <= place], part[part[:, axis] > place]]
        nodes = below
    return splits


def tree_order(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A kd-tree over projected points: their order, and where each leaf ends."""
    order, ends, todo = [], [], [np.arange(len(p))]
    done = 0
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            order.append(part)
            done += len(part)
            ends.append(done)
            continue
        axis = int(np.ptp(p[part], axis=0).argmax())
        half = len(part) // 2
        part = part[np.argpartition(p[part, axis], half)]
        todo += [part[half:], part[:half]]
    return np.concatenate(order), np.array(ends, dtype=np.int64)


@dataclass
class Block:
    """Vectors of one block in their tree's order."""

    ids: np.ndarray
    x: np.ndarray
    ends: np.ndarray
    low: np.ndarray   # leaf boxes
    high: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray, p: np.ndarray) -> Block:
        order, ends = tree_order(p)
        starts = np.concatenate([[0], ends[:-1]])
        q = p[order]
        return Block(ids[order], x[order], ends, np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts))

    def search(self, qid: int, q: np.ndarray, p: np.ndarray, greatest: float, k: int, floor: float, ratio: float):
        """(ids, scores) of the query's k best found here.

        ``floor`` is a product that k others are known to reach.  A vector of
        product s is at squared distance 2 g (g - s / |q|) from the query.
        """
        length = float(np.sqrt(q @ q))
        gap = np.maximum(0.0, np.maximum(self.low - p, p - self.high))
        away = (gap * gap).sum(axis=1)
        order = np.argsort(away, kind="stable")
        starts = np.concatenate([[0], self.ends[:-1]])
        at, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        done, step = 0, FIRST_LEAVES
        while done < len(order):
            leaves = order[done:done + step]
            if floor > -np.inf:  # the leaves are in order of distance: those beyond the test, and all after, are left
                leaves = leaves[away[leaves] <= ratio * max(0.0, 2 * greatest * (greatest - floor / length)) * (1 + 1e-9) + 1e-9]
                if not len(leaves):
                    break
            rows = starts[leaves][:, None] + np.arange(LEAF)
            rows = rows[rows < self.ends[leaves][:, None]]
            rows = rows[self.ids[rows] != qid]
            at, scores = np.concatenate([at, rows]), np.concatenate([scores, self.x[rows] @ q])
            if len(at) >= k:
                kth = float(np.partition(scores, len(scores) - k)[len(scores) - k])
                near = scores >= kth - 1e-9 * (1 + abs(kth))
                at, scores = at[near], scores[near]
                floor = max(floor, kth)
            done, step = done + step, 2 * step
        # a matrix product's last bits depend on its neighbours: equal vectors must score alike
        ids, scores = self.ids[at], (self.x[at] * q).sum(axis=1)
        chosen = best(scores, ids, k)
        return ids[chosen], scores[chosen]


BLOCK_SCHEMA = ("block long, ids binary, x binary, ends binary, low binary, high binary, "
                "q_ids binary, q binary, floors binary, found_ids binary, found binary, counts binary")


def nearest(vectors: DataFrame, k: int, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k largest products found for every query."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = vectors.where(valid(vector) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"),
                       F.coalesce(is_query, F.lit(False)).alias("asked"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = materialize(rows.withColumn("s", squares).where("s > 0"), "vectors")
    size = rows.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n"), F.max("s").alias("s")).first()
    if not size["n"]:
        return ranked(spark.createDataFrame([], schema), k)
    width, n = size["w"], size["n"]
    greatest = float(np.sqrt(size["s"]) * (1 + 1e-12))
    normal = np.random.default_rng(SEED).standard_normal((width + 1, DIMS))
    depth = max(0, int(np.ceil(np.log2(n / BLOCK))))
    sample = rows.where(unit_hash(SEED, "i") < min(1.0, SAMPLE / n)).select("v").collect() if depth else []
    flat = Projection(normal, greatest, np.zeros((0, 2)), 0)
    shared = spark.sparkContext.broadcast(Projection(normal, greatest, fit_splits(flat.vectors(matrix([r["v"] for r in sample], width)), depth), depth))
    ratio = _ratio_at(SURE)

    def place(batches):
        for pdf in batches:
            yield pdf.assign(leaf=shared.value.leaf(shared.value.vectors(matrix(pdf["v"], width))))

    placed = materialize(rows.select("i", "v", "asked").mapInPandas(place, "i long, v array<double>, asked boolean, leaf long"), "placed")
    # a leaf of many rows, such as copies of one vector, becomes several blocks
    parts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    keyed = placed.join(parts.hint("merge"), "leaf").withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "i"), F.col("parts")))

    def build(key, pdf):
        """A block, and what its queries find in it."""
        x, ids = matrix(pdf["v"], width), pdf["i"].to_numpy(dtype=np.int64)
        block = Block.build(ids, x, shared.value.vectors(x))
        asked = pdf["asked"].to_numpy(dtype=bool)
        q, qids = x[asked], ids[asked]
        p = shared.value.queries(q) if len(q) else np.zeros((0, DIMS))
        found = [block.search(i, a, b, greatest, k, -np.inf, ratio) for i, a, b in zip(qids, q, p)]
        floors = np.array([s[-1] if len(s) == k else -np.inf for _, s in found])
        empty = np.zeros(0)
        return pd.DataFrame([{
            "block": int(key[0]) << 24 | int(key[1]), "ids": packed(block.ids), "x": packed(block.x), "ends": packed(block.ends),
            "low": packed(block.low), "high": packed(block.high), "q_ids": packed(qids), "q": packed(q), "floors": packed(floors),
            "found_ids": packed(np.concatenate([empty.astype(np.int64), *(i for i, _ in found)])),
            "found": packed(np.concatenate([empty, *(s for _, s in found)])),
            "counts": packed(np.array([len(s) for _, s in found], dtype=np.int64))}])

    blocks = materialize(keyed.select("leaf", "part", "i", "v", "asked").groupBy("leaf", "part").applyInPandas(build, BLOCK_SCHEMA), "ann-blocks")

    def home(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                counts = unpacked(r.counts, dtype=np.int64)
                yield pd.DataFrame({"query_id": np.repeat(unpacked(r.q_ids, dtype=np.int64), counts),
                                    "vec_id": unpacked(r.found_ids, dtype=np.int64), "score": unpacked(r.found)})

    def frame(batches):
        for pdf in batches:
            yield pd.DataFrame({"block": pdf["block"], "low": [unpacked(b, DIMS).min(axis=0) for b in pdf["low"]],
                                "high": [unpacked(b, DIMS).max(axis=0) for b in pdf["high"]]})

    n_groups = -(-blocks.count() // BOXES)
    boxes = blocks.select("block", "low", "high").mapInPandas(frame, "block long, low array<double>, high array<double>")
    boxes = boxes.groupBy(F.pmod(F.xxhash64("block"), F.lit(n_groups)).alias("g")).agg(F.collect_list(F.struct("block", "low", "high")).alias("boxes"))

    def route(batches):
        """The blocks that a query's test does not rule out, with groups of queries for each."""
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qids, q, floors = unpacked(r.q_ids, dtype=np.int64), unpacked(r.q, width), unpacked(r.floors)
                p, length = shared.value.queries(q), np.sqrt((q * q).sum(axis=1))
                reach = np.where(np.isinf(floors), np.inf, ratio * np.maximum(0.0, 2 * greatest * (greatest - floors / length)) * (1 + 1e-9) + 1e-9)
                for box in r.boxes:
                    if box["block"] == r.block:
                        continue
                    gap = np.maximum(0.0, np.maximum(np.asarray(box["low"]) - p, p - np.asarray(box["high"])))
                    live = np.flatnonzero((gap * gap).sum(axis=1) <= reach)
                    for a in range(0, len(live), QUERY_GROUP):
                        at = live[a:a + QUERY_GROUP]
                        yield pd.DataFrame({"block": [box["block"]], "q_ids": [packed(qids[at])], "q": [packed(q[at])], "floors": [packed(floors[at])]})

    asked = blocks.where(F.length("q_ids") > 0).select("block", "q_ids", "q", "floors")
    tests = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).join(boxes.hint("merge"), "g").drop("g")
    routed = tests.mapInPandas(route, "block long, q_ids binary, q binary, floors binary")

    def visit(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                block = Block(unpacked(r.ids, dtype=np.int64), unpacked(r.x, width), unpacked(r.ends, dtype=np.int64), unpacked(r.low, DIMS), unpacked(r.high, DIMS))
                qids, q = unpacked(r.q_ids, dtype=np.int64), unpacked(r.q, width)
                found = [block.search(i, a, b, greatest, k, f, ratio) for i, a, b, f in zip(qids, q, shared.value.queries(q), unpacked(r.floors))]
                yield pd.DataFrame({"query_id": np.repeat(qids, [len(i) for i, _ in found]),
                                    "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])})

    visits = routed.join(blocks.select("block", "ids", "x", "ends", "low", "high").hint("merge"), "block")
    return ranked(blocks.mapInPandas(home, schema).union(visits.mapInPandas(visit, schema)), k)


def nearest_table(vectors: DataFrame) -> DataFrame:
    """Queries: ids divisible by 20; twenty neighbours each."""
    return nearest(vectors, 20, F.col("vec_id") % 20 == 0)
