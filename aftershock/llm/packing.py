"""Packing token sequences by the linear grouping scheme, then best fit.

1. A document's ids are followed by ``END_ID``.  A document longer than a
   sequence is cut into pieces of the full length, the first one shorter.
2. Large pieces (at least ``LARGE`` tokens), longest first, fall into
   ``GROUPS`` groups of as many pieces each; within a group all lengths count
   as the longest.  A solver on these few sizes repeats: take the longest
   group that has pieces left, fill the rest of the sequence as full as the
   remaining groups can (a knapsack), and use that configuration as often as
   its groups allow.
3. The k-th piece of a group takes the k-th slot that configurations have for
   the group; what a sequence has left is found from the true lengths.
4. Small pieces, longest first, go where they leave least room; where none
   has room a sequence is opened.

The driver sees counts by length only (``SEQUENCE`` numbers, whatever the
input's size) and makes the plan from them; pieces are numbered within their
length by ``ranks`` and find their slot by binary search in the plan.

Defined results: a null text is a document of the one id ``END_ID``; repeated
rows are documents of their own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .ranks import BUCKETS, number_within
from .tokens import encode

SEQUENCE = 1024  # tokens of a sequence, at most
END_ID = 2       # follows each document's ids
LARGE = 256      # least length of a large piece
GROUPS = 640     # groups of large pieces

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(ids: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, end) of the pieces: all of the full length but the first."""
    n = len(ids)
    first = n % sequence or min(n, sequence)
    ends = range(first, n + 1, sequence)
    return [(max(0, e - sequence) if k else 0, e) for k, e in enumerate(ends)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's pieces; with ``keep_ids`` also their token ids."""

    def split(batches):
        for pdf in batches:
            out = defaultdict(list)
            for i, t in zip(pdf["i"], pdf["t"]):
                ids = np.append(encode(t), np.uint32(END_ID)).astype("<u4")
                for k, (a, b) in enumerate(cut(ids)):
                    out["doc_id"].append(None if pd.isna(i) else int(i))
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        out["ids"].append(ids[a:b].astype(np.int64))
            if out:
                yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    return rows.mapInPandas(split, PIECES + (", ids array<long>" if keep_ids else ""))


# ------------------------------------------------------------------ plans


def best_fill(room: int, sizes: np.ndarray, counts: np.ndarray) -> list[int]:
    """How many pieces of each size fill ``room`` fullest, none beyond its count; larger sizes first on ties."""
    choice = np.full(room + 1, -1, dtype=np.int64)   # last group used for a sum
    used = np.zeros(room + 1, dtype=np.int64)        # pieces of that group in the sum
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    for g, (s, n) in enumerate(zip(sizes, counts)):
        if n <= 0 or s > room:
            continue
        before = reach.copy()
        for c in range(1, min(int(n), room // int(s)) + 1):
            new = np.zeros(room + 1, dtype=bool)
            new[c * s:] = before[:room + 1 - c * s]
            new &= ~reach
            reach |= new
            choice[new], used[new] = g, c
        if reach[room]:
            break
    total = int(np.flatnonzero(reach)[-1])
    take = [0] * len(sizes)
    while total:
        g, c = int(choice[total]), int(used[total])
        take[g] += c
        total -= c * int(sizes[g])
    return take


def plan_large(counts: np.ndarray, sequence: int = SEQUENCE, large: int = LARGE, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Slots for the large pieces, numbered longest first.

    ``counts[l]`` pieces are of length l.  Rows of the first result, in order:
    first number, one beyond the last, first sequence, sequences.  The pieces
    of a row are dealt to its sequences in turn.  The second result is the
    number of sequences.
    """
    longest = np.arange(sequence, large - 1, -1)
    ends = np.cumsum(counts[longest])
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return np.zeros((0, 4), dtype=np.int64), 0
    starts = np.unique(np.arange(groups, dtype=np.int64) * n // groups)
    size_at = longest[np.searchsorted(ends, starts, side="right")]
    # groups of one size are one group
    keep = np.concatenate([[True], size_at[1:] != size_at[:-1]])
    next_slot, sizes = starts[keep], size_at[keep]
    stop = np.append(next_slot[1:], n)
    next_slot = next_slot.copy()
    out, sequences = [], 0
    while (left := stop - next_slot).any():
        first = int(np.flatnonzero(left)[0])
        rest = left.copy()
        rest[first] -= 1
        take = np.array(best_fill(sequence - int(sizes[first]), sizes, rest))
        take[first] += 1
        some = np.flatnonzero(take)
        times = int((left[some] // take[some]).min())
        for g in some:
            k = int(take[g]) * times
            out.append((next_slot[g], next_slot[g] + k, sequences, times))
            next_slot[g] += k
        sequences += times
    out.sort()
    return np.array(out, dtype=np.int64), sequences


def plan_small(counts: np.ndarray, room: np.ndarray, sequence: int = SEQUENCE, large: int = LARGE) -> list[tuple[int, int, int, int, int]]:
    """Where the small pieces go: best fit, longest first.

    ``room[r]`` sequences have room for r more tokens.  Rows: length, first and
    one beyond the last number within the length, room that the sequences had
    at first (``sequence + 1``: a new one) and the number of the first of them
    among those that had that room.
    """
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by room now: room at first, number, how many
    for r in range(1, sequence + 1):
        if room[r]:
            runs[r].append((r, 0, int(room[r])))
    out, opened = [], 0
    for length in range(large - 1, 0, -1):
        done, n = 0, int(counts[length])
        at = length
        while done < n:
            while at <= sequence and not runs[at]:
                at += 1
            if at > sequence:
                new = -(-(n - done) // (sequence // length))
                runs[sequence].append((sequence + 1, opened, new))
                opened += new
                at = sequence
            origin, number, many = runs[at].pop()
            k = min(many, n - done)
            out.append((length, done, done + k, origin, number))
            if k < many:
                runs[at].append((origin, number + k, many - k))
            if at - length:
                runs[at - length].append((origin, number, k))
            done += k
            at = max(length, at - length) if at - length >= length else at
    return out


# ------------------------------------------------------------------- Spark


def pack(rows: DataFrame) -> DataFrame:
    """Add sequence_id and offset to written pieces (``PIECES``; other columns stay)."""
    spark = rows.sparkSession
    counts = np.zeros(SEQUENCE + 2, dtype=np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most SEQUENCE rows
        counts[r["length"]] = r["n"]
    slots, sequences = plan_large(counts)
    longer = np.zeros(SEQUENCE + 2, dtype=np.int64)  # large pieces longer than l
    longer[:SEQUENCE + 1] = np.cumsum(counts[::-1])[::-1][1:]
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int")
    numbered = number_within(rows.withColumn("_bucket", bucket), ["length"], "_bucket", ["doc_id", "piece", "start"], "_rank")
    numbered = numbered.drop("_bucket").withColumn("_large", F.col("length") >= LARGE)

    shared = spark.sparkContext.broadcast((slots, longer))

    def place_large(batches):
        table, above = shared.value
        for pdf in batches:
            number = above[pdf["length"].to_numpy()] + pdf["_rank"].to_numpy()
            row = table[np.searchsorted(table[:, 0], number, side="right") - 1]
            yield pdf.drop(columns=["_rank", "_large"]).assign(sequence_id=row[:, 2] + (number - row[:, 0]) % row[:, 3])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long"
    large = materialize(numbered.where("_large").mapInPandas(place_large, schema), "packing-large")

    # sequences by the room that is left, numbered within it
    filled = large.groupBy("sequence_id").agg((F.lit(SEQUENCE) - F.sum("length")).cast("int").alias("_room"))
    spread = F.pmod(F.xxhash64("sequence_id"), F.lit(BUCKETS)).cast("int")
    open_ = materialize(filled.where(F.col("_room") > 0), "packing-room")
    room = np.zeros(SEQUENCE + 2, dtype=np.int64)
    for r in open_.groupBy("_room").agg(F.count("*").alias("n")).collect():  # at most SEQUENCE rows
        room[r["_room"]] = r["n"]
    plan = plan_small(counts, room)
    places = np.array(sorted(plan), dtype=np.int64).reshape(len(plan), 5)
    shared_small = spark.sparkContext.broadcast(places)

    def place_small(batches):
        table = shared_small.value
        key = table[:, 0] << 40 | table[:, 1]
        for pdf in batches:
            rank = pdf["_rank"].to_numpy()
            row = table[np.searchsorted(key, pdf["length"].to_numpy().astype(np.int64) << 40 | rank, side="right") - 1]
            yield pdf.drop(columns=["_rank", "_large"]).assign(_room=row[:, 3].astype(np.int32), _number=row[:, 4] + rank - row[:, 1])

    small_schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", _room int, _number long"
    small = numbered.where("NOT _large").mapInPandas(place_small, small_schema)
    ranked = number_within(open_.withColumn("_bucket", spread), ["_room"], "_bucket", ["sequence_id"], "_number").drop("_bucket")
    small = small.join(ranked, ["_room", "_number"], "left")
    # a sequence opened for small pieces comes after all others
    small = small.withColumn("sequence_id", F.coalesce("sequence_id", F.lit(sequences) + F.col("_number"))).select(*large.columns)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "start").rowsBetween(Window.unboundedPreceding, -1)
    return large.union(small).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def packing_table(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    out = pack(materialize(pieces(docs), "packing-pieces"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
