"""Near-duplicate documents by MinHash bands, odd sketches and full shingle sets.

1. A text's set holds 64-bit hashes of its distinct runs of five words.  Texts
   of equal sets are one class; only a class's least id goes on.
2. ``BANDS`` bands of ``ROWS`` MinHash values each put a class into as many
   buckets.  A pair of similarity 0.75 misses all buckets once in 150,000.
3. The ``BANDS * ROWS`` MinHash values are folded into an odd sketch: each
   toggles one of ``SKETCH_BITS`` bits, equal values cancel in the XOR of two
   sketches, and its population count estimates how many differ.  A candidate
   pair whose estimate is below ``LEAST_ESTIMATE``, some five deviations under
   the threshold, is dropped.
4. What remains is confirmed on the full sets of both whole texts.

Candidates of a bucket are not all its pairs, since links matter only as far
as they join components:

* every member is compared with the bucket's least one, and components are
  formed; a bucket whose other members lie in one component is done;
* in a bucket with at most ``SMALL`` other members, all pairs of about equal
  size from different components are compared, and it is done;
* the members of larger undone buckets, such as heavily edited copies of one
  text, are compared by an exact rule instead.  Order all shingles by their
  frequency among these members: two sets that have 75 % of their union in
  common share one of the smaller set's rarest seventh and of the larger one's
  rarest quarter, and the first they share has enough shingles after it in
  both.  A copy with too much of its own shares none of its rarest shingles
  with another component, so what is left to compare is little.

Defined results: null texts and texts without a word have an empty set and are
linked with nothing; rows of one id are one document; a row without an id is
linked with nothing.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .components import components

SHINGLE = 5            # words of a shingle
PERCENT = 75           # least share of the union that linked sets have in common
BANDS, ROWS = 44, 5
SKETCH_BITS = 1024
LEAST_ESTIMATE = 0.55  # of the sketches
SMALL = 12             # members of a bucket, all pairs of which are compared
CHUNK = 1 << 20        # bytes of text hashed at once

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (splitmix64's finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors of a shingle's words; factors and shifts of the MinHash functions."""
    rng = np.random.default_rng(20)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
    return draw(SHINGLE), draw(BANDS * ROWS).astype(np.uint32), draw(BANDS * ROWS).astype(np.uint32)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hash_chunk(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(max(CHUNK + (CHUNK >> 3), 1 << int(len(data)).bit_length()) if len(data) > CHUNK + (CHUNK >> 3) else CHUNK + (CHUNK >> 3))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * up[:len(data)])])
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
    counts = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    factors = _constants()[0]
    n = max(0, len(words) - SHINGLE + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        runs += words[j:j + n] * factors[j]
    runs = _mix(runs)
    out = []
    for k, m in enumerate(counts):
        a = first[k]
        if m >= SHINGLE:
            out.append(np.unique(runs[a:a + m - SHINGLE + 1]))
        elif m:  # the whole sequence is the one shingle; its length keeps it apart from longer ones
            out.append(_mix(np.array([(words[a:a + m] * factors[:m]).sum() + _U(m)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts) -> list[np.ndarray]:
    """The sorted hashed shingle set of each text (None: empty)."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        data = t.encode("utf-8", "replace") if t else b""
        if chunk and size + len(data) > CHUNK:
            out += _hash_chunk(chunk)
            chunk, size = [], 0
        chunk.append(data)
        size += len(data) + 1
    return out + (_hash_chunk(chunk) if chunk else [])


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the bands, and the odd sketch as 64-bit words."""
    _, factors, shifts = _constants()
    high = (hashes >> _U(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(high), 1024):
        part = high[a:a + 1024]
        least = np.minimum(least, (factors[:, None] * part[None, :] + shifts[:, None]).min(axis=1))
    numbered = _mix(least.astype(np.uint64) | np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << _U(32))
    bands = _mix(numbered.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64))
    places = (numbered >> _U(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(places, minlength=SKETCH_BITS).astype(np.uint8) & 1
    return bands.view(np.int64), np.packbits(odd).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have PERCENT of their union in common."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < PERCENT * large:
        return False
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * common >= PERCENT * (small + large - common)


# ------------------------------------------------------------------- Spark


def pieces(batches, rows: int = 250):
    """Parts of the batches of so few rows that their texts' sets fit in little memory."""
    for pdf in batches:
        for a in range(0, len(pdf), rows):
            yield pdf.iloc[a:a + rows]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """i, n (set size), key (digest of the set), bands and sketch of every whole text."""

    def sign(batches):
        for pdf in pieces(batches):
            sets = shingle_sets(pdf["t"])
            rows = [signature(s) if len(s) else (None, None) for s in sets]
            yield pd.DataFrame({
                "i": pdf["i"].astype("Int64"), "n": [len(s) for s in sets],
                "key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [b for b, _ in rows], "sketch": [s for _, s in rows]})

    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    return rows.mapInPandas(sign, "i long, n long, key binary, bands array<long>, sketch array<long>")


def _differing_bits() -> Column:
    return sum((F.bit_count(F.col("sa")[j].bitwiseXOR(F.col("sb")[j])) for j in range(SKETCH_BITS // 64)), F.lit(0))


def most_differing_bits() -> int:
    """Population count of two sketches' XOR at the least accepted estimate."""
    toggles = 2 * BANDS * ROWS * (1 - LEAST_ESTIMATE)
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * toggles / SKETCH_BITS)))


def sketch_filter(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs a, b whose set sizes and sketches do not rule a link out."""
    sa = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    sb = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    near = (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & (_differing_bits() <= most_differing_bits())
    return pairs.join(sb, "b").join(sa, "a").where(near).select("a", "b")


def confirm(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Pairs a, b whose full sets are similar enough."""

    def check(batches):
        for pdf in pieces(batches):
            known: dict[int, np.ndarray] = {}  # a centre's set, for the batch
            new = pdf.drop_duplicates("a")
            known.update(zip(new["a"], shingle_sets(new["ta"])))
            ok = [similar(known[a], s) for a, s in zip(pdf["a"], shingle_sets(pdf["tb"]))]
            yield pdf.loc[ok, ["a", "b"]]

    texts = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    both = (pairs.join(texts.select(F.col("i").alias("b"), F.col("t").alias("tb")), "b")
            .join(texts.select(F.col("i").alias("a"), F.col("t").alias("ta")), "a"))
    return both.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long").distinct()


class _Labels:
    """Each rep's component: node and comp of those that are not their own."""

    def __init__(self, links: DataFrame):
        self.rows = materialize(components(links), "labels")

    def of(self, rows: DataFrame) -> DataFrame:
        """Add comp to rows with rep."""
        return rows.join(self.rows.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def add(self, links: DataFrame) -> None:
        """Join components by further links (a, b)."""
        links = materialize(links, "links")
        if links.isEmpty():
            return
        for end in ("a", "b"):
            comp = self.rows.select(F.col("node").alias(end), F.col("comp").alias("c"))
            links = links.join(comp, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        moved = components(links)
        old = self.rows.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("c")), "comp", "left")
        self.rows = materialize(old.select("node", F.coalesce("c", "comp").alias("comp")).union(moved), "labels")


def _undone(members: DataFrame, labels: _Labels) -> DataFrame:
    """The members, their comp and their bucket's number of members, where they lie in several components."""
    now = labels.of(members)
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("members"))
    return materialize(now.join(mixed.where("x < y").select("bucket", "members"), "bucket"), "undone")


def _pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs a < b of a bucket's members from different components whose sizes allow a link."""
    other = members.select("bucket", F.col("rep").alias("c"), F.col("comp").alias("cc"), F.col("n").alias("nc"))
    near = 100 * F.least("n", "nc") >= PERCENT * F.greatest("n", "nc")
    met = members.join(other, "bucket").where((F.col("rep") < F.col("c")) & (F.col("comp") != F.col("cc")) & near)
    return met.select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct()


def _rare_pairs(reps: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Distinct pairs a < b of ``reps`` (rep, comp) from different components that the order of shingles does not rule out."""

    def spread(batches):
        for pdf in pieces(batches):
            sets = shingle_sets(pdf["t"])
            yield pd.DataFrame({"rep": pdf["i"], "n": [len(s) for s in sets], "s": [s.view(np.int64) for s in sets]})

    texts = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    texts = texts.join(reps.select(F.col("rep").alias("i")), "i", "left_semi")
    held = texts.mapInPandas(spread, "rep long, n long, s array<long>").select("rep", "n", F.explode("s").alias("h"))
    held = materialize(held, "shingles")
    often = held.groupBy("h").agg(F.count("*").alias("times"))
    order = F.row_number().over(Window.partitionBy("rep").orderBy("times", "h")) - 1  # a text's shingles
    first = held.join(often, "h").withColumn("at", order)
    first = first.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100)) & (F.col("times") > 1))
    first = materialize(first.select("rep", "n", "h", "at").join(reps, "rep"), "rare-shingles")
    # x is the smaller set: of its n shingles, 2 * PERCENT / (100 + PERCENT) are common at least
    x = first.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * 2 * PERCENT / (100 + PERCENT)))
    x = x.select("h", *(F.col(c).alias(f"x_{c}") for c in ("rep", "comp", "n", "at")))
    common = 1 + F.least(F.col("x_n") - F.col("x_at") - 1, F.col("n") - F.col("at") - 1)  # at most
    enough = (100 + PERCENT) * common >= PERCENT * (F.col("x_n") + F.col("n"))
    met = x.join(first, "h").where((F.col("x_n") <= F.col("n")) & (F.col("x_comp") != F.col("comp")) & enough)
    return met.select(F.least("x_rep", "rep").alias("a"), F.greatest("x_rep", "rep").alias("b")).distinct()


def link_components(sets: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, labels): key and rep of each set; node and comp of each rep that is not its own component."""
    held = sets.where(F.col("n") > 0).where(F.col("i").isNotNull())
    classes = materialize(held.groupBy("key").agg(F.min("i").alias("rep")), "classes")
    reps = held.join(classes, "key").where(F.col("i") == F.col("rep")).select("rep", "n", "bands", "sketch")
    reps = materialize(reps, "class-sketches")
    sketches = reps.select("rep", "n", "sketch")
    rows = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    # the least member of each bucket is the first centre, and has met all others
    members = materialize(rows.join(shared.select("bucket", "lo"), "bucket").where("rep <> lo"), "buckets")

    def links(pairs: DataFrame) -> DataFrame:
        return confirm(materialize(sketch_filter(pairs, sketches), "pairs"), docs, doc_id, text)

    labels = _Labels(links(members.select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()))

    undone = _undone(members.select("bucket", "rep", "n"), labels)
    labels.add(links(_pairs(undone.where(F.col("members") <= SMALL))))
    large = undone.where(F.col("members") > SMALL).select("rep").distinct()
    if not large.isEmpty():
        labels.add(links(_rare_pairs(materialize(labels.of(large).select("rep", "comp"), "large"), docs, doc_id, text)))
    return classes, labels.rows


def neardup_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    sets = materialize(signatures(docs), "signatures")
    classes, labels = link_components(sets, docs)
    where = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp"))
    rows = sets.select("i", "n", F.when(F.col("i").isNotNull(), F.col("key")).alias("key")).join(where, "key", "left")
    component = F.coalesce("comp", "i")
    return rows.select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.col("i").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``; rows without an id stay."""
    kept = neardup_table(docs.select("doc_id", "text")).where("kept").where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    rows = docs.join(kept, "doc_id", "left_semi").withColumn("_row", first).where(F.col("_row") == 1).select(*docs.columns)
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


#: All pairs of sets that share a shingle, and all ids that links reach (ids are unique and not null).
ORACLE_SQL = f"""
WITH RECURSIVE
d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'),
                                             '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE}
      THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d),
c AS MATERIALIZED (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, words) AS class
  FROM (SELECT doc_id, count(*) AS n, sha256(string_agg(shingle, chr(10) ORDER BY shingle)) AS words FROM s GROUP BY doc_id)),
r AS MATERIALIZED (SELECT s.doc_id, n, shingle FROM s JOIN c ON s.doc_id = c.doc_id AND c.doc_id = c.class),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM r a JOIN r b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
                   AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, root) AS (
  SELECT class, class FROM (SELECT DISTINCT class FROM c)
  UNION
  SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node WHERE reach.root < e.b),
t AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(t.root, d.doc_id) AS component_id,
       d.doc_id = coalesce(t.root, d.doc_id) AS kept
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON t.node = c.class
"""
