"""Mixing sources to target weights by systematic sampling.

A source's documents all have the same expected number of copies, the source's
target over its size.  In their order, the prefix sums of those expectations
plus one random offset of the source cross integers; a document is emitted
once for each integer its interval crosses.  The order is by size, every
second document up and the others down again: neighbours are about as long,
and what the offset adds on the way up it takes back on the way down, so the
words taken follow the target closely.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share
all words by weight; no target exceeds ``MOST`` times its source's size, the
excess goes to the others by weight.  With sources sorted by size over weight
the capped ones come first, so one pass over running sums finds the level.

DataFrame functions only.  One row a source is sorted in one task; documents
are numbered in parts (``ranks``), so that one source may hold most rows.

Defined results: a null text has size 0; a null source is a source; sources of
no words get target 0; repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import BUCKETS, bucket_of, number_within

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3             # copies of a document, and target over size of a source, at most
OFFSET_STEPS = 1 << 20
SEED = "mixing"


def word_count(text: str | Column) -> Column:
    """Words of the whole text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Add the target to one row a source (source and, in words, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight)
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    cap = (F.col("source_size") * MOST).cast("double")
    # with the first k sources at their caps; it rises while those overflow and falls after
    final = F.max("level").over(everything)
    rows = rows.withColumn("level", level)
    return rows.withColumn("target", F.least(cap, final * F.col("weight"))).drop("weight", "level")


def offset_of(source_key: str) -> Column:
    """The source's random offset in [0, 1), a multiple of 1 / OFFSET_STEPS."""
    digits = F.substring(F.md5(F.concat(F.lit(SEED), F.col(source_key)).cast("binary")), 1, 5)
    return F.conv(digits, 16, 10).cast("long") / float(OFFSET_STEPS)


def with_copies(docs: DataFrame) -> DataFrame:
    """Documents and, in ``_source_size, _target, _copies``, what the mix takes.

    ``docs`` has ``_size`` among its columns, all of which stay.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_key")
    sizes = docs.groupBy("source", "_size").agg(F.count("*").alias("_n"))
    by_source = sizes.groupBy("source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("_rows"))
    plan = targets(by_source).select(key, "_rows", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    # rows of a source that are shorter, from its distinct sizes
    shorter = Window.partitionBy("_key").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    ladder = sizes.select(key, "_size", "_n").select("_key", "_size", F.coalesce(F.sum("_n").over(shorter), F.lit(0)).alias("_shorter"))
    ladder = ladder.join(plan, "_key").withColumn("_offset", offset_of("_key"))
    rows = docs.withColumn("_key", key).withColumn("_bucket", bucket_of(F.col("doc_id").cast("string")))
    rows = number_within(rows, ["_key", "_size"], "_bucket", ["doc_id"], "_rank", ladder)
    expected = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    rank = F.col("_shorter") + F.col("_rank")
    place = F.when(rank % 2 == 0, F.floor(rank / 2)).otherwise(F.col("_rows") - 1 - F.floor(rank / 2))
    copies = F.floor(F.col("_offset") + expected * (place + 1)) - F.floor(F.col("_offset") + expected * place)
    # an interval of at most 3 crosses at most 3 integers; rounding must not add one
    rows = rows.withColumn("_copies", F.least(copies, F.lit(MOST)).cast("long"))
    return rows.drop("_key", "_bucket", "_rank", "_shorter", "_offset", "_rows")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and ``_size``: all that the mix needs to know."""
    return docs.select("doc_id", "source", word_count("text").alias("_size"))


def mixing_table(sizes: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document of ``sized``."""
    out = with_copies(sizes)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                      F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, a row for each copy, with the columns of ``docs``."""
    rows = with_copies(docs.withColumn("_size", word_count("text"))).where(F.col("_copies") > 0)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce('s' || source, 'n') AS k,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::BIGINT % {BUCKETS} AS bucket
  FROM documents),
s AS (SELECT source, k, sum(size)::BIGINT AS source_size FROM d GROUP BY source, k),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (
  SELECT *, (sum(source_size) OVER ()
             - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT k, source_size,
         least((3 * source_size)::DOUBLE,
               max(level) OVER () * weight) AS target,
         ('0x' || substr(md5('{SEED}' || k), 1, 5))::BIGINT / {float(OFFSET_STEPS)} AS u
  FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END::DOUBLE AS e,
         row_number() OVER (PARTITION BY k ORDER BY d.size, d.bucket, d.doc_id) - 1 AS i,
         count(*) OVER (PARTITION BY k) AS n
  FROM d JOIN t USING (k)),
p AS (SELECT *, CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - i // 2 END AS place FROM r)
SELECT doc_id, size, source_size, target,
       least(floor(u + e * (place + 1)) - floor(u + e * place), {MOST})::BIGINT * size AS taken
FROM p
"""
