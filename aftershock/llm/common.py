"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package

BATCH_ROWS = 1_000  # rows that a Python worker gets at once: whole texts, some very long


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be anything that Spark's readers open."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus


def is_remainder(doc_id: str | Column, modulus: int, value: int) -> Column:
    """True where the id falls in the fold; a null id falls in none."""
    return F.coalesce(id_remainder(doc_id, modulus) == value, F.lit(False))


def unit_hash(seed: int, *cols: str | Column) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def hash_sample(rows: DataFrame, key: Column, at_most: int, seed: int, *cols: str) -> DataFrame:
    """About ``at_most`` rows of each value of ``key``, chosen by a hash of ``cols``.

    All rows of a value that has fewer.  The counts are taken over all rows;
    no group is sorted or gathered, so a value that holds most rows is as
    cheap as any other.  ``key`` must have few distinct values: one row each
    goes to the driver.
    """
    sizes = {r["k"]: r["n"] for r in rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(key.eqNullSafe(F.lit(value)), F.lit(min(1.0, at_most / n))).otherwise(share)
    return rows.where(unit_hash(seed, *cols) < share)
