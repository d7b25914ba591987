"""Row numbers within groups of any size, in DataFrame operations only.

A window over a group that holds a third of all rows would sort them in one
task.  Here each group is split by a hash into ``BUCKETS`` parts: the parts'
counts, at most ``BUCKETS`` rows a group, give each part's first number, and
rows are numbered within their part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 512


def bucket_of(key: str | Column) -> Column:
    """The part of a row, from the md5 of a text (null counts as empty)."""
    col = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.coalesce(col, F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS


def number_within(rows: DataFrame, group: list[str], bucket: str, order: list[str], name: str,
                  facts: DataFrame | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each group, by bucket and then ``order``.

    ``facts`` may have a row a group, whose columns are added too: they are
    joined to the parts' counts, so that no large group meets in one task.
    The group's columns must not be null.  Where ``order`` leaves ties, tied
    rows are numbered in any order.
    """
    parts = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    if facts is not None:
        first = first.join(facts, group)
    own = Window.partitionBy(*group, bucket).orderBy(*order)
    return (rows.join(first, [*group, bucket])
            .withColumn(name, F.col("_first") + F.row_number().over(own) - 1).drop("_first"))
