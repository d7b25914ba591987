"""Global running sums / ranks over a sorted key without a single-task window.

``ordered_cumsum`` range-partitions the rows on the order key
(``repartitionByRange`` samples the key, so partitions hold similar row
counts), pins that partitioning by writing it to the checkpoint folder (the
partition ids then stay stable across re-execution), computes running sums
inside each range partition and adds the totals of all earlier partitions
(one small row per partition).  Optional ``part`` columns restart the sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from aftershock.operators.joins import null_safe_join
from aftershock.session import materialize


def ordered_cumsum(df: DataFrame, order: Sequence[str], cols: Sequence[str], part: Sequence[str] = (),
                   prefix: str = "cum_", n_parts: int | None = None) -> DataFrame:
    """Inclusive running sums of ``cols`` in ascending ``order`` (within ``part``).
    The order must be total for a deterministic result.  ``part`` is meant
    for low-cardinality splits (classes, projections): the offsets table has
    one row per (range partition, part value)."""
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, order, cols = list(part), list(order), list(cols)
    r = materialize(df.repartitionByRange(n, *part, *order).withColumn("_pid", F.spark_partition_id()),
                    "range-partitioned")
    totals = r.groupBy("_pid", *part).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(cols)])
    earlier = W.partitionBy(*part).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offs = totals.select("_pid", *part, *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_o{i}")
                                          for i in range(len(cols))])
    within = W.partitionBy("_pid", *part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = r.withColumns({f"_w{i}": F.sum(c).over(within) for i, c in enumerate(cols)})
    # one row per (range partition, part); a null part is a part of its own
    out = null_safe_join(out, offs, ["_pid", *part], "inner")
    return (out.withColumns({f"{prefix}{c}": F.col(f"_w{i}") + F.col(f"_o{i}") for i, c in enumerate(cols)})
            .drop("_pid", *[f"_w{i}" for i in range(len(cols))], *[f"_o{i}" for i in range(len(cols))]))


def ordinal(df: DataFrame, order: Sequence[str], out: str = "ordinal", part: Sequence[str] = ()) -> DataFrame:
    """1-based position in ``order`` (within ``part``), distributed."""
    return ordered_cumsum(df.withColumn("_one", F.lit(1)), order, ["_one"], part, prefix="_c") \
        .withColumnRenamed("_c_one", out).drop("_one")


def in_tasks(n: int, least: int, usual: int, most: int) -> int:
    """Tasks for ``n`` rows of which each costs much: one for every ``least``
    rows up to ``usual`` tasks, beyond those as many as hold ``most`` rows."""
    return max(1, min(-(-n // least), usual), -(-n // most))
