"""Aggregations (A1-A18).  Every profile is one aggregate pass (partial +
final hash aggregation); nothing is collected except the final small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Per column, null count and null percentage (one pass, then stack)."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_n{i}") for i, c in enumerate(cols)])
    stacked = one.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("null_count")) for i, c in enumerate(cols)
    ])).alias("_s"))
    return stacked.select(F.col("_s.column").alias("column"), F.col("_s.null_count").alias("null_count"),
                          F.round(F.try_divide(F.col("_s.null_count") * 100.0, F.col("_rows")), digits).alias("null_pct"))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float]) -> list[float | None]:
    """Exact type-7 quantiles (linear interpolation) without gathering the
    column in one task: rows get their global rank by a distributed ordinal
    (range partitioning), and only the <= 2 rows per level are fetched."""
    from aftershock.operators.ranking import ordinal
    d = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    n = d.count()
    if n == 0:
        return [None for _ in qs]
    spots = []
    for q in qs:
        h = (n - 1) * q
        lo = int(h // 1)
        spots.append((h, lo, min(lo + 1, n - 1)))
    need = sorted({i + 1 for _, lo, hi in spots for i in (lo, hi)})
    o = ordinal(d, ["_v"], "_o")
    vals = {r["_o"]: r["_v"] for r in o.where(F.col("_o").isin(need)).collect()}  # <= 2 rows per level
    return [vals[lo + 1] + (h - lo) * (vals[hi + 1] - vals[lo + 1]) for h, lo, hi in spots]


def describe(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """Count, mean, sample sd, min, exact quartiles (linear), max.
    Quartiles come from ``exact_quantiles`` (distributed), the rest from one
    aggregate pass."""
    c = F.col(col)
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    lit = [F.lit(None).cast("double") if v is None else F.round(F.lit(float(v)), digits) for v in q]
    return df.agg(F.count(c).alias("count"), F.round(F.avg(c), digits).alias("mean"),
                  F.round(F.stddev_samp(c), digits).alias("std"), F.min(c).alias("min"),
                  F.max(c).alias("max")) \
        .select("count", "mean", "std", "min", lit[0].alias("p25"), lit[1].alias("p50"), lit[2].alias("p75"), "max")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts sorted by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(col)


def distinct_counts(df: DataFrame, group: str, col: str, all_label: str = "ALL") -> DataFrame:
    """A4: distinct non-null count of ``col`` per group, plus an overall row."""
    per = df.groupBy(F.col(group).cast("string").alias("group")).agg(F.countDistinct(col).alias("n_distinct"))
    tot = df.agg(F.lit(all_label).alias("group"), F.countDistinct(col).alias("n_distinct"))
    return per.unionByName(tot)


def incomplete_groups(entities: DataFrame, facts: DataFrame, key: str, year: str, n: int) -> DataFrame:
    """A5: entities with fewer than ``n`` distinct years (none counts as 0)."""
    years = facts.groupBy(key).agg(F.countDistinct(year).alias("_y"))
    j = entities.select(key).distinct().join(years, key, "left")
    return j.agg(F.count(F.when(F.coalesce("_y", F.lit(0)) < n, 1)).alias("n_incomplete"),
                 F.count(F.lit(1)).alias("n_entities"))


def coverage_summary(long: DataFrame, entity: str, variable: str, value: str, digits: int = 6) -> DataFrame:
    """Per variable: non-null rows, entities with any data and their share
    of all entities; sorted by entities desc, rows desc."""
    # the denominator is one number: computed by its own aggregate job
    tot = long.agg(F.countDistinct(entity)).first()[0]
    per = long.groupBy(variable).agg(
        F.count(F.col(value)).alias("non_null_observations"),
        F.countDistinct(F.when(F.col(value).isNotNull(), F.col(entity))).alias("firms_with_any_data"))
    share = (F.round(F.col("firms_with_any_data") / F.lit(float(tot)), digits) if tot
             else F.lit(None).cast("double"))
    return (per.select(F.col(variable).alias("variable"), "non_null_observations", "firms_with_any_data",
                       share.alias("share_of_firms_with_any_data"))
            .orderBy(F.col("firms_with_any_data").desc(), F.col("non_null_observations").desc()))
