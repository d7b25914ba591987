"""Numeric scalar functions (X17, X18, X20) with explicit edge semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ieee_divide(a, b) -> Column:
    """a / b with IEEE results for a zero divisor (+-inf, NaN for 0/0), as
    pandas and DuckDB give; null in -> null out.  Spark's ANSI mode would
    raise instead, and ``try_divide`` would hide the case as null."""
    a, b = _c(a), _c(b)
    return (F.when(b == 0, F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
                   .when(a == 0, F.lit(float("nan"))))
            .otherwise(a / b))


def nan_to_null(c) -> Column:
    """A NaN of a numeric source is a missing value: Spark orders NaN above
    every number, so it would win each maximum and pass each threshold."""
    return F.when(~F.isnan(_c(c)), _c(c))


def pct_change_expr(cur, prev) -> Column:
    """W5 ratio ``cur / prev - 1`` with IEEE zero handling."""
    return ieee_divide(cur, prev) - F.lit(1.0)


def exact_mean(c, scale: int = 6) -> Column:
    """Mean of a column of fixed-point values (prices) that does not depend
    on summation order: the sum is exact in DECIMAL(38, scale), then one
    division in double.  Same result for any partitioning or engine."""
    x = _c(c)
    n = F.count(x)
    # DECIMAL(18, s) input keeps the aggregation buffer on Spark's fast path;
    # the sum itself widens to DECIMAL(28, s), so it stays exact
    return F.when(n > 0, F.sum(x.cast(f"decimal(18,{scale})")).cast("double") / n)


def exact_mean_sql(expr: str, scale: int = 6) -> str:
    return f"(CAST(sum(CAST({expr} AS DECIMAL(18,{scale}))) AS DOUBLE) / nullif(count({expr}), 0))"
