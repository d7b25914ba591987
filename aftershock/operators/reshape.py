"""Reshape operators (R1-R9): wide <-> long, list columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def q(c: str):
    """Column by exact name (names may hold dots, blanks, newlines)."""
    return F.col(f"`{c}`")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
         var: str = "variable", val: str = "value") -> DataFrame:
    """Wide -> long; null values are kept."""
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot([q(c) for c in ids], [q(c) for c in values], var, val)


def melt_pattern(df: DataFrame, ids: Sequence[str], pattern: str, names: Sequence[str],
                 values: Sequence[str] | None = None, val: str = "value",
                 casts: dict[str, str] | None = None) -> DataFrame:
    """Wide -> long, the column name split by regex groups
    (``(.*)_(\\d{4})``, ``(upstream|downstream)\\((\\d{4})\\)``, ...).
    Greedy as written; a non-matching name gives null parts."""
    long = melt(df, ids, values, "_name", val)
    parts = {}
    for i, n in enumerate(names, start=1):
        e = F.regexp_extract(F.col("_name"), pattern, i)
        e = F.when(e == "", F.lit(None)).otherwise(e)
        parts[n] = e.cast(casts[n]) if casts and n in casts else e
    return long.withColumns(parts).select(*[q(c) for c in ids], *names, val)


def columns_matching(df: DataFrame, prefix: str, exclude_prefix: str | None = None) -> list[str]:
    """``starts_with`` (case-insensitive), optionally minus a longer prefix."""
    out = [c for c in df.columns if c.lower().startswith(prefix.lower())]
    if exclude_prefix:
        out = [c for c in out if not c.lower().startswith(exclude_prefix.lower())]
    return out


def distinct_values(df: DataFrame, column: str, descending: bool = False, at_most: int = 10_000) -> list:
    """The column's distinct values in order, nulls left out.  They become
    column names, so more than ``at_most`` of them is an error."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(at_most + 1).collect()
    if len(found) > at_most:
        raise ValueError(f"{column} has more than {at_most} distinct values")
    return sorted((r[0] for r in found), reverse=descending)


def pivot_first(df: DataFrame, keys: Sequence[str], pivot_col: str, pivot_values: Sequence | None,
                value_cols: Sequence[str], name: str = "{value}_{pivot}",
                order: str = "pivot_major", drop_null_keys: bool = True, whole: bool = False) -> DataFrame:
    """Long -> wide with ``first(ignorenulls)`` per cell.

    Rows whose pivot value is null are dropped; rows with a null key vanish
    too unless ``drop_null_keys=False`` (pandas vs tidyr semantics, T11).  ``order``: 'pivot_major' interleaves the value
    columns per pivot value (R7), 'value_major' groups by value column (R8);
    an explicit pivot value list has the caller's order; without one (None) it
    is the column's distinct values, ascending (A18).
    Rows of a value that is not in the list are left out, or with ``whole`` an error.
    """
    if pivot_values is None:
        pivot_values = distinct_values(df, pivot_col)
    d = df.where(F.col(pivot_col).isNotNull())
    if drop_null_keys:  # pandas pivot semantics (T11); tidyr keeps NA ids
        for k in keys:
            d = d.where(F.col(k).isNotNull())
    if whole:
        told = F.concat(F.lit(f"{pivot_col} not in the pivot list: "), F.col(pivot_col).cast("string"))
        d = d.withColumn(pivot_col, F.when(F.col(pivot_col).isin(list(pivot_values)), F.col(pivot_col)).otherwise(F.raise_error(told)))
    aggs = [F.first(F.col(v), ignorenulls=True).alias(v) for v in value_cols]
    wide = d.groupBy(*keys).pivot(pivot_col, list(pivot_values)).agg(*aggs)
    single = len(value_cols) == 1

    def src(p, v):
        return str(p) if single else f"{p}_{v}"

    if order == "pivot_major":
        cells = [(p, v) for p in pivot_values for v in value_cols]
    else:
        cells = [(p, v) for v in value_cols for p in pivot_values]
    return wide.select(*keys, *[F.col(f"`{src(p, v)}`").alias(name.format(value=v, pivot=p))
                                for p, v in cells])


def separate_rows(df: DataFrame, col: str, sep: str = r",\s*", pos: str = "pos",
                  out: str | None = None) -> DataFrame:
    """One row per item of a delimited string, with its 0-based position;
    a null string stays as one row with null item and position."""
    out = out or col
    rest = [q(c) for c in df.columns if c != col]
    return df.select(*rest, F.posexplode_outer(F.split(q(col), sep)).alias(pos, out))


def unnest_parallel(df: DataFrame, cols: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Explode several list columns in lock step (``arrays_zip``); rows
    whose lists are null or empty are dropped."""
    names = list(names or cols)
    rest = [q(c) for c in df.columns if c not in cols]
    z = F.explode(F.arrays_zip(*[q(c).alias(n) for c, n in zip(cols, names)])).alias("_z")
    return df.select(*rest, z).select(*rest, *[F.col("_z")[n].alias(n) for n in names])
