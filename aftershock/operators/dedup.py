"""Ordered dedup / first-row operators.

"Keep the first row per key under an ordering" is written as an aggregate
``min(struct(order..., payload))`` rather than ``row_number() == 1``: a hash
aggregate combines partially on the map side, so a key holding a third of all
rows never lands whole in one task.  Descending keys are negated (numbers,
dates) so the struct order is the wanted order; nulls sort last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order_part(col: str, desc: bool, dtype: str) -> list[Column]:
    c = F.col(col)
    if desc:
        if dtype in ("date",):
            c = -F.unix_date(c)
        elif dtype.startswith("timestamp"):
            c = -F.unix_micros(c.cast("timestamp"))
        elif dtype == "boolean":
            c = -c.cast("int")
        elif dtype == "string":
            raise ValueError("descending string order keys are not supported; map them to numbers")
        else:
            c = -c
    # nulls last in both directions: (is_null, value)
    return [F.col(col).isNull(), c]


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Keep one row per ``keys``: the first under ``order`` [(col, desc)].
    The order must be total (end with a unique column) for a deterministic
    result."""
    types = dict(df.dtypes)
    parts = []
    for i, (c, desc) in enumerate(order):
        isnull, val = _order_part(c, desc, types[c])
        parts += [isnull.alias(f"_n{i}"), val.alias(f"_o{i}")]
    payload = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*parts, F.struct(*[F.col(c) for c in payload]).alias("_p"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best._p")[c].alias(c) for c in payload])


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """``row_number() <= n``; Spark plans a partial WindowGroupLimit
    before the shuffle, so each map task sends at most n rows per group."""
    from pyspark.sql.window import Window as W
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
