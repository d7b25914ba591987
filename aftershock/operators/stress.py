"""Outcome stress (D15): z-scores (A15), linear score (X19), tail overwrite
(W10), group sampling (L5).  The random draws of the original simulation are
not built; the deterministic parts are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.hashing import seeded_hash
from aftershock.operators.ranking import ordinal


def zscores(df: DataFrame, cols: Sequence[str], prefix: str = "z_") -> DataFrame:
    """(x - mean) / sample sd with global statistics (one aggregate
    job, 2 numbers per column to the driver); null or constant -> 0."""
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = stats[f"m{i}"], stats[f"s{i}"]
        if m is None or not s:
            out[prefix + c] = F.lit(0.0)
        else:
            out[prefix + c] = F.coalesce((F.col(c) - F.lit(m)) / F.lit(s), F.lit(0.0))
    return df.withColumns(out)


def linear_score(df: DataFrame, base: float, weights: dict[str, float],
                 interactions: Sequence[tuple[str, str, float]], z_of: dict[str, str],
                 clamp: tuple[float, float], out: str = "score") -> DataFrame:
    """``base + sum(w * z) + sum(w * z_a * z_b)``, rounded half-even and
    clamped; a weight whose variable is absent from ``z_of`` contributes 0."""
    def z(name):
        return F.col(z_of[name]) if name in z_of else F.lit(0.0)
    expr = F.lit(base)
    for name, w in weights.items():
        expr = expr + F.lit(w) * z(name)
    for a, b, w in interactions:
        expr = expr + F.lit(w) * z(a) * z(b)
    lo, hi = clamp
    return df.withColumn(out, F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(expr, 0))))


def tail_overwrite(df: DataFrame, value: str, key: str, zero_share: float, long_share: float,
                   cap: float, out: str = "recovery_days") -> DataFrame:
    """The lowest ``max(1, round(zero_share*n))`` values -> 0, the highest
    ``max(1, round(long_share*n))`` of the rest -> at least cap+1, all others
    capped at ``cap``; ties by ``key``.  Ranks are distributed (``ordinal``)."""
    n = df.count()
    n_zero, n_long = max(1, round(zero_share * n)), max(1, round(long_share * n))
    if n_zero + n_long >= n:
        raise ValueError("zero + long tails cover all rows")
    d = ordinal(df, [value, key], "_lo")
    d = ordinal(d.withColumn("_negv", -F.col(value)), ["_negv", key], "_hi").drop("_negv")
    v = F.col(value)
    return (d.withColumn(out, F.when(F.col("_lo") <= n_zero, F.lit(0.0))
                         .when(F.col("_hi") <= n_long, F.greatest(v, F.lit(cap + 1)))
                         .otherwise(F.least(v, F.lit(cap))))
            .drop("_lo", "_hi"))


def sample_groups(df: DataFrame, group: str, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """Rows of the first ``n`` groups (by ``order``, default the group
    value); n is capped at the groups available.  Only the n group keys are
    kept (a top-n), then a left-semi join selects the rows."""
    keys = df.select(group).where(F.col(group).isNotNull()).distinct()
    chosen = keys.orderBy(*(order or [group])).limit(n)
    return df.join(F.broadcast(chosen), group, "left_semi")


def category_ordinal(df: DataFrame, col: str, out: str) -> DataFrame:
    """Category -> 1-based ordinal in alphabetical order (R's
    ``as.numeric(as.factor(x))``); null stays null.  The distinct levels are
    numbered with a distributed ordinal and joined back (broadcast only when
    their count is checked small)."""
    from aftershock.operators.joins import broadcast_if_small
    from aftershock.operators.ranking import ordinal
    levels = df.select(col).where(F.col(col).isNotNull()).distinct()
    levels = ordinal(levels, [col], out).withColumn(out, F.col(out).cast("double"))
    return df.join(broadcast_if_small(levels), col, "left")


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """L4: a seeded sample of ``n`` rows: those with the n smallest hashes of
    key and seed (a top-n; reproducible under any partitioning)."""
    return df.orderBy(seeded_hash(key, seed), F.col(key)).limit(n)
