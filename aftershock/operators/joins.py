"""Join operators (J1-J9, J13-J15, J19) expressed as equi-joins.

Range and substring predicates are turned into equi-joins by exploding the
small, bounded side (day offsets of a window; substrings of a short location
text), so no join here is a nested loop or a cartesian product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a checked row count; otherwise leave the
    join strategy to Catalyst/AQE (sort-merge with skew splitting)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join where NULL matches NULL (``<=>``), keys kept once."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def left_join_fill(left: DataFrame, right: DataFrame, on: Sequence[str] | str,
                   fill: dict) -> DataFrame:
    """Left join, then absent right values -> defaults."""
    return left.join(right, on, "left").fillna(fill)


def window_join(events: DataFrame, series: DataFrame, event_date: str, series_date: str,
                before: int, after: int, offset_col: str = "offset_days") -> DataFrame:
    """Each event row x series rows with date in [d - before, d + after]
    (calendar days, both ends inclusive).  The event side is exploded into its
    window days and equi-joined on the date, so the join is a hash join whose
    fan-out is the window length."""
    days = events.withColumn(offset_col, F.explode(F.sequence(F.lit(-before), F.lit(after))))
    days = days.withColumn("_d", F.date_add(F.col(event_date), F.col(offset_col)))
    return days.join(series.withColumnRenamed(series_date, "_d"), "_d").withColumnRenamed("_d", series_date)


def substring_or_equal_join(left: DataFrame, right: DataFrame, left_text: str,
                            right_text: str, right_equal: str) -> DataFrame:
    """J13 theta join: ``left_text`` is a substring of ``right_text`` OR equals
    ``right_equal``.  Every substring of the (short) right text is emitted and
    equi-joined with the left text; a NULL text matches nothing.  Returns the
    distinct (left row, right row) pairs."""
    n = F.length(F.col(right_text))
    subs = right.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))) \
        .withColumn("_l", F.explode(F.sequence(F.lit(1), F.greatest(n - F.col("_i") + 1, F.lit(1))))) \
        .where(F.col(right_text).isNotNull() & (n > 0)) \
        .select(*right.columns, F.substring(F.col(right_text), F.col("_i"), F.col("_l")).alias("_key"))
    eq = right.where(F.col(right_equal).isNotNull()).select(*right.columns, F.col(right_equal).alias("_key"))
    keyed = subs.unionByName(eq).distinct()
    return left.join(keyed, left[left_text] == keyed["_key"]).drop("_key").distinct()


def membership_flag(df: DataFrame, col: str, members: DataFrame, member_col: str,
                    out: str) -> DataFrame:
    """Boolean column 'value of ``col`` occurs in ``members``'."""
    m = members.select(F.col(member_col).alias("_m")).where(F.col("_m").isNotNull()).distinct() \
        .withColumn(out, F.lit(True))
    return (df.join(m, df[col] == m["_m"], "left").drop("_m")
            .withColumn(out, F.coalesce(F.col(out), F.lit(False))))


def semi(df: DataFrame, other: DataFrame, on, anti: bool = False) -> DataFrame:
    """F11/J19/F6 with a table: left-semi (keep matches) or left-anti."""
    return df.join(other, on, "left_anti" if anti else "left_semi")
