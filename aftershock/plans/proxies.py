"""Driver tables standing in for the domain inputs.

* long prices  = lineitem per (ticker=l_suppkey, date=ship date),
                 close = mean(l_extendedprice) rounded to 6 places (exact
                 decimal sum, so independent of summation order);
* storms       = the 3 largest orders (o_totalprice) of each order year,
                 event_name = order key as text, shock date = order date;
* firms        = suppliers, their nation as "state", region as region;
* event prices = events per (ticker=user_id, day), close = value of the
                 latest (ts, event_id) of the day.

Each proxy is also written as SQL (``*_SQL``) for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from aftershock.functions.numeric import exact_mean, exact_mean_sql
from aftershock.sources.tables import table

START = "1995-01-01"
STORMS_PER_YEAR = 3


def _ts(day: str):
    # timestamp_ntz literal so the comparison is pushed into the Parquet scan
    return F.expr(f"TIMESTAMP_NTZ'{day} 00:00:00'")


def long_prices(spark: SparkSession, sf_dir: str, start: str | None = None) -> DataFrame:
    """``start`` is the recovery panel's lower date bound (F2)."""
    li = table(spark, sf_dir, "lineitem")
    li = li.where(F.col("l_shipdate") >= _ts(start)) if start else li.where(F.col("l_shipdate").isNotNull())
    return (li.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"))
            .agg(F.round(exact_mean("l_extendedprice"), 6).alias("close")))


def _long_prices_sql(condition: str) -> str:
    return f"""
SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, round({exact_mean_sql("l_extendedprice")}, 6) AS close
FROM lineitem WHERE {condition} GROUP BY 1, 2"""


LONG_PRICES_SQL = _long_prices_sql("l_shipdate IS NOT NULL")
RECOVERY_PRICES_SQL = _long_prices_sql(f"l_shipdate >= TIMESTAMP '{START}'")


def storms(spark: SparkSession, sf_dir: str, per_year: int = STORMS_PER_YEAR,
           start: str | None = None) -> DataFrame:
    """W4 top-N per year.  ``row_number() <= N`` is planned with a partial
    WindowGroupLimit before the shuffle, so a huge year ships only N rows per
    map task."""
    o = table(spark, sf_dir, "orders")
    o = o.where(F.col("o_orderdate") >= _ts(start)) if start else o.where(F.col("o_orderdate").isNotNull())
    w = W.partitionBy(F.year("o_orderdate")).orderBy(F.col("o_totalprice").desc_nulls_last(),
                                                      F.col("o_orderkey"))
    return (o.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_year)
            .select(F.col("o_orderkey").cast("string").alias("event_name"),
                    F.to_date("o_orderdate").alias("shock_date"),
                    F.year("o_orderdate").alias("disaster_year"),
                    F.col("o_totalprice").alias("damage"),
                    F.col("o_custkey"), F.col("o_orderkey"),
                    F.col("_r").cast("int").alias("storm_rank")))


def _storms_sql(condition: str) -> str:
    return f"""
SELECT CAST(o_orderkey AS VARCHAR) AS event_name, CAST(o_orderdate AS DATE) AS shock_date,
       CAST(year(o_orderdate) AS INTEGER) AS disaster_year, o_totalprice AS damage,
       o_custkey, o_orderkey, CAST(r AS INTEGER) AS storm_rank
FROM (SELECT *, row_number() OVER (PARTITION BY year(o_orderdate)
                                   ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS r
      FROM orders WHERE {condition}) t
WHERE r <= {STORMS_PER_YEAR}"""


STORMS_SQL = _storms_sql("o_orderdate IS NOT NULL")
RECOVERY_STORMS_SQL = _storms_sql(f"o_orderdate >= TIMESTAMP '{START}'")


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close per user: value of the latest (ts, event_id) of the day.
    ``max_by`` is a partial aggregate, so a hot user is combined map-side."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"))
            .agg(F.max_by("value", F.struct("ts", "event_id")).alias("close")))


EVENT_PRICES_SQL = """
SELECT user_id AS ticker, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close
FROM events GROUP BY 1, 2"""
