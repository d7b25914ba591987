"""D8 recovery panel and its checks (the flagship query)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.operators.asof import asof_backward, recovery_search
from aftershock.operators.flags import horizon_flags
from aftershock.plans import proxies
from aftershock.sources.tables import table

HORIZONS = (1, 7, 30, 180)


def recovery_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery_search(proxies.long_prices(spark, sf_dir, proxies.START),
                           proxies.storms(spark, sf_dir, start=proxies.START))


def recovery_panel_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel over prices of which every fifth is NaN: missing, as null is."""
    p = proxies.long_prices(spark, sf_dir, proxies.START)
    hole = (F.datediff("date", F.lit("1970-01-01")) + F.col("ticker")) % 5 == 0
    p = p.withColumn("close", F.when(hole, F.lit(float("nan"))).otherwise(F.col("close")))
    return recovery_search(p, proxies.storms(spark, sf_dir, start=proxies.START))


def recovery_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4/A6/A8 over the recovery panel in one aggregate.  The exact
    percentiles hold one entry per distinct day count, a calendar-bounded
    set (0..length of the price history), so the aggregate stays small."""
    r = recovery_panel(spark, sf_dir)
    d = F.col("recovery_days")
    missing = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing_{c}")
               for c in ("pre_shock_date", "pre_shock_price", "recovery_date", "recovery_price",
                         "recovery_days")]
    return r.agg(
        F.countDistinct("event_name").alias("num_storms"),
        F.count(F.lit(1)).alias("n_rows"),
        *missing,
        F.count(d).alias("days_count"),
        F.round(F.avg(d), 6).alias("days_mean"),
        F.round(F.stddev_samp(d), 6).alias("days_std"),
        F.min(d).alias("days_min"),
        F.round(F.percentile(d, 0.25), 6).alias("days_p25"),
        F.round(F.percentile(d, 0.5), 6).alias("days_p50"),
        F.round(F.percentile(d, 0.75), 6).alias("days_p75"),
        F.max(d).alias("days_max"))


def recovery_ticker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of 'distinct tickers per storm' (all storms equal)."""
    r = recovery_panel(spark, sf_dir)
    per_storm = r.groupBy("event_name").agg(F.countDistinct("ticker").alias("num_distinct_tickers"))
    return (per_storm.groupBy("num_distinct_tickers").agg(F.count(F.lit(1)).alias("num_storms"))
            .orderBy("num_distinct_tickers"))


def recovery_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recovery_panel(spark, sf_dir).select("event_name", "ticker", "recovery_days")
    return horizon_flags(r, "recovery_days", HORIZONS)


def asof_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 on event prices: for each purchase day of a user, the user's last
    daily close strictly before that day."""
    ev = table(spark, sf_dir, "events")
    probes = (ev.where(F.col("event_type") == "purchase")
              .select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("probe_date")).distinct())
    prices = proxies.event_prices(spark, sf_dir)
    out = asof_backward(probes, prices, by="ticker", left_on="probe_date", right_on="date",
                        values=["close"], strict=True, prefix="pre_")
    return out.select("ticker", "probe_date", F.col("pre_date").alias("pre_shock_date"),
                      F.col("pre_close").alias("pre_shock_price"))


def _recovery_sql(prices: str) -> str:
    return f"""
WITH prices AS ({prices}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM prices),
storms AS ({proxies.RECOVERY_STORMS_SQL}),
tickers AS (SELECT DISTINCT ticker FROM prices),
pairs AS (SELECT s.event_name, s.shock_date, t.ticker FROM storms s CROSS JOIN tickers t),
bench AS (
  SELECT p.event_name, p.shock_date, p.ticker, r.date AS pre_shock_date, r.close AS pre_shock_price, r.rn AS brn
  FROM pairs p ASOF LEFT JOIN ranked r ON p.ticker = r.ticker AND p.shock_date > r.date),
hits AS (
  SELECT b.event_name, b.ticker, min(r.rn) AS hit_rn
  FROM bench b JOIN ranked r
    ON r.ticker = b.ticker AND r.date >= b.shock_date AND r.close >= b.pre_shock_price
  GROUP BY 1, 2),
panel AS (
SELECT b.event_name, b.shock_date, b.ticker, b.pre_shock_date, b.pre_shock_price,
       r.date AS recovery_date, r.close AS recovery_price,
       CAST(CASE WHEN b.pre_shock_price IS NULL THEN NULL WHEN h.hit_rn IS NULL THEN -1
                 ELSE h.hit_rn - b.brn - 1 END AS INTEGER) AS recovery_days,
       CAST(CASE WHEN b.pre_shock_price IS NULL THEN 0 ELSE 1 END AS INTEGER) AS benchmark_available,
       CAST(CASE WHEN b.pre_shock_price IS NULL THEN NULL WHEN h.hit_rn IS NULL THEN 0 ELSE 1 END AS INTEGER)
         AS recovered_by_end
FROM bench b LEFT JOIN hits h ON h.event_name = b.event_name AND h.ticker = b.ticker
LEFT JOIN ranked r ON r.ticker = b.ticker AND r.rn = h.hit_rn)"""


_RECOVERY_SQL = _recovery_sql(proxies.RECOVERY_PRICES_SQL)

ORACLE = {
    "recovery_panel": _RECOVERY_SQL + "\nSELECT * FROM panel",
    "recovery_panel_nan": _recovery_sql(f"""SELECT ticker, date,
  CASE WHEN (date - DATE '1970-01-01' + ticker) % 5 <> 0 THEN close END AS close
  FROM ({proxies.RECOVERY_PRICES_SQL}) x""") + "\nSELECT * FROM panel",
    "recovery_checks": _RECOVERY_SQL + """
SELECT count(DISTINCT event_name) AS num_storms, count(*) AS n_rows,
       count(*) FILTER (WHERE pre_shock_date IS NULL) AS missing_pre_shock_date,
       count(*) FILTER (WHERE pre_shock_price IS NULL) AS missing_pre_shock_price,
       count(*) FILTER (WHERE recovery_date IS NULL) AS missing_recovery_date,
       count(*) FILTER (WHERE recovery_price IS NULL) AS missing_recovery_price,
       count(*) FILTER (WHERE recovery_days IS NULL) AS missing_recovery_days,
       count(recovery_days) AS days_count, round(avg(recovery_days), 6) AS days_mean,
       round(stddev_samp(recovery_days), 6) AS days_std, min(recovery_days) AS days_min,
       round(quantile_cont(recovery_days, 0.25), 6) AS days_p25,
       round(quantile_cont(recovery_days, 0.5), 6) AS days_p50,
       round(quantile_cont(recovery_days, 0.75), 6) AS days_p75,
       max(recovery_days) AS days_max
FROM panel""",
    "recovery_ticker_counts": _RECOVERY_SQL + """
SELECT num_distinct_tickers, count(*) AS num_storms FROM
  (SELECT event_name, count(DISTINCT ticker) AS num_distinct_tickers FROM panel GROUP BY 1) t
GROUP BY 1 ORDER BY 1""",
    "recovery_flags": _RECOVERY_SQL + """
SELECT event_name, ticker, recovery_days,
""" + ",\n".join(
        f"  CAST((recovery_days <> -1 AND recovery_days <= {k}) AS INTEGER) AS rec_{k}d" for k in HORIZONS
    ) + "\nFROM panel",
    "asof_benchmark": f"""
WITH prices AS ({proxies.EVENT_PRICES_SQL}),
probes AS (SELECT DISTINCT user_id AS ticker, CAST(ts AS DATE) AS probe_date FROM events
           WHERE event_type = 'purchase')
SELECT p.ticker, p.probe_date, r.date AS pre_shock_date, r.close AS pre_shock_price
FROM probes p ASOF LEFT JOIN prices r ON p.ticker = r.ticker AND p.probe_date > r.date""",
}

QUERIES = {
    "recovery_panel": recovery_panel,
    "recovery_panel_nan": recovery_panel_nan,
    "recovery_checks": recovery_checks,
    "recovery_ticker_counts": recovery_ticker_counts,
    "recovery_flags": recovery_flags,
    "asof_benchmark": asof_benchmark,
}
