"""Damage rollups, market/local returns around storms, sector impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from aftershock.functions.numeric import exact_mean, exact_mean_sql, pct_change_expr
from aftershock.operators.joins import membership_flag, substring_or_equal_join, window_join
from aftershock.operators.ranking import ordinal
from aftershock.operators.series import ffill_series, pct_change
from aftershock.plans import proxies
from aftershock.sources.tables import table

MARKET_DAYS, LOCAL_DAYS = 15, 10
SECTOR_RANGE = ("1998-01-01", "1998-02-28")
PEAK_DAYS = ("1998-01-25", "1998-01-29")
SECTOR_STATES = ("NATION_1", "NATION_3", "NATION_8", "NATION_12", "NATION_17", "NATION_20", "NATION_24")


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- D10
def storm_top3_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest 'storms' (orders by damage) of every year."""
    return proxies.storms(spark, sf_dir).select("disaster_year", "storm_rank", "event_name", "damage")


def damage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + P7 + L2: damage (revenue, millions) per year and priority.

    lineitem is pre-aggregated per order before the join; that aggregate
    already hash-partitions on the order key, so the join adds no shuffle of
    the big side."""
    li = table(spark, sf_dir, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("_rev"),
        F.count(F.lit(1)).alias("_n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"),
                                              "o_orderpriority")
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey)
    return (j.groupBy("year", "o_orderpriority")
            .agg(_r6(F.coalesce(F.sum("_rev"), F.lit(0.0)) / 1e6).alias("total_damage_m"),
                 F.sum("_n").alias("n_lines"))
            .orderBy("year", "o_orderpriority"))


def top_k_damage(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """L3: top-k orders by damage (the limit is the feature)."""
    o = table(spark, sf_dir, "orders")
    return (o.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(k)
            .select("o_orderkey", "o_custkey", _r6(F.col("o_totalprice") / 1000).alias("damage_k")))


# ---------------------------------------------------------------- D11
def _market(spark, sf_dir) -> DataFrame:
    """Market average close per day (nulls skipped)."""
    return proxies.long_prices(spark, sf_dir).groupBy("date").agg(exact_mean("close").alias("market_close"))


def market_return_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pct_change(_market(spark, sf_dir), [], "date", "market_close", "market_ret")
    return m.select("date", _r6("market_close").alias("market_close"), _r6("market_ret").alias("market_ret"))


def storm_vs_normal_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 + A3: mean market return on storm days vs other days, one pass."""
    m = pct_change(_market(spark, sf_dir), [], "date", "market_close", "market_ret")
    m = membership_flag(m, "date", proxies.storms(spark, sf_dir), "shock_date", "is_storm_day")
    r, s = F.col("market_ret"), F.col("is_storm_day")
    return m.agg(_r6(F.avg(F.when(s, r))).alias("avg_ret_storm"),
                 _r6(F.avg(F.when(~s, r))).alias("avg_ret_normal"),
                 F.count(F.when(s, r)).alias("n_storm_days"),
                 F.count(F.when(~s, r)).alias("n_normal_days"))


# ---------------------------------------------------------------- D12
def event_window_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market returns, computed on the full series, within +-15 days."""
    st = proxies.storms(spark, sf_dir).select("event_name", "shock_date")
    m = pct_change(_market(spark, sf_dir), [], "date", "market_close", "market_ret")
    j = window_join(st, m, "shock_date", "date", MARKET_DAYS, MARKET_DAYS)
    return j.select("event_name", "shock_date", "date", F.col("offset_days").cast("int").alias("offset_days"),
                    _r6("market_close").alias("market_close"), _r6("market_ret").alias("market_ret"))


def _trading_days(prices: DataFrame) -> DataFrame:
    """date and its number among all days on which any firm has a price."""
    return ordinal(prices.select("date").distinct(), ["date"], "day")


def _storm_places(spark, sf_dir) -> DataFrame:
    """Storm location = lower nation name of the ordering customer; storm
    'country' = lower name of nation (order key mod 25)."""
    st = proxies.storms(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    loc = n.select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("location"))
    ctry = n.select(F.col("n_nationkey").alias("_ck"), F.lower("n_name").alias("country"))
    # nation is a fixed 25-row dimension: broadcast lookups
    return (st.join(c, st.o_custkey == c.c_custkey, "left").join(F.broadcast(loc), "c_nationkey", "left")
            .join(F.broadcast(ctry), F.col("_ck") == F.col("o_orderkey") % 25, "left")
            .select("event_name", "shock_date", "location", "country"))


def _firms(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), "s_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"),
                                              F.lower("n_name").alias("firm_region"), "n_regionkey")
    return s.join(F.broadcast(n), "s_nationkey")  # 25-row dimension


def event_window_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 + J14: firms whose region is inside the storm location (substring)
    or equals its country; the mean of their daily returns within +-10 days.
    A firm's return is taken inside the window, over consecutive trading days;
    a day without a price gives none."""
    pairs = substring_or_equal_join(_firms(spark, sf_dir).select("ticker", "firm_region"),
                                    _storm_places(spark, sf_dir), "firm_region", "location", "country")
    pairs = pairs.select("event_name", "shock_date", "ticker")
    prices = proxies.long_prices(spark, sf_dir)
    days = pairs.withColumn("offset_days", F.explode(F.sequence(F.lit(-LOCAL_DAYS), F.lit(LOCAL_DAYS)))) \
        .withColumn("date", F.date_add("shock_date", "offset_days"))
    j = days.join(prices.hint("merge"), ["ticker", "date"]).join(_trading_days(prices), "date")
    own = W.partitionBy("event_name", "ticker").orderBy("date")  # at most 21 rows
    ret = F.when(F.lag("day").over(own) == F.col("day") - 1,
                 pct_change_expr(F.col("close"), F.lag("close").over(own)))
    local = j.withColumn("_ret", ret).groupBy("event_name", "shock_date", "date", "offset_days").agg(
        F.avg("_ret").alias("local_ret"), F.countDistinct("ticker").alias("n_firms"))
    return local.select("event_name", "shock_date", "date", F.col("offset_days").cast("int").alias("offset_days"),
                        _r6("local_ret").alias("local_ret"), "n_firms")


# ---------------------------------------------------------------- D13 / W6
def ffill_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 + W5: daily grid per user between first and last active day, close
    forward-filled, then percent change of the filled series."""
    p = proxies.event_prices(spark, sf_dir)
    span = p.groupBy("ticker").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    grid = span.select("ticker", F.explode(F.sequence("_lo", "_hi")).alias("date"))
    g = grid.join(p, ["ticker", "date"], "left")
    g = ffill_series(g, "ticker", "date", "close", "close_ffill")
    g = pct_change(g, "ticker", "date", "close_ffill", "ret")
    return g.select("ticker", "date", _r6("close").alias("close"), _r6("close_ffill").alias("close_ffill"),
                    _r6("ret").alias("ret"))


def sector_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firms of some states (last part of the headquarters text); over a
    two-month slice of trading days the close is forward-filled and differenced,
    the returns of the peak days are averaged per firm, then over the firms of
    each sector (region), lowest first."""
    def between(bounds):
        return F.col("date").between(*[F.lit(x).cast("date") for x in bounds])

    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("sector"))
    # nation and region are fixed dimensions of 25 and 5 rows
    firms = s.join(F.broadcast(n), "s_nationkey").join(F.broadcast(reg), "n_regionkey")
    headquarters = F.concat_ws(", ", "s_name", "n_name")
    state = F.trim(F.element_at(F.split(headquarters, ","), -1))
    firms = firms.where(state.isin(*SECTOR_STATES)).select(F.col("s_suppkey").alias("ticker"), "sector")
    p = proxies.long_prices(spark, sf_dir).where(between(SECTOR_RANGE))
    days = p.select("date").distinct()  # at most the days of the slice
    grid = firms.join(p.select("ticker").distinct(), "ticker", "left_semi").select("ticker", F.explode(F.sequence(
        F.lit(SECTOR_RANGE[0]).cast("date"), F.lit(SECTOR_RANGE[1]).cast("date"))).alias("date"))
    g = grid.join(days, "date").join(p, ["ticker", "date"], "left")
    w = W.partitionBy("ticker").orderBy("date")  # at most 59 rows
    g = g.withColumn("filled", F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = g.withColumn("ret", pct_change_expr(F.col("filled"), F.lag("filled").over(w)))
    per_firm = g.where(between(PEAK_DAYS)).groupBy("ticker").agg(F.avg("ret").alias("mean_ret"))
    return (per_firm.join(firms, "ticker").groupBy("sector")
            .agg(_r6(F.avg("mean_ret")).alias("avg_return"), F.count("mean_ret").alias("n_firms"))
            .orderBy(F.col("avg_return").asc_nulls_last()))


QUERIES = {
    "storm_top3_per_year": storm_top3_per_year,
    "damage_by_group": damage_by_group,
    "top_k_damage": top_k_damage,
    "market_return_daily": market_return_daily,
    "storm_vs_normal_returns": storm_vs_normal_returns,
    "event_window_market": event_window_market,
    "event_window_local": event_window_local,
    "ffill_returns": ffill_returns,
    "sector_impact": sector_impact,
}

_MARKET = f"""market AS (SELECT date, {exact_mean_sql("close")} AS market_close FROM ({proxies.LONG_PRICES_SQL}) p GROUP BY date),
mret AS (SELECT date, market_close, market_close / lag(market_close) OVER (ORDER BY date) - 1 AS market_ret
         FROM market)"""

_FIRMS = """firms AS (SELECT s.s_suppkey AS ticker, lower(n.n_name) AS firm_region, n.n_regionkey
          FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

ORACLE = {
    "storm_top3_per_year": f"SELECT disaster_year, storm_rank, event_name, damage FROM ({proxies.STORMS_SQL}) s",
    "damage_by_group": """
SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, o.o_orderpriority,
       round(coalesce(sum(l.l_extendedprice * (1 - l.l_discount)), 0) / 1e6, 6) AS total_damage_m,
       count(*) AS n_lines
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY 1, 2 ORDER BY 1, 2""",
    "top_k_damage": """
SELECT o_orderkey, o_custkey, round(o_totalprice / 1000, 6) AS damage_k FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10""",
    "market_return_daily": f"""WITH {_MARKET}
SELECT date, round(market_close, 6) AS market_close, round(market_ret, 6) AS market_ret FROM mret""",
    "storm_vs_normal_returns": f"""WITH {_MARKET},
storms AS ({proxies.STORMS_SQL}),
flagged AS (SELECT m.*, m.date IN (SELECT shock_date FROM storms) AS s FROM mret m)
SELECT round(avg(market_ret) FILTER (WHERE s), 6) AS avg_ret_storm,
       round(avg(market_ret) FILTER (WHERE NOT s), 6) AS avg_ret_normal,
       count(market_ret) FILTER (WHERE s) AS n_storm_days,
       count(market_ret) FILTER (WHERE NOT s) AS n_normal_days
FROM flagged""",
    "event_window_market": f"""WITH {_MARKET},
storms AS ({proxies.STORMS_SQL})
SELECT s.event_name, s.shock_date, m.date, CAST(m.date - s.shock_date AS INTEGER) AS offset_days,
       round(m.market_close, 6) AS market_close, round(m.market_ret, 6) AS market_ret
FROM storms s JOIN mret m
  ON m.date BETWEEN s.shock_date - INTERVAL {MARKET_DAYS} DAY AND s.shock_date + INTERVAL {MARKET_DAYS} DAY""",
    "event_window_local": f"""WITH storms AS ({proxies.STORMS_SQL}),
places AS (SELECT s.event_name, s.shock_date, lower(n1.n_name) AS location, lower(n2.n_name) AS country
           FROM storms s LEFT JOIN customer c ON s.o_custkey = c.c_custkey
           LEFT JOIN nation n1 ON c.c_nationkey = n1.n_nationkey
           LEFT JOIN nation n2 ON n2.n_nationkey = s.o_orderkey % 25),
{_FIRMS},
pairs AS (SELECT DISTINCT p.event_name, p.shock_date, f.ticker FROM places p JOIN firms f
          ON contains(p.location, f.firm_region) OR f.firm_region = p.country),
prices AS ({proxies.LONG_PRICES_SQL}),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM prices) d),
j AS (SELECT p.event_name, p.shock_date, p.ticker, x.date, x.close, c.day
      FROM pairs p JOIN prices x ON x.ticker = p.ticker
       AND x.date BETWEEN p.shock_date - INTERVAL {LOCAL_DAYS} DAY AND p.shock_date + INTERVAL {LOCAL_DAYS} DAY
      JOIN cal c ON c.date = x.date),
r AS (SELECT *, CASE WHEN lag(day) OVER o = day - 1 THEN close / lag(close) OVER o - 1 END AS ret
      FROM j WINDOW o AS (PARTITION BY event_name, ticker ORDER BY date))
SELECT event_name, shock_date, date, CAST(date - shock_date AS INTEGER) AS offset_days,
       round(avg(ret), 6) AS local_ret, count(DISTINCT ticker) AS n_firms
FROM r GROUP BY event_name, shock_date, date""",
    "ffill_returns": f"""WITH p AS ({proxies.EVENT_PRICES_SQL}),
span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM p GROUP BY 1),
grid AS (SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
g AS (SELECT grid.ticker, grid.date, p.close,
             last_value(p.close IGNORE NULLS) OVER (PARTITION BY grid.ticker ORDER BY grid.date
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close_ffill
      FROM grid LEFT JOIN p ON p.ticker = grid.ticker AND p.date = grid.date)
SELECT ticker, date, round(close, 6) AS close, round(close_ffill, 6) AS close_ffill,
       round(close_ffill / lag(close_ffill) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS ret
FROM g""",
    "sector_impact": f"""WITH p AS (SELECT * FROM ({proxies.LONG_PRICES_SQL}) x
           WHERE date BETWEEN DATE '{SECTOR_RANGE[0]}' AND DATE '{SECTOR_RANGE[1]}'),
firms AS (SELECT s.s_suppkey AS ticker, g.r_name AS sector
          FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region g ON g.r_regionkey = n.n_regionkey
          WHERE trim(split_part(s.s_name || ', ' || n.n_name, ',', -1)) IN {SECTOR_STATES}),
grid AS (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM p WHERE ticker IN (SELECT ticker FROM firms)) t
         CROSS JOIN (SELECT DISTINCT date FROM p) d),
f AS (SELECT grid.ticker, grid.date, last_value(p.close IGNORE NULLS) OVER (PARTITION BY grid.ticker ORDER BY grid.date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cf
      FROM grid LEFT JOIN p ON p.ticker = grid.ticker AND p.date = grid.date),
r AS (SELECT ticker, date, cf / lag(cf) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM f),
per AS (SELECT ticker, avg(ret) AS mean_ret FROM r
        WHERE date BETWEEN DATE '{PEAK_DAYS[0]}' AND DATE '{PEAK_DAYS[1]}' GROUP BY 1)
SELECT firms.sector, round(avg(mean_ret), 6) AS avg_return, count(mean_ret) AS n_firms
FROM per JOIN firms USING (ticker) GROUP BY 1 ORDER BY 2 NULLS LAST""",
}
