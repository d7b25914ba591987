"""Firms x storms by state and year, and the predictor table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.functions.constants import RECOVERY_HORIZONS
from aftershock.functions.dates import duration_days
from aftershock.operators.dedup import first_by
from aftershock.operators.flags import horizon_flags
from aftershock.operators.joins import null_safe_join
from aftershock.operators.reshape import separate_rows
from aftershock.plans import proxies
from aftershock.plans.recovery import _RECOVERY_SQL, recovery_panel
from aftershock.sources.tables import table


def _storm_states(spark, sf_dir) -> DataFrame:
    """Storms with ``affected_states``: the nations of the ordering customer's
    region as a comma list (nation-key order), then one row per state."""
    n = table(spark, sf_dir, "nation")
    # a dimension table: one list per region
    rs = n.groupBy("n_regionkey").agg(F.concat_ws(", ", F.transform(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]))
        .alias("affected_states"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    st = proxies.storms(spark, sf_dir)
    j = (st.join(c, st.o_custkey == c.c_custkey, "left")
         .join(F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey", "left")
         .join(F.broadcast(rs), "n_regionkey", "left")
         .select("event_name", "shock_date", "disaster_year", "o_orderkey", "affected_states"))
    return separate_rows(j, "affected_states", r",\s*", pos="state_pos", out="state")


def _firm_branches(spark, sf_dir) -> DataFrame:
    """Firms = suppliers with two branch states (own nation and nation+5)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n1 = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("_a"))
    n2 = n.select(F.col("n_nationkey").alias("_k2"), F.col("n_name").alias("_b"))
    wide = (s.join(F.broadcast(n1), "s_nationkey")  # nation: 25-row dimension
            .join(F.broadcast(n2), F.col("_k2") == (F.col("s_nationkey") + 5) % 25)
            .select(F.col("s_suppkey").alias("ticker"), F.concat_ws(", ", "_a", "_b").alias("branches")))
    return separate_rows(wide, "branches", r",\s*", pos="_bpos", out="state").drop("_bpos")


def _firm_metrics(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("disaster_year")) \
        .agg(F.sum("l_extendedprice").alias("revenue"))


def firm_event_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 (storm states x firm branches, left), J3 (metrics of the same year),
    W3 (first row per firm and storm by state position)."""
    ev = _storm_states(spark, sf_dir)
    # both sides come from explodes (sizes underestimated): a shuffle join
    j = ev.join(_firm_branches(spark, sf_dir).hint("merge"), "state", "left")
    j = j.join(_firm_metrics(spark, sf_dir), ["ticker", "disaster_year"], "left")
    j = first_by(j, ["ticker", "event_name"], [("state_pos", False), ("state", False)])
    return j.select("event_name", "disaster_year", "ticker", "state", "state_pos",
                    F.round("revenue", 6).alias("revenue"))


def _macro(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("disaster_year")) \
        .agg(F.round(F.sum("o_totalprice") / 1e6, 6).alias("gdp"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("disaster_year")) \
        .agg(F.round(F.avg("l_tax") * 100, 6).alias("inflation"))
    return o.join(li, "disaster_year", "full")


def predictor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm-storm rows + recovery (J2) + dates (X5, X6) + flags
    + macro by year (J1) + home region (P11) ; rows without firm dropped (F4)."""
    fe = firm_event_join(spark, sf_dir).where(F.col("ticker").isNotNull())
    rec = recovery_panel(spark, sf_dir).select("event_name", "ticker", "shock_date", "pre_shock_price",
                                               "recovery_days")
    j = null_safe_join(fe, rec, ["event_name", "ticker"], "left")
    st = proxies.storms(spark, sf_dir).select("event_name", "o_orderkey")
    j = (j.join(st, "event_name", "left")
         .withColumn("end_date", F.date_add("shock_date", (F.col("o_orderkey") % 7).cast("int")))
         .withColumn("start_month", F.month("shock_date"))
         .withColumn("end_month", F.month("end_date"))
         .withColumn("duration", duration_days("shock_date", "end_date")))
    j = horizon_flags(j, "recovery_days", RECOVERY_HORIZONS)
    j = j.join(F.broadcast(_macro(spark, sf_dir)), "disaster_year", "left")  # one row per year
    home = (table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), "s_nationkey")
            .join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"),
                                                                    "n_regionkey")), "s_nationkey", "left")
            .join(F.broadcast(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"),
                                                                    "r_name")), "n_regionkey", "left")
            .select("ticker", F.coalesce("r_name", F.lit("Other")).alias("region")))
    j = j.join(home, "ticker", "left")
    return j.select("event_name", "ticker", "disaster_year", "shock_date", "end_date", "start_month",
                    "end_month", "duration", "state", "revenue", "pre_shock_price", "recovery_days",
                    *[f"rec_{k}d" for k in RECOVERY_HORIZONS], "gdp", "inflation", "region")


_FE_CTES = """
region_states AS (SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS states
                  FROM nation GROUP BY 1),
ss AS (SELECT s.event_name, s.disaster_year, rs.states AS affected_states
       FROM storms s LEFT JOIN customer c ON s.o_custkey = c.c_custkey
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
       LEFT JOIN region_states rs ON rs.n_regionkey = n.n_regionkey),
ex AS (SELECT event_name, disaster_year, unnest(range(0, len(parts))) AS state_pos, unnest(parts) AS state
       FROM (SELECT *, regexp_split_to_array(affected_states, ',\\s*') AS parts FROM ss)),
firms AS (SELECT s.s_suppkey AS ticker, n1.n_name || ', ' || n2.n_name AS branches
          FROM supplier s JOIN nation n1 ON n1.n_nationkey = s.s_nationkey
          JOIN nation n2 ON n2.n_nationkey = (s.s_nationkey + 5) % 25),
fb AS (SELECT ticker, unnest(regexp_split_to_array(branches, ',\\s*')) AS state FROM firms),
metrics AS (SELECT l_suppkey AS ticker, year(l_shipdate) AS y, sum(l_extendedprice) AS revenue
            FROM lineitem GROUP BY 1, 2),
fej AS (SELECT ex.*, fb.ticker, m.revenue FROM ex LEFT JOIN fb ON fb.state = ex.state
        LEFT JOIN metrics m ON m.ticker = fb.ticker AND m.y = ex.disaster_year),
fe AS (SELECT event_name, disaster_year, ticker, state, CAST(state_pos AS INTEGER) AS state_pos,
              round(revenue, 6) AS revenue
       FROM (SELECT *, row_number() OVER (PARTITION BY ticker, event_name ORDER BY state_pos, state) AS r
             FROM fej) t WHERE r = 1)"""

_PRED_SQL = _RECOVERY_SQL + "," + _FE_CTES + """,
macro AS (SELECT coalesce(a.y, b.y) AS y, a.gdp, b.inflation FROM
          (SELECT year(o_orderdate) AS y, round(sum(o_totalprice) / 1e6, 6) AS gdp FROM orders GROUP BY 1) a
          FULL JOIN (SELECT year(l_shipdate) AS y, round(avg(l_tax) * 100, 6) AS inflation
                     FROM lineitem GROUP BY 1) b ON a.y = b.y),
home AS (SELECT s.s_suppkey AS ticker, coalesce(r.r_name, 'Other') AS region FROM supplier s
         LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey),
pj AS (SELECT fe.*, p.shock_date, p.pre_shock_price, p.recovery_days,
              p.shock_date + CAST(s.o_orderkey % 7 AS INTEGER) AS end_date
       FROM fe LEFT JOIN panel p ON fe.event_name IS NOT DISTINCT FROM p.event_name
                               AND fe.ticker IS NOT DISTINCT FROM p.ticker
       LEFT JOIN storms s ON s.event_name = fe.event_name
       WHERE fe.ticker IS NOT NULL)
SELECT pj.event_name, pj.ticker, pj.disaster_year, pj.shock_date, pj.end_date,
       CAST(month(pj.shock_date) AS INTEGER) AS start_month, CAST(month(pj.end_date) AS INTEGER) AS end_month,
       CAST(pj.end_date - pj.shock_date AS INTEGER) AS duration, pj.state, pj.revenue, pj.pre_shock_price,
       pj.recovery_days, """ + ", ".join(
    f"CAST((pj.recovery_days <> -1 AND pj.recovery_days <= {k}) AS INTEGER) AS rec_{k}d" for k in RECOVERY_HORIZONS
) + """, macro.gdp, macro.inflation, home.region
FROM pj LEFT JOIN macro ON macro.y = pj.disaster_year LEFT JOIN home ON home.ticker = pj.ticker"""

QUERIES = {
    "firm_event_join": firm_event_join,
    "predictor_table": predictor_table,
}

ORACLE = {
    "firm_event_join": f"WITH storms AS ({proxies.STORMS_SQL}),{_FE_CTES}\nSELECT * FROM fe",
    "predictor_table": _PRED_SQL,
}
