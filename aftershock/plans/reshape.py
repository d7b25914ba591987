"""Reshape queries on the customer x year order panel and list columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.operators.reshape import distinct_values, melt_pattern, pivot_first, separate_rows, unnest_parallel
from aftershock.sources.tables import table

YEARS = list(range(1995, 2002))
METRICS = ["spend", "orders"]


def panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x year panel metrics (long form, unique per key and year)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).agg(
        F.round(F.sum("o_totalprice"), 6).alias("spend"), F.count(F.lit(1)).cast("double").alias("orders"))


def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spend_1995 ... orders_2001`` columns (the firm sheet shape)."""
    return pivot_first(panel_long(spark, sf_dir), ["c_custkey"], "year", YEARS, METRICS,
                       name="{value}_{pivot}", order="value_major", whole=True)


def melt_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide -> long, name split by ``(.*)_(\\d{4})``; nulls kept."""
    return melt_pattern(panel_wide(spark, sf_dir), ["c_custkey"], r"^(.*)_(\d{4})$", ["metric", "year"],
                        casts={"year": "int"})


def pivot_panel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spend(1995), orders(1995), spend(1996), ...`` years ascending."""
    return pivot_first(panel_long(spark, sf_dir), ["c_custkey"], "year", YEARS, METRICS,
                       name="{value}({pivot})", order="pivot_major", whole=True)


def pivot_value_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of the panel in descending order, as a pivot takes them."""
    years = distinct_values(panel_long(spark, sf_dir), "year", descending=True)
    return spark.createDataFrame([(y, k) for k, y in enumerate(years)], "year int, position int")


def pivot_wide_years_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable-major, years descending: ``spend_2001 ... orders_1995``."""
    return pivot_first(panel_long(spark, sf_dir), ["c_custkey"], "year", YEARS[::-1], METRICS,
                       name="{value}_{pivot}", order="value_major", whole=True)


def explode_multivalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names split on blanks, one row per word with its position."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return separate_rows(p, "p_name", " ", pos="pos", out="word")


def list_unnest_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys and values of each event's JSON props unnested together."""
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    m = F.from_json("props", "map<string,bigint>")
    lists = ev.select("event_id", F.map_keys(m).alias("ks"), F.map_values(m).alias("vs"))
    return unnest_parallel(lists, ["ks", "vs"], ["prop_key", "prop_value"])


QUERIES = {
    "melt_panel": melt_panel,
    "pivot_value_list": pivot_value_list,
    "pivot_panel_first": pivot_panel_first,
    "pivot_wide_years_desc": pivot_wide_years_desc,
    "explode_multivalue": explode_multivalue,
    "list_unnest_parallel": list_unnest_parallel,
}

_AGG = """agg AS (SELECT o_custkey AS c_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 6) AS spend,
                CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1, 2)"""


def _pivot_sql(cells: list[tuple[int, str]], fmt: str) -> str:
    cols = ",\n  ".join(f'max({m}) FILTER (WHERE y = {y}) AS "{fmt.format(value=m, pivot=y)}"' for y, m in cells)
    return f"WITH {_AGG}\nSELECT c_custkey,\n  {cols}\nFROM agg GROUP BY c_custkey"


ORACLE = {
    "pivot_value_list": """
SELECT y AS year, CAST(row_number() OVER (ORDER BY y DESC) - 1 AS INTEGER) AS position
FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE o_orderdate IS NOT NULL)""",
    "melt_panel": f"""WITH {_AGG},
keys AS (SELECT DISTINCT c_custkey FROM agg),
yrs AS (SELECT unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS y),
m AS (SELECT unnest(['spend', 'orders']) AS metric)
SELECT k.c_custkey, m.metric, CAST(yrs.y AS INTEGER) AS year,
       CASE m.metric WHEN 'spend' THEN a.spend ELSE a.orders END AS value
FROM keys k CROSS JOIN yrs CROSS JOIN m LEFT JOIN agg a ON a.c_custkey = k.c_custkey AND a.y = yrs.y""",
    "pivot_panel_first": _pivot_sql([(y, m) for y in YEARS for m in METRICS], "{value}({pivot})"),
    "pivot_wide_years_desc": _pivot_sql([(y, m) for m in METRICS for y in YEARS[::-1]], "{value}_{pivot}"),
    "explode_multivalue": """
SELECT p_partkey, CAST(pos AS INTEGER) AS pos, word FROM (
  SELECT p_partkey, unnest(range(0, len(s))) AS pos, unnest(s) AS word
  FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part))""",
    "list_unnest_parallel": """
SELECT event_id, k AS prop_key, CAST(json_extract_string(props, k) AS BIGINT) AS prop_value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""",
}
