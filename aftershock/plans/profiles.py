"""Profiles and checks: A4-A9, A12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.operators.aggregate import (coverage_summary as _coverage, describe, distinct_counts as _dc,
                                            incomplete_groups as _incomplete, null_profile as _nulls,
                                            value_counts as _vc)
from aftershock.plans.reshape import melt_panel
from aftershock.sources.tables import table

PROFILE_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
MIN_YEARS = 7


def _docs_labels(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nulls(_docs_labels(spark, sf_dir), PROFILE_COLS)


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(melt_panel(spark, sf_dir), "c_custkey", "metric", "value")


def describe_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(table(spark, sf_dir, "orders"), "o_totalprice")


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vc(table(spark, sf_dir, "orders"), "o_orderpriority")


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dc(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


def incomplete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"),
                                              F.year("o_orderdate").alias("year"))
    return _incomplete(table(spark, sf_dir, "customer"), o, "c_custkey", "year", MIN_YEARS)


QUERIES = {
    "null_profile": null_profile,
    "coverage_summary": coverage_summary,
    "describe_col": describe_col,
    "value_counts": value_counts,
    "distinct_counts": distinct_counts,
    "incomplete_groups": incomplete_groups,
}

_DL = "dl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d " \
      "LEFT JOIN labels l ON l.doc_id = d.doc_id)"

ORACLE = {
    "null_profile": f"WITH {_DL}\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS null_pct FROM dl"
        for c in PROFILE_COLS),
    "coverage_summary": """
WITH agg AS (SELECT o_custkey AS c_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 6) AS spend,
                    CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1, 2),
keys AS (SELECT DISTINCT c_custkey FROM agg),
yrs AS (SELECT unnest(range(1995, 2002)) AS y),
m AS (SELECT unnest(['spend', 'orders']) AS metric),
long AS (SELECT k.c_custkey, m.metric, CASE m.metric WHEN 'spend' THEN a.spend ELSE a.orders END AS value
         FROM keys k CROSS JOIN yrs CROSS JOIN m LEFT JOIN agg a ON a.c_custkey = k.c_custkey AND a.y = yrs.y),
tot AS (SELECT count(DISTINCT c_custkey) AS t FROM long)
SELECT metric AS variable, count(value) AS non_null_observations,
       count(DISTINCT c_custkey) FILTER (WHERE value IS NOT NULL) AS firms_with_any_data,
       CASE WHEN max(tot.t) > 0 THEN round(count(DISTINCT c_custkey) FILTER (WHERE value IS NOT NULL) / max(tot.t), 6)
       END AS share_of_firms_with_any_data
FROM long, tot GROUP BY metric ORDER BY 3 DESC, 2 DESC""",
    "describe_col": """
SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std,
       min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS p25,
       round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.75), 6) AS p75,
       max(o_totalprice) AS max FROM orders""",
    "value_counts": "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1 ORDER BY 1",
    "distinct_counts": """
SELECT CAST(o_orderstatus AS VARCHAR) AS "group", count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY 1
UNION ALL SELECT 'ALL', count(DISTINCT o_custkey) FROM orders""",
    "incomplete_groups": f"""
WITH y AS (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS n FROM orders GROUP BY 1)
SELECT count(*) FILTER (WHERE coalesce(y.n, 0) < {MIN_YEARS}) AS n_incomplete, count(*) AS n_entities
FROM (SELECT DISTINCT c_custkey FROM customer) c LEFT JOIN y ON y.o_custkey = c.c_custkey""",
}
