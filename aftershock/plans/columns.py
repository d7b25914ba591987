"""Lookup and column queries: P1-P15, J2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.functions.constants import nace_to_sector
from aftershock.functions.text import first_digits, prefix, zfill
from aftershock.operators.columns import (across, drop_containing, drop_if_present, fill_by_name_rules,
                                          map_values, relocate_after, rename_first, select_rename,
                                          syntactic_names)
from aftershock.operators.joins import null_safe_join
from aftershock.operators.reshape import columns_matching
from aftershock.plans.reshape import YEARS, panel_wide, pivot_panel_first
from aftershock.sources.tables import table

# name rules of the part proxy (the domain default is SECTOR_NAME_RULES)
PART_NAME_RULES = [(["WIDGET", "GEAR"], 2), (["BOLT"], 11)]


def _part_codes(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = (F.col("p_size") * 100 + F.col("p_partkey") % 100).cast("string")
    nace4 = zfill(first_digits(raw), 4)
    return p.select("p_partkey", "p_name", nace4.alias("nace4")) \
        .withColumn("nace2", prefix("nace4", 2)) \
        .withColumn("sector_code", map_values("nace2", nace_to_sector(), "int"))


def sector_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9 + X10 + X11 + P9: digits -> zero-pad 4 -> 2-digit prefix -> sector."""
    return _part_codes(spark, sf_dir).select("p_partkey", "nace4", "nace2", "sector_code")


def conditional_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: null sector filled by name pattern, first rule first."""
    p = _part_codes(spark, sf_dir)
    return p.select("p_partkey", "p_name", "sector_code",
                    fill_by_name_rules("sector_code", "p_name", PART_NAME_RULES).cast("int").alias("sector_filled"))


def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11/P12 + J1: firm state (nation) -> region through a small lookup,
    deduplicated first and broadcast; unmapped -> 'Other'."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lookup = (table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"),
                                                  F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state"),
                      F.col("r_name").alias("_r")).distinct())
    return (s.join(F.broadcast(lookup), "s_nationkey", "left")
            .select("s_suppkey", "state", F.coalesce("_r", F.lit("Other")).alias("region")))


def null_safe_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-key left join where NULL keys match NULL keys."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("k1"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("k2"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    seg = (o.join(c, o.o_custkey == c.c_custkey).groupBy("k1", "k2")
           .agg(F.round(F.sum("o_totalprice"), 6).alias("segment_spend")))
    return null_safe_join(c, seg, ["k1", "k2"], "left")


def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 prefix select, P4 keyword drop, P5 tolerant drop, P7 derived scale,
    P6 relocate, P1 rename."""
    w = panel_wide(spark, sf_dir)
    s = w.select("c_custkey", *columns_matching(w, "SPEND_"), "orders_2001")
    s = drop_containing(s, ["1995"])
    s = drop_if_present(s, ["orders_2001", "no_such_column"])
    s = s.withColumn("spend_2001_m", F.round(F.col("spend_2001") / 1e6, 6))
    s = relocate_after(s, ["spend_2001_m"], "c_custkey")
    return select_rename(s, {c: ("firm_id" if c == "c_custkey" else c) for c in s.columns})


def bulk_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 across, P15 syntactic names, P2 rename first column."""
    w = pivot_panel_first(spark, sf_dir)
    w = across(w, [c for c in w.columns if c.startswith("spend(")], lambda c: F.round(c / 1000, 6))
    return rename_first(syntactic_names(w), "firm")


QUERIES = {
    "sector_code_map": sector_code_map,
    "conditional_fill": conditional_fill,
    "region_map": region_map,
    "null_safe_left_join": null_safe_left_join,
    "select_columns": select_columns,
    "bulk_rename": bulk_rename,
}

_NACE_VALUES = ", ".join(f"('{k}', {v})" for k, v in sorted(nace_to_sector().items()))
_PART_CODES = f"""codes AS (
  SELECT p_partkey, p_name, nace4, substr(nace4, 1, 2) AS nace2 FROM (
    SELECT p_partkey, p_name,
      CASE WHEN length(d) < 4 THEN lpad(d, 4, '0') ELSE d END AS nace4
    FROM (SELECT p_partkey, p_name,
                 nullif(regexp_extract(CAST(p_size * 100 + p_partkey % 100 AS VARCHAR), '(\\d+)', 1), '') AS d
          FROM part) a) b),
m(code, sector) AS (VALUES {_NACE_VALUES}),
sc AS (SELECT codes.*, CAST(m.sector AS INTEGER) AS sector_code FROM codes LEFT JOIN m ON m.code = codes.nace2)"""


def _rule_sql() -> str:
    whens = " ".join(
        f"WHEN sector_code IS NULL AND regexp_matches(upper(p_name), '{'|'.join(pats)}') THEN {v}"
        for pats, v in PART_NAME_RULES)
    return f"CAST(CASE {whens} ELSE sector_code END AS INTEGER)"


_SPEND_COLS = [f"spend_{y}" for y in YEARS if y != 1995]
ORACLE = {
    "sector_code_map": f"WITH {_PART_CODES} SELECT p_partkey, nace4, nace2, sector_code FROM sc",
    "conditional_fill": f"WITH {_PART_CODES} SELECT p_partkey, p_name, sector_code, {_rule_sql()} AS sector_filled FROM sc",
    "region_map": """
SELECT s.s_suppkey, n.n_name AS state, coalesce(r.r_name, 'Other') AS region
FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "null_safe_left_join": """
WITH c AS (SELECT c_custkey, c_nationkey AS k1, nullif(c_mktsegment, 'HOUSEHOLD') AS k2 FROM customer),
seg AS (SELECT c.k1, c.k2, round(sum(o.o_totalprice), 6) AS segment_spend
        FROM orders o JOIN c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT c.c_custkey, c.k1, c.k2, seg.segment_spend
FROM c LEFT JOIN seg ON c.k1 IS NOT DISTINCT FROM seg.k1 AND c.k2 IS NOT DISTINCT FROM seg.k2""",
    "select_columns": """
WITH agg AS (SELECT o_custkey AS c_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 6) AS spend
             FROM orders GROUP BY 1, 2)
SELECT c_custkey AS firm_id, round(max(spend) FILTER (WHERE y = 2001) / 1e6, 6) AS spend_2001_m, """
    + ", ".join(f"max(spend) FILTER (WHERE y = {c[-4:]}) AS {c}" for c in _SPEND_COLS)
    + "\nFROM agg GROUP BY c_custkey",
    "bulk_rename": """
WITH agg AS (SELECT o_custkey AS c_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 6) AS spend,
                    CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1, 2)
SELECT c_custkey AS firm, """
    + ", ".join(f'round(max(spend) FILTER (WHERE y = {y}) / 1000, 6) AS "spend.{y}.", '
                f'max(orders) FILTER (WHERE y = {y}) AS "orders.{y}."' for y in YEARS)
    + "\nFROM agg GROUP BY c_custkey",
}
