"""Firm sector classification, sector x year position panel, wide form.

Domain pipelines over the real input shapes (position CSV, sector lookup,
firm list with NACE codes); each is one lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.constants import SECTOR_NAME_RULES, nace_to_sector
from aftershock.functions.text import first_digits, prefix, zfill
from aftershock.operators.columns import fill_by_name_rules, map_values
from aftershock.operators.joins import null_safe_join
from aftershock.operators.reshape import pivot_first

YEARS = (2014, 2024)


def sector_lookup(sectors: DataFrame, source: str = "adb") -> DataFrame:
    """I2 -> (adb_sector_code, adb_sector_name), deduplicated (U2) so the
    later lookup joins cannot fan out."""
    s = sectors.select(F.col("sect").try_cast("int").alias("adb_sector_code"),
                       F.col("sect_name").alias("adb_sector_name"),
                       F.lower(F.trim(F.col("source"))).alias("_src"))
    return s.where(F.col("_src") == source).drop("_src").distinct()


def position_panel(position: DataFrame, lookup: DataFrame, years=YEARS, country: str = "USA",
                   source: str = "adb") -> DataFrame:
    """country/source (normalised), sector present, years inclusive; J1
    sector names.  ``downstream_value`` is optional in the input (T4)."""
    down = F.col("downstreamness") if "downstreamness" in position.columns else F.lit(None).cast("double")
    p = position.where((F.upper(F.trim("country")) == country) & (F.lower(F.trim("source")) == source)
                       & F.col("sect").isNotNull() & F.col("year").between(*years))
    p = p.select(F.col("sect").cast("int").alias("adb_sector_code"), "year",
                 F.col("upstreamness").alias("upstream_value"), down.alias("downstream_value"))
    return p.join(F.broadcast(lookup), "adb_sector_code", "left")  # lookup: <= 35 sectors


def classify_firms(firms: DataFrame, lookup: DataFrame, rules=SECTOR_NAME_RULES) -> DataFrame:
    """NACE core code -> 4-digit (zero-padded, never truncated) -> 2-digit
    -> sector (P9); null sector filled from name patterns (P10); sector name
    (J1); distinct rows (U2).  Expects company_name, country_iso, nace, ticker."""
    f = firms.where(F.upper(F.trim("country_iso")) == "US")
    f = f.select("company_name", "ticker", zfill(first_digits("nace"), 4).alias("nace_code_4d"))
    f = f.withColumn("nace_code_2d", prefix("nace_code_4d", 2))
    f = f.withColumn("adb_sector_code", map_values("nace_code_2d", nace_to_sector(), "int"))
    f = f.withColumn("adb_sector_code", fill_by_name_rules("adb_sector_code", "company_name", rules).cast("int"))
    f = f.join(F.broadcast(lookup), "adb_sector_code", "left")
    return f.select("company_name", "ticker", "nace_code_4d", "nace_code_2d", "adb_sector_code",
                    "adb_sector_name").distinct()


def sector_panel(classified: DataFrame, panel: DataFrame) -> DataFrame:
    """Firm x year rows; the two-key join matches NULL to NULL (T9), so
    unmapped firms meet the sector rows whose code and name are null."""
    p = panel.select("adb_sector_code", "adb_sector_name", "year", "upstream_value", "downstream_value")
    return null_safe_join(classified, p, ["adb_sector_code", "adb_sector_name"], "left")


def sector_coverage(panel: DataFrame, n_years: int = YEARS[1] - YEARS[0] + 1) -> DataFrame:
    """A4/A5 checks: unique companies, mapped sectors, unmapped rows and
    companies with fewer than ``n_years`` distinct years."""
    per = panel.groupBy("company_name").agg(F.countDistinct("year").alias("_y"))
    incomplete = per.agg(F.count(F.when(F.col("_y") < n_years, 1))).first()[0]  # one number
    return panel.agg(F.countDistinct("company_name").alias("unique_companies"),
                     F.countDistinct("adb_sector_code").alias("mapped_sectors"),
                     F.count(F.when(F.col("adb_sector_code").isNull(), 1)).alias("unmapped_rows")) \
        .withColumn("incomplete_companies", F.lit(int(incomplete)))


def panel_to_wide(panel: DataFrame, years=range(YEARS[0], YEARS[1] + 1)) -> DataFrame:
    """``upstream(Y), downstream(Y)`` per year ascending; rows with a
    null key vanish as in a pivot (T11), so they are filtered explicitly."""
    keys = ["company_name", "ticker", "nace_code_4d", "nace_code_2d", "adb_sector_code", "adb_sector_name"]
    long = panel.withColumnRenamed("upstream_value", "upstream").withColumnRenamed("downstream_value", "downstream")
    return pivot_first(long, keys, "year", list(years), ["upstream", "downstream"], name="{value}({pivot})",
                       order="pivot_major")


def attach_to_firms(firms: DataFrame, wide: DataFrame) -> DataFrame:
    """Left join by ticker, dropping the duplicate name column first;
    duplicate tickers fan out."""
    return firms.join(wide.drop("company_name"), "ticker", "left")


# ---------------------------------------------------------------- driver-table query
# Proxies: sector lookup = part key mod 35 + 1 ("SECTOR n"); position rows =
# lineitem per (country, sector, ship year), upstreamness = 1 + 10 x mean
# discount (country 'can' for supplier key mod 10 = 0, else 'usa ', so the
# normalised country filter matters); firms = suppliers with a NACE text from
# the supplier key (null / non-numeric for some), ISO 'ca' or ' us'.
PROXY_YEARS = list(range(1996, 2001))


def _proxy_inputs(spark, sf_dir):
    from aftershock.functions.numeric import exact_mean
    from aftershock.sources.tables import table
    code = (F.col("p_partkey") % 35 + 1)
    sectors = table(spark, sf_dir, "part").select(
        code.cast("string").alias("sect"), F.concat(F.lit("SECTOR "), code.cast("string")).alias("sect_name"),
        F.lit("adb").alias("source")).distinct()
    li = table(spark, sf_dir, "lineitem")
    position = li.groupBy(
        F.when(F.col("l_suppkey") % 10 == 0, F.lit("can")).otherwise(F.lit("usa ")).alias("country"),
        (F.col("l_partkey") % 35 + 1).cast("int").alias("sect"), F.year("l_shipdate").alias("year")
    ).agg(F.round(F.lit(1.0) + exact_mean("l_discount") * 10, 6).alias("upstreamness")) \
        .withColumn("source", F.lit("adb"))
    k = F.col("s_suppkey")
    firms = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("company_name"),
        F.when(F.col("s_nationkey") % 5 == 0, F.lit("ca")).otherwise(F.lit(" us")).alias("country_iso"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("text"))
        .otherwise((k * 7919 % 9999).cast("string")).alias("nace"),
        F.concat(F.lit("T"), k.cast("string")).alias("ticker"))
    return sectors, position, firms


def sector_panel_wide(spark, sf_dir: str) -> DataFrame:
    """D1 -> D2 -> D3 end to end: classify firms, position panel, firm x
    year panel (NULL-safe sector join), wide ``upstream(Y)/downstream(Y)``."""
    sectors, position, firms = _proxy_inputs(spark, sf_dir)
    lk = sector_lookup(sectors)
    panel = sector_panel(classify_firms(firms, lk), position_panel(position, lk, (PROXY_YEARS[0], PROXY_YEARS[-1])))
    return panel_to_wide(panel, PROXY_YEARS)


QUERIES = {"sector_panel_wide": sector_panel_wide}


def _oracle() -> str:
    from aftershock.functions.numeric import exact_mean_sql
    nace = ", ".join(f"('{c}', {v})" for c, v in sorted(nace_to_sector().items()))
    whens = " ".join(f"WHEN code0 IS NULL AND regexp_matches(upper(company_name), '{'|'.join(pats)}') THEN {v}"
                     for pats, v in SECTOR_NAME_RULES)
    cells = ", ".join(f'max(upstream_value) FILTER (WHERE year = {y}) AS "upstream({y})", '
                      f'max(downstream_value) FILTER (WHERE year = {y}) AS "downstream({y})"' for y in PROXY_YEARS)
    keys = "company_name, ticker, nace_code_4d, nace_code_2d, adb_sector_code, adb_sector_name"
    return f"""
WITH sectors AS (SELECT DISTINCT CAST(p_partkey % 35 + 1 AS INTEGER) AS adb_sector_code,
                        'SECTOR ' || CAST(p_partkey % 35 + 1 AS VARCHAR) AS adb_sector_name FROM part),
pos AS (SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'can' ELSE 'usa ' END AS country,
               CAST(l_partkey % 35 + 1 AS INTEGER) AS sect, year(l_shipdate) AS year,
               round(1.0 + {exact_mean_sql('l_discount')} * 10, 6) AS upstreamness, 'adb' AS source
        FROM lineitem GROUP BY 1, 2, 3),
pp AS (SELECT p.sect AS adb_sector_code, p.year, p.upstreamness AS upstream_value,
              CAST(NULL AS DOUBLE) AS downstream_value, s.adb_sector_name
       FROM pos p LEFT JOIN sectors s ON s.adb_sector_code = p.sect
       WHERE upper(trim(p.country)) = 'USA' AND lower(trim(p.source)) = 'adb' AND p.sect IS NOT NULL
         AND p.year BETWEEN {PROXY_YEARS[0]} AND {PROXY_YEARS[-1]}),
f0 AS (SELECT s_name AS company_name, 'T' || CAST(s_suppkey AS VARCHAR) AS ticker,
              CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'text'
                   ELSE CAST(s_suppkey * 7919 % 9999 AS VARCHAR) END AS nace,
              CASE WHEN s_nationkey % 5 = 0 THEN 'ca' ELSE ' us' END AS iso FROM supplier),
f1 AS (SELECT company_name, ticker, CASE WHEN length(d) < 4 THEN lpad(d, 4, '0') ELSE d END AS nace_code_4d
       FROM (SELECT *, nullif(regexp_extract(nace, '(\\d+)', 1), '') AS d FROM f0 WHERE upper(trim(iso)) = 'US') x),
m(code, sector) AS (VALUES {nace}),
f3 AS (SELECT f1.*, substr(nace_code_4d, 1, 2) AS nace_code_2d, m.sector AS code0
       FROM f1 LEFT JOIN m ON m.code = substr(f1.nace_code_4d, 1, 2)),
f4 AS (SELECT *, CAST(CASE {whens} ELSE code0 END AS INTEGER) AS adb_sector_code FROM f3),
cls AS (SELECT DISTINCT f4.company_name, f4.ticker, f4.nace_code_4d, f4.nace_code_2d, f4.adb_sector_code,
               s.adb_sector_name FROM f4 LEFT JOIN sectors s ON s.adb_sector_code = f4.adb_sector_code),
panel AS (SELECT cls.*, pp.year, pp.upstream_value, pp.downstream_value FROM cls LEFT JOIN pp
          ON cls.adb_sector_code IS NOT DISTINCT FROM pp.adb_sector_code
         AND cls.adb_sector_name IS NOT DISTINCT FROM pp.adb_sector_name)
SELECT {keys}, {cells}
FROM panel
WHERE year IS NOT NULL AND company_name IS NOT NULL AND ticker IS NOT NULL AND nace_code_4d IS NOT NULL
  AND nace_code_2d IS NOT NULL AND adb_sector_code IS NOT NULL AND adb_sector_name IS NOT NULL
GROUP BY {keys}"""


ORACLE = {"sector_panel_wide": _oracle()}
