"""Scalar function queries: X1-X16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.functions.dates import date_from_parts, duration_days, parse_date, shift_days
from aftershock.functions.text import (clean_upper, first_digits, label_or_default, last_item, matches,
                                       name_normalizer_sql, normalize_company_name, prefix, to_number, zfill)
from aftershock.sources.tables import table


def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        clean_upper("p_name").alias("name_upper"),
        F.lower(F.trim("p_type")).alias("type_lower"),
        first_digits("p_brand").alias("brand_digits"),
        prefix("p_type", 3).alias("type_prefix"),
        matches("p_name", "^(red|blue) ").alias("is_colour"),
        last_item("p_name", " ").alias("last_word"),
        F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("B-")).alias("brand_short"),
        label_or_default([F.when(F.col("p_size") % 5 != 0, F.col("p_name")), F.col("p_size")],
                         "Unnamed Storm").alias("label"))


def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/M/d"))
            .when(k == 2, F.date_format(d, "d/M/yyyy")).otherwise(F.lit("bad")))
    return o.select(
        "o_orderkey", d.alias("d"), F.year(d).alias("y"), F.month(d).alias("m"),
        text.alias("d_text"), parse_date(text).alias("d_parsed"),
        duration_days(F.lit("1995-01-01").cast("date"), d).alias("days_since"),
        shift_days(d, 15).alias("d_plus"), shift_days(d, -15).alias("d_minus"),
        date_from_parts(F.year(d), (F.col("o_orderkey") % 13 + 1).cast("int"),
                        (F.col("o_orderkey") % 31 + 1).cast("int")).alias("d_parts"))


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    raw = (F.when(k == 0, F.format_number("o_totalprice", 2)).when(k == 1, F.col("o_totalprice").cast("string"))
           .otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", raw.alias("raw"), to_number(raw).alias("value"))


def zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", zfill("c_custkey", 4).alias("key4"), zfill("c_nationkey", 3).alias("nation3"),
                    zfill(F.col("c_custkey") * 1000, 2).alias("long_kept"))


def _company_names(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    name = (F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" CO.")))
            .when(k == 1, F.concat(F.lit("The "), F.col("p_name"), F.lit(" Group, Inc.")))
            .when(k == 2, F.concat(F.col("p_name"), F.lit(" & "), F.col("p_type"), F.lit(" (Holdings) Ltd")))
            .otherwise(F.concat(F.col("p_name"), F.lit("-"), F.col("p_brand"), F.lit(" N V"))))
    return p.select("p_partkey", name.alias("company_name"))


def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _company_names(spark, sf_dir)
    return n.select("p_partkey", "company_name", normalize_company_name("company_name").alias("normalized_name"))


QUERIES = {
    "scalar_text": scalar_text,
    "scalar_dates": scalar_dates,
    "numeric_coerce": numeric_coerce,
    "zero_pad": zero_pad,
    "name_normalise": name_normalise,
}

_NAMES_SQL = """names AS (SELECT p_partkey, CASE p_partkey % 4
    WHEN 0 THEN upper(p_name) || ' CO.'
    WHEN 1 THEN 'The ' || p_name || ' Group, Inc.'
    WHEN 2 THEN p_name || ' & ' || p_type || ' (Holdings) Ltd'
    ELSE p_name || '-' || p_brand || ' N V' END AS company_name FROM part)"""

ORACLE = {
    "scalar_text": """
SELECT p_partkey, upper(trim(p_name)) AS name_upper, lower(trim(p_type)) AS type_lower,
       nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS brand_digits, substr(p_type, 1, 3) AS type_prefix,
       coalesce(regexp_matches(p_name, '^(red|blue) '), false) AS is_colour,
       trim(string_split(p_name, ' ')[-1]) AS last_word, replace(p_brand, 'Brand#', 'B-') AS brand_short,
       concat_ws(' ', coalesce(CASE WHEN p_size % 5 <> 0 THEN p_name END, 'Unnamed Storm'),
                 CAST(p_size AS VARCHAR)) AS label
FROM part""",
    "scalar_dates": """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                      WHEN 1 THEN strftime(o_orderdate, '%Y/%-m/%-d')
                      WHEN 2 THEN strftime(o_orderdate, '%-d/%-m/%Y') ELSE 'bad' END AS d_text FROM orders)
SELECT o_orderkey, d, CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, d_text,
       CAST(coalesce(try_strptime(d_text, '%Y-%m-%d'), try_strptime(d_text, '%Y/%m/%d'),
                     try_strptime(d_text, '%d/%m/%Y')) AS DATE) AS d_parsed,
       CAST(d - DATE '1995-01-01' AS INTEGER) AS days_since,
       d + 15 AS d_plus, d - 15 AS d_minus,
       CAST(try_strptime(year(d) || '-' || (o_orderkey % 13 + 1) || '-' || (o_orderkey % 31 + 1), '%Y-%m-%d')
            AS DATE) AS d_parts
FROM o""",
    "numeric_coerce": """
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN format('{:,.2f}', o_totalprice)
                                                  WHEN 1 THEN CAST(o_totalprice AS VARCHAR)
                                                  ELSE o_orderpriority END AS raw FROM orders)
SELECT o_orderkey, raw, TRY_CAST(replace(trim(raw), ',', '') AS DOUBLE) AS value FROM o""",
    "zero_pad": """
SELECT c_custkey,
  CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 4 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0')
       ELSE CAST(c_custkey AS VARCHAR) END AS key4,
  CASE WHEN length(CAST(c_nationkey AS VARCHAR)) < 3 THEN lpad(CAST(c_nationkey AS VARCHAR), 3, '0')
       ELSE CAST(c_nationkey AS VARCHAR) END AS nation3,
  CASE WHEN length(CAST(c_custkey * 1000 AS VARCHAR)) < 2 THEN lpad(CAST(c_custkey * 1000 AS VARCHAR), 2, '0')
       ELSE CAST(c_custkey * 1000 AS VARCHAR) END AS long_kept
FROM customer""",
    "name_normalise": f"WITH {_NAMES_SQL}\nSELECT p_partkey, company_name, "
                      f"{name_normalizer_sql('company_name')} AS normalized_name FROM names",
}
