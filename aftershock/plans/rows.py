"""Dedup, set and filter queries: W1-W3, U1-U5, J19, F1-F10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.operators.dedup import first_by
from aftershock.operators.filters import cohort_split as _cohorts, prefer_within_group
from aftershock.operators.joins import semi
from aftershock.sources.tables import table

COHORT_CUTOFF = 4500.0


def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order per (customer, year): non-amended (status F) first,
    latest date, largest price, then order key."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", F.year("o_orderdate").alias("year"),
        (F.col("o_orderstatus") != "F").cast("int").alias("is_amend"))
    d = first_by(o, ["o_custkey", "year"], [("is_amend", False), ("o_orderdate", True),
                                            ("o_totalprice", True), ("o_orderkey", False)])
    return d.select("o_custkey", "year", "o_orderkey", "o_orderdate", "o_totalprice")


def keep_first_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First order of every customer (date, then key)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return first_by(o, ["o_custkey"], [("o_orderdate", False), ("o_orderkey", False)])


def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2."""
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag union by column name, missing columns -> null."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"),
                                              F.lit("orders").alias("src"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
                                                F.lit("customer").alias("src"))
    return o.unionByName(c, allowMissingColumns=True)


def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders (left-semi) and without (left-anti)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return (semi(c, o, "c_custkey").withColumn("side", F.lit("with_orders"))
            .unionByName(semi(c, o, "c_custkey", anti=True).withColumn("side", F.lit("without_orders"))))


def group_pref_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per (customer, year) keep the F-status orders if any exist, else all."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"),
                                              "o_orderstatus")
    return prefer_within_group(o, ["o_custkey", "year"], F.col("o_orderstatus") == "F")


def drop_any_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels; rows with any null label dropped."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").dropna("any", subset=["quality", "toxic"])


def cohort_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: threshold cohorts (>= cutoff upstream, < cutoff downstream) plus
    every row again in the 'full' cohort; a null position joins only 'full'."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return _cohorts(c, "c_acctbal", COHORT_CUTOFF).select("c_custkey", "cohort")


def conjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalised-equality, year range (inclusive), set
    membership and a regex on a text column, all pushed to the scan where
    Catalyst can."""
    o = table(spark, sf_dir, "orders")
    y = F.year("o_orderdate")
    return (o.where(F.upper(F.trim("o_orderstatus")).isin("F", "O") & y.between(1996, 2000)
                    & F.col("o_orderpriority").rlike("^[12]-|LOW$"))
            .select("o_orderkey", "o_orderstatus", y.alias("year"), "o_orderpriority"))


QUERIES = {
    "ordered_dedup": ordered_dedup,
    "keep_first_group": keep_first_group,
    "distinct_rows": distinct_rows,
    "union_by_name": union_by_name,
    "semi_anti": semi_anti,
    "group_pref_filter": group_pref_filter,
    "drop_any_null": drop_any_null,
    "cohort_split": cohort_split,
    "conjunctive_filter": conjunctive_filter,
}

ORACLE = {
    "ordered_dedup": """
SELECT o_custkey, year, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, CAST(year(o_orderdate) AS INTEGER) AS year, row_number() OVER (
    PARTITION BY o_custkey, year(o_orderdate)
    ORDER BY CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END, o_orderdate DESC, o_totalprice DESC, o_orderkey) AS r
  FROM orders) t WHERE r = 1""",
    "keep_first_group": """
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) t
WHERE r = 1""",
    "distinct_rows": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
    "union_by_name": """
SELECT o_custkey AS id, o_totalprice AS amount, 'orders' AS src, CAST(NULL AS DOUBLE) AS balance FROM orders
UNION ALL
SELECT c_custkey, NULL, 'customer', c_acctbal FROM customer""",
    "semi_anti": """
SELECT c_custkey, c_nationkey, 'with_orders' AS side FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL
SELECT c_custkey, c_nationkey, 'without_orders' FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "group_pref_filter": """
SELECT o_orderkey, o_custkey, year, o_orderstatus FROM (
  SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus,
         max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS has
  FROM orders) t
WHERE has = 0 OR o_orderstatus = 'F'""",
    "drop_any_null": """
SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
    "cohort_split": f"""
SELECT c_custkey, 'full' AS cohort FROM customer
UNION ALL
SELECT c_custkey, CASE WHEN c_acctbal >= {COHORT_CUTOFF} THEN 'upstream' ELSE 'downstream' END
FROM customer WHERE c_acctbal IS NOT NULL""",
    "conjunctive_filter": """
SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority FROM orders
WHERE upper(trim(o_orderstatus)) IN ('F', 'O') AND year(o_orderdate) BETWEEN 1996 AND 2000
  AND regexp_matches(o_orderpriority, '^[12]-|LOW$')""",
}
