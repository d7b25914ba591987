"""D4 on a JSON round trip of ``events``.

Each event becomes one fact of filer ``cik = user_id``: tag by event type,
unit ``shares`` for event_id % 5 = 0 else USD, end = event day minus
(event_id % 3) days, filed = event day plus (event_id % 11) days, form
10-K/A (id % 6 = 0), 10-Q (id % 6 = 1) or 10-K, fp Q1 (id % 4 = 0), 'fy'
(id % 8 = 1) or FY.  Documents are built per (filer, event day, block of
10,000 event ids) with ``to_json`` (sorted by event id inside), then parsed
back; the oracle computes the same series from the flat events table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.functions.constants import ANNUAL_FORMS, FILING_TAGS, FILING_YEARS
from aftershock.operators.facts import annual_panel, annual_series, coverage
from aftershock.sources.json_facts import parse_company_facts
from aftershock.sources.tables import table

EVENT_TAGS = {"purchase": "Revenues", "click": "RevenueFromContractWithCustomerExcludingAssessedTax",
              "view": "Assets", "signup": "NetIncomeLoss", "error": "OperatingIncomeLoss"}
VARIABLES = list(FILING_TAGS)
DOC_FACTS = 10_000


def fact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, json) company-facts documents built from events."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    tag = F.create_map(*[x for k, v in EVENT_TAGS.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    i = F.col("event_id")
    f = e.select(
        F.col("user_id").alias("cik"), day.alias("day"), tag.alias("tag"),
        F.when(i % 5 == 0, F.lit("shares")).otherwise(F.lit("USD")).alias("unit"), i.alias("event_id"),
        F.struct(F.date_format(F.date_sub(day, (i % 3).cast("int")), "yyyy-MM-dd").alias("end"),
                 F.col("value").alias("val"),
                 F.when(i % 6 == 0, F.lit("10-K/A")).when(i % 6 == 1, F.lit("10-Q")).otherwise(F.lit("10-K")).alias("form"),
                 F.date_format(F.date_add(day, (i % 11).cast("int")), "yyyy-MM-dd").alias("filed"),
                 F.lit(2024).alias("fy"),
                 F.when(i % 4 == 0, F.lit("Q1")).when(i % 8 == 1, F.lit("fy")).otherwise(F.lit("FY")).alias("fp"),
                 i.cast("string").alias("accn")).alias("fact"))
    # one document per (filer, day, block of DOC_FACTS event ids): a document
    # never holds more than DOC_FACTS facts, however hot the filer; the
    # extraction treats all documents of a filer as one logical document
    f = f.withColumn("chunk", F.expr(f"event_id div {DOC_FACTS}"))
    lists = f.groupBy("cik", "day", "chunk", "tag", "unit").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", "fact"))), lambda x: x["fact"]).alias("facts"))
    concepts = lists.groupBy("cik", "day", "chunk", "tag").agg(
        F.map_from_entries(F.collect_list(F.struct("unit", "facts"))).alias("units"))
    docs = concepts.groupBy("cik", "day", "chunk").agg(
        F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.col("units").alias("units"))))).alias("gaap"))
    return docs.select(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("-"),
                                F.lpad(F.col("chunk").cast("string"), 12, "0")).alias("doc"),
                       F.to_json(F.struct("cik", F.create_map(F.lit("us-gaap"), F.col("gaap")).alias("facts")))
                       .alias("json"))


def _series(spark, sf_dir) -> DataFrame:
    parsed, _failed = parse_company_facts(fact_documents(spark, sf_dir))
    return annual_series(parsed, FILING_TAGS, FILING_YEARS, ANNUAL_FORMS)


def facts_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir)


def facts_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual_panel(_series(spark, sf_dir), VARIABLES)


def facts_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 on the annual series: per variable, non-null observations, filers
    with any data and their share of all filers in the series."""
    return coverage(_series(spark, sf_dir))


QUERIES = {
    "facts_provenance": facts_provenance,
    "facts_panel": facts_panel,
    "facts_coverage": facts_coverage,
}

_TAGS_VALUES = ", ".join(f"('{v}', '{t}', {i})" for v, ts in FILING_TAGS.items() for i, t in enumerate(ts))
_FORMS = ", ".join(f"'{x}'" for x in ANNUAL_FORMS)
_CASE_TAG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TAGS.items())
_PROV = f"""
WITH f AS (SELECT user_id AS cik, event_id, CAST(ts AS DATE) AS day,
    CASE event_type {_CASE_TAG} END AS tag,
    CASE WHEN event_id % 5 = 0 THEN 'shares' ELSE 'USD' END AS unit, value AS val,
    CAST(ts AS DATE) - CAST(event_id % 3 AS INTEGER) AS end_d,
    CAST(ts AS DATE) + CAST(event_id % 11 AS INTEGER) AS filed_d,
    CASE event_id % 6 WHEN 0 THEN '10-K/A' WHEN 1 THEN '10-Q' ELSE '10-K' END AS form,
    CASE WHEN event_id % 4 = 0 THEN 'Q1' WHEN event_id % 8 = 1 THEN 'fy' ELSE 'FY' END AS fp
  FROM events),
units AS (SELECT cik, tag, CASE WHEN bool_or(unit = 'USD') THEN 'USD' WHEN bool_or(unit = 'USD/shares') THEN 'USD/shares'
                                WHEN bool_or(unit = 'shares') THEN 'shares' END AS chosen FROM f GROUP BY 1, 2),
tags(variable, tag, prio) AS (VALUES {_TAGS_VALUES}),
k AS (SELECT f.*, t.variable, t.prio, year(f.end_d) AS fiscal_year FROM f
      JOIN units u ON u.cik = f.cik AND u.tag = f.tag AND u.chosen = f.unit JOIN tags t ON t.tag = f.tag
      WHERE f.form IN ({_FORMS}) AND year(f.end_d) BETWEEN {FILING_YEARS[0]} AND {FILING_YEARS[1]}),
k1 AS (SELECT *, max(CASE WHEN upper(fp) = 'FY' THEN 1 ELSE 0 END) OVER (PARTITION BY cik, tag) AS has_fy FROM k),
k2 AS (SELECT * FROM k1 WHERE has_fy = 0 OR upper(fp) = 'FY'),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, variable, tag, fiscal_year
        ORDER BY CASE WHEN regexp_matches(form, '/A|A$') THEN 1 ELSE 0 END, filed_d DESC, end_d DESC, day, event_id)
        AS r FROM k2) x WHERE r = 1),
best AS (SELECT cik, variable, min(prio) AS p FROM d GROUP BY 1, 2),
prov AS (SELECT d.cik, d.variable AS variable_name, d.tag AS source_tag, CAST(d.fiscal_year AS INTEGER) AS fiscal_year,
                d.end_d AS period_end, d.filed_d AS filed_date, d.form, d.val AS value
         FROM d JOIN best b ON b.cik = d.cik AND b.variable = d.variable AND b.p = d.prio)"""

ORACLE = {
    "facts_provenance": _PROV + "\nSELECT * FROM prov",
    "facts_panel": _PROV + "\nSELECT cik, fiscal_year, " + ", ".join(
        f"first(value) FILTER (WHERE variable_name = '{v}') AS {v}" for v in VARIABLES)
    + "\nFROM prov GROUP BY cik, fiscal_year",
    "facts_coverage": _PROV + """,
tot AS (SELECT count(DISTINCT cik) AS t FROM prov)
SELECT variable_name AS variable, count(value) AS non_null_observations,
       count(DISTINCT cik) FILTER (WHERE value IS NOT NULL) AS firms_with_any_data,
       CASE WHEN max(tot.t) > 0 THEN round(count(DISTINCT cik) FILTER (WHERE value IS NOT NULL) / max(tot.t), 6)
       END AS share_of_firms_with_any_data
FROM prov, tot GROUP BY variable_name ORDER BY 3 DESC, 2 DESC""",
}
