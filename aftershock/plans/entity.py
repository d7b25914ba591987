"""D5 name matching on part/supplier proxies.

directory = parts with key % 3 = 0: ``upper(name type) CORP``, ticker =
lower-case brand, cik = part key; firms = the other parts: ``name type Inc.``
(key % 3 = 1, exact after normalising when the combination is listed) or
``name typ`` with the last letter of the type cut (key % 3 = 2, fuzzy);
overrides = every supplier, naming an existing firm (even key) or a new
name (odd key), each twice: the later (higher position) wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.functions.constants import FUZZY_THRESHOLD
from aftershock.functions.text import name_normalizer_sql
from aftershock.operators.entity import (MAPPING_COLUMNS, apply_overrides, exact_matches, fuzzy_matches,
                                         match_names, needs_review, prepare_directory,
                                         prepare_firms)
from aftershock.sources.tables import table


def _directory(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 == 0)
    d = p.select(F.concat(F.upper(F.concat_ws(" ", "p_name", "p_type")), F.lit(" CORP")).alias("sec_company_name"),
                 F.lower("p_brand").alias("ticker"), F.col("p_partkey").alias("cik"), F.col("p_partkey").alias("pos"))
    return prepare_directory(d)


def _firm_name_col():
    k = F.col("p_partkey") % 3
    typo = F.expr("substring(p_type, 1, length(p_type) - 1)")
    return F.when(k == 1, F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" Inc."))) \
        .otherwise(F.concat(F.col("p_name"), F.lit(" "), typo))


def _firms(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 != 0)
    return prepare_firms(p.select(_firm_name_col().alias("orbis_company_name"), F.col("p_partkey").alias("pos")))


def _overrides(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = s.join(p, p.p_partkey == s.s_suppkey * 3 + 1, "left")
    name = F.when((F.col("s_suppkey") % 2 == 0) & F.col("p_partkey").isNotNull(), _firm_name_col()) \
        .otherwise(F.col("s_name"))
    first = j.select(name.alias("orbis_company_name"),
                     F.concat(F.lit(" brand#"), ((F.col("s_suppkey") % 25) + 1).cast("string")).alias("ticker"),
                     F.col("s_suppkey").alias("cik"), F.col("s_suppkey").alias("pos"))
    later = j.select(name.alias("orbis_company_name"),
                     F.concat(F.lit("brand#"), ((F.col("s_suppkey") % 25) + 2).cast("string")).alias("ticker"),
                     (F.col("s_suppkey") + 1000000).alias("cik"), (F.col("s_suppkey") + 1000000).alias("pos"))
    return first.unionByName(later)


def entity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_matches(_firms(spark, sf_dir), _directory(spark, sf_dir)).select(*MAPPING_COLUMNS)


def entity_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms, d = _firms(spark, sf_dir), _directory(spark, sf_dir)
    rest = firms.join(exact_matches(firms, d).select("orbis_company_name"), "orbis_company_name", "left_anti")
    return fuzzy_matches(rest, d, FUZZY_THRESHOLD, False, "levenshtein").select(*MAPPING_COLUMNS)


def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17 with the matching-block ratio and review rows (not SQL: tested
    against an exhaustive search)."""
    return match_names(_firms(spark, sf_dir), _directory(spark, sf_dir))


def entity_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the mapping that a person has to look at."""
    return needs_review(entity_match(spark, sf_dir))


def entity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _directory(spark, sf_dir)
    mapping = match_names(_firms(spark, sf_dir), d, FUZZY_THRESHOLD, False, "levenshtein")
    return apply_overrides(mapping, _overrides(spark, sf_dir), d) \
        .select(*MAPPING_COLUMNS)


QUERIES = {
    "entity_exact": entity_exact,
    "entity_fuzzy": entity_fuzzy,
    "entity_match": entity_match,
    "entity_review": entity_review,
    "entity_override": entity_override,
}

_FIRM_NAME_SQL = """CASE WHEN p_partkey % 3 = 1 THEN p_name || ' ' || p_type || ' Inc.'
                         ELSE p_name || ' ' || substr(p_type, 1, length(p_type) - 1) END"""
_BASE = f"""
dir AS (SELECT upper(p_name || ' ' || p_type) || ' CORP' AS sec_company_name, upper(trim(lower(p_brand))) AS ticker,
               CAST(p_partkey AS VARCHAR) AS cik, p_partkey AS pos FROM part WHERE p_partkey % 3 = 0),
dirn AS (SELECT *, {name_normalizer_sql('sec_company_name')} AS norm FROM dir),
dfirst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY pos) AS r FROM dirn) x WHERE r = 1),
f0 AS (SELECT {_FIRM_NAME_SQL} AS orbis_company_name, p_partkey AS pos FROM part WHERE p_partkey % 3 <> 0),
firms AS (SELECT orbis_company_name, min(pos) AS pos,
                 {name_normalizer_sql('orbis_company_name')} AS normalized_orbis_name FROM f0 GROUP BY 1),
exact AS (SELECT f.orbis_company_name, f.normalized_orbis_name, d.sec_company_name AS matched_sec_name, d.ticker,
                 d.cik, 100 AS match_score, 'exact_normalized' AS match_method, 'auto_ok' AS review_flag
          FROM firms f JOIN dfirst d ON d.norm = f.normalized_orbis_name),
rest AS (SELECT * FROM firms WHERE orbis_company_name NOT IN (SELECT orbis_company_name FROM exact)),
pairs AS (SELECT r.normalized_orbis_name AS fn, d.norm AS dn,
                 CAST(round_even(100.0 * (1.0 - levenshtein(r.normalized_orbis_name, d.norm)
                      / greatest(length(r.normalized_orbis_name), length(d.norm))), 0) AS INTEGER) AS score
          FROM (SELECT DISTINCT normalized_orbis_name FROM rest) r, (SELECT DISTINCT norm FROM dirn) d),
best AS (SELECT fn, arg_max(dn, (score, dn)) AS dn, max(score) AS score FROM pairs
         WHERE score >= {FUZZY_THRESHOLD} GROUP BY fn),
fuzzy AS (SELECT r.orbis_company_name, r.normalized_orbis_name, d.sec_company_name AS matched_sec_name, d.ticker,
                 d.cik, b.score AS match_score,
                 CASE WHEN b.score IS NULL THEN 'unmatched' ELSE 'fuzzy' END AS match_method,
                 CASE WHEN b.score IS NULL THEN 'unmatched' WHEN b.score >= {FUZZY_THRESHOLD} THEN 'auto_ok'
                      ELSE 'review' END AS review_flag
          FROM rest r LEFT JOIN best b ON b.fn = r.normalized_orbis_name LEFT JOIN dfirst d ON d.norm = b.dn),
mapping AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy)"""

_OVERRIDE = f"""
ov0 AS (SELECT CASE WHEN s.s_suppkey % 2 = 0 AND p.p_partkey IS NOT NULL THEN {_FIRM_NAME_SQL} ELSE s.s_name END
                 AS orbis_company_name, s.s_suppkey FROM supplier s
        LEFT JOIN part p ON p.p_partkey = s.s_suppkey * 3 + 1),
ov AS (SELECT orbis_company_name, upper(trim(' brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR))) AS t,
              CAST(s_suppkey AS VARCHAR) AS c, s_suppkey AS pos FROM ov0
       UNION ALL
       SELECT orbis_company_name, upper(trim('brand#' || CAST(s_suppkey % 25 + 2 AS VARCHAR))),
              CAST(s_suppkey + 1000000 AS VARCHAR), s_suppkey + 1000000 FROM ov0),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY orbis_company_name ORDER BY pos DESC) AS r
                        FROM ov) x WHERE r = 1),
bt AS (SELECT * FROM (SELECT ticker, sec_company_name, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS r
                      FROM dirn) x WHERE r = 1),
lastn AS (SELECT last.orbis_company_name, last.t, last.c, bt.sec_company_name AS ov_name FROM last
          LEFT JOIN bt ON bt.ticker = last.t)"""

ORACLE = {
    "entity_exact": f"WITH {_BASE}\nSELECT * FROM exact",
    "entity_fuzzy": f"WITH {_BASE}\nSELECT * FROM fuzzy",
    "entity_override": f"""WITH {_BASE}, {_OVERRIDE}
SELECT m.orbis_company_name, m.normalized_orbis_name,
       CASE WHEN l.t IS NOT NULL THEN l.ov_name ELSE m.matched_sec_name END AS matched_sec_name,
       CASE WHEN l.t IS NOT NULL THEN l.t ELSE m.ticker END AS ticker,
       CASE WHEN l.t IS NOT NULL THEN l.c ELSE m.cik END AS cik,
       CASE WHEN l.t IS NOT NULL THEN 999 ELSE m.match_score END AS match_score,
       CASE WHEN l.t IS NOT NULL THEN 'manual_override' ELSE m.match_method END AS match_method,
       CASE WHEN l.t IS NOT NULL THEN 'manual_ok' ELSE m.review_flag END AS review_flag
FROM mapping m LEFT JOIN lastn l ON l.orbis_company_name = m.orbis_company_name
UNION ALL
SELECT l.orbis_company_name, {name_normalizer_sql('l.orbis_company_name')}, l.ov_name, l.t, l.c, 999,
       'manual_override', 'manual_ok'
FROM lastn l WHERE l.orbis_company_name NOT IN (SELECT orbis_company_name FROM mapping)""",
}
