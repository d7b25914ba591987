"""Filing facts -> annual series.

Input: parsed documents ``(doc, cik, facts)`` where ``facts`` is
``map<taxonomy, map<tag, struct<units: map<unit, array<fact>>>>>``.  The
documents of one filer are treated as one logical document (their facts are
unioned), so a filer may be split into any number of landed files.

Rules per (filer, variable): tags are tried in their listed order; for a tag
the unit list is USD, else USD/shares, else shares, else the first unit key
(a present key with an empty list still wins, which empties the tag); facts
are kept when the form is an annual form, end and filed parse, and the year
of ``end`` is in range; if any kept fact has fp = FY (any case) only those
stay; per year the first by (non-amended, filed desc, end desc, position)
wins; the first tag with any row supplies all years.

Every step is a hash aggregate or a join keyed by filer (no per-filer
collect), so a filer with a third of all facts is still spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.constants import ANNUAL_FORMS, FILING_TAGS, UNIT_PREFERENCE
from aftershock.operators.dedup import first_by
from aftershock.operators.filters import amended_form


def _tag_table(spark, tags: dict[str, list[str]]) -> DataFrame:
    rows = [(v, t, i) for v, ts in tags.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "variable string, tag string, prio int")


def flatten_facts(parsed: DataFrame, taxonomy: str = "us-gaap", tags: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Only the wanted ``tags``, if given, leave the map: a filer has hundreds.
    -> (unit keys ``cik, tag, unit, key_pos, doc``, facts ``cik, tag, unit,
    doc, pos, end, val, form, filed, fy, fp``)."""
    tx = parsed.select("doc", "cik", F.col("facts")[taxonomy].alias("_t")).where(F.col("_t").isNotNull())
    if tags is not None:
        tx = tx.withColumn("_t", F.map_filter("_t", lambda tag, _: tag.isin(*tags)))
    concepts = tx.select("doc", "cik", F.explode("_t").alias("tag", "_c"))
    units = concepts.select("doc", "cik", "tag", F.posexplode(F.map_entries("_c.units")).alias("key_pos", "_u"))
    keys = units.select("cik", "tag", F.col("_u.key").alias("unit"), "key_pos", "doc")
    facts = units.select("doc", "cik", "tag", F.col("_u.key").alias("unit"),
                         F.posexplode("_u.value").alias("pos", "_f"))
    facts = facts.select("cik", "tag", "unit", "doc", "pos", F.col("_f.end").alias("end"),
                         F.col("_f.val").alias("val"), F.col("_f.form").alias("form"),
                         F.col("_f.filed").alias("filed"), F.col("_f.fy").alias("fy"), F.col("_f.fp").alias("fp"))
    return keys, facts


def choose_units(keys: DataFrame) -> DataFrame:
    """Per (cik, tag) the preferred unit key present."""
    pref = F.when(F.col("unit") == UNIT_PREFERENCE[0], 0)
    for i, u in enumerate(UNIT_PREFERENCE[1:], start=1):
        pref = pref.when(F.col("unit") == u, i)
    ranked = keys.withColumn("_pref", pref.otherwise(len(UNIT_PREFERENCE)))
    return first_by(ranked.select("cik", "tag", "_pref", "doc", "key_pos", "unit"), ["cik", "tag"],
                    [("_pref", False), ("doc", False), ("key_pos", False)]).select("cik", "tag", "unit")


def annual_series(parsed: DataFrame, tags: dict[str, list[str]] = FILING_TAGS,
                  years: tuple[int, int] = (2013, 2025), forms=ANNUAL_FORMS) -> DataFrame:
    """Provenance rows: cik, variable_name, source_tag, fiscal_year,
    period_end, filed_date, form, value."""
    spark = parsed.sparkSession
    keys, facts = flatten_facts(parsed, tags=sorted({t for ts in tags.values() for t in ts}))
    chosen = choose_units(keys)
    f = facts.join(chosen.hint("merge"), ["cik", "tag", "unit"])         # N2 (facts are exploded)
    f = f.join(F.broadcast(_tag_table(spark, tags)), "tag")              # variable, priority (small literal)
    f = (f.withColumn("end_d", F.try_to_date("end")).withColumn("filed_d", F.try_to_date("filed"))
         .where(F.col("form").isin(list(forms)) & F.col("end_d").isNotNull() & F.col("filed_d").isNotNull())
         .withColumn("fiscal_year", F.year("end_d"))
         .where(F.col("fiscal_year").between(years[0], years[1])))
    # FY rows only, if the (cik, tag) list has any
    is_fy = F.coalesce(F.upper("fp") == "FY", F.lit(False))
    has_fy = f.groupBy("cik", "tag").agg(F.max(is_fy.cast("int")).alias("_has_fy"))
    f = f.join(has_fy.hint("merge"), ["cik", "tag"]).where((F.col("_has_fy") == 0) | is_fy)
    # One fact per (cik, variable, tag, year)
    f = f.withColumn("_amend", amended_form("form").cast("int"))
    f = first_by(f.select("cik", "variable", "tag", "prio", "fiscal_year", "_amend", "filed_d", "end_d", "doc", "pos",
                          "val", "form"),
                 ["cik", "variable", "tag", "fiscal_year"],
                 [("_amend", False), ("filed_d", True), ("end_d", True), ("doc", False), ("pos", False)])
    # The first tag (by priority) with any row supplies all years
    best = f.groupBy("cik", "variable").agg(F.min("prio").alias("prio"))
    f = f.join(best.hint("merge"), ["cik", "variable", "prio"])
    return f.select("cik", F.col("variable").alias("variable_name"), F.col("tag").alias("source_tag"),
                    "fiscal_year", F.col("end_d").alias("period_end"), F.col("filed_d").alias("filed_date"),
                    "form", F.col("val").alias("value"))


def annual_panel(provenance: DataFrame, variables: list[str]) -> DataFrame:
    """One row per (cik, fiscal_year), one column per variable (a
    single pivot instead of a chain of outer merges)."""
    return (provenance.groupBy("cik", "fiscal_year").pivot("variable_name", variables)
            .agg(F.first("value", ignorenulls=True)))


def coverage(panel_long: DataFrame) -> DataFrame:
    from aftershock.operators.aggregate import coverage_summary
    return coverage_summary(panel_long, "cik", "variable_name", "value")
