"""Company-facts JSON (S5, S9) and filer directory JSON (S4, N6) sources.

Landed JSON documents are read as text (one document per row), parsed with
an explicit schema by ``from_json``; documents that do not parse go to a
failure table instead of stopping the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = T.StructType([
    T.StructField("end", T.StringType()), T.StructField("val", T.DoubleType()),
    T.StructField("form", T.StringType()), T.StructField("filed", T.StringType()),
    T.StructField("fy", T.IntegerType()), T.StructField("fp", T.StringType()),
    T.StructField("accn", T.StringType()),
])
CONCEPT = T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(FACT)))])
COMPANY_FACTS = T.StructType([
    T.StructField("cik", T.LongType()),
    T.StructField("entityName", T.StringType()),
    T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), CONCEPT))),
])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One landed JSON file per row: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"),
                                                         F.col("value").alias("json"))


def parse_company_facts(docs: DataFrame, json_col: str = "json", doc_col: str = "doc") -> tuple[DataFrame, DataFrame]:
    """-> (parsed rows ``doc, cik, facts``, failures ``doc, error``)."""
    p = docs.withColumn("_p", F.from_json(F.col(json_col), COMPANY_FACTS, {"mode": "PERMISSIVE"}))
    ok = F.col("_p").isNotNull() & F.col("_p.facts").isNotNull()
    parsed = p.where(ok).select(doc_col, F.col("_p.cik").alias("cik"), F.col("_p.facts").alias("facts"))
    failed = p.where(~ok).select(doc_col, F.lit("unparsable company facts document").alias("error"))
    return parsed, failed


def directory_rows(raw: DataFrame) -> DataFrame:
    """Filer directory in either layout: ``{fields: [...], data: [[...]]}``
    (positional rows) or a list/map of records with cik, name, ticker."""
    if "fields" in raw.columns and "data" in raw.columns:
        row = raw.select("fields", F.explode("data").alias("_r"))
        pos = {n: F.array_position(F.col("fields"), F.lit(n)).cast("int") for n in ("cik", "name", "ticker")}
        return row.select(*[F.element_at(F.col("_r"), pos[n]).alias(n) for n in ("cik", "name", "ticker")])
    return raw.select(F.col("cik").cast("string").alias("cik"), "name", "ticker")
