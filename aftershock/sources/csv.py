"""CSV sources (S1, S2, S6, S7) and the macro / position tables they feed.

Explicit schemas everywhere (no inference at scale); blank and, where asked,
the text ``NA`` are read as NULL; bad values become NULL through
``try_cast`` / ``try_to_date`` in a projection after the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.functions.dates import parse_date


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Raise when required columns are missing (schema-only check)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_text: str | None = None, header: bool = True) -> DataFrame:
    """Header CSV; blank -> NULL, ``na_text`` (e.g. 'NA') -> NULL.
    With no schema every column is read as text (coerce afterwards)."""
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if na_text is not None:
        r = r.option("nullValue", na_text)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_optional(spark: SparkSession, path: str | None, schema: T.StructType,
                  required: Iterable[str] = ()) -> DataFrame:
    """An override table that may be absent: absent -> empty table.
    Spark's own reader decides, so the path may be on any store; any other
    failure is raised."""
    if not path:
        return spark.createDataFrame([], schema)
    try:
        found = read_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return require_columns(found, required)


MACRO_SCHEMA = "observation_date string, value string"


def read_macro(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``observation_date`` in d/M/yyyy (or ISO) + one value column
    -> (year, <name>)."""
    raw = read_csv(spark, path, MACRO_SCHEMA, na_text="NA")
    d = parse_date(F.col("observation_date"))
    return raw.select(F.year(d).alias("year"), F.col("value").try_cast("double").alias(name)) \
        .where(F.col("year").isNotNull())


POSITION_SCHEMA = "country string, sect string, t string, upstreamness string, source string"


def read_position(spark: SparkSession, path: str) -> DataFrame:
    """Supply-chain position rows, typed; the footer row without country
    and source is removed by the later country/source filter (F1)."""
    raw = read_csv(spark, path, POSITION_SCHEMA)
    return raw.select(F.upper(F.trim("country")).alias("country"),
                      F.col("sect").try_cast("int").alias("sect"), F.col("t").try_cast("int").alias("year"),
                      F.col("upstreamness").try_cast("double").alias("upstreamness"),
                      F.lower(F.trim("source")).alias("source"))
