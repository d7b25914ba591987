"""Small tables that the tests of the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple], extra: str = "", values: tuple = ()) -> DataFrame:
    """Documents from (doc_id, text, lang, source); ``extra`` adds columns of constant values."""
    full = [(i, t, g, s, None if t is None else len(t), *values) for i, t, g, s in rows]
    return spark.createDataFrame(full, DOCS + (", " + extra if extra else ""))


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like results."""
    long = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", None, "b"),
            (5, long, "en", "a"), (6, long, "en", "a"), (7, "é ß 中文 <|endoftext|> 🙂 ​", "de", "b"),
            (8, "the same few words here now", "en", "b"), (8, "the same few words here now", "en", "b"),
            (None, "no id but some words are here", "fr", "c")]
    return documents(spark, rows, "score double, size long, held_out string, predicted string, component_id string, "
                     "kept string, length string, taken string, n_tokens string, y string, t string, i string",
                     (0.5, 7, "x", "x", "x", "x", "x", "x", "x", "x", "x", "x"))
