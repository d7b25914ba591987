"""Scalar text functions (X1, X2, X9-X16), all built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from aftershock.functions.constants import NAME_LEADING_WORDS, NAME_LEGAL_WORDS, NAME_PUNCTUATION


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_upper(c) -> Column:
    """Trim + upper; null stays null."""
    return F.upper(F.trim(_c(c)))


def to_number(c) -> Column:
    """Strip thousands commas and blanks, then cast; bad text -> null."""
    s = F.regexp_replace(F.trim(_c(c).cast("string")), ",", "")
    return s.try_cast("double")


def first_digits(c) -> Column:
    """First run of digits, '' -> null."""
    e = F.regexp_extract(_c(c).cast("string"), r"(\d+)", 1)
    return F.when(e == "", F.lit(None)).otherwise(e)


def zfill(c, width: int) -> Column:
    """Left-pad with zeros to ``width``; longer strings are kept whole
    (``lpad`` alone would truncate them)."""
    s = _c(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def prefix(c, n: int) -> Column:
    """X11: first ``n`` characters."""
    return F.substring(_c(c), 1, n)


def matches(c, pattern: str) -> Column:
    """Regex contains; null -> false."""
    return F.coalesce(_c(c).rlike(pattern), F.lit(False))


def last_item(c, sep: str = ",") -> Column:
    """Last item of a delimited string, trimmed."""
    return F.trim(F.element_at(F.split(_c(c), re.escape(sep)), -1))


def label_or_default(parts: list, default: str, sep: str = " ") -> Column:
    """Concatenate label parts; a null first part becomes ``default``."""
    cols = [_c(p).cast("string") for p in parts]
    return F.concat_ws(sep, F.coalesce(cols[0], F.lit(default)), *cols[1:])


def _word_alt(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def normalize_company_name(c) -> Column:
    """Trim + upper, '&' -> AND, punctuation -> blank, the word THE and
    then the legal-form words removed (whole words), blanks collapsed last;
    null -> ''.  The order of the steps matters."""
    s = F.upper(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))))
    s = F.regexp_replace(s, "&", " AND ")
    s = F.regexp_replace(s, "[" + re.escape("".join(NAME_PUNCTUATION)) + "]", " ")
    s = F.regexp_replace(s, rf"\b(?:{_word_alt(NAME_LEADING_WORDS)})\b", " ")
    s = F.regexp_replace(s, rf"\b(?:{_word_alt(NAME_LEGAL_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def name_normalizer_sql(col: str) -> str:
    """The same normaliser as a DuckDB/ANSI expression (oracle side)."""
    punct = re.escape("".join(NAME_PUNCTUATION)).replace("'", "''")
    s = f"upper(trim(coalesce(CAST({col} AS VARCHAR), '')))"
    s = f"regexp_replace({s}, '&', ' AND ', 'g')"
    s = f"regexp_replace({s}, '[{punct}]', ' ', 'g')"
    s = f"regexp_replace({s}, '\\b(?:{_word_alt(NAME_LEADING_WORDS)})\\b', ' ', 'g')"
    s = f"regexp_replace({s}, '\\b(?:{_word_alt(NAME_LEGAL_WORDS)})\\b', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
