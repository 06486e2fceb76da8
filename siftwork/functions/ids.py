"""Column expressions for identifiers, question ids and years.

All of them are built-in Spark expressions, so they stay inside
whole-stage codegen and push down like any other projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import OPENALEX_PREFIX


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Trim every kind of leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def clean_id(col, prefix: str | None = OPENALEX_PREFIX) -> Column:
    """Article id for matching: lower case, trimmed, OpenAlex URL prefix gone.

    Lower-casing happens first, so upper-case prefixes are stripped as well;
    empty strings become null so that nulls never match each other.
    """
    out = strip_ws(F.lower(_c(col)))
    if prefix:
        out = F.regexp_replace(out, "^" + prefix.lower().replace(".", r"\."), "")
    return F.nullif(out, F.lit(""))


def fix_question_id(col) -> Column:
    """Question id in slash form: no whitespace, ',' -> '/', no trailing '.'."""
    out = F.regexp_replace(_c(col).cast("string"), r"\s+", "")
    out = F.regexp_replace(out, ",", "/")
    out = F.regexp_replace(out, r"\.$", "")
    return strip_ws(F.lower(out))


def std_question_id(col) -> Column:
    """Question id in comma form: '/' -> ',', spaces gone, no trailing '.'."""
    out = F.regexp_replace(_c(col).cast("string"), "/", ",")
    out = F.regexp_replace(out, r"\s*,\s*", ",")
    out = F.regexp_replace(out, r"\s+", "")
    return F.regexp_replace(out, r"\.$", "")


def question_from_file_name(col) -> Column:
    """`gdg1_9_1_embase-1.ris` -> `1.9.1`: drop the last `_` part and `gdg`."""
    name = F.regexp_replace(_c(col), r"_[^_]*$", "")
    name = F.regexp_replace(name, "^gdg", "")
    return F.regexp_replace(name, "_", ".")


def clean_year(col) -> Column:
    """Lenient publication year: '2019//', '/2020/', '2021,03', ' 2015.0 ' -> int.

    Junk, blanks and the strings nan/None/NaT become null; so does a
    fractional year (it is not a year).
    """
    s = F.regexp_replace(_c(col).cast("string"), "//", "")
    s = F.regexp_replace(s, r"^/+|/+$", "")
    s = strip_ws(F.split(strip_ws(s), ",").getItem(0))
    s = F.when(s.isin("", "nan", "None", "NaT"), F.lit(None)).otherwise(s)
    d = s.try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("int"))


def year_strict(col) -> Column:
    """Broad-search year: drop '//', first comma part, integer or null."""
    s = F.split(F.regexp_replace(_c(col).cast("string"), "//", ""), ",").getItem(0)
    return strip_ws(s).try_cast("int")
