"""Tagged-text (RIS) exports read as a Spark job.

Records are split by the reader itself (``lineSep`` = newline + end tag),
so a folder of large exports is read in parallel splits, never parsed on
the driver.  Per record: carriage returns dropped, lines without a tag
folded into the previous tagged line, ``TAG  - value`` pairs grouped into
``map<tag, array<value>>``, then projected through a tag map.
Sub-folders whose names start with ``_`` (e.g. excluded questions) are
hidden paths for Spark's file listing and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import question_from_file_name
from ..schemas import QUESTION_ID_REMAP

TAG_LINE = r"^[A-Z][A-Z0-9]  - "
RECORD_SEP = "\nER  - "

# tag -> (column, multi-valued)
DEFAULT_TAG_MAP = {
    "TY": ("record_type", False),
    "TI": ("primary_title", False),
    "T1": ("primary_title", False),
    "AB": ("notes_abstract", False),
    "N2": ("notes_abstract", False),
    "AN": ("accession_number", False),
    "ID": ("id", False),
    "PY": ("publication_year", False),
    "Y1": ("publication_year", False),
    "AU": ("authors", True),
    "DO": ("doi", False),
}


def _fold(lines: Column) -> Column:
    """Append untagged continuation lines to the previous tagged line."""
    empty = F.array().cast("array<string>")

    def step(acc, line):
        n = F.size(acc)
        merged = F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))),
                          F.array(F.concat_ws(" ", F.element_at(acc, -1), F.trim(line))))
        return (F.when(line.rlike(TAG_LINE), F.concat(acc, F.array(line)))
                .when(n == 0, acc).otherwise(merged))

    return F.aggregate(lines, empty, step)


def parse_records(records: DataFrame, text_col: str = "value") -> DataFrame:
    """One raw record per row -> ``fields: map<tag, array<value>>``."""
    rec = F.regexp_replace(F.col(text_col), "\r", "")
    lines = F.filter(F.split(rec, "\n"), lambda l: F.length(F.trim(l)) > 0)
    folded = _fold(lines)
    entries = F.transform(folded, lambda l: F.struct(F.substring(l, 1, 2).alias("tag"),
                                                     F.trim(F.substring(l, 7, 1 << 30)).alias("value")))
    tags = F.array_distinct(F.transform(entries, lambda e: e["tag"]))
    values = F.transform(tags, lambda t: F.transform(F.filter(entries, lambda e: e["tag"] == t),
                                                     lambda e: e["value"]))
    out = records.where(F.regexp_replace(F.col(text_col), "\r", "").rlike(r"(^|\n)TY  - "))
    return out.withColumn("fields", F.map_from_arrays(tags, values))


def project_fields(df: DataFrame, tag_map: dict[str, tuple[str, bool]] | None = None) -> DataFrame:
    """Tag map -> columns; the first listed tag with a value wins for a
    column; unknown tags are dropped."""
    tag_map = tag_map or DEFAULT_TAG_MAP
    by_col: dict[str, list[tuple[str, bool]]] = {}
    for tag, (col, multi) in tag_map.items():
        by_col.setdefault(col, []).append((tag, multi))
    sel = []
    for col, tags in by_col.items():
        vals = [F.col("fields")[t] if multi else F.col("fields")[t][0] for t, multi in tags]
        sel.append(F.coalesce(*vals).alias(col) if len(vals) > 1 else vals[0].alias(col))
    return df.select(*[c for c in df.columns if c != "fields"], *sel)


def remap_question(col: Column, mapping=QUESTION_ID_REMAP) -> Column:
    """Combined question ids to guideline ids (a literal map, no join)."""
    m = F.create_map(*[F.lit(x) for pair in mapping for x in pair])
    return F.coalesce(m[col], col)


def read_tagged_records(spark: SparkSession, path: str,
                        tag_map: dict[str, tuple[str, bool]] | None = None,
                        question_from_name: bool = True) -> DataFrame:
    """Read every export of a folder (top level) into typed columns plus
    ``origin_file`` and, from the file name, ``question_id``."""
    raw = (spark.read.option("lineSep", RECORD_SEP).option("pathGlobFilter", "*.ris").text(path)
           .select("value", F.col("_metadata.file_name").alias("origin_file")))
    out = project_fields(parse_records(raw), tag_map)
    if question_from_name:
        out = out.withColumn("question_id", remap_question(question_from_file_name("origin_file")))
    return out
