"""Retrieval date windows: build them, tag records with them, check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DATE_WINDOW_DEFAULT


def _d(x) -> Column:
    return F.to_date(F.lit(x)) if isinstance(x, str) else x


def date_windows(bounds: DataFrame, start_col: str = "start", end_col: str = "end",
                 years: int = DATE_WINDOW_DEFAULT[2]) -> DataFrame:
    """Contiguous windows of ``years`` years from each bounds row's start to
    its end; the last one is clipped.  A window may start on the end date.

    Each window ends the day before the next one starts, so month
    arithmetic (Feb 29) never opens a gap.
    """
    starts = F.sequence(F.col(start_col), F.col(end_col), F.expr(f"INTERVAL {int(years)} YEARS"))
    w = bounds.select("*", F.posexplode(starts).alias("window_id", "window_start"))
    nxt = F.try_element_at(starts, (F.col("window_id") + 2).cast("int"))
    return w.select(
        *[c for c in bounds.columns if c not in (start_col, end_col)],
        F.col("window_id").cast("int").alias("window_id"),
        F.col("window_start"),
        F.coalesce(F.date_sub(nxt, 1), F.col(end_col)).alias("window_end"))


def default_bounds(spark, start: str = DATE_WINDOW_DEFAULT[0], end: str = DATE_WINDOW_DEFAULT[1]) -> DataFrame:
    return spark.range(1).select(F.to_date(F.lit(start)).alias("start"), F.to_date(F.lit(end)).alias("end"))


def assign_window(df: DataFrame, date_col: str, start: str = DATE_WINDOW_DEFAULT[0],
                  end: str = DATE_WINDOW_DEFAULT[1], years: int = DATE_WINDOW_DEFAULT[2]) -> DataFrame:
    """Tag each row with its retrieval window — arithmetic, no join.

    window index = whole ``years`` periods between start and the date;
    corrected by one where month arithmetic lands off by a day.  Dates
    outside [start, end] get null windows.
    """
    s, e, k = _d(start), _d(end), 12 * int(years)
    d = F.to_date(F.col(date_col))
    idx0 = F.floor(F.months_between(d, s) / k).cast("int")
    idx = (F.when(d < F.add_months(s, idx0 * k), idx0 - 1)
           .when(d >= F.add_months(s, (idx0 + 1) * k), idx0 + 1)
           .otherwise(idx0))
    inside = (d >= s) & (d <= e)
    ws = F.add_months(s, idx * k)
    we = F.least(F.date_sub(F.add_months(s, (idx + 1) * k), 1), e)
    return df.withColumn("window_id", F.when(inside, idx)) \
        .withColumn("window_start", F.when(inside, ws)) \
        .withColumn("window_end", F.when(inside, we))


def join_windows(df: DataFrame, date_col: str, windows: DataFrame, start_col: str = "window_start",
                 end_col: str = "window_end") -> DataFrame:
    """Rows of ``df`` with every window that holds their date; windows may be of
    any length, overlap and repeat.

    A window of n days lies in two bins at most of the power of two at or above n,
    so windows and dates meet by equality on (bin size, bin) and the exact test is
    left to the rows that meet.  A window is there twice at most, a row once for
    each bin size that occurs (17 cover 300 years).  Rows without date, windows
    without a start or end, or that end before they start, match nothing."""
    days = F.datediff(F.col(end_col), F.col(start_col)) + 1
    w = windows.where(days > 0).withColumn("_level", F.ceil(F.log2(days)).cast("int"))
    number = {c: F.unix_date(F.to_date(F.col(c))) for c in (start_col, end_col)}
    w = w.withColumn("_bin", F.explode(F.sequence(*[F.floor(number[c] / F.pow(F.lit(2), F.col("_level"))).cast("long")
                                                    for c in (start_col, end_col)])))
    sizes = sorted(r[0] for r in w.select("_level").distinct().collect())        # a few numbers
    d = df.where(F.col(date_col).isNotNull()).withColumn("_day", F.unix_date(F.to_date(F.col(date_col))))
    d = d.withColumn("_l", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
    d = d.withColumn("_b", F.floor(F.col("_day") / F.pow(F.lit(2), F.col("_l"))).cast("long"))
    met = d.join(w, (d["_l"] == w["_level"]) & (d["_b"] == w["_bin"]))
    return met.where(F.col("_day").between(number[start_col], number[end_col])).drop("_day", "_l", "_b", "_level", "_bin")


def check_windows(windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Violations: a next window that does not start the day after this one
    ends (gaps or overlaps).  Windows per bounds row are few."""
    w = Window.partitionBy(*(by or [])).orderBy("window_start")
    nxt = F.lead("window_start").over(w)
    return windows.withColumn("next_start", nxt) \
        .where(F.col("next_start").isNotNull() & (F.datediff("next_start", "window_end") != 1))
