"""Load-duration curves, year-over-year and day overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import texts, times
from gridloom.operators.ordered import in_order

LEAP_YEAR_HOURS = 8784


def duration_curve(hourly: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Each series by falling value with its own times, numbered from 0; equal values by time.

    Ranks are row numbers in ranges of (value, time), so values that repeat (nights at zero) are cut like
    any others.
    """
    part = part or ["series"]
    kept = hourly.filter(texts.is_kept(F.col("series")) & F.col("value").isNotNull())
    falling = kept.withColumn("_key", -F.col("value"))
    ranked = in_order(falling, part, ["_key", "ts"]).number("rank").result()
    return ranked.select(*part, (F.col("rank") - 1).alias("rank"), "ts", "value")


def duration_curve_by_year(hourly: DataFrame) -> DataFrame:
    """A curve per series and year, padded with nulls to the hours of a leap year."""
    rows = with_year(hourly)
    curve = duration_curve(rows, ["series", "year"])
    return curve.unionByName(padding(rows, LEAP_YEAR_HOURS))


def padding(rows: DataFrame, hours: int) -> DataFrame:
    """The ranks that a curve lacks to the given length, counted from its rows, not from the curve."""
    kept = rows.filter(texts.is_kept(F.col("series")))
    lengths = kept.groupBy("series", "year").agg(F.count("value").alias("n"))
    missing = F.sequence(F.col("n"), F.lit(hours - 1).cast("long"))
    return lengths.filter(F.col("n") < hours).select(
        "series", "year", F.explode(missing).alias("rank"),
        F.lit(None).cast(rows.schema["ts"].dataType).alias("ts"),
        F.lit(None).cast("double").alias("value"),
    )


def side_by_side(curve: DataFrame, series: list[str]) -> DataFrame:
    """Curves next to each other by rank: a value and a time column per listed series."""
    wide = curve.groupBy("rank").pivot("series", series)
    return wide.agg(F.first("value").alias("value"), F.first("ts").alias("orgidx"))


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("ts"))


def split_years(df: DataFrame) -> DataFrame:
    """Year as a column, name with the year, time moved to the common leap year."""
    kept = df.filter(texts.is_kept(F.col("series")))
    year = F.year("ts")
    return kept.select(
        "series", year.alias("year"), texts.name_in_year(F.col("series"), year).alias("name"),
        times.on_overlay_year(F.col("ts")).alias("ts"), "value", F.col("ts").alias("orgidx"),
    )


def lines_by_year(years: DataFrame) -> DataFrame:
    """Names of the lines in the year frames."""
    return years.select("year", "name").distinct()


def overlay_days(df: DataFrame, days: list[str]) -> DataFrame:
    """Chosen days on one common date; the day stays as a key."""
    chosen = df.filter(_on_days(F.col("ts"), days))
    return chosen.select(
        "series", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        times.on_overlay_day(F.col("ts")).alias("ts"),
        texts.shown_value(F.col("series"), F.col("value")).alias("value"), F.col("ts").alias("orgidx"),
    )


def _on_days(ts: Column, days: list[str]) -> Column:
    # Ranges on the bare column reach the scan; a function on the column would not.
    hit = F.lit(False)
    for day in days:
        start = F.lit(day).cast("timestamp_ntz")
        hit = hit | ((ts >= start) & (ts < start + F.expr("interval 1 day")))
    return hit


def clip(value: Column, level: float) -> Column:
    """A value cut at a level: from above for a positive level, from below otherwise."""
    cut = F.least if level > 0 else F.greatest
    return F.when(value.isNotNull(), cut(value, F.lit(float(level))))


def clipped(df: DataFrame, level: float) -> DataFrame:
    return df.withColumn("value", clip(F.col("value"), level))


def drawable(df: DataFrame) -> DataFrame:
    """Series with more than one value."""
    enough = df.groupBy("series").agg(F.count("value").alias("n")).filter("n > 1")
    return df.join(enough, "series", "left_semi")
