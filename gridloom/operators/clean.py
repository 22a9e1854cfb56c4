"""Cleaning of tables and of the time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.operators.fill import akima_rows
from gridloom.operators.ordered import Ordered, in_order
from gridloom.operators.resample import hourly_mean, on_even_rows
from gridloom.session import stored

SUNDAY = 7


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Keep the columns with any value; one pass counts all columns at once."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    row = counts.first()
    return df.select(*[f"`{c}`" for i, c in enumerate(df.columns) if row[i] > 0])


def in_spring_gap(ts: Column, switch_weekday: int = SUNDAY) -> Column:
    """True in the hour that is skipped when the clock moves to summer time."""
    return (
        (F.month(ts) == 3)
        & (F.dayofmonth(ts) > 24)
        & (times.iso_weekday(ts) == switch_weekday)
        & (F.hour(ts) == 2)
    )


def drop_spring_hour(df: DataFrame, switch_weekday: int = SUNDAY) -> DataFrame:
    return df.filter(~F.coalesce(in_spring_gap(F.col("ts"), switch_weekday), F.lit(False)))


def first_of_duplicates(df: DataFrame) -> DataFrame:
    """Per (series, ts) the row that came first. An aggregate, so copies collapse before the shuffle."""
    return _one_per_stamp(df, F.min_by, F.min).select(*df.columns)


def clean_switches(df: DataFrame, switch_weekday: int = SUNDAY) -> DataFrame:
    """No spring hour, no second copy of the autumn hour."""
    return first_of_duplicates(drop_spring_hour(df, switch_weekday))


def switch_rejects(df: DataFrame, switch_weekday: int = SUNDAY) -> DataFrame:
    """What cleaning removes: the last row of each spring-hour stamp and of each doubled stamp."""
    groups = _one_per_stamp(df, F.max_by, F.max)
    lost = groups.filter((F.col("_n") > 1) | in_spring_gap(F.col("ts"), switch_weekday))
    return lost.select(*df.columns)


def _one_per_stamp(df: DataFrame, by, end) -> DataFrame:
    # Column by column, not as one struct: numbers then stay in a hash aggregate.
    rest = [c for c in df.columns if c not in ("series", "ts", "seq")]
    return df.groupBy("series", "ts").agg(
        end("seq").alias("seq"), *[by(c, "seq").alias(c) for c in rest], F.count(F.lit(1)).alias("_n")
    )


def fix_half_days(df: DataFrame, *, only_where_found: bool = False) -> DataFrame:
    """Times written on a 12-hour clock without AM/PM, put right in order of ``seq``.

    Hour 12 counts as 0; from the point where the hour goes down within a day, 12 hours are added
    until the date changes. With ``only_where_found``, series whose hour never goes down within a
    day keep their times.
    """
    half = F.col("ts") - F.expr("interval 12 hours")
    rows = in_order(df, ["series"], ["seq"])
    clock = rows.over(rows.df.withColumn("_t", F.when(F.hour("ts") == 12, half).otherwise(F.col("ts"))))
    before = lambda w: {"_p": F.lag("_t").over(w), "_raw": F.lag("ts").over(w)}
    steps = clock.near(1, before)
    new_day = F.col("_p").isNull() | (F.to_date("_t") != F.to_date("_p"))
    down = F.hour("_t") < F.hour("_p")
    shift = F.when(new_day, F.lit(0)).when(down, F.lit(12))
    filled = steps.over(steps.df.withColumn("_shift", shift)).fill("_shift", "_hours")
    ts = (F.col("_t") + F.make_dt_interval(hours=F.col("_hours"))).cast("timestamp_ntz")
    if only_where_found:
        back = (F.hour("ts") < F.hour("_raw")) & (F.to_date("ts") == F.to_date("_raw"))
        filled = filled.largest(F.coalesce(back, F.lit(False)), "_found")
        ts = F.when(F.col("_found"), ts).otherwise(F.col("ts"))
    return filled.result().withColumn("ts", ts).select(*df.columns)


def null_where_constant(df: DataFrame | Ordered) -> DataFrame:
    """Values equal to the one before become null."""
    return _moving(in_order(df, ["series"], ["ts"])).result()


def _moving(rows: Ordered) -> Ordered:
    steps = rows.near(1, lambda w: {"_prev": F.lag("value").over(w)})
    value = F.when(F.col("value") == F.col("_prev"), None).otherwise(F.col("value"))
    return steps.over(steps.df.withColumn("value", value).drop("_prev"))


def fill_where_constant(df: DataFrame | Ordered) -> DataFrame:
    """Frozen values replaced by Akima interpolation between the moving ones, in one order of the rows. Moving values
    of one time make one knot, their mean."""
    return akima_rows(_moving(in_order(df, ["series"], ["ts"], together=True)), joint=True).result()


def repair_half_day_meter(df: DataFrame) -> DataFrame:
    """A 12-hour meter export to clean hourly values.

    Time repair only for series that show the pattern, first of doubled stamps, hourly mean on every hour
    between the first and the last of a series, then frozen and missing values interpolated. Only the values
    and the time are kept. A series without any time has no hours.
    """
    fixed = first_of_duplicates(fix_half_days(df, only_where_found=True))
    hours = hourly_mean(fixed.filter(F.col("ts").isNotNull())).select("series", "ts", "value")
    # Hours are few beside the readings, and the grid reads them twice.
    return fill_where_constant(on_even_rows(stored(hours, "hours"), 3600))


def remove_outliers(df: DataFrame, above: float | None = None) -> DataFrame:
    """Values above the limit are deleted and the gaps interpolated; default limit: overall maximum. What is left of
    one time makes one knot, its mean."""
    groups = df.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    facts = groups.agg(F.sum("n").alias("total"), F.max("n").alias("n"), F.max("top").alias("top")).first()
    limit = facts["top"] if above is None else above
    rows = in_order(df, ["series"], ["ts"], sizes=(facts["total"] or 0, facts["n"] or 0), together=True)
    value = F.when(F.col("value") > F.lit(limit), None).otherwise(F.col("value"))
    return akima_rows(rows.over(rows.df.withColumn("value", value)), joint=True).result()
