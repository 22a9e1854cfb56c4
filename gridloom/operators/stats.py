"""Statistics per series: quantiles, summaries, extremes, steps, years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import texts, times, units
from gridloom.operators.joins import attach
from gridloom.operators.ordered import in_order
from gridloom.session import stored


def value_counts(df: DataFrame, part: list[str]) -> DataFrame:
    """Rows per group and value: copies collapse before the shuffle."""
    return df.groupBy(*part, "value").agg(F.count(F.lit(1)).alias("n"))


def nearest_quantiles(df: DataFrame, shares: dict[str, float], part: list[str] | None = None) -> DataFrame:
    """Exact quantiles as the value at the nearest rank, one column per name.

    Equal values collapse to (value, count) before the shuffle; running counts give the ranks.
    """
    part = part or ["series"]
    return _quantiles(value_counts(df.filter(F.col("value").isNotNull()), part), shares, part)


def _quantiles(counts: DataFrame, shares: dict[str, float], part: list[str]) -> DataFrame:
    running = in_order(counts, part, ["value"]).running(F.col("n"), "upto")
    ranked = running.largest(F.col("upto"), "total").df
    found = {}
    for name, share in shares.items():
        rank = F.round((F.col("total") - 1) * F.lit(share)) + 1
        found[name] = F.min(F.when(F.col("upto") >= rank, F.col("value"))).alias(name)
    return ranked.groupBy(*part).agg(*found.values())


def quantile_95(df: DataFrame) -> DataFrame:
    return nearest_quantiles(df, {"q95": 0.95})


def summary(df: DataFrame) -> DataFrame:
    """Count, nulls, mean, deviation, extremes and quartiles per series, all from one table of value counts, for
    which the rows are read once."""
    counts = stored(value_counts(df, ["series"]), "counts")
    known = counts.filter(F.col("value").isNotNull())
    n, value = F.col("n"), F.col("value")
    plain = counts.groupBy("series").agg(
        F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("null_count"),
        (F.sum(value * n) / F.sum(F.when(value.isNotNull(), n))).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    around = attach(known, plain.select("series", "mean", "count"), ["series"])
    apart = F.sum(n * (value - F.col("mean")) * (value - F.col("mean"))) / F.nullif(F.max("count") - 1, F.lit(0))
    spread = around.groupBy("series").agg(F.sqrt(apart).alias("std"))
    quartiles = _quantiles(known, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["series"])
    joined = plain.join(spread, "series", "left").join(quartiles, "series", "left")
    return joined.select("series", "count", "null_count", "mean", "std", "min", "max", "q25", "q50", "q75")


def extremes(df: DataFrame) -> DataFrame:
    """Per series the largest value and its first time; the smallest for series shown negative."""
    shown = texts.shown_value(F.col("series"), F.col("value"))
    sign = F.when(texts.is_feed_in(F.col("series")), F.lit(-1.0)).otherwise(F.lit(1.0))
    rows = df.filter(F.col("value").isNotNull()).select("series", "ts", (shown * sign).alias("size"), "value")
    # Largest size first, then earliest time: one aggregate over (size, minus time).
    key = F.struct("size", (-times.micros(F.col("ts"))).alias("early"))
    top = rows.groupBy("series").agg(F.max_by(F.struct("ts", "value"), key).alias("top"))
    value = texts.shown_value(F.col("series"), F.col("top.value"))
    return top.select("series", F.col("top.ts").alias("ts"), value.alias("value"))


def years(df: DataFrame) -> DataFrame:
    """Sorted years of the data and whether there are several."""
    found = df.groupBy("series").agg(F.array_sort(F.collect_set(F.year("ts"))).alias("years"))
    return found.withColumn("multi_years", F.size("years") > 1)


def step_minutes(df: DataFrame) -> DataFrame:
    """Mean step per series in whole minutes (each step cut to minutes first) and its name."""
    rows = in_order(df.select("series", "ts"), ["series"], ["ts"])
    steps = rows.near(1, lambda w: {"_prev": F.lag("ts").over(w)}).result()
    gap = times.micros(F.col("ts")) - times.micros(F.col("_prev"))
    minutes = F.floor(gap / 60_000_000)
    mean = steps.groupBy("series").agg(F.floor(F.avg(minutes)).alias("td_mnts"))
    name = F.when(F.col("td_mnts") == 15, "15min").when(F.col("td_mnts") == 60, "h")
    return mean.withColumn("td_interval", name)


def differences(df: DataFrame) -> DataFrame:
    """Change to the row before in value, hour, day and time (seconds)."""
    rows = in_order(df, ["series"], ["ts"]).near(
        1, lambda w: {"_v": F.lag("value").over(w), "_t": F.lag("ts").over(w)}
    )
    return rows.result().select(
        "series", "ts",
        (F.col("value") - F.col("_v")).alias("value_diff"),
        (F.hour("ts") - F.hour("_t")).alias("hour_diff"),
        (F.dayofmonth("ts") - F.dayofmonth("_t")).alias("day_diff"),
        ((times.micros(F.col("ts")) - times.micros(F.col("_t"))) / 1_000_000).alias("seconds"),
    )


def numbered(df: DataFrame) -> DataFrame:
    """Row index from 0 in time order."""
    rows = in_order(df, ["series"], ["ts"]).number("_n").result()
    return rows.withColumn("index", F.col("_n") - 1).drop("_n")


def time_extent(df: DataFrame) -> DataFrame:
    """First, last and middle time, and the span snapped to whole months."""
    ends = df.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return _with_middle(ends)


def series_extent(df: DataFrame) -> DataFrame:
    ends = df.groupBy("series").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return _with_middle(ends)


def _with_middle(ends: DataFrame) -> DataFrame:
    low, high = times.micros(F.col("first")), times.micros(F.col("last"))
    middle = F.timestamp_micros(low + F.floor((high - low) / 2)).cast("timestamp_ntz")
    return ends.withColumns(
        {
            "middle": middle,
            "month_start": times.start_of_month(F.col("first")),
            "month_end": times.end_of_month(F.col("last")),
        }
    )


def by_frequency(df: DataFrame, value: str, seen: str) -> DataFrame:
    """Distinct values with their count, most frequent first, ties by first appearance."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen")


def import_format(q95: DataFrame, meta: DataFrame) -> DataFrame:
    """Number format per series at import, from the 95 % quantile."""
    return _formatted(q95, meta, small="#,##0.0")


def export_format(q95: DataFrame, meta: DataFrame, *, monthly: bool = False) -> DataFrame:
    """Number format per series for export; monthly power is written as energy."""
    kept = q95.filter(texts.is_kept(F.col("series")))
    out = _formatted(kept, meta, small="#,##0.000")
    if monthly:
        with_h = F.regexp_replace("number_format", '"$', 'h"')
        power = units.in_group(F.col("unit"), "sum_month")
        out = out.withColumn("number_format", F.when(power, with_h).otherwise(F.col("number_format")))
    return out


def _formatted(q95: DataFrame, meta: DataFrame, *, small: str) -> DataFrame:
    joined = q95.join(meta.select("series", "unit"), "series", "left")
    text: Column = units.number_format(F.col("q95"), F.col("unit"), small=small)
    return joined.withColumn("number_format", text)
