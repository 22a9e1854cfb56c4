"""Resampling of long profiles ``(series, ts, value)``; units come from ``(series, unit)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import texts, times, units
from gridloom.operators.fill import akima, akima_rows
from gridloom.operators.joins import lookup
from gridloom.operators.ordered import Ordered, on_time_slices
from gridloom.session import stored

# Nominal steps in seconds; a month counts as four weeks when steps are compared.
STEP_SECONDS = {"15m": 900, "1h": 3600, "1d": 86400, "1mo": 2419200}


def hourly_mean(df: DataFrame) -> DataFrame:
    """Mean per series and hour. Energy series are left out, the power suffix is dropped."""
    kept = df.filter(texts.is_kept(F.col("series"), "suff_arbeit"))
    named = kept.withColumn("series", texts.without_suffix(F.col("series")))
    hours = named.groupBy("series", F.window("ts", "1 hour").alias("w")).agg(
        F.avg("value").alias("value")
    )
    return hours.select(
        "series", F.col("w.start").alias("ts"), "value", F.col("w.start").alias("orgidx")
    )


def with_rule(df: DataFrame, units_of: DataFrame, rule: str, *, missing: bool = False) -> DataFrame:
    """Add ``mean``: is the unit of the series averaged? ``missing`` decides for series without unit."""
    unit = F.col("unit")
    if missing:
        flag = units.in_group(unit, rule) | (F.trim(F.coalesce(unit, F.lit(""))) == "")
    else:
        flag = units.in_group(unit, rule)
    small = units_of.select("series", flag.alias("mean"))
    return lookup(df, small, ["series"]).withColumn("mean", F.coalesce("mean", F.lit(missing)))


def _by_rule(df: DataFrame, units_of: DataFrame, rule: str, bucket: Column) -> DataFrame:
    # Sum and count per bucket first: the rule is joined to the small result, not to every row.
    sums = df.groupBy("series", bucket.alias("ts")).agg(
        F.avg("value").alias("avg"), F.sum("value").alias("sum")
    )
    ruled = with_rule(sums, units_of, rule)
    value = F.when(F.col("mean"), F.col("avg")).otherwise(F.coalesce("sum", F.lit(0.0)))
    return ruled.select("series", "ts", value.alias("value"))


def monthly_values(hourly: DataFrame, units_of: DataFrame) -> DataFrame:
    """Per month: mean for always-averaged units, else the sum (kW becomes kWh)."""
    kept = hourly.filter(texts.is_kept(F.col("series")))
    months = _by_rule(kept, units_of, "mean_always", times.floor_to(F.col("ts"), "1mo"))
    return months.select(
        "series", times.on_mid_month(F.col("ts")).alias("ts"), "value", F.col("ts").alias("orgidx")
    )


def downsample(df: DataFrame, units_of: DataFrame, step: str) -> DataFrame:
    """Buckets of 15m, 1h, 1d or 1mo: mean for averaged units, else the sum."""
    return _by_rule(df, units_of, "mean_all", times.floor_to(F.col("ts"), step))


def mean_step(df: DataFrame) -> DataFrame:
    """Per series: mean step in seconds. The steps add up to last minus first time."""
    span = df.groupBy("series").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("ts").alias("n")
    )
    whole = (times.micros(F.col("last")) - times.micros(F.col("first"))) / 1_000_000
    return span.withColumn("step", whole / F.nullif(F.col("n") - 1, F.lit(0)))


def grid(spans: DataFrame, seconds: int) -> DataFrame:
    """Times ``first``, ``first + step`` .. ``last`` per series.

    Made in two steps, a row per 10,000 grid points and then the points, so that a long span is
    spread over tasks and no row holds the whole grid.
    """
    block = 10_000
    first, last = times.micros(F.col("first")), times.micros(F.col("last"))
    size = seconds * 1_000_000
    count = F.floor((last - first) / size)
    blocks = spans.select(
        "series", first.alias("_first"), count.alias("_n"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(count / block))).alias("_block"),
    ).repartition("series", "_block")
    start = F.col("_block") * block
    end = F.least(F.col("_n"), start + (block - 1))
    points = blocks.select("series", "_first", F.explode(F.sequence(start, end)).alias("_i"))
    return points.select(
        "series",
        F.timestamp_micros(F.col("_first") + F.col("_i") * size).cast("timestamp_ntz").alias("ts"),
    )


def on_grid(df: DataFrame, seconds: int, spans: DataFrame | None = None) -> DataFrame:
    """Rows of the profile plus empty rows at missing grid times (full outer join by union)."""
    if spans is None:
        spans = df.groupBy("series").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    empty = grid(spans, seconds).withColumn("value", F.lit(None).cast("double"))
    both = df.select("series", "ts", "value").unionByName(empty)
    return both.groupBy("series", "ts").agg(F.max("value").alias("value"))


def on_even_rows(df: DataFrame, seconds: int, steps: DataFrame | None = None) -> Ordered:
    """``on_grid`` in order of time, cut by spans of time where a series is too long for one task."""
    if steps is None:
        steps = stored(mean_step(df), "steps")
    whole = (times.micros(F.col("last")) - times.micros(F.col("first"))) / (seconds * 1_000_000)
    top = steps.agg(F.max(F.col("n") + F.ceil(whole) + 1)).first()[0] or 0
    return on_time_slices(on_grid(df, seconds, steps.select("series", "first", "last")), ["series"], "ts", seconds, top)


def moves(df: DataFrame, units_of: DataFrame, step: str) -> DataFrame:
    """What a new step means for each series, as a small stored table: ``move`` is down, up or same.

    A series goes down where its own mean step is finer than asked for and up otherwise; one with fewer than
    two times has no step and stays the same. ``scale`` is what its values take on the way up.
    """
    seconds = F.lit(float(STEP_SECONDS[step]))
    move = F.when(F.col("step").isNull(), "same").when(F.col("step") < seconds, "down").otherwise("up")
    ruled = with_rule(mean_step(df), units_of, "mean_all").withColumn("move", move)
    scale = F.when(F.col("mean") | F.col("step").isNull(), F.lit(1.0)).otherwise(seconds / F.nullif(F.col("step"), F.lit(0.0)))
    return stored(ruled.withColumn("scale", scale), "moves")


def upsample(df: DataFrame, units_of: DataFrame, step: str) -> DataFrame:
    """Finer grid with Akima values; summed units are scaled by new step / mean old step."""
    return _upsample(df, moves(df, units_of, step), step)


def _upsample(df: DataFrame, steps: DataFrame, step: str) -> DataFrame:
    if step == "1mo":
        raise ValueError("a month has no fixed length: upsampling to months is not offered")
    scaled = lookup(df.select("series", "ts", "value"), steps.select("series", "scale"), ["series"])
    scaled = scaled.withColumn("value", F.col("value") * F.col("scale")).drop("scale")
    return akima_rows(on_even_rows(scaled, STEP_SECONDS[step], steps)).result()


def hourly_to_quarter(df: DataFrame, units_of: DataFrame) -> DataFrame:
    """Hourly to 15 minutes: a quarter of summed units; a missing unit counts as averaged."""
    steps = stored(mean_step(df), "steps")
    share = with_rule(steps.select("series"), units_of, "mean_all", missing=True)
    ruled = lookup(df.select("series", "ts", "value"), share, ["series"])
    value = F.when(F.col("mean"), F.col("value")).otherwise(F.col("value") / 4)
    return akima_rows(on_even_rows(ruled.withColumn("value", value).drop("mean"), 900, steps)).result()


def change_resolution(df: DataFrame, units_of: DataFrame, step: str) -> DataFrame:
    """Each series on its own: down where its mean step is finer than asked for, up otherwise; a series with
    one time stays as it is."""
    steps = moves(df, units_of, step)
    facts = steps.agg(F.collect_set("move").alias("kinds"), F.min("step").alias("low")).first()
    if facts["low"] == 0:
        raise ValueError("time steps of zero: clean doubled times first")
    rows = df.select("series", "ts", "value")
    parts = []
    for kind in ("down", "up", "same"):
        if kind not in facts["kinds"]:
            continue
        chosen = steps.filter(F.col("move") == kind)
        own = rows if len(facts["kinds"]) == 1 else lookup(rows, chosen.select("series"), ["series"], "left_semi")
        if kind == "down":
            own = downsample(own, units_of, step)
        elif kind == "up":
            own = _upsample(own, chosen, step)
        parts.append(own.select("series", "ts", "value"))
    return reduce(DataFrame.unionByName, parts) if parts else rows


def curve_to_hours(df: DataFrame, last_hour: int = 8760) -> DataFrame:
    """A duration curve ``(series, hour, value)`` in coarse steps on every hour 0..last_hour."""
    names = df.select("series").distinct()
    hours = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last_hour).cast("long"))).alias("hour")
    empty = names.select("series", hours, F.lit(None).cast("double").alias("value"))
    every = df.select("series", "hour", "value").unionByName(empty)
    merged = every.groupBy("series", "hour").agg(F.max("value").alias("value"))
    return akima(merged, axis="hour")
