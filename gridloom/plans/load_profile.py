"""From a labelled sheet to hourly values, duration curve and monthly values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import texts
from gridloom.operators import clean, curves, meta, resample, weather
from gridloom.session import fixed_table, stored
from gridloom.sources import sheet


@dataclass(frozen=True)
class Profile:
    """Cleaned long profile ``(series, ts, value, unit)`` and its series metadata."""

    data: DataFrame
    meta: DataFrame


def import_sheet(spark: SparkSession, path: str) -> Profile:
    """Cells, titles, units, types, clock changes, OBIS names, energy and power counterparts.

    Two scans: one for the label rows, one for the values.
    """
    labels = sheet.labels_of(spark, path)
    raw = sheet.long_profile(sheet.typed(sheet.read_labelled(spark, path, labels)))
    tidy = clean.clean_switches(raw.filter(F.col("ts").isNotNull()))
    if not labels.units:
        raise ValueError(f"no series in {path}")
    units_of = fixed_table(spark, list(labels.units.items()), "series, unit")
    renamed = meta.obis_names(meta.series_meta(units_of))
    # One row per sheet column.
    names = renamed.select(F.col("old_series").alias("series"), F.col("series").alias("new"))
    doubled = names.groupBy("new").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("series")).alias("titles")).filter("n > 1").first()
    if doubled:
        raise ValueError(f"the titles {doubled['titles']} all stand for {doubled['new']}")
    data = tidy.join(F.broadcast(names), "series").withColumn("series", F.col("new")).drop("new")
    paired = meta.energy_and_power(data, renamed)
    return Profile(paired, renamed)


def hourly(profile: Profile) -> DataFrame:
    return resample.hourly_mean(profile.data)


def duration_curve(profile: Profile) -> DataFrame:
    return curves.duration_curve(hourly(profile))


def monthly(profile: Profile) -> DataFrame:
    units_of = profile.data.groupBy("series").agg(F.min("unit").alias("unit"))
    return resample.monthly_values(hourly(profile), units_of)


def page(profile: Profile, temperature: DataFrame | None = None) -> dict[str, DataFrame]:
    """All frames of the load-profile page from one import.

    ``raw``, ``hourly``, ``curve`` and ``monthly``; ``raw_years``, ``hourly_years`` and ``monthly_years`` are split by
    year and moved to one leap year; ``temperature(ts, value)`` adds a weather column to ``raw``. Curve and
    months start from the hours, which are made once and stored.
    """
    units_of = stored(profile.data.groupBy("series").agg(F.min("unit").alias("unit")), "units")
    hours = stored(hourly(profile), "hours")
    bare = units_of.select(texts.without_suffix(F.col("series")).alias("series"), "unit", F.col("series").contains(texts.ENERGY_SUFFIX).alias("_energy"))
    months = resample.monthly_values(hours, bare.filter("NOT _energy").drop("_energy"))
    raw = profile.data.select("series", "ts", "value")
    frames = {"raw": raw, "hourly": hours, "curve": curves.duration_curve(hours), "monthly": months}
    for name in ("raw", "hourly", "monthly"):
        frames[f"{name}_years"] = curves.split_years(frames[name])
    if temperature is not None:
        frames["raw"] = weather.with_temperature(raw, temperature)
    return frames


def curve_of_events(events: DataFrame) -> DataFrame:
    """Hourly means of an event table and their duration curve, series by event type."""
    profile = events.select(F.col("event_type").alias("series"), "ts", "value")
    return curves.duration_curve(resample.hourly_mean(profile))
