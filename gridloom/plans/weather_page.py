"""Weather for many requests at once: a place, a parameter and a span of time each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import units
from gridloom.operators import resample, weather
from gridloom.operators.joins import is_small, lookup
from gridloom.session import stored

REQUEST = ["parameter", "start", "end"]
PLACE = ["place_id", "start", "end"]


@dataclass(frozen=True)
class Weather:
    """``values(place_id, start, end, ts, parameter, value)`` and ``report`` with a status per request. The values in
    two parts: ``keyed(place_id, start, end, series)`` and ``lines(series, parameter, ts, value)``."""

    values: DataFrame
    report: DataFrame
    keyed: DataFrame
    lines: DataFrame


def collect(
    requests: DataFrame, stations: DataFrame, observed: DataFrame, units_of: DataFrame, wanted: str,
    share: float = weather.COVERAGE,
) -> Weather:
    """Values in the wanted resolution from the nearest station that covers the span of each request.

    ``requests(place_id, latitude, longitude, parameter, start, end)``, ``observed(station_id, parameter,
    resolution, date, value)``, ``units_of(parameter, unit)``. Per parameter the preferred resolution among the
    available ones is taken, then per request the nearest station with the share of the expected values, its
    values in the span on even steps, and J/cm2 as W/m2. Requests that meet the same station, parameter and span
    share one series, which is resampled once. A request without a parameter that is observed, or without a
    station in reach, has no values and the status none.
    """
    used = stored(weather.closest_resolution(observed, wanted), "resolutions")
    asked = lookup(requests, used, ["parameter"], "inner")
    near = stored(weather.nearest_covering(asked, stations, observed, share), "nearest")
    found = near.select("station_id", "resolution", *REQUEST).distinct()
    name = F.concat_ws("|", "station_id", *[F.col(c).cast("string") for c in ("resolution", *REQUEST)])
    series = stored(found.withColumn("series", name), "series")
    lines = observed.join(F.broadcast(series) if is_small(series) else series, ["station_id", "parameter", "resolution"])
    rows = lines.filter(F.col("date").between(F.col("start"), F.col("end"))).select("series", F.col("date").alias("ts"), "value")
    unit = lookup(series, units_of, ["parameter"]).select("series", "unit")
    even = resample.change_resolution(rows, unit, weather.STEP_OF[wanted])
    known = lookup(even, unit, ["series"])
    watts = known.withColumn("value", units.power_density(F.col("value"), F.col("unit"))).drop("unit")
    keyed = near.select("place_id", "station_id", "resolution", *REQUEST).join(series, ["station_id", "resolution", *REQUEST])
    values = keyed.join(watts, "series").select("place_id", "start", "end", "ts", "parameter", "value")
    lined = lookup(watts, series.select("series", "parameter"), ["series"], "inner").select("series", "parameter", "ts", "value")
    told = weather.report(requests.select("place_id", *REQUEST), used, near, wanted, ["start", "end"])
    return Weather(values, told, keyed.select(*PLACE, "series"), lined)


def wide(found: Weather, parameters: list[str]) -> DataFrame:
    """One row per place, span and time with a column per parameter; what a parameter lacks is null.

    Places with the same series share one table, which is made once; places then only look it up, so no task holds
    their rows. The rows of a table are dealt by time, so that neither their sum nor one table lands in one task.
    """
    spark = found.keyed.sparkSession
    sets = stored(found.keyed.groupBy(*PLACE).agg(F.array_sort(F.collect_set("series")).alias("_set")), "sets")
    tables = stored(sets.select("_set").distinct().withColumn("_table", F.monotonically_increasing_id()), "tables")
    lines = tables.select("_table", F.explode("_set").alias("series")).join(found.lines, "series").drop("series")
    even = lines.repartition("_table", "ts").groupBy("_table", "ts").pivot("parameter", parameters).agg(F.first("value"))
    rows = stored(even, "wide")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = sets.join(tables, "_set").drop("_set").repartition(tasks, *PLACE)
    return lookup(placed, rows, ["_table"], "inner").select(*PLACE, "ts", *[F.col(f"`{p}`") for p in parameters])
