"""Weather series: observations, resolutions, coverage, nearest station with data, joins to profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import times, units
from gridloom.operators import geo
from gridloom.operators.fill import linear_by_row
from gridloom.operators.joins import attach, is_small, lookup
from gridloom.operators.ordered import in_order
from gridloom.operators.resample import change_resolution
from gridloom.session import fixed_table, stored

# Resolutions of the weather service from fine to coarse, with German names.
RESOLUTIONS = [
    ("minute_1", "Minutenwerte"),
    ("minute_5", "5-Minutenwerte"),
    ("minute_10", "10-Minutenwerte"),
    ("hourly", "Stundenwerte"),
    ("6_hour", "6-Stundenwerte"),
    ("subdaily", "mehrmals täglich"),
    ("daily", "Tageswerte"),
    ("monthly", "Monateswerte"),
    ("annual", "Jahreswerte"),
]

# The resolution asked of the weather service for each resampling step.
STEP_OF = {"minute_10": "15m", "hourly": "1h", "daily": "1d", "monthly": "1mo"}

# Seconds between two values of each resolution with an even step.
SECONDS_OF = {
    "minute_1": 60, "minute_5": 300, "minute_10": 600, "hourly": 3600, "6_hour": 21600, "subdaily": 28800, "daily": 86400,
}

# Weather parameters and their German names.
PARAMETER_NAMES = [
    ("cloud_cover_total", "Wolkendecke"),
    ("humidity", "Relative Luftfeuchte"),
    ("humidity_absolute", "Absolute Luftfeuchte"),
    ("precipitation_duration", "Niederschlagsdauer"),
    ("precipitation_height", "Niederschlagshöhe"),
    ("pressure_air_sea_level", "Luftdruck auf Meereshöhe"),
    ("pressure_air_site", "Luftdruck am Standort"),
    ("pressure_vapor", "Dampfdruck"),
    ("radiation_global", "Globalstrahlung"),
    ("radiation_sky_long_wave", "Atmosphärische Gegenstrahlung"),
    ("radiation_sky_short_wave_diffuse", "Diffuse Stahlung"),
    ("snow_depth", "Schneehöhe"),
    ("snow_depth_new", "Schneehöhe Neu"),
    ("temperature_air_max_2m", "Lufttemperatur (Max)"),
    ("temperature_air_max_2m_mean", "Lufttemperatur (Max-Ø)"),
    ("temperature_air_mean_2m", "Lufttemperatur"),
    ("temperature_air_min_2m", "Lufttemperatur (Min)"),
    ("temperature_air_min_2m_mean", "Lufttemperatur (Min-Ø)"),
    ("temperature_dew_point_mean_2m", "Taupunkttemperatur (Ø)"),
    ("temperature_soil_mean_0_05m", "Bodentemperatur in 5 cm Tiefe"),
    ("temperature_soil_mean_0_1m", "Bodentemperatur in 10 cm Tiefe"),
    ("temperature_soil_mean_0_2m", "Bodentemperatur in 20 cm Tiefe"),
    ("temperature_soil_mean_0_5m", "Bodentemperatur in 50 cm Tiefe"),
    ("temperature_soil_mean_1m", "Bodentemperatur in 1 m Tiefe"),
    ("temperature_wet_mean_2m", "Bodentemperatur in 2 m Tiefe"),
    ("visibility_range", "Sichtweite"),
    ("weather", "Wetter"),
    ("wind_direction", "Windrichtung"),
    ("wind_direction_gust_max", "Windrichtung Maximalböhe"),
    ("wind_gust_max", "Maximalböhe"),
    ("wind_speed", "Windgeschwindigkeit"),
    ("wind_speed_min", "Minimale Windgeschwindigkeit"),
    ("wind_speed_rolling_mean_max", "Maximalen Windgeschwindigkeit (gleitendes Mittel)"),
]

# Parameters that the weather service cannot deliver.
UNUSABLE_PARAMETERS = [
    "cloud_cover_total_index",
    "temperature_soil_mean_1m",
    "visibility_range_index",
    "water_equivalent_snow_depth",
    "water_equivalent_snow_depth_excelled",
    "wind_force_beaufort",
    "wind_gust_max_last_3h",
    "wind_gust_max_last_6h",
]

# Parameters selected by default, and columns of the simulation weather file.
DEFAULT_PARAMETERS = ["temperature_air_mean_2m"]
SIMULATION_COLUMNS = {
    "radiation_global": "Gh [W/m²]",
    "radiation_sky_short_wave_diffuse": "Dh [W/m²]",
    "temperature_air_mean_2m": "Tamb [°C]",
    "radiation_sky_long_wave": "Lh [W/m²]",
    "wind_speed": "Vwndh [m/s]",
    "humidity": "Hrel [%]",
}
COVERAGE = 0.9
SECONDS_PER_YEAR = 31_536_000


def resolution_table(spark: SparkSession) -> DataFrame:
    """Nine fixed rows: (resolution, name_de, place from fine to coarse)."""
    rows = [(en, de, i) for i, (en, de) in enumerate(RESOLUTIONS)]
    return fixed_table(spark, rows, "resolution, name_de, place")


def parameter_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, PARAMETER_NAMES, "parameter, name_de")


def observations(
    df: DataFrame, parameter: str, resolution: str | None, start: str, end: str
) -> DataFrame:
    """Values of one parameter in a span, in one or all resolutions; plain filters for the scan."""
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    hit = (F.col("parameter") == parameter) & F.col("date").between(first, last)
    if resolution is not None:
        hit = hit & (F.col("resolution") == resolution)
    return df.filter(hit)


def german_names(df: DataFrame, column: str = "parameter") -> DataFrame:
    """Add ``name_de``; a parameter without translation keeps its name."""
    names = parameter_table(df.sparkSession).withColumnRenamed("parameter", column)
    joined = df.join(F.broadcast(names), column, "left")  # fixed table
    return joined.withColumn("name_de", F.coalesce("name_de", column))


def english_names(df: DataFrame, column: str = "name_de") -> DataFrame:
    names = parameter_table(df.sparkSession).select(
        F.col("name_de").alias(column), F.col("parameter").alias("name_en")
    )
    joined = df.join(F.broadcast(names), column, "left")  # fixed table
    return joined.withColumn("name_en", F.coalesce("name_en", column))


def catalogue(df: DataFrame) -> DataFrame:
    """Per parameter its resolutions and unit."""
    return df.groupBy("parameter").agg(
        F.array_sort(F.collect_set("resolution")).alias("resolutions"), F.min("unit").alias("unit")
    )


def usable_parameters(parameters: DataFrame, unusable: list[str] | None = None) -> DataFrame:
    names = UNUSABLE_PARAMETERS if unusable is None else unusable
    return parameters.select("parameter").distinct().filter(~F.col("parameter").isin(names))


def parameter_choice(parameters: DataFrame, selected: list[str]) -> DataFrame:
    """Names for a selection list: selected ones first, then by name."""
    named = german_names(parameters)
    rows = named.select("name_de", "unit", F.col("parameter").isin(selected).alias("selected"))
    return rows.orderBy(F.desc("selected"), "name_de")


def with_and_without_data(df: DataFrame) -> DataFrame:
    """Every resolution of every parameter with its number of values."""
    counts = df.groupBy("parameter", "resolution").agg(F.count("value").alias("n"))
    names = F.array(*[F.lit(en) for en, _ in RESOLUTIONS])
    every = counts.select("parameter").distinct().select("parameter", F.explode(names).alias("resolution"))
    joined = every.join(counts, ["parameter", "resolution"], "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("parameter", "resolution", n.alias("n"), (n > 0).alias("has_data"))


def station_coverage(df: DataFrame, expected: int, share: float = COVERAGE) -> DataFrame:
    """Stations where even the weakest parameter has the share of the expected values."""
    per_parameter = df.groupBy("station_id", "parameter").agg(
        (F.count("value") / F.lit(expected)).alias("coverage")
    )
    worst = per_parameter.groupBy("station_id").agg(F.min("coverage").alias("coverage"))
    return worst.filter(F.col("coverage") >= share)


def expected_values(resolution: Column, first: Column, last: Column) -> Column:
    """Values that a complete series of a resolution has from ``first`` to ``last``, both included."""
    seconds = F.lit(None).cast("double")
    for name, step in SECONDS_OF.items():
        seconds = F.when(resolution == name, F.lit(float(step))).otherwise(seconds)
    span = (times.micros(last) - times.micros(first)) / 1_000_000
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1
    years = F.year(last) - F.year(first) + 1
    return F.when(resolution == "monthly", months).when(resolution == "annual", years).otherwise(F.floor(span / seconds) + 1)


def covering_stations(observed: DataFrame, spans: DataFrame, share: float = COVERAGE) -> DataFrame:
    """Stations that have the share of the expected values, per ``spans(parameter, resolution, start, end)``.

    Spans meet the observations by month, so a long table of observations is not crossed with them; counts are
    made before the shuffle.
    """
    first, last = (F.trunc(F.col(c).cast("date"), "month") for c in ("start", "end"))
    months = F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("_month")
    wanted = spans.select("parameter", "resolution", "start", "end").filter("start <= end").distinct().select("*", months)
    rows = observed.filter(F.col("value").isNotNull()).withColumn("_month", F.trunc(F.col("date").cast("date"), "month"))
    met = rows.join(F.broadcast(wanted) if is_small(wanted) else wanted, ["parameter", "resolution", "_month"])
    counts = met.filter(F.col("date").between(F.col("start"), F.col("end"))).groupBy(
        "station_id", "parameter", "resolution", "start", "end"
    ).agg(F.count(F.lit(1)).alias("n"))
    expected = expected_values(F.col("resolution"), F.col("start"), F.col("end"))
    covered = counts.withColumn("coverage", F.col("n") / expected)
    return covered.filter(F.col("coverage") >= share).drop("n")


def preference_order(options: DataFrame, wanted: str) -> DataFrame:
    """Options ``(resolution, place)``: the wanted one, then finer ones outwards, then coarser."""
    chosen = options.filter(F.col("resolution") == wanted).select("place").first()
    if chosen is None:
        raise ValueError(f"{wanted} is not among the options")
    return options.withColumn("preference", _preference(chosen["place"])).orderBy("preference")


def _preference(wanted_place: int):
    place = F.col("place")
    return F.when(place <= wanted_place, F.lit(wanted_place) - place).otherwise(place)


def closest_resolution(df: DataFrame, wanted: str) -> DataFrame:
    """Per parameter the available resolution that is preferred for the wanted one."""
    place = [en for en, _ in RESOLUTIONS].index(wanted)
    have = df.select("parameter", "resolution").distinct()
    placed = have.join(F.broadcast(resolution_table(df.sparkSession)), "resolution")  # nine rows
    return placed.groupBy("parameter").agg(F.min_by("resolution", _preference(place)).alias("resolution"))


def stations_by_distance(
    stations: DataFrame, latitude: float, longitude: float, limit_km: float = geo.LIST_LIMIT_KM
) -> DataFrame:
    """Stations around one place, nearest first."""
    km = geo.distance_km(F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude"))
    return stations.withColumn("distance", km).filter(F.col("distance") <= limit_km).orderBy(
        "distance", "station_id"
    )


def all_stations(lists: list[DataFrame]) -> DataFrame:
    """Union of station lists, one row per station (the nearest entry), nearest first."""
    both = lists[0]
    for other in lists[1:]:
        both = both.unionByName(other)
    rest = [c for c in both.columns if c not in ("station_id", "distance")]
    row = F.struct("distance", *rest)
    one = both.groupBy("station_id").agg(F.min(row).alias("_row"))
    return one.select("station_id", *[f"_row.{c}" for c in rest], "_row.distance").orderBy(
        "distance", "station_id"
    )


def nearest_with_data(
    places: DataFrame, stations: DataFrame, observed: DataFrame, limit_km: float = geo.STATION_LIMIT_KM
) -> DataFrame:
    """Nearest station of each place among the stations that have any value."""
    having = observed.filter(F.col("value").isNotNull()).select("station_id").distinct()
    return geo.nearest_station(places, stations.join(having, "station_id", "left_semi"), limit_km)


def nearest_by_parameter(
    requests: DataFrame, stations: DataFrame, observed: DataFrame, limit_km: float = geo.STATION_LIMIT_KM
) -> DataFrame:
    """The same per ``(place, parameter)``: each parameter has its own nearest station."""
    having = observed.filter(F.col("value").isNotNull()).select("station_id", "parameter").distinct()
    sites = having.join(stations, "station_id")
    return geo.nearest_station(requests, sites, limit_km, by=["parameter"])


def nearest_covering(
    requests: DataFrame, stations: DataFrame, observed: DataFrame, share: float = COVERAGE,
    limit_km: float = geo.STATION_LIMIT_KM,
) -> DataFrame:
    """Per ``(place, parameter, resolution, start, end)`` the nearest station that has the share of the values
    of the span; nearer ones that are too sparse do not count."""
    spans = requests.select("parameter", "resolution", "start", "end").distinct()
    sites = covering_stations(observed, spans, share).drop("coverage").join(stations, "station_id")
    return geo.nearest_station(requests, sites, limit_km, by=["parameter", "resolution", "start", "end"])


def station_attributes(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Attributes by station id, only where the id is unique in the station table."""
    rest = [c for c in stations.columns if c != "station_id"]
    one = stations.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_row")
    )
    unique = one.filter(F.col("_n") == 1).select("station_id", *[f"_row.{c}" for c in rest])
    return lookup(df, unique, ["station_id"])


def report(
    requests: DataFrame, used: DataFrame, nearest: DataFrame, wanted: str, by: list[str] | None = None
) -> DataFrame:
    """Per request: used resolution, station, distance and status none / other resolution / ok. Requests are told
    apart by place and parameter, and by the columns ``by``."""
    key = ["place_id", "parameter", *(by or [])]
    joined = attach(requests, used, ["parameter"])
    found = attach(joined, nearest.select(*key, "station_id", "distance"), key)
    status = (
        F.when(F.col("station_id").isNull(), F.lit("none"))
        .when(F.col("resolution") != wanted, F.lit("other resolution"))
        .otherwise(F.lit("ok"))
    )
    return found.select(*key, "resolution", "station_id", "distance", status.alias("status"))


def full_join_on_time(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on series and time; both sides have unique times."""
    return left.join(right, ["series", "ts"], "full")


def with_temperature(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Add ``temperature`` to the profile from weather ``(ts, value)``.

    Profile times and weather times form one axis; the weather value is interpolated along its rows
    and taken at the profile times. Gaps that remain at the ends, and gaps in the profile values,
    take the value before and then the value after.
    """
    rows = in_order(df, ["series"], ["ts"])
    axis = rows.df.select("ts").distinct().withColumns(
        {"value": F.lit(None).cast("double"), "_profile": F.lit(True)}
    )
    seen = weather.select("ts", "value").withColumn("_profile", F.lit(False))
    merged = axis.unionByName(seen).groupBy("ts").agg(
        F.max("value").alias("value"), F.max("_profile").alias("_profile")
    )
    merged = stored(merged.withColumn("_axis", F.lit(0)), "axis")
    line = linear_by_row(in_order(merged, ["_axis"], ["ts"]), "value", "_t")
    known = line.result().filter("_profile").select("ts", F.col("_t").alias("temperature"))
    rows = rows.over(rows.df.join(known, "ts", "left"))
    for name in ("value", "temperature"):
        rows = rows.fill(name, "_f").fill(name, "_b", forward=False)
        filled = F.coalesce(name, "_f", "_b")
        rows = rows.over(rows.df.withColumn(name, filled).drop("_f", "_b"))
    return rows.result().select(*df.columns, "temperature")


def combined(df: DataFrame, units_of: DataFrame, step: str, parameters: list[str]) -> DataFrame:
    """Parameters ``(series, ts, value)`` resampled to one step, one column each, by time."""
    even = change_resolution(df, units_of, step)
    return even.groupBy("ts").pivot("series", parameters).agg(F.first("value"))


def watt_values(df: DataFrame) -> DataFrame:
    """J/cm² series as W/m²; needs ``unit``."""
    return df.withColumn("value", units.power_density(F.col("value"), F.col("unit")))


def simulation_hours(wide: DataFrame) -> DataFrame:
    """Hourly rows of one year by second, from weather columns by ``ts``; missing values are 0."""
    first = F.lit(wide.agg(F.min("ts")).first()[0]).cast("timestamp_ntz")
    timed = wide.withColumn("Time [s]", times.seconds_of_year(F.col("ts"), first)).drop("ts")
    hours = wide.sparkSession.range(0, SECONDS_PER_YEAR, 3600).withColumnRenamed("id", "Time [s]")
    known = [c for c in SIMULATION_COLUMNS if c in wide.columns]
    joined = hours.join(timed, "Time [s]", "left")
    return joined.select(
        "Time [s]", *[F.coalesce(c, F.lit(0.0)).alias(SIMULATION_COLUMNS[c]) for c in known]
    )


def span_of(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def in_span(df: DataFrame, start: str, end: str) -> DataFrame:
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.filter(F.col("ts").between(first, last))
