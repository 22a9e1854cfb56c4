"""Sorts, limits, preferences, unions and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.fixtures import observation, p_events, p_orders, r, station, with_sql
from gridloom.catalog.joins import KM
from gridloom.catalog.resampling import RES
from gridloom.operators import curves, weather


@query("t1_sort_by_time", with_sql("p_events", "SELECT * FROM p_events ORDER BY series, ts"))
def _(spark, folder):
    return p_events(spark, folder).orderBy("series", "ts")


@query("t2_sort_by_value", with_sql("p_gaps", "SELECT series, ts, value FROM p_gaps ORDER BY series, value DESC NULLS LAST, ts"))
def _(spark, folder):
    from gridloom.catalog.fixtures import p_gaps

    return p_gaps(spark, folder).select("series", "ts", "value").orderBy("series", F.desc_nulls_last("value"), "ts")


HERE = KM.replace("p.latitude", "53.0758196::DOUBLE").replace("p.longitude", "8.8071646::DOUBLE")


@query(
    "t3_stations_by_distance",
    with_sql("station", f"SELECT s.*, round({HERE}, 6) AS distance FROM station s WHERE {HERE} <= 300 ORDER BY distance, station_id"),
)
def _(spark, folder):
    rows = weather.stations_by_distance(station(spark, folder), 53.0758196, 8.8071646, 300.0)
    return rows.withColumn("distance", r("distance"))


OPTIONS = "SELECT DISTINCT resolution, place FROM observation JOIN res USING (resolution)"


@query(
    "t4_resolution_preference",
    with_sql(
        "observation",
        "SELECT resolution, place, CASE WHEN place <= 3 THEN 3 - place ELSE place END::INTEGER AS preference FROM o ORDER BY 3",
        res=RES, o=OPTIONS,
    ),
)
def _(spark, folder):
    have = observation(spark, folder).select("resolution").distinct()
    placed = have.join(F.broadcast(weather.resolution_table(spark)), "resolution").select("resolution", "place")
    return weather.preference_order(placed, "hourly")


THIN_OBSERVED = "SELECT * FROM observation WHERE NOT (parameter = 'A' AND resolution = 'hourly') AND NOT (parameter = 'R' AND resolution = 'daily')"


def thin_observed(spark, folder):
    p, x = F.col("parameter"), F.col("resolution")
    return observation(spark, folder).filter(~((p == "A") & (x == "hourly")) & ~((p == "R") & (x == "daily")))


CLOSEST = (
    "SELECT DISTINCT parameter, resolution FROM thin JOIN res USING (resolution) QUALIFY row_number() OVER (PARTITION BY parameter "
    "ORDER BY CASE WHEN place <= 3 THEN 3 - place ELSE place END) = 1"
)


@query("t5_closest_resolution", with_sql("observation", "SELECT * FROM cl", thin=THIN_OBSERVED, res=RES, cl=CLOSEST))
def _(spark, folder):
    return weather.closest_resolution(thin_observed(spark, folder), "hourly")


@query("t6_first_rows", with_sql("p_events", "SELECT * FROM p_events ORDER BY ts, seq LIMIT 5"))
def _(spark, folder):
    return p_events(spark, folder).orderBy("ts", "seq").limit(5)


@query("t7_first_and_last_time", with_sql("p_orders", "SELECT series, min(ts) AS first, max(ts) AS last FROM p_orders GROUP BY 1"))
def _(spark, folder):
    return p_orders(spark, folder).groupBy("series").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


LISTED = "SELECT s.*, round({km}, 6) AS distance FROM station s WHERE {km} <= {limit}"


@query(
    "u1_all_stations",
    with_sql(
        "station",
        "SELECT station_id, any_value(name) AS name, any_value(latitude) AS latitude, any_value(longitude) AS longitude, min(distance) AS distance "
        f"FROM ({LISTED.format(km=HERE, limit=400)} UNION ALL {LISTED.format(km=HERE, limit=700)}) GROUP BY 1",
    ),
)
def _(spark, folder):
    stations = station(spark, folder)
    lists = [weather.stations_by_distance(stations, 53.0758196, 8.8071646, limit) for limit in (400.0, 700.0)]
    return weather.all_stations(lists).withColumn("distance", r("distance"))


@query(
    "u2_usable_parameters",
    with_sql("observation", "SELECT DISTINCT parameter FROM observation WHERE parameter NOT IN ('N')"),
)
def _(spark, folder):
    return weather.usable_parameters(observation(spark, folder), ["N"])


@query(
    "u3_year_parts",
    with_sql("p_orders", "SELECT series, year(ts)::INTEGER AS year, count(*) AS n, round(sum(value), 2) AS total FROM p_orders GROUP BY 1, 2"),
)
def _(spark, folder):
    parts = curves.split_years(p_orders(spark, folder))
    return parts.groupBy("series", "year").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query(
    "u4_null_padding",
    with_sql(
        "p_orders",
        "SELECT series, year::INTEGER AS year, unnest(range(n, 8784)) AS rank, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS value FROM "
        "(SELECT series, year(ts) AS year, count(*) AS n FROM p_orders GROUP BY 1, 2)",
    ),
)
def _(spark, folder):
    return curves.padding(curves.with_year(p_orders(spark, folder)), curves.LEAP_YEAR_HOURS)


