"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.fixtures import (
    p_events, place, r, table, weather_daily, weather_units, with_sql,
)
from gridloom.catalog.sheets import SHEET_SQL, TITLES, sheet_cells
from gridloom.functions import texts
from gridloom.operators import clean, curves, geo, weather
from gridloom.sources import sheet

SPARSE = (
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS a, "
    "CASE WHEN event_id % 4 = 0 THEN user_id END AS b, NULL::VARCHAR AS c FROM events"
)


def _sparse(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("a"),
        F.when(F.col("event_id") % 4 == 0, F.col("user_id")).alias("b"),
        F.lit(None).cast("string").alias("c"),
    )


@query(
    "p1_drop_empty_rows",
    f"WITH s AS ({SPARSE}) SELECT a, b, c FROM s WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL",
)
def _(spark, folder):
    return clean.drop_empty_rows(_sparse(spark, folder).drop("event_id"))


@query("p2_drop_empty_columns", f"WITH s AS ({SPARSE}) SELECT event_id, a, b FROM s")
def _(spark, folder):
    return clean.drop_empty_columns(_sparse(spark, folder))


TITLED = ", ".join(f'c{i} AS "{t}"' for i, t in enumerate([texts.INDEX_MARK, *TITLES]))


@query("p3_titles_from_marker_row", f"WITH {SHEET_SQL} SELECT {TITLED} FROM sheet")
def _(spark, folder):
    return sheet.titled(sheet_cells(spark, folder)).drop("seq")


@query("p4_rows_below_header", f"WITH {SHEET_SQL} SELECT {TITLED} FROM sheet WHERE kind = 'data'")
def _(spark, folder):
    return sheet.rows_below(sheet.titled(sheet_cells(spark, folder))).drop("seq")


@query(
    "p5_typed_columns",
    f"WITH {SHEET_SQL} SELECT ts, "
    + ", ".join(f'round(CAST(c{i} AS FLOAT)::DOUBLE, 4) AS "{t}"' for i, t in enumerate(TITLES, 1))
    + " FROM sheet WHERE kind = 'data'",
)
def _(spark, folder):
    typed = sheet.typed(sheet.rows_below(sheet.titled(sheet_cells(spark, folder)))).orderBy("ts")
    return typed.select("ts", *[F.round(F.col(f"`{t}`").cast("double"), 4).alias(t) for t in TITLES])


@query("p6_original_time", with_sql("p_events", "SELECT *, ts AS orgidx FROM p_events"))
def _(spark, folder):
    return sheet.with_original_time(p_events(spark, folder))


NAMES_SQL = (
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type || ' → Arbeit' WHEN 1 THEN event_type || ' geglättet' "
    "WHEN 2 THEN event_type || ' - orgidx' WHEN 3 THEN 'hline ' || event_type WHEN 4 THEN '↓ Index ↓' "
    "ELSE event_type END AS series FROM events"
)


def _names(spark, folder):
    e = F.col("event_type")
    rest = F.col("event_id") % 6
    name = (
        F.when(rest == 0, F.concat(e, F.lit(" → Arbeit"))).when(rest == 1, F.concat(e, F.lit(" geglättet")))
        .when(rest == 2, F.concat(e, F.lit(" - orgidx"))).when(rest == 3, F.concat(F.lit("hline "), e))
        .when(rest == 4, F.lit("↓ Index ↓")).otherwise(e)
    )
    return table(spark, folder, "events").select("event_id", name.alias("series"))


def _without(parts):
    return " AND ".join(f"NOT contains(series, '{p}')" for p in parts)


@query(
    "p7_excluded_series",
    f"WITH n AS ({NAMES_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS list, event_id, series FROM n WHERE {_without(v)}" for k, v in texts.EXCLUDED.items()
    ),
)
def _(spark, folder):
    lists = F.array(*[
        F.when(texts.is_kept(F.col("series"), k), F.lit(k)) for k in texts.EXCLUDED
    ])
    names = _names(spark, folder).withColumn("list", F.explode(F.array_compact(lists)))
    return names.select("list", "event_id", "series")


DAYS = ["2024-01-05", "2024-01-12"]


@query(
    "p8_day_overlay",
    with_sql(
        "p_events",
        "SELECT series, strftime(ts, '%Y-%m-%d') AS day, TIMESTAMP '2020-01-01' + (ts - date_trunc('day', ts)) AS ts, "
        "value, ts AS orgidx FROM p_events WHERE ts::DATE IN (DATE '2024-01-05', DATE '2024-01-12')",
    ),
)
def _(spark, folder):
    return curves.overlay_days(p_events(spark, folder), DAYS)


FED_SQL = "SELECT CASE WHEN event_type = 'error' THEN 'Einsp error' ELSE event_type END AS series, ts, value FROM events"


def fed_in(spark, folder):
    name = F.when(F.col("series") == "error", F.lit("Einsp error")).otherwise(F.col("series"))
    return p_events(spark, folder).select(name.alias("series"), "ts", "value")


@query(
    "p9_feed_in_negative",
    f"WITH f AS ({FED_SQL}) SELECT series, ts, CASE WHEN contains(series, 'Einsp') THEN -value ELSE value END AS value FROM f",
)
def _(spark, folder):
    return fed_in(spark, folder).withColumn("value", texts.shown_value(F.col("series"), F.col("value")))


@query(
    "p10_clip_at_level",
    "SELECT event_id, least(value, 20.0::DOUBLE) AS above, greatest(10.0::DOUBLE - value, -20.0::DOUBLE) AS below FROM events",
)
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "value")
    above, below = curves.clip(F.col("value"), 20.0), curves.clip(F.lit(10.0) - F.col("value"), -20.0)
    return e.select("event_id", above.alias("above"), below.alias("below"))


@query(
    "p12_time_span",
    with_sql(
        "p_events",
        "SELECT series, seq, ts, value FROM p_events WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' "
        "AND TIMESTAMP '2024-01-20 18:00:00'",
    ),
)
def _(spark, folder):
    return weather.in_span(p_events(spark, folder), "2024-01-10 06:00:00", "2024-01-20 18:00:00")


@query(
    "p12_span_of_data",
    with_sql("p_events", 'SELECT min(ts) AS start, max(ts) AS "end" FROM p_events'),
)
def _(spark, folder):
    return weather.span_of(p_events(spark, folder))


def point_table(spark, folder):
    return place(spark, folder).select(
        F.col("name").alias("Name"), F.col("latitude").alias("Breitengrad"),
        F.col("longitude").alias("Längengrad"), F.col("attr_size").alias("Punktgröße"),
    )


@query(
    "p13_point_table",
    with_sql(
        "place",
        "SELECT name, latitude, longitude, attr_size, NULL::DOUBLE AS attr_colour FROM place",
    ),
)
def _(spark, folder):
    return geo.points(point_table(spark, folder))


THIN_SQL = "SELECT event_type AS series, ts, CASE WHEN event_type <> 'view' OR event_id = (SELECT min(event_id) FROM events WHERE event_type = 'view') THEN value END AS value FROM events"


@query(
    "p14_drawable_series",
    f"WITH t AS ({THIN_SQL}) SELECT series, ts, value FROM t WHERE series IN "
    "(SELECT series FROM t GROUP BY series HAVING count(value) > 1)",
)
def _(spark, folder):
    events = p_events(spark, folder)
    first = events.filter("series = 'view'").agg(F.min("seq")).first()[0]
    keep = (F.col("series") != "view") | (F.col("seq") == F.lit(first))
    thin = events.select("series", "ts", F.when(keep, F.col("value")).alias("value"))
    return curves.drawable(thin).select("series", "ts", "value")


WIDE_WEATHER = (
    "SELECT ts, avg(value) FILTER (series = 'radiation_global') AS radiation_global, "
    "avg(value) FILTER (series = 'temperature_air_mean_2m') AS temperature_air_mean_2m, "
    "avg(value) FILTER (series = 'humidity') AS humidity FROM weather_daily GROUP BY ts"
)


def wide_weather(spark, folder):
    names = ["radiation_global", "temperature_air_mean_2m", "humidity"]
    return weather_daily(spark, folder).groupBy("ts").pivot("series", names).agg(F.first("value"))


@query(
    "p15_output_names",
    with_sql(
        "weather_daily",
        'SELECT ts, round(radiation_global, 6) AS "Gh [W/m²]", round(temperature_air_mean_2m, 6) AS "Tamb [°C]", '
        'round(humidity, 6) AS "Hrel [%]" FROM w', w=WIDE_WEATHER,
    ),
)
def _(spark, folder):
    wide = wide_weather(spark, folder)
    known = {k: v for k, v in weather.SIMULATION_COLUMNS.items() if k in wide.columns}
    return wide.select("ts", *[r(k).alias(v) for k, v in known.items()])


DE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in weather.PARAMETER_NAMES) + ") AS v(parameter, name_de)"


@query(
    "p16_german_names",
    with_sql(
        "weather_daily",
        "SELECT w.series, ts, round(value, 6) AS value, coalesce(name_de, w.series) AS name_de FROM "
        "(SELECT CASE WHEN day(ts) = 1 THEN 'other' ELSE series END AS series, ts, value FROM weather_daily) w "
        "LEFT JOIN de ON de.parameter = w.series",
        de=DE_SQL,
    ),
)
def _(spark, folder):
    w = weather_daily(spark, folder)
    some = w.withColumn("series", F.when(F.dayofmonth("ts") == 1, F.lit("other")).otherwise(F.col("series")))
    return weather.german_names(some, "series").select("series", "ts", r("value").alias("value"), "name_de")


@query(
    "p17_parameter_choice",
    with_sql(
        "weather_daily weather_units",
        "SELECT DISTINCT coalesce(name_de, d.series) AS name_de, unit, d.series = 'temperature_air_mean_2m' AS selected "
        "FROM weather_daily d JOIN weather_units USING (series) LEFT JOIN de ON de.parameter = d.series",
        de=DE_SQL,
    ),
)
def _(spark, folder):
    found = weather_daily(spark, folder).select(F.col("series").alias("parameter")).distinct()
    units_of = weather_units(spark).withColumnRenamed("series", "parameter")
    return weather.parameter_choice(found.join(units_of, "parameter"), weather.DEFAULT_PARAMETERS)


