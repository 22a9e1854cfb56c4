"""Joins: profiles with weather, stations, addresses, units, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.fixtures import (
    EVENTS, akima_sql, event_units, obis_titles, observation, p_events, p_gaps, place, r, station, weather_daily,
    weather_units, with_sql,
)
from gridloom.catalog.tables import WIDE_WEATHER, wide_weather
from gridloom.catalog.windows import linear_sql
from gridloom.functions import obis, units
from gridloom.operators import curves, geo, meta, resample, weather
from gridloom.plans import weather_page
from gridloom.session import fixed_table

KM = (
    "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.latitude - p.latitude) / 2), 2) + cos(radians(p.latitude)) "
    "* cos(radians(s.latitude)) * pow(sin(radians(s.longitude - p.longitude) / 2), 2))))"
)


@query(
    "g1_full_join_on_time",
    with_sql(
        "h_events",
        "SELECT coalesce(a.series, b.series) AS series, coalesce(a.ts, b.ts) AS ts, round(a.value, 6) AS value, b.n FROM "
        "(SELECT * FROM h_events WHERE hour(ts) < 16) a FULL JOIN (SELECT event_type AS series, date_trunc('hour', ts) AS ts, "
        "count(*) AS n FROM events WHERE hour(ts) > 8 GROUP BY 1, 2) b ON a.series = b.series AND a.ts = b.ts",
    ),
)
def _(spark, folder):
    events = p_events(spark, folder)
    left = resample.hourly_mean(events).filter(F.hour("ts") < 16).select("series", "ts", r("value").alias("value"))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    right = events.filter(F.hour("ts") > 8).groupBy("series", hour.alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return weather.full_join_on_time(left, right)


WEATHER_2024 = "SELECT make_timestamp(2024, month(l_shipdate), day(l_shipdate), 0, 0, 0.0) AS ts, avg(l_quantity) AS value FROM lineitem GROUP BY 1"


def _weather_2024(spark, folder):
    from gridloom.catalog.fixtures import table

    rows = table(spark, folder, "lineitem")
    zero = F.lit(0)
    moved = F.make_timestamp_ntz(F.lit(2024), F.month("l_shipdate"), F.dayofmonth("l_shipdate"), zero, zero, zero)
    return rows.groupBy(moved.alias("ts")).agg(F.avg("l_quantity").alias("value"))


FILL = "coalesce({c}, last_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query(
    "g2_profile_with_temperature",
    with_sql(
        "p_gaps",
        f"SELECT series, seq, ts, round({FILL.format(c='value')}, 6) AS value, round({FILL.format(c='temperature')}, 6) AS temperature FROM j",
        w=WEATHER_2024,
        ax="SELECT 0 AS series, coalesce(p.ts, w.ts) AS ts, w.value FROM (SELECT DISTINCT ts FROM p_gaps) p FULL JOIN w ON p.ts = w.ts",
        **linear_sql("ax"),
        t="SELECT ts, coalesce(value, va + (vb - va) * (k - ka) / nullif(kb - ka, 0)) AS temperature FROM e",
        j="SELECT p.*, t.temperature FROM p_gaps p JOIN t ON p.ts = t.ts",
    ),
)
def _(spark, folder):
    rows = weather.with_temperature(p_gaps(spark, folder), _weather_2024(spark, folder))
    return rows.withColumns({"value": r("value"), "temperature": r("temperature")})


NAMES = ["radiation_global", "temperature_air_mean_2m", "humidity"]


@query(
    "g3_combined_parameters",
    with_sql(
        "weather_daily weather_units",
        "SELECT ts, " + ", ".join(f"round(any_value(value) FILTER (series = '{n}'), 6) AS {n}" for n in NAMES) + " FROM m GROUP BY 1",
        m="SELECT w.series, date_trunc('month', ts)::TIMESTAMP AS ts, CASE WHEN any_value(coalesce(lower(trim(unit)) IN ("
        + ", ".join("'" + u.lower() + "'" for u in units.MEAN_ALL)
        + "), false)) THEN avg(value) ELSE sum(value) END AS value FROM weather_daily w JOIN weather_units u ON u.series = w.series GROUP BY 1, 2",
    ),
)
def _(spark, folder):
    wide = weather.combined(weather_daily(spark, folder), weather_units(spark), "1mo", NAMES)
    return wide.select("ts", *[r(n).alias(n) for n in NAMES])


@query(
    "g4_simulation_hours",
    with_sql(
        "weather_daily",
        'SELECT h.s AS "Time [s]", round(coalesce(radiation_global, 0), 6) AS "Gh [W/m²]", round(coalesce(temperature_air_mean_2m, 0), 6) '
        'AS "Tamb [°C]", round(coalesce(humidity, 0), 6) AS "Hrel [%]" FROM (SELECT unnest(range(0, 31536000, 3600)) AS s) h LEFT JOIN '
        "(SELECT *, (epoch_us(ts) - epoch_us(date_trunc('year', (SELECT min(ts) FROM w))::TIMESTAMP)) // 1000000 AS s FROM w) v USING (s)",
        w=WIDE_WEATHER,
    ),
)
def _(spark, folder):
    hours = weather.simulation_hours(wide_weather(spark, folder))
    return hours.select("Time [s]", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in hours.columns[1:]])


@query(
    "g5_curves_side_by_side",
    with_sql(
        "h_events",
        "SELECT rank, " + ", ".join(
            f"round(any_value(value) FILTER (series = '{e}'), 6) AS {e}_value, any_value(ts) FILTER (series = '{e}') AS {e}_orgidx" for e in EVENTS
        ) + " FROM c GROUP BY 1",
        c="SELECT series, row_number() OVER (PARTITION BY series ORDER BY value DESC, ts) - 1 AS rank, ts, value FROM h_events",
    ),
)
def _(spark, folder):
    hours = resample.hourly_mean(p_events(spark, folder))
    wide = curves.side_by_side(curves.duration_curve(hours), EVENTS)
    return wide.select("rank", *[r(c).alias(c) if c.endswith("_value") else c for c in wide.columns[1:]])


NEAR = (
    "SELECT p.place_id{more}, s.station_id, round(" + KM + ", 6) AS distance FROM place p JOIN {s} s ON "
    + KM + " <= {limit} QUALIFY row_number() OVER (PARTITION BY p.place_id{by} ORDER BY " + KM + ", s.station_id) = 1"
)


@query(
    "g6_nearest_station_with_data",
    with_sql(
        "place station observation", NEAR.format(more="", s="live", limit=150, by=""),
        live="SELECT * FROM station WHERE station_id IN (SELECT station_id FROM observation WHERE value IS NOT NULL)",
    ),
)
def _(spark, folder):
    near = weather.nearest_with_data(place(spark, folder), station(spark, folder), observation(spark, folder))
    return near.select("place_id", "station_id", r("distance").alias("distance"))


def requests(spark, folder):
    flags = F.array(F.lit("A"), F.lit("N"), F.lit("R"), F.lit("X"))
    return place(spark, folder).select("place_id", "latitude", "longitude", F.explode(flags).alias("parameter"))


@query(
    "g6_nearest_station_by_parameter",
    with_sql(
        "place station observation", NEAR.format(more=", s.parameter", s="live", limit=60, by=", s.parameter"),
        live="SELECT DISTINCT station.*, parameter FROM station JOIN observation USING (station_id) WHERE value IS NOT NULL",
    ),
)
def _(spark, folder):
    near = weather.nearest_by_parameter(requests(spark, folder), station(spark, folder), observation(spark, folder), 60.0)
    return near.select("place_id", "parameter", "station_id", r("distance").alias("distance"))


SPANS = [("1993-01-01", "1994-12-31"), ("1995-09-01", "1997-03-31")]
READINGS = (
    "SELECT l_suppkey % 8 AS station_id, l_returnflag AS parameter, CASE l_returnflag WHEN 'A' THEN 'monthly' ELSE 'daily' END AS resolution, "
    "CASE l_returnflag WHEN 'A' THEN date_trunc('month', l_shipdate)::TIMESTAMP ELSE l_shipdate END AS date, "
    "avg(CASE WHEN l_suppkey % 4 = 3 AND day(l_shipdate) % 5 = 0 THEN NULL ELSE l_quantity END) AS value FROM lineitem GROUP BY 1, 2, 3, 4"
)
SITES = (
    "SELECT s_suppkey % 8 AS station_id, round(avg(47.0::DOUBLE + (s_suppkey * 37 % 80) / 10.0::DOUBLE), 4) AS latitude, "
    "round(avg(6.0::DOUBLE + (s_suppkey * 53 % 90) / 10.0::DOUBLE), 4) AS longitude FROM supplier GROUP BY 1"
)
WISHES = (
    "SELECT place_id, latitude, longitude, parameter, start, \"end\" FROM (SELECT s_suppkey AS place_id, 47.0::DOUBLE + (s_suppkey * 41 % 80) / 10.0::DOUBLE AS latitude, "
    "6.0::DOUBLE + (s_suppkey * 59 % 90) / 10.0::DOUBLE AS longitude FROM supplier), (VALUES ('A'), ('N'), ('R'), ('X')) f(parameter), "
    "(VALUES " + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in SPANS) + ") p(start, \"end\")"
)


def readings(spark, folder):
    """Eight weather stations: A monthly, N and R daily; two of the stations lack every fifth day."""
    from gridloom.catalog.fixtures import table

    monthly = F.col("l_returnflag") == "A"
    lost = (F.col("l_suppkey") % 4 == 3) & (F.dayofmonth("l_shipdate") % 5 == 0)
    date = F.when(monthly, F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")).otherwise(F.col("l_shipdate"))
    return table(spark, folder, "lineitem").groupBy(
        (F.col("l_suppkey") % 8).alias("station_id"), F.col("l_returnflag").alias("parameter"),
        F.when(monthly, "monthly").otherwise("daily").alias("resolution"), date.alias("date"),
    ).agg(F.avg(F.when(~lost, F.col("l_quantity"))).alias("value"))


def sites(spark, folder):
    return station(spark, folder).groupBy((F.col("station_id") % 8).alias("station_id")).agg(
        F.round(F.avg("latitude"), 4).alias("latitude"), F.round(F.avg("longitude"), 4).alias("longitude")
    )


def wishes(spark, folder):
    """Every parameter, also one that is never observed, in two spans for each supplier's place."""
    spans = F.array(*[F.struct(F.lit(a).cast("timestamp_ntz").alias("start"), F.lit(b).cast("timestamp_ntz").alias("end")) for a, b in SPANS])
    places = station(spark, folder).select(
        F.col("station_id").alias("place_id"), (47.0 + (F.col("station_id") * 41 % 80) / 10.0).alias("latitude"),
        (6.0 + (F.col("station_id") * 59 % 90) / 10.0).alias("longitude"), F.explode(F.array(*[F.lit(x) for x in "ANRX"])).alias("parameter"),
    )
    return places.select("*", F.inline(spans))


CHAIN = {
    "obs": READINGS, "s0": SITES, "ask": WISHES,
    "used": "SELECT parameter, min(resolution) AS resolution FROM obs GROUP BY 1",
    "cnt": "SELECT station_id, o.parameter, o.resolution, start, \"end\", count(value) AS n FROM obs o JOIN (SELECT DISTINCT start, \"end\" FROM ask) p "
    "ON o.date BETWEEN p.start AND p.\"end\" GROUP BY 1, 2, 3, 4, 5",
    "live": "SELECT s0.*, parameter, resolution, start, \"end\" FROM cnt JOIN s0 USING (station_id) WHERE n / (CASE resolution WHEN 'daily' THEN date_diff('day', start, \"end\") + 1 "
    "ELSE date_diff('month', start, \"end\") + 1 END)::DOUBLE >= 0.9",
    "near": "SELECT p.place_id, p.parameter, s.resolution, p.start, p.\"end\", s.station_id, " + KM + " AS distance FROM ask p JOIN live s ON s.parameter = p.parameter AND s.start = p.start "
    "AND s.\"end\" = p.\"end\" AND " + KM + " <= 150 QUALIFY row_number() OVER (PARTITION BY p.place_id, p.parameter, p.start, p.\"end\" ORDER BY " + KM + ", s.station_id) = 1",
}


@query(
    "g6_nearest_covering_station",
    with_sql("", "SELECT place_id, parameter, start, \"end\", station_id, round(distance, 6) AS distance FROM near", **CHAIN),
)
def _(spark, folder):
    """The nearest station may be too sparse: the nearest one with nine tenths of the values wins."""
    observed = readings(spark, folder)
    asked = wishes(spark, folder).join(weather.closest_resolution(observed, "daily"), "parameter")
    near = weather.nearest_covering(asked, sites(spark, folder), observed)
    return near.select("place_id", "parameter", "start", "end", "station_id", r("distance").alias("distance"))


E2_UNITS = [("A", "J/cm**2"), ("N", "°C"), ("R", "pct")]


def _weather(spark, folder):
    units_of = fixed_table(spark, E2_UNITS, "parameter, unit")
    return weather_page.collect(wishes(spark, folder), sites(spark, folder), readings(spark, folder), units_of, "daily")


@query(
    "e2_weather",
    with_sql(
        "", "SELECT place_id, n.start, n.\"end\", ts, round(any_value(value * 2.778::DOUBLE) FILTER (n.parameter = 'A'), 4) AS a, "
        "round(any_value(value) FILTER (n.parameter = 'N'), 4) AS n, round(any_value(value) FILTER (n.parameter = 'R'), 4) AS r FROM near n JOIN akima k "
        "ON k.series = concat_ws('|', n.station_id, n.parameter, n.start) GROUP BY 1, 2, 3, 4",
        **CHAIN,
        keys="SELECT DISTINCT station_id, parameter, resolution, start, \"end\" FROM near",
        p="SELECT concat_ws('|', o.station_id, o.parameter, k.start) AS series, date AS ts, value, o.parameter FROM obs o JOIN keys k ON k.station_id = o.station_id "
        "AND k.parameter = o.parameter AND k.resolution = o.resolution AND date BETWEEN k.start AND k.\"end\"",
        sp="SELECT series, any_value(parameter) AS parameter, min(ts) AS a, max(ts) AS b, epoch_us(max(ts)) - epoch_us(min(ts)) AS w, count(ts) AS n FROM p GROUP BY 1",
        sc="SELECT p.series, ts, value * CASE WHEN sp.parameter IN ('N', 'R') THEN 1.0 ELSE 86400.0::DOUBLE / (w / 1000000 / (n - 1)) END AS value FROM p JOIN sp USING (series)",
        gr="SELECT series, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM sp",
        oj="SELECT coalesce(s.series, g.series) AS series, coalesce(s.ts, g.ts) AS ts, s.value FROM sc s FULL JOIN gr g ON s.series = g.series AND s.ts = g.ts",
        **akima_sql("oj"),
    ),
)
def _(spark, folder):
    """Resolution, nearest covering station, values, even steps, parameters side by side, W/m2."""
    wide = weather_page.wide(_weather(spark, folder), ["A", "N", "R"])
    return wide.select("place_id", "start", "end", "ts", *[r(c, 4).alias(c.lower()) for c in "ANR"])


@query(
    "e2_weather_report",
    with_sql(
        "", "SELECT ask.place_id, ask.parameter, ask.start, ask.\"end\", u.resolution, n.station_id, round(n.distance, 6) AS distance, "
        "CASE WHEN n.station_id IS NULL THEN 'none' WHEN u.resolution <> 'daily' THEN 'other resolution' ELSE 'ok' END AS status "
        "FROM ask LEFT JOIN used u ON u.parameter = ask.parameter LEFT JOIN near n ON n.place_id = ask.place_id AND n.parameter = ask.parameter AND n.start = ask.start AND n.\"end\" = ask.\"end\"",
        **CHAIN,
    ),
)
def _(spark, folder):
    return _weather(spark, folder).report.withColumn("distance", r("distance"))


ASKED = "SELECT place_id, replace(name, '#', '  #' || chr(10)) AS address FROM place WHERE place_id % 7 <> 0 UNION ALL SELECT place_id, 'nowhere' FROM place WHERE place_id % 7 = 0"


@query(
    "g7_coordinates_of_addresses",
    with_sql(
        "place",
        "SELECT a.place_id, a.address, g.latitude, g.longitude FROM a LEFT JOIN (SELECT name || '' AS name, latitude, longitude FROM place) g "
        "ON regexp_replace(replace(a.address, chr(10), ', '), '\\s+', '', 'g') = regexp_replace(replace(g.name, '#', ' #, '), '\\s+', '', 'g')",
        a=ASKED,
    ),
)
def _(spark, folder):
    known = place(spark, folder)
    # The gazetteer writes '... #, 000' where the question has blanks and a line break.
    gazetteer = known.select(F.replace("name", F.lit("#"), F.lit(" #, ")).alias("address"), "latitude", "longitude")
    broken = F.replace("name", F.lit("#"), F.concat(F.lit("  #"), F.char(F.lit(10))))
    asked = known.select("place_id", F.when(F.col("place_id") % 7 != 0, broken).otherwise(F.lit("nowhere")).alias("address"))
    return geo.coordinates_of(asked, gazetteer)


@query(
    "g7_addresses_of_coordinates",
    with_sql(
        "place station",
        "SELECT p.place_id, s.name AS address, round(" + KM + ", 6) AS distance FROM place p JOIN station s ON " + KM
        + " <= 150 QUALIFY row_number() OVER (PARTITION BY p.place_id ORDER BY " + KM + ", s.name) = 1",
    ),
)
def _(spark, folder):
    gazetteer = station(spark, folder).withColumnRenamed("name", "address")
    found = geo.addresses_of(place(spark, folder).drop("name"), gazetteer)
    return found.withColumn("distance", r("distance"))


@query(
    "g8_station_attributes",
    with_sql(
        "station observation",
        "SELECT o.station_id, o.parameter, n, t.name, t.latitude, t.longitude FROM (SELECT station_id, parameter, count(*) AS n FROM observation "
        "GROUP BY 1, 2) o LEFT JOIN (SELECT station_id, any_value(name) AS name, any_value(latitude) AS latitude, any_value(longitude) AS longitude "
        "FROM twice GROUP BY 1 HAVING count(*) = 1) t USING (station_id)",
        twice="SELECT * FROM station UNION ALL SELECT * FROM station WHERE station_id % 5 = 0",
    ),
)
def _(spark, folder):
    stations = station(spark, folder)
    twice = stations.unionByName(stations.filter(F.col("station_id") % 5 == 0))
    counts = observation(spark, folder).groupBy("station_id", "parameter").agg(F.count(F.lit(1)).alias("n"))
    return weather.station_attributes(counts, twice)


@query(
    "g9_unit_of_series",
    with_sql("p_events event_units", "SELECT p.*, u.unit FROM p_events p LEFT JOIN event_units u USING (series)"),
)
def _(spark, folder):
    return meta.with_unit(p_events(spark, folder), event_units(spark))


def _listed(rows):
    return ", ".join("(" + ", ".join("'" + c + "'" for c in row) + ")" for row in rows)


OBIS_STEPS = {
    "q": f"SELECT * FROM (VALUES {_listed(obis.quantity_rows())}) AS v(quantity_code, quantity, unit, short_name)",
    "k": f"SELECT * FROM (VALUES {_listed(obis.KINDS)}) AS v(kind_code, kind)",
    "c": "SELECT *, regexp_extract(title, '1-\\d*:\\d*\\.\\d*') AS code FROM titles",
}
TITLES_SQL = "SELECT * FROM obis_titles UNION ALL SELECT p_partkey + 1000000000, replace(title, ' 1-1:', ' 1-1:8') FROM obis_titles WHERE p_partkey % 10 = 0"


def _titles(spark, folder):
    titles = obis_titles(spark, folder)
    odd = titles.filter(F.col("p_partkey") % 10 == 0)
    moved = odd.select((F.col("p_partkey") + 1000000000).alias("p_partkey"), F.replace("title", F.lit(" 1-1:"), F.lit(" 1-1:8")).alias("title"))
    return titles.unionByName(moved)


@query(
    "g10_obis_lookup",
    with_sql(
        "obis_titles",
        "SELECT p_partkey, title, code, 'Elektrizität' AS medium, quantity, kind, ' ' || unit AS unit, short_name || ' (' || code || ')' AS name, "
        "short_name, quantity || ' [' || unit || '] - ' || kind || ' (' || code || ')' AS long_name FROM c "
        "JOIN q ON q.quantity_code = split_part(split_part(code, ':', 2), '.', 1) JOIN k ON k.kind_code = split_part(code, '.', 2)",
        titles=TITLES_SQL, **OBIS_STEPS,
    ),
)
def _(spark, folder):
    known = meta.known_obis(_titles(spark, folder))
    return known.select(
        "p_partkey", "title", "code", "medium", "quantity", "kind", F.concat(F.lit(" "), "obis_unit").alias("unit"),
        F.col("obis_name").alias("name"), "short_name", "long_name",
    )


@query(
    "g10_unknown_obis",
    with_sql(
        "obis_titles",
        "SELECT p_partkey, title, code FROM c WHERE code <> '' AND (split_part(split_part(code, ':', 2), '.', 1) NOT IN "
        "(SELECT quantity_code FROM q) OR split_part(code, '.', 2) NOT IN (SELECT kind_code FROM k))",
        titles=TITLES_SQL, **OBIS_STEPS,
    ),
)
def _(spark, folder):
    return meta.unknown_obis(_titles(spark, folder)).select("p_partkey", "title", "code")


