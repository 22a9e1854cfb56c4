"""Aggregations and time resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.fixtures import (
    akima_sql, event_units, observation, order_units, p_events, p_orders, place, r,
    table, weather_daily, weather_units, with_sql,
)
from gridloom.catalog.tables import FED_SQL, fed_in
from gridloom.functions import units
from gridloom.operators import geo, resample, stats, weather
from gridloom.session import fixed_table


def _in(rule: str, unit: str = "unit") -> str:
    listed = ", ".join("'" + u.strip().lower() + "'" for u in units.RULES[rule])
    return f"coalesce(lower(trim({unit})) IN ({listed}), false)"


@query(
    "a1_hourly_mean",
    with_sql("h_events", "SELECT series, ts, round(value, 6) AS value, ts AS orgidx FROM h_events"),
)
def _(spark, folder):
    return resample.hourly_mean(p_events(spark, folder)).withColumn("value", r("value"))


SUFFIXED = (
    "SELECT event_type || CASE event_type WHEN 'click' THEN ' → Arbeit' WHEN 'view' THEN ' → Leistung' ELSE '' END "
    "AS series, ts, value FROM events"
)


@query(
    "a1_hourly_mean_power_only",
    f"WITH s AS ({SUFFIXED}) SELECT replace(series, ' → Leistung', '') AS series, date_trunc('hour', ts) AS ts, "
    "round(avg(value), 6) AS value, date_trunc('hour', ts) AS orgidx FROM s WHERE NOT contains(series, ' → Arbeit') GROUP BY 1, 2",
)
def _(spark, folder):
    suffix = F.when(F.col("series") == "click", " → Arbeit").when(F.col("series") == "view", " → Leistung").otherwise("")
    named = p_events(spark, folder).withColumn("series", F.concat("series", suffix))
    return resample.hourly_mean(named).withColumn("value", r("value"))


@query(
    "a2_monthly_values",
    with_sql(
        "p_orders order_units",
        "SELECT p.series, date_trunc('month', ts) + INTERVAL 14 DAY AS ts, round(CASE WHEN "
        f"any_value({_in('mean_always')}) THEN avg(value) ELSE sum(value) END, 6) AS value, "
        "date_trunc('month', ts)::TIMESTAMP AS orgidx FROM p_orders p LEFT JOIN order_units u ON p.series = u.series GROUP BY 1, 2, 4",
    ),
)
def _(spark, folder):
    months = resample.monthly_values(p_orders(spark, folder), order_units(spark))
    return months.withColumn("value", r("value"))


def _down_sql(source: str, names: str, bucket: str, places: int) -> str:
    return with_sql(
        f"{source} {names}",
        f"SELECT p.series, {bucket} AS ts, round(CASE WHEN any_value({_in('mean_all')}) THEN avg(value) ELSE sum(value) END, "
        f"{places}) AS value FROM {source} p LEFT JOIN {names} u ON p.series = u.series GROUP BY 1, 2",
    )


@query("a3_downsample_quarter_hour", _down_sql("p_events", "event_units", "time_bucket(INTERVAL 15 MINUTE, ts)", 6))
def _(spark, folder):
    return resample.downsample(p_events(spark, folder), event_units(spark), "15m").withColumn("value", r("value"))


@query("a3_downsample_hour", _down_sql("p_events", "event_units", "date_trunc('hour', ts)", 6))
def _(spark, folder):
    return resample.downsample(p_events(spark, folder), event_units(spark), "1h").withColumn("value", r("value"))


@query("a3_downsample_day", _down_sql("p_events", "event_units", "date_trunc('day', ts)::TIMESTAMP", 6))
def _(spark, folder):
    return resample.change_resolution(p_events(spark, folder), event_units(spark), "1d").withColumn("value", r("value"))


@query("a3_downsample_month", _down_sql("p_orders", "order_units", "date_trunc('month', ts)::TIMESTAMP", 6))
def _(spark, folder):
    return resample.change_resolution(p_orders(spark, folder), order_units(spark), "1mo").withColumn("value", r("value"))


def _grid_steps(source: str, names: str, seconds: int, scaled: str) -> dict[str, str]:
    return {
        "sp": f"SELECT series, min(ts) AS a, max(ts) AS b, epoch_us(max(ts)) - epoch_us(min(ts)) AS w, count(ts) AS n FROM {source} GROUP BY 1",
        "sc": f"SELECT p.series, ts, value * {scaled} AS value FROM {source} p JOIN sp USING (series) LEFT JOIN {names} u ON u.series = p.series",
        "gr": f"SELECT series, unnest(generate_series(a, b, INTERVAL {seconds} SECOND)) AS ts FROM sp",
        "oj": "SELECT coalesce(s.series, g.series) AS series, coalesce(s.ts, g.ts) AS ts, s.value FROM sc s FULL JOIN gr g "
        "ON s.series = g.series AND s.ts = g.ts",
    }


UP = "CASE WHEN " + _in("mean_all") + " THEN 1.0 ELSE {sec}.0::DOUBLE / (w / 1000000 / (n - 1)) END"


@query(
    "a4_upsample_quarter_hour",
    with_sql(
        "h_events event_units", "SELECT series, ts, round(value, 7) AS value FROM akima",
        **(_grid_steps("h_events", "event_units", 900, UP.format(sec=900)) | akima_sql("oj")),
    ),
)
def _(spark, folder):
    hours = resample.hourly_mean(p_events(spark, folder)).drop("orgidx")
    return resample.upsample(hours, event_units(spark), "15m").select("series", "ts", r("value", 7).alias("value"))


@query(
    "a4_upsample_hour_by_choice",
    with_sql(
        "weather_daily weather_units", "SELECT series, ts, round(value, 6) AS value FROM akima",
        **(_grid_steps("weather_daily", "weather_units", 3600, UP.format(sec=3600)) | akima_sql("oj")),
    ),
)
def _(spark, folder):
    finer = resample.change_resolution(weather_daily(spark, folder), weather_units(spark), "1h")
    return finer.select("series", "ts", r("value", 6).alias("value"))


@query(
    "a5_hourly_to_quarter",
    with_sql(
        "h_events event_units", "SELECT series, ts, round(value, 7) AS value FROM akima",
        **(_grid_steps(
            "h_events", "event_units", 900,
            f"CASE WHEN {_in('mean_all')} OR trim(coalesce(unit, '')) = '' THEN 1.0 ELSE 0.25::DOUBLE END",
        ) | akima_sql("oj")),
    ),
)
def _(spark, folder):
    hours = resample.hourly_mean(p_events(spark, folder)).drop("orgidx")
    return resample.hourly_to_quarter(hours, event_units(spark)).select("series", "ts", r("value", 7).alias("value"))


COARSE = "SELECT series, row_number() OVER (PARTITION BY series ORDER BY value DESC, ts) - 1 AS k, value FROM p_orders"


@query(
    "a6_curve_to_hours",
    with_sql(
        "p_orders", "SELECT series, hour, round(value, 4) AS value FROM akima",
        ranks=COARSE,
        st="SELECT series, k * 3 AS hour, value FROM ranks",
        gr="SELECT DISTINCT series, unnest(range(0, 8761)) AS hour FROM st",
        oj="SELECT g.series, g.hour, s.value FROM gr g LEFT JOIN st s USING (series, hour)",
        **akima_sql("oj", axis="hour::DOUBLE", scale="1.0", key="hour"),
    ),
)
def _(spark, folder):
    from gridloom.operators.curves import duration_curve

    curve = duration_curve(p_orders(spark, folder))
    coarse = curve.select("series", (F.col("rank") * 3).alias("hour"), "value")  # all ranks: a day stands for three hours
    return resample.curve_to_hours(coarse).select("series", "hour", r("value", 4).alias("value"))


def _quantile(share: float) -> str:
    return f"min(value) FILTER (rn = round((n - 1) * {share}::DOUBLE) + 1)"


RANKED = "SELECT *, row_number() OVER (PARTITION BY series ORDER BY value) AS rn, count(*) OVER (PARTITION BY series) AS n FROM {0} WHERE value IS NOT NULL"


@query(
    "a7_quantile_nearest",
    with_sql("p_events", f"SELECT series, {_quantile(0.95)} AS q95 FROM k GROUP BY 1", k=RANKED.format("p_events")),
)
def _(spark, folder):
    return stats.quantile_95(p_events(spark, folder))


@query(
    "a8_summary",
    with_sql(
        "p_gaps",
        "SELECT p.series, count(value) AS count, count(*) - count(value) AS null_count, round(avg(value), 6) AS mean, "
        "round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, any_value(q25) AS q25, any_value(q50) AS q50, "
        "any_value(q75) AS q75 FROM p_gaps p JOIN q ON p.series = q.series GROUP BY 1",
        k=RANKED.format("p_gaps"),
        q=f"SELECT series, {_quantile(0.25)} AS q25, {_quantile(0.5)} AS q50, {_quantile(0.75)} AS q75 FROM k GROUP BY 1",
    ),
)
def _(spark, folder):
    from gridloom.catalog.fixtures import p_gaps

    return stats.summary(p_gaps(spark, folder)).withColumns({"mean": r("mean"), "std": r("std")})


@query(
    "a9_extremes",
    f"WITH f AS ({FED_SQL}) SELECT series, ts, CASE WHEN contains(series, 'Einsp') THEN -value ELSE value END AS value FROM f "
    "QUALIFY row_number() OVER (PARTITION BY series ORDER BY value DESC, ts) = 1",
)
def _(spark, folder):
    return stats.extremes(fed_in(spark, folder))


@query(
    "a10_years",
    with_sql(
        "p_orders",
        "SELECT series, array_to_string(list_sort(list(DISTINCT year(ts))), ',') AS years, count(DISTINCT year(ts)) > 1 AS multi_years "
        "FROM p_orders GROUP BY 1",
    ),
)
def _(spark, folder):
    found = stats.years(p_orders(spark, folder))
    return found.withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@query(
    "a11_step_minutes",
    with_sql(
        "p_orders p_events",
        "SELECT series, m AS td_mnts, CASE m WHEN 15 THEN '15min' WHEN 60 THEN 'h' END AS td_interval FROM t",
        u="SELECT series, ts FROM p_orders UNION ALL SELECT series, ts FROM p_events",
        d="SELECT series, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series ORDER BY ts)) / 60000000) AS x FROM u",
        t="SELECT series, floor(avg(x))::BIGINT AS m FROM d GROUP BY 1",
    ),
)
def _(spark, folder):
    both = p_orders(spark, folder).unionByName(p_events(spark, folder))
    return stats.step_minutes(both)


@query(
    "a12_time_extent",
    with_sql(
        "p_events",
        "SELECT *, make_timestamp(((epoch_us(\"first\") + epoch_us(\"last\")) // 2)::BIGINT) AS middle, "
        "date_trunc('month', \"first\") + (\"first\" - date_trunc('day', \"first\")) AS month_start, "
        "last_day(\"last\")::TIMESTAMP + (\"last\" - date_trunc('day', \"last\")) AS month_end "
        "FROM (SELECT min(ts) AS \"first\", max(ts) AS \"last\" FROM p_events)",
    ),
)
def _(spark, folder):
    return stats.time_extent(p_events(spark, folder))


@query(
    "a12_time_extent_by_series",
    with_sql(
        "p_orders",
        "SELECT *, make_timestamp(((epoch_us(\"first\") + epoch_us(\"last\")) // 2)::BIGINT) AS middle, "
        "date_trunc('month', \"first\")::TIMESTAMP AS month_start, last_day(\"last\")::TIMESTAMP AS month_end "
        "FROM (SELECT series, min(ts) AS \"first\", max(ts) AS \"last\" FROM p_orders GROUP BY 1)",
    ),
)
def _(spark, folder):
    return stats.series_extent(p_orders(spark, folder))


@query(
    "a13_units_by_frequency",
    with_sql(
        "event_units",
        "SELECT unit, count(*) AS n, min(event_id) AS first_seen FROM events e JOIN event_units u ON u.series = e.event_type GROUP BY 1",
    ),
)
def _(spark, folder):
    named = table(spark, folder, "events").select(F.col("event_type").alias("series"), "event_id")
    return stats.by_frequency(resample.lookup(named, event_units(spark), ["series"]), "unit", "event_id")


SIZES = "SELECT CASE WHEN attr_size > 0 THEN attr_size END AS attr_size, CASE WHEN attr_colour > 20 THEN 4.0 END AS attr_colour FROM place"


def _sizes(spark, folder):
    return place(spark, folder).select(
        F.when(F.col("attr_size") > 0, F.col("attr_size")).alias("attr_size"),
        F.when(F.col("attr_colour") > 20, F.lit(4.0)).alias("attr_colour"),
    )


@query(
    "a14_same_attributes",
    with_sql(
        "place",
        "SELECT count(DISTINCT coalesce(nullif(attr_size, 0), 4)) = 1 AS all_same_size, "
        "count(DISTINCT coalesce(nullif(attr_colour, 0), 4)) = 1 AS all_same_colour FROM s", s=SIZES,
    ),
)
def _(spark, folder):
    return geo.same_attributes(_sizes(spark, folder))


@query(
    "a15_size_reference",
    with_sql("place", "SELECT 2 * max(coalesce(nullif(attr_size, 0), 4)) / 25 AS size_ref FROM s", s=SIZES),
)
def _(spark, folder):
    return geo.size_reference(_sizes(spark, folder))


@query(
    "a16_map_extent",
    with_sql(
        "place",
        "SELECT min_lat, max_lat, min_lon, max_lon, (max_lat + min_lat) / 2 AS lat, (max_lon + min_lon) / 2 AS lon, "
        "round(14 - ln(greatest(max_lat - min_lat, max_lon - min_lon) * 111), 6) AS zoom FROM (SELECT min(latitude) AS min_lat, "
        "max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon FROM place)",
    ),
)
def _(spark, folder):
    return geo.map_extent(place(spark, folder)).withColumn("zoom", r("zoom"))


FLAGS = "SELECT * FROM (VALUES ('A', ' J/cm²'), ('N', ' °C'), ('R', ' pct')) AS v(parameter, unit)"


def with_flag_unit(spark, df):
    signs = fixed_table(spark, [("A", " J/cm²"), ("N", " °C"), ("R", " pct")], "parameter, unit")
    return df.join(F.broadcast(signs), "parameter")


@query(
    "a17_resolutions_by_parameter",
    with_sql(
        "observation",
        "SELECT parameter, array_to_string(list_sort(list(DISTINCT resolution)), ',') AS resolutions, any_value(unit) AS unit "
        "FROM observation JOIN f USING (parameter) GROUP BY 1", f=FLAGS,
    ),
)
def _(spark, folder):
    found = weather.catalogue(with_flag_unit(spark, observation(spark, folder)))
    return found.withColumn("resolutions", F.array_join("resolutions", ","))


@query(
    "a18_station_coverage",
    with_sql(
        "observation",
        "SELECT station_id, round(coverage, 6) AS coverage FROM (SELECT station_id, min(c) AS coverage FROM (SELECT station_id, parameter, "
        "count(value) / 100.0::DOUBLE AS c FROM observation GROUP BY 1, 2) GROUP BY 1) WHERE coverage >= 0.9",
    ),
)
def _(spark, folder):
    return weather.station_coverage(observation(spark, folder), expected=100).withColumn("coverage", r("coverage"))


RES = "SELECT * FROM (VALUES " + ", ".join(f"('{en}', {i})" for i, (en, _) in enumerate(weather.RESOLUTIONS)) + ") AS v(resolution, place)"


@query(
    "a19_with_and_without_data",
    with_sql(
        "observation",
        "SELECT p.parameter, r.resolution, count(o.value) AS n, count(o.value) > 0 AS has_data FROM (SELECT DISTINCT parameter "
        "FROM observation) p CROSS JOIN r LEFT JOIN observation o ON o.parameter = p.parameter AND o.resolution = r.resolution GROUP BY 1, 2",
        r=RES,
    ),
)
def _(spark, folder):
    return weather.with_and_without_data(observation(spark, folder))


