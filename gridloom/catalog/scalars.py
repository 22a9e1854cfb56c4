"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.fixtures import event_units, observation, p_events, place, r, table, with_sql
from gridloom.catalog.resampling import RANKED, _quantile
from gridloom.catalog.sets import HERE
from gridloom.functions import obis, texts, times, units
from gridloom.operators import geo, meta, resample, stats

SERIAL_SQL = "SELECT event_id, epoch_us(date_trunc('hour', ts)) / 86400000000.0::DOUBLE + 25569 AS days FROM events"


def _serials(spark, folder):
    hour = times.floor_to(F.col("ts"), "1h")
    return table(spark, folder, "events").select(
        "event_id", (times.micros(hour) / F.lit(86_400_000_000.0) + 25569).alias("days")
    )


@query(
    "j1_serial_numbers",
    f"SELECT event_id, days, make_timestamp(round(days * 86400000000)::BIGINT - 2209161600000000) AS ts FROM ({SERIAL_SQL})",
)
def _(spark, folder):
    return _serials(spark, folder).withColumn("ts", times.serial_to_time(F.col("days")))




@query("j2_parse_times", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN date_trunc('minute', ts) END AS ts FROM events")
def _(spark, folder):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(times.format_time(F.col("ts")))
    return table(spark, folder, "events").select("event_id", times.parse_time(text).alias("ts"))


@query("j3_format_times", "SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS text FROM events")
def _(spark, folder):
    return table(spark, folder, "events").select("event_id", times.format_time(F.col("ts")).alias("text"))


@query(
    "j4_moved_times",
    "SELECT event_id, ts + (TIMESTAMP '2020-01-01' - TIMESTAMP '2024-01-01') AS on_year, TIMESTAMP '2020-01-01' + (ts - date_trunc('day', ts)) AS on_day, "
    "date_trunc('month', ts) + INTERVAL 14 DAY + (ts - date_trunc('day', ts)) AS mid_month FROM events",
)
def _(spark, folder):
    ts = F.col("ts")
    return table(spark, folder, "events").select(
        "event_id", times.on_overlay_year(ts).alias("on_year"), times.on_overlay_day(ts).alias("on_day"),
        times.on_mid_month(ts).alias("mid_month"),
    )


@query(
    "j5_time_parts",
    "SELECT event_id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, hour(ts)::INTEGER AS hour, "
    "isodow(ts)::INTEGER AS weekday FROM events",
)
def _(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"),
        F.hour("ts").alias("hour"), times.iso_weekday(F.col("ts")).alias("weekday"),
    )


@query(
    "j6_month_ends",
    "SELECT o_orderkey, date_trunc('month', ts)::TIMESTAMP + (ts - date_trunc('day', ts)) AS month_start, last_day(ts)::TIMESTAMP + (ts - date_trunc('day', ts)) "
    "AS month_end FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 96) * INTERVAL 15 MINUTE AS ts FROM orders)",
)
def _(spark, folder):
    from gridloom.catalog.fixtures import p_dst

    return p_dst(spark, folder).select(
        F.col("seq").alias("o_orderkey"), times.start_of_month(F.col("ts")).alias("month_start"),
        times.end_of_month(F.col("ts")).alias("month_end"),
    )


@query(
    "j7_normal_addresses",
    "SELECT doc_id, regexp_replace(replace(regexp_replace(replace(text, chr(10), ', '), '\\s+', ' ', 'g'), ' ,', ','), '\\s+', ' ', 'g') AS address FROM documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", texts.normal_address(F.col("text")).alias("address"))


NUMBER = (
    "translate(CASE WHEN abs(x) >= 100 THEN format('{:,.0f}', x) WHEN abs(x) >= 10 THEN format('{:,.1f}', x) ELSE format('{:,.2f}', x) END, ',.', '.,')"
)


@query(
    "j8_numbers_as_text",
    f"SELECT o_orderkey, {NUMBER} AS text FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) + 0.25 WHEN 1 THEN -floor(o_totalprice) / 4096 ELSE "
    "floor(o_totalprice) / 65536 + 0.001 END AS x FROM orders)",
)
def _(spark, folder):
    whole, rest = F.floor("o_totalprice").cast("double"), F.col("o_orderkey") % 3
    x = F.when(rest == 0, whole + 0.25).when(rest == 1, -whole / 4096).otherwise(whole / 65536 + 0.001)
    return table(spark, folder, "orders").select("o_orderkey", texts.number_text(x).alias("text"))


def _export_sql(monthly: bool) -> str:
    q = "'\"' || coalesce(unit, '') || '\"'"
    text = (
        f"CASE WHEN abs(q95) >= 1000 THEN '#,##0' || {q} WHEN abs(q95) >= 100 THEN '#,##0.0' || {q} WHEN abs(q95) >= 10 THEN '#,##0.00' || {q} "
        f"ELSE '#,##0.000' || {q} END"
    )
    if monthly:
        return f"CASE WHEN lower(unit) IN ('w', 'kw', 'mw') THEN regexp_replace({text}, '\"$', 'h\"') ELSE {text} END"
    return text


@query(
    "j9_export_formats",
    with_sql(
        "h_events event_units",
        f"SELECT q.series, round(q95, 6) AS q95, unit, {_export_sql(False)} AS number_format, {_export_sql(True)} AS monthly_format FROM q LEFT JOIN event_units USING (series)",
        k=RANKED.format("h_events"), q=f"SELECT series, {_quantile(0.95)} AS q95 FROM k GROUP BY 1",
    ),
)
def _(spark, folder):
    q95 = stats.quantile_95(resample.hourly_mean(p_events(spark, folder)))
    plain = stats.export_format(q95, event_units(spark))
    monthly = stats.export_format(q95, event_units(spark), monthly=True)
    both = plain.join(monthly.select("series", F.col("number_format").alias("monthly_format")), "series")
    return both.withColumn("q95", r("q95"))


@query(
    "j10_digits_shown",
    "SELECT event_id, CASE WHEN abs(value) < 10 THEN 2 WHEN abs(value) < 100 THEN 1 ELSE 0 END::INTEGER AS digits FROM events",
)
def _(spark, folder):
    return table(spark, folder, "events").select("event_id", texts.digits_shown(F.col("value")).alias("digits"))


@query(
    "j11_power_density",
    with_sql(
        "weather_daily weather_units",
        "SELECT w.series, ts, round(CASE WHEN contains(lower(replace(unit, ' ', '')), 'j/cm**2') THEN value * 2.778::DOUBLE ELSE value END, 6) AS value "
        "FROM weather_daily w JOIN weather_units u ON u.series = w.series",
    ),
)
def _(spark, folder):
    from gridloom.catalog.fixtures import weather_daily, weather_units
    from gridloom.operators import weather

    rows = meta.with_unit(weather_daily(spark, folder), weather_units(spark))
    return weather.watt_values(rows).select("series", "ts", r("value").alias("value"))


@query("j12_distance", with_sql("place", f"SELECT place_id, round({HERE.replace('s.', 'p.')}, 6) AS km FROM place p"))
def _(spark, folder):
    km = geo.distance_km(F.lit(53.0758196), F.lit(8.8071646), F.col("latitude"), F.col("longitude"))
    return place(spark, folder).select("place_id", r(km).alias("km"))


@query("j13_without_zone", with_sql("observation", "SELECT station_id, parameter, resolution, date AS ts FROM observation"))
def _(spark, folder):
    zoned = observation(spark, folder).withColumn("date", F.col("date").cast("timestamp"))
    return zoned.select("station_id", "parameter", "resolution", times.without_zone(F.col("date")).alias("ts"))


@query("j14_seconds_of_year", "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS seconds FROM events")
def _(spark, folder):
    events = table(spark, folder, "events")
    first = F.lit(events.agg(F.min("ts")).first()[0]).cast("timestamp_ntz")
    return events.select("event_id", times.seconds_of_year(F.col("ts"), first).alias("seconds"))


@query(
    "j15_obis_codes",
    with_sql(
        "obis_titles",
        "SELECT p_partkey, code, split_part(split_part(code, ':', 2), '.', 1) AS quantity, split_part(code, '.', 2) AS kind FROM "
        "(SELECT p_partkey, regexp_extract(title, '1-\\d*:\\d*\\.\\d*') AS code FROM obis_titles)",
    ),
)
def _(spark, folder):
    from gridloom.catalog.fixtures import obis_titles

    code = obis.code_of(F.col("title"))
    quantity, kind = obis.code_parts(code)
    return obis_titles(spark, folder).select("p_partkey", code.alias("code"), quantity.alias("quantity"), kind.alias("kind"))


@query(
    "j16_step_resolution",
    "SELECT l_orderkey, l_linenumber, m AS minutes, CASE WHEN m < 5 THEN 'minute_1' WHEN m < 10 THEN 'minute_5' WHEN m < 60 THEN 'minute_10' WHEN m < 1440 THEN 'hourly' "
    "WHEN m < 40320 THEN 'daily' ELSE 'monthly' END AS resolution FROM (SELECT l_orderkey, l_linenumber, l_partkey * l_linenumber * 7 AS m FROM lineitem)",
)
def _(spark, folder):
    minutes = F.col("l_partkey") * F.col("l_linenumber") * 7
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", minutes.alias("minutes"), times.step_resolution(minutes).alias("resolution")
    )


@query(
    "j17_suffixes",
    "SELECT event_id, trim(replace(replace(s, ' → Arbeit', ''), ' → Leistung', '')) AS bare, trim(replace(replace(s, ' → Arbeit', ''), ' → Leistung', '')) || ' → Leistung' "
    "AS power, contains(s, ' → Arbeit') AS is_energy, trim(u, 'h') AS hourly FROM (SELECT event_id, event_type || CASE event_id % 3 WHEN 0 THEN ' → Arbeit' WHEN 1 THEN ' → Leistung' "
    "ELSE '' END AS s, CASE event_id % 2 WHEN 0 THEN 'kWh' ELSE 'hPah' END AS u FROM events)",
)
def _(spark, folder):
    rest = F.col("event_id") % 3
    suffix = F.when(rest == 0, F.lit(texts.ENERGY_SUFFIX)).when(rest == 1, F.lit(texts.POWER_SUFFIX)).otherwise(F.lit(""))
    unit = F.when(F.col("event_id") % 2 == 0, F.lit("kWh")).otherwise(F.lit("hPah"))
    rows = table(spark, folder, "events").select("event_id", F.concat("event_type", suffix).alias("s"), unit.alias("u"))
    return rows.select(
        "event_id", texts.without_suffix(F.col("s")).alias("bare"), F.get(texts.suffix_variants(F.col("s")), 2).alias("power"),
        F.col("s").contains(texts.ENERGY_SUFFIX).alias("is_energy"), units.hourly_unit(F.col("u")).alias("hourly"),
    )


PHRASES = ["license", "copyright", "all rights reserved"]
ANY = "(?i)all rights reserved|copyright|license"


@query(
    "j18_listed_phrases",
    f"SELECT doc_id, regexp_replace(text, '{ANY}', '', 'g') AS text, len(regexp_extract_all(text, '{ANY}'))::INTEGER AS hits FROM documents",
)
def _(spark, folder):
    text, hits = texts.remove_phrases(F.col("text"), PHRASES)
    return table(spark, folder, "documents").select("doc_id", text.alias("text"), hits.alias("hits"))


