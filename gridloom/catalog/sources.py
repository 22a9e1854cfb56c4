"""Sources and sinks. Files are written from the given tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.cleaning import C5_STEPS
from gridloom.catalog.fixtures import (
    ORDER_UNITS, akima_sql, event_units, observation, p_ampm, p_events, p_orders, place, r, table, with_sql,
)
from gridloom.catalog.metadata import PAIRS
from gridloom.catalog.sheets import SHEET_SQL, sheet_cells, sheet_path
from gridloom.catalog.tables import WIDE_WEATHER, wide_weather
from gridloom.functions import times
from gridloom.operators import clean, curves, resample, weather
from gridloom.plans import load_profile, meter_folder, results
from gridloom.session import scratch_path
from gridloom.sources import kml, sheet, sinks


@query("s1_sheet_cells", f"WITH {SHEET_SQL} SELECT c0 AS _c0, c1 AS _c1, c2 AS _c2, c3 AS _c3, c4 AS _c4, c5 AS _c5 FROM sheet")
def _(spark, folder):
    return sheet_cells(spark, folder).drop("seq")


@query("s1_bare_title_line", f"WITH {SHEET_SQL} SELECT c0 AS _c0, c1 AS _c1, c2 AS _c2, c3 AS _c3, c4 AS _c4, c5 AS _c5 FROM sheet")
def _(spark, folder):
    """The title line holds one cell and no separator; all columns of the sheet are there."""
    cells = sheet_cells(spark, folder)
    names = [c for c in cells.columns if c != "seq"]
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in names])
    path = scratch_path(spark, "bare")
    cells.orderBy("seq").select(F.when(F.col("_c0") == "Lastgang", F.col("_c0")).otherwise(line).alias("line")).write.text(path)
    return sheet.read_cells(spark, path).drop("seq")


IMPORTED = {
    "ren": "SELECT * FROM (VALUES ('click', 'click', ' kWh'), ('view', 'view', ' kW'), ('purchase', 'purchase', ' °C'), ('error', 'error', ' m³'), "
    "('signup', 'Bezug (1-1:1.29)', ' kWh')) AS v(event, series, unit)",
    "q0": "SELECT ren.series, ts, CAST(v AS FLOAT)::DOUBLE AS value FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, max(value) AS v FROM events GROUP BY 1, 2) "
    "JOIN ren ON ren.event = event_type",
    "event_units": "SELECT series, unit FROM ren",
    "even": "SELECT s.series, g.ts, q.value FROM (SELECT DISTINCT series FROM q0) s CROSS JOIN (SELECT DISTINCT ts FROM q0) g LEFT JOIN q0 q ON q.series = s.series AND q.ts = g.ts",
} | PAIRS


@query("s2_sheet_import", with_sql("", "SELECT series, ts, round(value, 4) AS value, unit FROM pairs", **IMPORTED))
def _(spark, folder):
    profile = load_profile.import_sheet(spark, sheet_path(spark, folder))
    return profile.data.withColumn("value", r("value", 4))


E1_STEPS = {
    "h": "SELECT replace(series, ' → Leistung', '') AS series, date_trunc('hour', ts) AS ts, avg(value) AS value, any_value(unit) AS unit FROM pairs "
    "WHERE NOT contains(series, ' → Arbeit') GROUP BY 1, 2",
    "mo": "SELECT series, date_trunc('month', ts) + INTERVAL 14 DAY AS ts, CASE WHEN any_value(trim(unit)) IN ('°C', 'm³') THEN avg(value) ELSE sum(value) END AS value FROM h GROUP BY 1, 2",
    "moved": "SELECT 'raw' AS f, series, ts, value FROM pairs UNION ALL SELECT 'hourly', series, ts, value FROM h UNION ALL SELECT 'monthly', series, ts, value FROM mo",
}


@query(
    "e1_profile",
    with_sql(
        "", "SELECT f AS frame, series, ts, round(value, 4) AS value, NULL::BIGINT AS rank, NULL::INTEGER AS year FROM moved "
        "UNION ALL SELECT 'curve', series, ts, round(value, 4), row_number() OVER (PARTITION BY series ORDER BY value DESC, ts) - 1, NULL FROM h WHERE value IS NOT NULL "
        "UNION ALL SELECT f || '_years', CASE WHEN contains(series, ' → ') THEN regexp_replace(series, '( → .*)', ' ' || year(ts) || '\\1') ELSE series || ' ' || year(ts) END, "
        "make_timestamp(2020, month(ts), day(ts), hour(ts), minute(ts), second(ts)::DOUBLE), round(value, 4), NULL, year(ts)::INTEGER FROM moved",
        **IMPORTED, **E1_STEPS,
    ),
)
def _(spark, folder):
    """All frames of the load-profile page from one sheet: raw, hourly, curve, monthly, and three of them by year."""
    shown = None
    for name, df in load_profile.page(load_profile.import_sheet(spark, sheet_path(spark, folder))).items():
        title = F.col("name") if "name" in df.columns else F.col("series")
        rank = F.col("rank") if "rank" in df.columns else F.lit(None)
        year = F.col("year") if "year" in df.columns else F.lit(None)
        part = df.select(
            F.lit(name).alias("frame"), title.alias("series"), "ts", r("value", 4).alias("value"), rank.cast("long").alias("rank"), year.cast("int").alias("year")
        )
        shown = part if shown is None else shown.unionByName(part)
    return shown


PRIORITIES = [s for s, _ in ORDER_UNITS]


@query(
    "s3_table_with_header",
    with_sql(
        "p_orders",
        'SELECT ts AS "Datum", ' + ", ".join(f"max(value) FILTER (series = '{s}') AS \"{s}\"" for s in PRIORITIES) + " FROM p_orders GROUP BY 1",
    ),
)
def _(spark, folder):
    wide = p_orders(spark, folder).groupBy("ts").pivot("series", PRIORITIES).agg(F.max("value"))
    path = scratch_path(spark, "orders")
    blank = wide.withColumn("leer", F.lit(None).cast("string")).withColumn("Datum", times.format_time(F.col("ts")))
    blank.select("Datum", *PRIORITIES, "leer").write.csv(path, header=True)
    read = sheet.read_table(spark, path)
    return read.select("Datum", *[F.col(f"`{s}`").cast("double").alias(s) for s in PRIORITIES])


@query(
    "s4_dates_or_serials",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN make_timestamp(round(CAST(CAST(days AS VARCHAR) AS DOUBLE) * 86400000000)::BIGINT "
    "- 2209161600000000) END AS ts FROM (SELECT *, epoch_us(date_trunc('hour', ts)) / 86400000000.0::DOUBLE + 25569 AS days FROM events)",
)
def _(spark, folder):
    ts, rest = F.col("ts"), F.col("event_id") % 3
    days = (times.micros(times.floor_to(ts, "1h")) / F.lit(86_400_000_000.0) + 25569).cast("string")
    text = F.when(rest == 0, times.format_time(ts)).when(rest == 1, days).otherwise(F.lit("?"))
    return table(spark, folder, "events").select("event_id", times.parse_time_or_serial(text).alias("ts"))


@query(
    "s5_folder_import",
    "SELECT event_type AS file, CAST(ts AS VARCHAR) AS \"Zeitstempel\", value AS \"momentane Leistung kW\" FROM (SELECT event_type, date_trunc('second', ts) AS ts, value FROM events)",
)
def _(spark, folder):
    path = scratch_path(spark, "meters")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Zeitstempel")
    rows = p_events(spark, folder).select("series", stamp, F.col("value").alias("momentane Leistung kW"), F.lit("x").alias("Bemerkung"))
    rows.write.partitionBy("series").csv(path, header=True)
    # A lock file as a spreadsheet program leaves it behind.
    p_events(spark, folder).limit(1).select("series").write.csv(f"{path}/~$lock", header=True)
    read = sheet.read_folder(spark, path, ["Zeitstempel", "Leistung kW"])
    name = F.regexp_extract("source_file", "series=([^/]+)/", 1)
    return read.select(name.alias("file"), "Zeitstempel", F.col("momentane Leistung kW").cast("double").alias("momentane Leistung kW"))


HEADERS = {
    "click": ["Zeitstempel", "momentane Leistung kW", "Bemerkung"],
    "view": ["Bemerkung", "momentane Leistung kW", "Zeitstempel"],
    "purchase": ["mittlere Leistung kW", "Zeitstempel"],
    "error": ["Bemerkung"],
    "signup": ["Zeitstempel", "Bemerkung", "mittlere Leistung kW", "momentane Leistung kW"],
}


@query(
    "s5_mixed_headers",
    "SELECT event_type AS file, strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"Zeitstempel\", "
    "CASE WHEN event_type <> 'purchase' THEN value END AS \"momentane Leistung kW\", "
    "CASE WHEN event_type IN ('purchase', 'signup') THEN value * 2 END AS \"mittlere Leistung kW\" "
    "FROM events WHERE event_type <> 'error'",
)
def _(spark, folder):
    """Files with other columns in another order: values by name; a file without wanted columns is left out."""
    path = scratch_path(spark, "mixed")
    columns = {
        "Zeitstempel": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "momentane Leistung kW": F.col("value"),
        "mittlere Leistung kW": F.col("value") * 2, "Bemerkung": F.lit("x, y"),
    }
    for name, header in HEADERS.items():
        own = p_events(spark, folder).filter(F.col("series") == name)
        own.select(*[columns[c].alias(c) for c in header]).write.csv(f"{path}/file={name}", header=True)
    read = sheet.read_folder(spark, path, ["Zeitstempel", "Leistung kW"])
    number = lambda c: F.col(f"`{c}`").cast("double").alias(c)
    return read.select(
        F.regexp_extract("source_file", "file=([^/]+)/", 1).alias("file"), "Zeitstempel",
        number("momentane Leistung kW"), number("mittlere Leistung kW"),
    )


def _kml_path(spark, folder):
    """Places as placemarks: most as points, every tenth as a line."""
    path = scratch_path(spark, "places") + ".kml"
    at = F.concat_ws(",", F.col("longitude").cast("string"), F.col("latitude").cast("string"))
    line = F.col("place_id") % 10 == 0
    marks = place(spark, folder).select(
        "name", F.when(~line, F.struct(at.alias("coordinates"))).alias("Point"),
        F.when(line, F.struct(F.concat(at, F.lit(" 9,50")).alias("coordinates"))).alias("LineString"),
    )
    marks.write.format("xml").option("rootTag", "Document").option("rowTag", "Placemark").save(path)
    return path


@query(
    "s6_placemarks",
    with_sql("place", "SELECT name, CASE WHEN place_id % 10 <> 0 THEN longitude || ',' || latitude END AS coordinates FROM place"),
)
def _(spark, folder):
    return kml.read_placemarks(spark, _kml_path(spark, folder))


@query("s7_placemark_points", with_sql("place", "SELECT name, latitude, longitude FROM place WHERE place_id % 10 <> 0"))
def _(spark, folder):
    return kml.marked_points(kml.read_placemarks(spark, _kml_path(spark, folder)))


@query(
    "s8_observations",
    with_sql(
        "observation",
        "SELECT station_id, parameter, resolution, date, round(value, 6) AS value FROM observation WHERE parameter = 'N' AND resolution = 'daily' "
        "AND date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31 23:59:00'",
    ),
)
def _(spark, folder):
    rows = weather.observations(observation(spark, folder), "N", "daily", "1997-01-01 00:00:00", "1999-12-31 23:59:00")
    return rows.withColumn("value", r("value"))


@query(
    "s8_observations_all_resolutions",
    with_sql(
        "observation",
        "SELECT resolution, count(*) AS n FROM observation WHERE parameter = 'A' AND date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31 23:59:00' GROUP BY 1",
    ),
)
def _(spark, folder):
    rows = weather.observations(observation(spark, folder), "A", None, "1997-01-01 00:00:00", "1999-12-31 23:59:00")
    return rows.groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s9_result_tables",
    with_sql(
        "h_events event_units",
        "SELECT 'Stundenwerte' AS sheet, series, ts, round(value, 6) AS value FROM h_events UNION ALL SELECT 'Jahresdauerlinie', series, ts, round(value, 6) FROM h_events UNION ALL "
        "SELECT 'Monatswerte', h.series, date_trunc('month', ts) + INTERVAL 14 DAY, round(CASE WHEN any_value(coalesce(unit, '') IN ('°C', 'm³')) THEN avg(value) ELSE sum(value) END, 6) "
        "FROM h_events h LEFT JOIN event_units u ON u.series = h.series GROUP BY 1, 2, 3",
    ),
)
def _(spark, folder):
    path = scratch_path(spark, "tables")
    hours = resample.hourly_mean(p_events(spark, folder))
    tables = {
        "Daten": None, "Stundenwerte": hours, "Jahresdauerlinie": curves.duration_curve(hours),
        "Monatswerte": resample.monthly_values(hours, event_units(spark)),
    }
    written = sinks.write_tables(tables, path)
    read = [
        spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("sheet"), "series", "ts", r("value").alias("value"))
        for name in written
    ]
    return read[0].unionByName(read[1]).unionByName(read[2])


def _formats(names: str, monthly: bool) -> str:
    """Number formats of one table ``(series, value)`` in SQL."""
    unit = "coalesce(unit, '')"
    if monthly:
        unit = f"{unit} || CASE WHEN lower(trim(coalesce(unit, ''))) IN ('w', 'kw', 'mw') THEN 'h' ELSE '' END"
    return (
        f"SELECT series, CASE WHEN abs(q95) >= 1000 THEN '#,##0' WHEN abs(q95) >= 100 THEN '#,##0.0' WHEN abs(q95) >= 10 THEN '#,##0.00' ELSE '#,##0.000' END "
        f"|| '\"' || {unit} || '\"' AS number_format FROM (SELECT series, min(value) FILTER (rn = round((n - 1) * 0.95::DOUBLE) + 1) AS q95 FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY series ORDER BY value) AS rn, count(*) OVER (PARTITION BY series) AS n FROM {names} WHERE value IS NOT NULL) GROUP BY 1) "
        "LEFT JOIN event_units USING (series)"
    )


BUNDLE = {
    "mon": "SELECT h.series, date_trunc('month', ts) + INTERVAL 14 DAY AS ts, date_trunc('month', ts)::TIMESTAMP AS orgidx, CASE WHEN any_value(coalesce(unit, '') IN ('°C', 'm³')) "
    "THEN avg(value) ELSE sum(value) END AS value FROM h_events h LEFT JOIN event_units u ON u.series = h.series GROUP BY 1, 2, 3",
    "f1": _formats("p_events", False), "f2": _formats("h_events", False), "f3": _formats("mon", True),
}


@query(
    "s9_result_bundle",
    with_sql(
        "p_events h_events event_units",
        "SELECT 'Daten' AS sheet, series, ts, ts AS orgidx, NULL::BIGINT AS rank, round(value, 6) AS value, NULL AS number_format FROM p_events "
        "UNION ALL SELECT 'Stundenwerte', series, ts, ts, NULL, round(value, 6), NULL FROM h_events "
        "UNION ALL SELECT 'Jahresdauerlinie', series, ts, NULL, row_number() OVER (PARTITION BY series ORDER BY value DESC, ts) - 1, round(value, 6), NULL FROM h_events "
        "UNION ALL SELECT 'Monatswerte', series, ts, orgidx, NULL, round(value, 6), NULL FROM mon "
        "UNION ALL SELECT 'Format Daten', series, NULL, NULL, NULL, NULL, number_format FROM f1 "
        "UNION ALL SELECT 'Format ' || s, series, NULL, NULL, NULL, NULL, number_format FROM f2, (VALUES ('Stundenwerte'), ('Jahresdauerlinie')) v(s) "
        "UNION ALL SELECT 'Format Monatswerte', series, NULL, NULL, NULL, NULL, number_format FROM f3 "
        "UNION ALL SELECT 'Format ' || s, c, NULL, NULL, NULL, NULL, 'DD.MM.YYYY hh:mm' FROM (VALUES ('Daten'), ('Stundenwerte'), ('Jahresdauerlinie'), ('Monatswerte')) v(s), (VALUES ('ts'), ('orgidx')) w(c)",
        **BUNDLE,
    ),
)
def _(spark, folder):
    """All tables of the bundle as they were written, each with its own columns, and the formats."""
    path = scratch_path(spark, "bundle")
    data = p_events(spark, folder).select("series", "ts", "value")
    shown = None
    for name in results.write(data, event_units(spark), path):
        df = spark.read.parquet(f"{path}/{name}")
        sheet_name = F.concat(F.lit("Format "), "sheet") if name == "Format" else F.lit(name)
        kinds = {"ts": "timestamp_ntz", "orgidx": "timestamp_ntz", "rank": "long", "value": "double", "number_format": "string"}
        columns = [(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
        part = df.select(sheet_name.alias("sheet"), "series", *columns)
        shown = part if shown is None else shown.unionByName(part)
    return shown.withColumn("value", r("value"))


@query(
    "s10_simulation_csv",
    with_sql(
        "weather_daily",
        'SELECT h.s AS "# Time [s]", round(coalesce(radiation_global, 0), 6) AS "Gh [W/m²]", round(coalesce(temperature_air_mean_2m, 0), 6) '
        'AS "Tamb [°C]", round(coalesce(humidity, 0), 6) AS "Hrel [%]" FROM (SELECT unnest(range(0, 31536000, 3600)) AS s) h LEFT JOIN '
        "(SELECT *, (epoch_us(ts) - epoch_us(date_trunc('year', (SELECT min(ts) FROM w))::TIMESTAMP)) // 1000000 AS s FROM w) v USING (s)",
        w=WIDE_WEATHER,
    ),
)
def _(spark, folder):
    path = scratch_path(spark, "simulation")
    sinks.write_simulation_csv(weather.simulation_hours(wide_weather(spark, folder)), path)
    read = spark.read.csv(path, header=True)
    first, *rest = read.columns
    return read.select(F.col(f"`{first}`").cast("long").alias(first), *[r(F.col(f"`{c}`").cast("double")).alias(c) for c in rest])


@query(
    "s11_hourly_files",
    with_sql(
        "p_orders",
        "SELECT series AS source_file, ts, round(value, 4) AS value FROM p_orders",
    ),
)
def _(spark, folder):
    path = scratch_path(spark, "hourly")
    hours = resample.hourly_mean(clean.first_of_duplicates(p_orders(spark, folder)))
    sinks.write_by_source(hours.select(F.col("series").alias("source_file"), "ts", "value"), path)
    return spark.read.parquet(path).select("source_file", "ts", r("value", 4).alias("value"))


@query(
    "s11_repaired_folder",
    with_sql(
        "", "SELECT series AS source_file, 'momentane Leistung kW' AS \"column\", ts, round(value, 6) AS value FROM akima",
        p_ampm="SELECT event_type AS series, event_id AS seq, date_trunc('second', ts) + (CASE WHEN hour(ts) = 0 THEN 12 WHEN hour(ts) > 12 THEN -12 ELSE 0 END) * INTERVAL 1 HOUR AS ts, "
        "CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events",
        **(C5_STEPS | akima_sql("calm")),
    ),
)
def _(spark, folder):
    """Meter files on a 12-hour clock with seconds and unreadable numbers: repaired hours, a folder per meter."""
    path, out = scratch_path(spark, "meters"), scratch_path(spark, "repaired")
    number = F.when(F.col("seq") % 11 != 0, F.col("value").cast("string")).otherwise("n. v.")
    rows = p_ampm(spark, folder).select(
        "series", "seq", F.date_format("ts", "dd.MM.yyyy HH:mm:ss").alias("Zeitstempel"), F.lit("x").alias("Bemerkung"), number.alias("momentane Leistung kW")
    )
    rows.repartitionByRange("seq").sortWithinPartitions("series", "seq").drop("seq").write.partitionBy("series").csv(path, header=True)
    meter = F.regexp_extract("source_file", "series=([^/]+)/", 1)
    meter_folder.fix_and_export(spark, path, out, ["Leistung kW"], meter)
    return spark.read.parquet(out).select("source_file", "column", "ts", r("value").alias("value"))
