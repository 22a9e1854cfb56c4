"""Metadata and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.fixtures import (
    event_units, order_units, p_events, p_orders, r, station, table, weather_daily, weather_units, with_sql,
)
from gridloom.catalog.joins import NEAR, requests
from gridloom.catalog.resampling import RANKED, RES, _in, _quantile
from gridloom.catalog.sets import CLOSEST, THIN_OBSERVED, thin_observed
from gridloom.catalog.sheets import SHEET_SQL, TITLES, sheet_cells
from gridloom.functions import texts, units
from gridloom.operators import curves, meta, resample, stats, weather
from gridloom.sources import sheet

UNIT_CELLS = " UNION ALL ".join(f"SELECT '{t}' AS series, c{i} AS u FROM sheet WHERE kind = 'unit'" for i, t in enumerate(TITLES, 1))


@query(
    "m1_units_of_sheet",
    f"WITH {SHEET_SQL} SELECT series, series || ' - orgidx' AS name_orgidx, series AS orig_tit, series AS tit, "
    f"' ' || trim(u) AS unit, trim(' ' || trim(u), 'h') AS unit_h FROM ({UNIT_CELLS})",
)
def _(spark, folder):
    return meta.series_meta(sheet.unit_rows(sheet.titled(sheet_cells(spark, folder))))


PART_META = "SELECT title AS series, title AS tit, title AS orig_tit, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE ' MWh' END AS unit FROM obis_titles"


def _part_meta(spark, folder):
    from gridloom.catalog.fixtures import obis_titles

    rest = F.col("p_partkey") % 3
    unit = F.when(rest == 1, F.lit("")).when(rest == 2, F.lit(" MWh"))
    t = F.col("title")
    return obis_titles(spark, folder).select(t.alias("series"), t.alias("tit"), t.alias("orig_tit"), unit.alias("unit"))


def _obis_steps():
    from gridloom.catalog.joins import OBIS_STEPS

    return {k: v for k, v in OBIS_STEPS.items() if k != "c"}


@query(
    "m2_obis_names",
    with_sql(
        "obis_titles",
        "SELECT old_series, nm AS series, nm || ' - orgidx' AS name_orgidx, orig_tit, nm AS tit, u AS unit, trim(u, 'h') AS unit_h, code AS obis FROM "
        "(SELECT series AS old_series, orig_tit, short_name || ' (' || code || ')' AS nm, code, CASE WHEN coalesce(m.unit, '') = '' THEN ' ' || q.unit "
        "ELSE m.unit END AS u FROM m JOIN q ON q.quantity_code = split_part(split_part(code, ':', 2), '.', 1))",
        **_obis_steps(),
        m=f"SELECT *, regexp_extract(series, '1-\\d*:\\d*\\.\\d*') AS code FROM ({PART_META})",
    ),
)
def _(spark, folder):
    return meta.obis_names(_part_meta(spark, folder))


QUARTERS = "SELECT event_type AS series, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, max(value) AS value FROM events GROUP BY 1, 2"
EVEN = "SELECT s.series, g.ts, q.value FROM (SELECT DISTINCT series FROM q0) s CROSS JOIN (SELECT DISTINCT ts FROM q0) g LEFT JOIN q0 q ON q.series = s.series AND q.ts = g.ts"
PAIRS = {
    "st": "SELECT series, floor(avg(d)) AS m FROM (SELECT series, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series ORDER BY ts)) "
    "/ 60000000) AS d FROM even) GROUP BY 1",
    "kd": "SELECT u.series, u.unit, CASE WHEN m <> 15 THEN NULL WHEN trim(unit) IN ('GWh', 'MWh', 'kWh', 'Wh') THEN 'Arbeit' WHEN trim(unit) IN "
    "('GW', 'MW', 'kW', 'W') THEN 'Leistung' END AS kind FROM event_units u JOIN st USING (series)",
    "pairs": "SELECT e.series || CASE kind WHEN 'Arbeit' THEN ' → Arbeit' WHEN 'Leistung' THEN ' → Leistung' ELSE '' END AS series, ts, value, unit "
    "FROM even e JOIN kd USING (series) UNION ALL SELECT e.series || CASE kind WHEN 'Arbeit' THEN ' → Leistung' ELSE ' → Arbeit' END, ts, "
    "CASE kind WHEN 'Arbeit' THEN value * 4 ELSE value / 4 END, CASE kind WHEN 'Arbeit' THEN left(unit, length(unit) - 1) ELSE unit || 'h' END "
    "FROM even e JOIN kd USING (series) WHERE kind IS NOT NULL",
}


def even_quarters(spark, folder):
    """Quarter-hour maxima with a row per series and quarter in which any series has a value."""
    from gridloom.catalog.sheets import quarter_hours

    return quarter_hours(spark, folder).unpivot("ts", ["click", "view", "purchase", "error", "signup"], "series", "value")


@query(
    "m3_energy_and_power",
    with_sql("event_units", "SELECT series, ts, value, unit FROM pairs", q0=QUARTERS, even=EVEN, **PAIRS),
)
def _(spark, folder):
    return meta.energy_and_power(even_quarters(spark, folder), event_units(spark))


@query(
    "m4_counterpart_units",
    "SELECT DISTINCT l_shipmode || l AS series, unit FROM (SELECT l_returnflag AS l_shipmode, CASE l_linestatus WHEN 'O' THEN ' → Leistung' ELSE ' → Arbeit' END AS l, "
    "CASE l_linestatus WHEN 'O' THEN 'MW' ELSE ' kWh' END AS unit FROM lineitem)",
)
def _(spark, folder):
    unit = F.when(F.col("l_linestatus") == "O", F.lit("MWh")).otherwise(F.lit(" kW"))
    names = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("series"), unit.alias("unit")).distinct()
    return meta.counterpart_meta(names)


@query(
    "m5_copied_metadata",
    with_sql(
        "order_units",
        "SELECT o.series || ' ' || year AS series, o.series || ' ' || year || ' - orgidx' AS name_orgidx, o.series || ' ' || year AS orig_tit, "
        "o.series || ' ' || year AS tit, ' ' || u.unit AS unit, trim(' ' || u.unit, 'h') AS unit_h FROM "
        "(SELECT DISTINCT o_orderpriority AS series, year(o_orderdate) AS year FROM orders) o JOIN order_units u USING (series)",
    ),
)
def _(spark, folder):
    lines = curves.split_years(p_orders(spark, folder)).select("series", F.col("name").alias("new_series")).distinct()
    return meta.copied(meta.series_meta(order_units(spark)), lines)


@query(
    "m5_weather_line",
    with_sql(
        "order_units weather_units",
        "SELECT series, series || ' - orgidx' AS name_orgidx, series AS orig_tit, series AS tit, ' ' || unit AS unit, trim(' ' || unit, 'h') AS unit_h FROM order_units "
        "WHERE series IN (SELECT o_orderpriority FROM orders) UNION ALL "
        "SELECT DISTINCT n.de, n.de || ' - orgidx', n.de, n.de, ' ' || unit, trim(' ' || unit, 'h') FROM weather_units JOIN n ON n.en = series "
        "WHERE series IN (SELECT CASE l_returnflag WHEN 'A' THEN 'radiation_global' WHEN 'N' THEN 'temperature_air_mean_2m' ELSE 'humidity' END FROM lineitem)",
        n="SELECT * FROM (VALUES " + ", ".join(f"('{en}', '{de}')" for en, de in weather.PARAMETER_NAMES) + ") AS v(en, de)",
    ),
)
def _(spark, folder):
    """Metadata of a profile with the lines of the weather series that were added to it."""
    own = p_orders(spark, folder).select("series").distinct().join(order_units(spark), "series")
    added = weather_daily(spark, folder).select(F.col("series").alias("parameter")).distinct()
    known = added.join(weather_units(spark).withColumnRenamed("series", "parameter"), "parameter")
    return meta.with_weather_lines(meta.series_meta(own), weather.german_names(known))


def _format(small: str) -> str:
    q = "'\"' || coalesce(unit, '') || '\"'"
    below = f"'{small}' || {q}" if small.endswith("000") else f"'{small}' || coalesce(unit, '')"
    return (
        f"CASE WHEN abs(q95) >= 1000 THEN '#,##0' || {q} WHEN abs(q95) >= 100 THEN '#,##0.0' || {q} WHEN abs(q95) >= 10 THEN '#,##0.00' || {q} "
        f"ELSE {below} END AS number_format"
    )


@query(
    "m6_import_format",
    with_sql(
        "p_events event_units", f"SELECT q.series, q95, unit, {_format('#,##0.0')} FROM q LEFT JOIN event_units USING (series)",
        k=RANKED.format("p_events"), q=f"SELECT series, {_quantile(0.95)} AS q95 FROM k GROUP BY 1",
    ),
)
def _(spark, folder):
    return stats.import_format(stats.quantile_95(p_events(spark, folder)), event_units(spark))


@query(
    "m7_unit_map",
    with_sql("order_units", "SELECT DISTINCT series, unit FROM order_units JOIN orders ON o_orderpriority = series"),
)
def _(spark, folder):
    named = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("series")).distinct()
    return meta.unit_of_series(named.join(order_units(spark), "series"))


LAST_SUFFIX = "CASE WHEN contains(series, ' → Arbeit') THEN replace(series, ' → Arbeit', '') || ' ' || year(ts) || ' → Arbeit' ELSE series || ' ' || year(ts) END"
YEARS = "SELECT CASE WHEN series = '1-URGENT' THEN series || ' → Arbeit' ELSE series END AS series, ts, value FROM p_orders"


def _named_orders(spark, folder):
    name = F.when(F.col("series") == "1-URGENT", F.concat("series", F.lit(texts.ENERGY_SUFFIX))).otherwise(F.col("series"))
    return p_orders(spark, folder).select(name.alias("series"), "ts", "value")


MOVED = "make_timestamp(2020, month(ts), day(ts), hour(ts), minute(ts), second(ts)::DOUBLE)"


@query(
    "m8_split_years",
    with_sql("p_orders", f"SELECT series, year(ts)::INTEGER AS year, {LAST_SUFFIX} AS name, {MOVED} AS ts, value, ts AS orgidx FROM y", y=YEARS),
)
def _(spark, folder):
    return curves.split_years(_named_orders(spark, folder))


@query(
    "m8_split_years_monthly",
    with_sql(
        "p_orders order_units",
        f"SELECT series, year(ts)::INTEGER AS year, {LAST_SUFFIX} AS name, {MOVED} AS ts, value, ts AS orgidx FROM m",
        m="SELECT p.series, date_trunc('month', ts) + INTERVAL 14 DAY AS ts, round(CASE WHEN any_value(" + _in("mean_always")
        + ") THEN avg(value) ELSE sum(value) END, 6) AS value FROM p_orders p LEFT JOIN order_units u ON p.series = u.series GROUP BY 1, 2",
    ),
)
def _(spark, folder):
    months = resample.monthly_values(p_orders(spark, folder), order_units(spark)).withColumn("value", r("value"))
    return curves.split_years(months)


@query("m9_lines_by_year", with_sql("p_orders", f"SELECT DISTINCT year(ts)::INTEGER AS year, {LAST_SUFFIX} AS name FROM y", y=YEARS))
def _(spark, folder):
    return curves.lines_by_year(curves.split_years(_named_orders(spark, folder)))


@query(
    "m10_averaged_units",
    with_sql(
        "event_units",
        f"SELECT event_id, {_in('mean_all')} AS mean_all, {_in('mean_always')} AS mean_always, {_in('sum_month')} AS sum_month FROM "
        "(SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(' ' || unit || ' ') ELSE unit END AS unit FROM events JOIN event_units ON series = event_type)",
    ),
)
def _(spark, folder):
    rows = meta.with_unit(p_events(spark, folder), event_units(spark))
    odd = F.when(F.col("seq") % 2 == 0, F.upper(F.concat(F.lit(" "), "unit", F.lit(" ")))).otherwise(F.col("unit"))
    return rows.select(F.col("seq").alias("event_id"), *[units.in_group(odd, k).alias(k) for k in ("mean_all", "mean_always", "sum_month")])


@query(
    "m11_shown_units",
    with_sql(
        "event_units",
        "SELECT DISTINCT event_type AS series, frame, CASE frame WHEN 'raw' THEN u WHEN 'hourly' THEN h ELSE CASE WHEN lower(trim(h)) IN ('w', 'kw', 'mw') "
        "THEN h || 'h' ELSE h END END AS unit FROM events JOIN (SELECT series, ' ' || unit AS u, trim(' ' || unit, 'h') AS h FROM event_units) ON series = event_type "
        "CROSS JOIN (SELECT unnest(['raw', 'hourly', 'monthly']) AS frame)",
    ),
)
def _(spark, folder):
    seen = p_events(spark, folder).select("series").distinct()
    return meta.shown_units(meta.series_meta(seen.join(event_units(spark), "series")))


@query(
    "m12_weather_report",
    with_sql(
        "place station observation",
        "SELECT p.place_id, p.parameter, cl.resolution, near.station_id, near.distance, CASE WHEN near.station_id IS NULL THEN 'none' WHEN cl.resolution <> 'hourly' "
        "THEN 'other resolution' ELSE 'ok' END AS status FROM (SELECT place_id, unnest(['A', 'N', 'R', 'X']) AS parameter FROM place) p "
        "LEFT JOIN cl ON cl.parameter = p.parameter LEFT JOIN near ON near.place_id = p.place_id AND near.parameter = p.parameter",
        thin=THIN_OBSERVED, res=RES, cl=CLOSEST,
        live="SELECT DISTINCT station.*, thin.parameter FROM station JOIN thin USING (station_id) JOIN cl ON cl.parameter = thin.parameter AND cl.resolution = thin.resolution WHERE value IS NOT NULL",
        near=NEAR.format(more=", s.parameter", s="live", limit=60, by=", s.parameter"),
    ),
)
def _(spark, folder):
    seen = thin_observed(spark, folder)
    used = weather.closest_resolution(seen, "hourly")
    asked = requests(spark, folder)
    chosen = seen.join(used, ["parameter", "resolution"], "left_semi")
    near = weather.nearest_by_parameter(asked, station(spark, folder), chosen, 60.0)
    return weather.report(asked, used, near, "hourly").withColumn("distance", r("distance"))


