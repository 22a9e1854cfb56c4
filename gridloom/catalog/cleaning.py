"""Cleaning of the time axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.fixtures import SQL, akima_sql, p_ampm, p_dst, p_events, r, with_sql
from gridloom.operators import clean

SPRING = "month(ts) = 3 AND day(ts) > 24 AND isodow(ts) = {day} AND hour(ts) = 2"


@query("c1_spring_hour", with_sql("p_dst", f"SELECT * FROM p_dst WHERE NOT ({SPRING.format(day=7)})"))
def _(spark, folder):
    return clean.drop_spring_hour(p_dst(spark, folder))


@query("c1_spring_hour_saturday", with_sql("p_dst", f"SELECT * FROM p_dst WHERE NOT ({SPRING.format(day=6)})"))
def _(spark, folder):
    return clean.drop_spring_hour(p_dst(spark, folder), switch_weekday=6)


@query(
    "c2_first_of_duplicates",
    with_sql(
        "p_dst",
        f"SELECT series, seq, ts, value FROM p_dst WHERE NOT ({SPRING.format(day=7)}) "
        "QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY seq) = 1",
    ),
)
def _(spark, folder):
    return clean.clean_switches(p_dst(spark, folder))


@query(
    "c3_switch_rejects",
    with_sql(
        "p_dst",
        "SELECT series, seq, ts, value FROM (SELECT *, count(*) OVER (PARTITION BY series, ts) AS n, "
        "row_number() OVER (PARTITION BY series, ts ORDER BY seq DESC) AS rn FROM p_dst) "
        f"WHERE rn = 1 AND (n > 1 OR ({SPRING.format(day=7)}))",
    ),
)
def _(spark, folder):
    return clean.switch_rejects(p_dst(spark, folder))


HALF_STEPS = {
    "c": "SELECT *, CASE WHEN hour(ts) = 12 THEN ts - INTERVAL 12 HOUR ELSE ts END AS t FROM p_ampm",
    "l": "SELECT *, lag(t) OVER (PARTITION BY series ORDER BY seq) AS p FROM c",
    "o": "SELECT *, CASE WHEN p IS NULL OR t::DATE <> p::DATE THEN 0 WHEN hour(t) < hour(p) THEN 12 END AS off FROM l",
    "fixed": "SELECT series, seq, t + (last_value(off IGNORE NULLS) OVER (PARTITION BY series ORDER BY seq "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * INTERVAL 1 HOUR AS ts, value FROM o",
}


@query("c4_half_day_clock", with_sql("p_ampm", "SELECT series, seq, ts, value FROM fixed", **HALF_STEPS))
def _(spark, folder):
    return clean.fix_half_days(p_ampm(spark, folder))


C5_STEPS = HALF_STEPS | {
    "one": "SELECT series, ts, value FROM fixed QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY seq) = 1",
    "hour": "SELECT series, date_trunc('hour', ts) AS ts, avg(value) AS value FROM one GROUP BY 1, 2",
    "span": "SELECT series, min(ts) AS a, max(ts) AS b FROM hour GROUP BY 1",
    "every": "SELECT series, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span",
    "even": "SELECT e.series, e.ts, h.value FROM every e LEFT JOIN hour h ON h.series = e.series AND h.ts = e.ts",
    "calm": "SELECT series, ts, CASE WHEN value = lag(value) OVER (PARTITION BY series ORDER BY ts) THEN NULL "
    "ELSE value END AS value FROM even",
}


@query(
    "c5_half_day_meter",
    with_sql("p_ampm", "SELECT series, ts, round(value, 6) AS value FROM akima", **(C5_STEPS | akima_sql("calm"))),
)
def _(spark, folder):
    repaired = clean.repair_half_day_meter(p_ampm(spark, folder))
    return repaired.select("series", "ts", r("value").alias("value"))


GAPS = "hour(ts) NOT IN (3, 4) AND day(ts) % 7 <> 3"


@query(
    "c5_empty_hours",
    with_sql(
        "", "SELECT series, ts, round(value, 6) AS value FROM akima",
        **({"p_ampm": f"SELECT * FROM ({SQL['p_ampm']}) WHERE {GAPS}"} | C5_STEPS | akima_sql("calm")),
    ),
)
def _(spark, folder):
    """Hours and whole days are missing: they are there afterwards, interpolated."""
    gappy = p_ampm(spark, folder).filter(GAPS)
    return clean.repair_half_day_meter(gappy).select("series", "ts", r("value").alias("value"))


FROZEN_SQL = "SELECT event_type AS series, ts, floor(value / 8) AS value FROM events"


def _frozen(spark, folder):
    return p_events(spark, folder).select("series", "ts", F.floor(F.col("value") / 8).cast("double").alias("value"))


@query(
    "c6_frozen_values",
    with_sql(
        "", "SELECT series, ts, round(value, 6) AS value FROM akima",
        f=FROZEN_SQL,
        calm="SELECT series, ts, CASE WHEN value = lag(value) OVER (PARTITION BY series ORDER BY ts) THEN NULL "
        "ELSE value END AS value FROM f",
        **akima_sql("calm"),
    ),
)
def _(spark, folder):
    filled = clean.fill_where_constant(_frozen(spark, folder))
    return filled.select("series", "ts", r("value").alias("value"))


@query(
    "p11_outliers",
    with_sql(
        "p_events", "SELECT series, ts, round(value, 6) AS value FROM akima",
        cut="SELECT series, ts, CASE WHEN value > 30 THEN NULL ELSE value END AS value FROM p_events",
        **akima_sql("cut"),
    ),
)
def _(spark, folder):
    kept = clean.remove_outliers(p_events(spark, folder).drop("seq"), above=30.0)
    return kept.select("series", "ts", r("value").alias("value"))


@query(
    "p11_outliers_default_limit",
    with_sql("p_events", "SELECT series, ts, round(value, 6) AS value FROM p_events"),
)
def _(spark, folder):
    kept = clean.remove_outliers(p_events(spark, folder).drop("seq"))
    return kept.select("series", "ts", r("value").alias("value"))
