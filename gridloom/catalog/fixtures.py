"""Profiles, stations, observations and titles derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import fixed_table

EVENTS = ["click", "view", "purchase", "error", "signup"]
EVENT_UNITS = [("click", "kWh"), ("view", "kW"), ("purchase", "°C"), ("error", "m³"), ("signup", None)]
ORDER_UNITS = [
    ("1-URGENT", "kW"), ("2-HIGH", "°C"), ("3-MEDIUM", "kWh"), ("4-NOT SPECIFIED", "m³"), ("5-LOW", None),
]
FLAG_UNITS = [("A", "J/cm**2", "radiation_global"), ("N", "°C", "temperature_air_mean_2m"), ("R", "pct", "humidity")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(value: Column | str, places: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, places)


def p_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("series"), F.col("event_id").alias("seq"), "ts", "value"
    )


def p_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Events with every third value missing."""
    return p_events(spark, folder).withColumn("value", F.when(F.col("seq") % 3 != 1, F.col("value")))


def p_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts")
    ).agg(F.min("o_orderkey").alias("seq"), F.round(F.sum("o_totalprice"), 2).alias("value"))


def p_dst(spark: SparkSession, folder: str) -> DataFrame:
    quarter = F.make_dt_interval(mins=(F.col("o_orderkey") % 96 * 15).cast("int"))
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderkey").alias("seq"),
        (F.col("o_orderdate") + quarter).cast("timestamp_ntz").alias("ts"),
        F.col("o_totalprice").alias("value"),
    )


def p_ampm(spark: SparkSession, folder: str) -> DataFrame:
    """Events on a 12-hour clock: 0 becomes 12, 13 becomes 1 and so on."""
    hour = F.hour("ts")
    shift = F.when(hour == 0, 12).when(hour > 12, -12).otherwise(0)
    moved = (F.col("ts") + F.make_dt_interval(hours=shift)).cast("timestamp_ntz")
    return p_events(spark, folder).withColumn("ts", moved)


def event_units(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, EVENT_UNITS, "series, unit")


def order_units(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, ORDER_UNITS, "series, unit")


def station(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("station_id"), F.col("s_name").alias("name"),
        (47.0 + (F.col("s_suppkey") * 37 % 80) / 10.0).alias("latitude"),
        (6.0 + (F.col("s_suppkey") * 53 % 90) / 10.0).alias("longitude"),
    )


def place(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"),
        (47.0 + (F.col("c_custkey") * 41 % 80) / 10.0).alias("latitude"),
        (6.0 + (F.col("c_custkey") * 59 % 90) / 10.0).alias("longitude"),
        F.col("c_acctbal").alias("attr_size"), F.col("c_nationkey").cast("double").alias("attr_colour"),
    )


def observation(spark: SparkSession, folder: str) -> DataFrame:
    """Daily values by supplier as station; the values of every third station are missing."""
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("station_id"), F.col("l_returnflag").alias("parameter"),
        F.when(F.col("l_linestatus") == "O", "daily").otherwise("hourly").alias("resolution"),
        F.col("l_shipdate").alias("date"),
    ).agg(F.avg(F.when(F.col("l_suppkey") % 3 != 0, F.col("l_quantity"))).alias("value"))


def weather_daily(spark: SparkSession, folder: str) -> DataFrame:
    """One value per parameter and day over all stations, scaled so that no value is a rounding tie."""
    names = F.create_map(*[F.lit(x) for flag, _, name in FLAG_UNITS for x in (flag, name)])
    return table(spark, folder, "lineitem").groupBy(
        names[F.col("l_returnflag")].alias("series"), F.col("l_shipdate").alias("ts")
    ).agg((F.avg("l_quantity") * 0.7182818284).alias("value"))


def weather_units(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, [(n, u) for _, u, n in FLAG_UNITS], "series, unit")


def obis_titles(spark: SparkSession, folder: str) -> DataFrame:
    kind = (1 + F.col("p_partkey") % 38).cast("string")
    title = F.concat(F.lit("Meter "), "p_name", F.lit(" 1-1:"), F.col("p_size").cast("string"), F.lit("."), kind, F.lit(".0"))
    return table(spark, folder, "part").select("p_partkey", title.alias("title"))


def _values(rows, columns: str) -> str:
    def literal(x):
        return "NULL" if x is None else ("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x))

    body = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


SQL = {
    "p_events": "SELECT event_type AS series, event_id AS seq, ts, value FROM events",
    "p_gaps": "SELECT event_type AS series, event_id AS seq, ts, "
    "CASE WHEN event_id % 3 <> 1 THEN value END AS value FROM events",
    "h_events": "SELECT event_type AS series, date_trunc('hour', ts) AS ts, avg(value) AS value "
    "FROM events GROUP BY 1, 2",
    "p_orders": "SELECT o_orderpriority AS series, min(o_orderkey) AS seq, o_orderdate AS ts, "
    "round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 3",
    "p_dst": "SELECT o_orderpriority AS series, o_orderkey AS seq, "
    "o_orderdate + (o_orderkey % 96) * INTERVAL 15 MINUTE AS ts, o_totalprice AS value FROM orders",
    "p_ampm": "SELECT event_type AS series, event_id AS seq, ts + (CASE WHEN hour(ts) = 0 THEN 12 "
    "WHEN hour(ts) > 12 THEN -12 ELSE 0 END) * INTERVAL 1 HOUR AS ts, value FROM events",
    "event_units": _values(EVENT_UNITS, "series, unit"),
    "order_units": _values(ORDER_UNITS, "series, unit"),
    "weather_units": _values([(n, u) for _, u, n in FLAG_UNITS], "series, unit"),
    "station": "SELECT s_suppkey AS station_id, s_name AS name, 47.0::DOUBLE + (s_suppkey * 37 % 80) / 10.0::DOUBLE "
    "AS latitude, 6.0::DOUBLE + (s_suppkey * 53 % 90) / 10.0::DOUBLE AS longitude FROM supplier",
    "place": "SELECT c_custkey AS place_id, c_name AS name, 47.0::DOUBLE + (c_custkey * 41 % 80) / 10.0::DOUBLE "
    "AS latitude, 6.0::DOUBLE + (c_custkey * 59 % 90) / 10.0::DOUBLE AS longitude, c_acctbal AS attr_size, "
    "c_nationkey::DOUBLE AS attr_colour FROM customer",
    "observation": "SELECT l_suppkey AS station_id, l_returnflag AS parameter, "
    "CASE WHEN l_linestatus = 'O' THEN 'daily' ELSE 'hourly' END AS resolution, l_shipdate AS date, "
    "avg(CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity END) AS value FROM lineitem GROUP BY 1, 2, 3, 4",
    "weather_daily": "SELECT CASE l_returnflag WHEN 'A' THEN 'radiation_global' WHEN 'N' THEN "
    "'temperature_air_mean_2m' ELSE 'humidity' END AS series, l_shipdate AS ts, avg(l_quantity) * 0.7182818284::DOUBLE AS value "
    "FROM lineitem GROUP BY 1, 2",
    "obis_titles": "SELECT p_partkey, 'Meter ' || p_name || ' 1-1:' || p_size || '.' || (1 + p_partkey % 38) "
    "|| '.0' AS title FROM part",
}


def with_sql(fixtures: str, body: str, **more: str) -> str:
    """The body after the named fixtures and further named steps, in order."""
    steps = {n: SQL[n] for n in fixtures.split()} | more
    listed = ",\n".join(f"{n} AS ({text})" for n, text in steps.items())
    return f"WITH {listed}\n{body}" if steps else body


def akima_sql(source: str, axis: str = "epoch_us(ts)", scale: str = "1e6", key: str = "ts") -> dict[str, str]:
    """Steps that fill null values of ``source(series, ts, value)`` by Akima; last step ``akima``."""
    return {
        "kn": f"SELECT *, {axis} AS x FROM {source} WHERE value IS NOT NULL",
        "sl": "SELECT *, lead(x) OVER w AS x1, (lead(value) OVER w - value) / ((lead(x) OVER w - x) / "
        f"{scale}) AS s FROM kn WINDOW w AS (PARTITION BY series ORDER BY x)",
        "nb": "SELECT *, lag(s) OVER w AS l1, lag(s, 2) OVER w AS l2, lead(s) OVER w AS r1 FROM sl "
        "WINDOW w AS (PARTITION BY series ORDER BY x)",
        "ms": "SELECT *, coalesce(l2, CASE WHEN l1 IS NULL THEN 3*s - 2*r1 ELSE 2*l1 - s END) AS a, "
        "coalesce(l1, 2*s - r1) AS b, coalesce(s, 2*l1 - l2) AS c, "
        "coalesce(r1, CASE WHEN s IS NULL THEN 3*l1 - 2*l2 ELSE 2*s - l1 END) AS d FROM nb",
        "ff": "SELECT *, abs(d - c) AS f1, abs(b - a) AS f2, max(abs(d - c) + abs(b - a)) OVER "
        "(PARTITION BY series) AS top FROM ms",
        "tt": "SELECT series, x AS x0, x1, value AS y0, s, CASE WHEN f1 + f2 > 1e-9 * top "
        "THEN (f1 * b + f2 * c) / (f1 + f2) ELSE (d + a) / 2 END AS t0 FROM ff",
        "sg": "SELECT *, lead(t0) OVER (PARTITION BY series ORDER BY x0) AS t1 FROM tt",
        "akima": f"SELECT q.series, q.{key}, coalesce(q.value, g.y0 + g.t0 * (({axis.replace(key, 'q.' + key)} - g.x0) / {scale}) "
        f"+ ((3*g.s - 2*g.t0 - g.t1) / ((g.x1 - g.x0) / {scale})) * power(({axis.replace(key, 'q.' + key)} - g.x0) / {scale}, 2) "
        f"+ ((g.t0 + g.t1 - 2*g.s) / power((g.x1 - g.x0) / {scale}, 2)) * power(({axis.replace(key, 'q.' + key)} - g.x0) / {scale}, 3)) "
        f"AS value FROM {source} q ASOF LEFT JOIN sg g ON q.series = g.series AND {axis.replace(key, 'q.' + key)} >= g.x0",
    }


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
