"""Window functions, fills, interpolation, smoothing, duration curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.fixtures import akima_sql, p_events, p_gaps, p_orders, r, with_sql
from gridloom.operators import clean, curves, fill, resample, smooth, stats

BY_TIME = "PARTITION BY series ORDER BY ts"


@query(
    "f1_differences",
    with_sql(
        "p_events",
        "SELECT series, ts, round(value - lag(value) OVER w, 6) AS value_diff, (hour(ts) - hour(lag(ts) OVER w))::INTEGER AS hour_diff, "
        "(day(ts) - day(lag(ts) OVER w))::INTEGER AS day_diff, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000 AS seconds "
        f"FROM p_events WINDOW w AS ({BY_TIME})",
    ),
)
def _(spark, folder):
    return stats.differences(p_events(spark, folder)).withColumn("value_diff", r("value_diff"))


UP_TO = f"({BY_TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FROM_HERE = f"({BY_TIME} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "f2_forward_fill",
    with_sql("p_gaps", f"SELECT series, seq, ts, last_value(value IGNORE NULLS) OVER {UP_TO} AS value FROM p_gaps"),
)
def _(spark, folder):
    return fill.forward_fill(p_gaps(spark, folder))


@query(
    "f3_backward_fill",
    with_sql("p_gaps", f"SELECT series, seq, ts, first_value(value IGNORE NULLS) OVER {FROM_HERE} AS value FROM p_gaps"),
)
def _(spark, folder):
    return fill.backward_fill(p_gaps(spark, folder))


LINEAR = {
    "n": f"SELECT *, row_number() OVER ({BY_TIME}) AS k FROM {{0}}",
    "e": "SELECT *, last_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER {u} AS ka, "
    "last_value(value IGNORE NULLS) OVER {u} AS va, first_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER {f} AS kb, "
    "first_value(value IGNORE NULLS) OVER {f} AS vb FROM n",
}


def linear_sql(source: str, by: str = "series") -> dict[str, str]:
    up, down = (x.replace("series", by) for x in (UP_TO, FROM_HERE))
    return {"n": LINEAR["n"].format(source).replace("BY series", f"BY {by}"), "e": LINEAR["e"].format(u=up, f=down)}


LINE = "coalesce(value, va + (vb - va) * (k - ka) / nullif(kb - ka, 0))"


@query(
    "f4_linear_by_row",
    with_sql("p_gaps", f"SELECT series, seq, ts, round({LINE}, 6) AS value FROM e", **linear_sql("p_gaps")),
)
def _(spark, folder):
    return fill.interpolate_linear(p_gaps(spark, folder)).withColumn("value", r("value"))


@query(
    "f5_row_index",
    with_sql("p_events", f'SELECT *, row_number() OVER ({BY_TIME}) - 1 AS "index" FROM p_events'),
)
def _(spark, folder):
    return stats.numbered(p_events(spark, folder))


@query(
    "f6_akima",
    with_sql("p_gaps", "SELECT series, ts, round(value, 6) AS value FROM akima", **akima_sql("p_gaps")),
)
def _(spark, folder):
    return fill.akima(p_gaps(spark, folder), joint=True).select("series", "ts", r("value").alias("value"))


def smooth_sql(source: str, window: int, degree: int) -> dict[str, str]:
    half = window // 2
    weights = ", ".join(f"({j}, {c!r}::DOUBLE)" for j, c in zip(range(-half, half + 1), smooth.coefficients(window, degree)))
    return {
        "n": f"SELECT *, row_number() OVER ({BY_TIME}) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM {source}",
        "c": f"SELECT * FROM (VALUES {weights}) AS v(j, c)",
        "s": "SELECT series, ts, value, c, CASE WHEN k + j < 0 THEN -(k + j) WHEN k + j > n - 1 THEN 2 * (n - 1) - (k + j) "
        "ELSE k + j END AS i FROM n CROSS JOIN c",
        "sm": "SELECT s.series, s.ts, any_value(s.value) AS value, sum(s.c * m.value) AS smoothed FROM s JOIN n m "
        "ON m.series = s.series AND m.k = s.i GROUP BY 1, 2",
    }


@query(
    "f7_savitzky_golay",
    with_sql(
        "p_events", "SELECT series, ts, value, round(smoothed, 6) AS smoothed FROM sm", **smooth_sql("p_events", 31, 3)
    ),
)
def _(spark, folder):
    rows = smooth.smoothed(p_events(spark, folder).drop("seq"), 31, 3)
    return rows.withColumn("smoothed", r("smoothed"))


@query(
    "f8_default_window",
    with_sql(
        "p_events",
        "SELECT m AS max_window, m // 5 + CASE WHEN (m // 5) % 2 = 0 THEN 1 ELSE 0 END AS start_window FROM (SELECT max(n) // 3 + "
        "CASE WHEN (max(n) // 3) % 2 = 0 THEN 1 ELSE 0 END AS m FROM (SELECT series, count(*) AS n FROM p_events GROUP BY 1))",
    ),
)
def _(spark, folder):
    return smooth.default_windows(p_events(spark, folder).groupBy("series").agg(F.count(F.lit(1)).alias("n")))


@query(
    "f9_smoothed_lines",
    with_sql(
        "p_orders", "SELECT series || ' geglättet' AS series, ts, round(smoothed, 4) AS value FROM sm",
        **smooth_sql("p_orders", 11, 2),
    ),
)
def _(spark, folder):
    lines = smooth.smoothed_lines(p_orders(spark, folder).drop("seq"), 11, 2)
    return lines.withColumn("value", r("value", 4))


FALLING = "row_number() OVER (PARTITION BY {0} ORDER BY value DESC, ts) - 1"


@query(
    "f10_duration_curve",
    with_sql(
        "h_events",
        f"SELECT series, {FALLING.format('series')} AS rank, ts, round(value, 6) AS value FROM h_events",
    ),
)
def _(spark, folder):
    hours = resample.hourly_mean(p_events(spark, folder))
    return curves.duration_curve(hours).withColumn("value", r("value"))


@query(
    "f10_duration_curve_of_frozen_values",
    "WITH f AS (SELECT event_type AS series, ts, event_id, floor(value / 16) AS value FROM events) "
    f"SELECT series, {FALLING.format('series')} AS rank, ts, value FROM f",
)
def _(spark, folder):
    frozen = p_events(spark, folder).withColumn("value", F.floor(F.col("value") / 16).cast("double"))
    return curves.duration_curve(frozen)


@query(
    "f11_duration_curve_by_year",
    with_sql(
        "p_orders",
        "SELECT g.series, g.year::INTEGER AS year, g.rank, c.ts, c.value FROM g LEFT JOIN c USING (series, year, rank)",
        c=f"SELECT series, year(ts) AS year, {FALLING.format('series, year(ts)')} AS rank, ts, value FROM p_orders",
        g="SELECT DISTINCT series, year, unnest(range(0, 8784)) AS rank FROM c",
    ),
)
def _(spark, folder):
    return curves.duration_curve_by_year(p_orders(spark, folder))


@query(
    "f12_first_occurrence",
    with_sql("p_dst", "SELECT * FROM p_dst QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY seq) = 1"),
)
def _(spark, folder):
    from gridloom.catalog.fixtures import p_dst

    return clean.first_of_duplicates(p_dst(spark, folder))
