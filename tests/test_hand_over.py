"""What the steps cost: how often a chain reads its input when its series are cut, and what windows cost."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import clean, curves, fill, resample, smooth, stats, weather
from gridloom.session import SLICE_ROWS_KEY


@pytest.fixture
def cut(spark):
    spark.conf.set(SLICE_ROWS_KEY, "200")
    yield
    spark.conf.unset(SLICE_ROWS_KEY)


def counted(spark, df):
    """The same rows, and an accumulator of how many were read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def readings(spark, n=1500):
    rows = spark.range(n).repartition(3)
    return rows.select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("series"), F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") * 1800 + 1_600_000_000).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 11 < 9, F.floor(F.col("id") * 37 % 101 / 4).cast("double")).alias("value"),
    )


def with_temperature(df):
    hours = df.sparkSession.range(900).select(
        F.timestamp_seconds(F.col("id") * 3600 + 1_600_000_000).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value")
    )
    return weather.with_temperature(df, hours)


def units_of(df):
    return df.sparkSession.createDataFrame([("hot", "kWh"), ("s0", "kW")], "series string, unit string")


CHAINS = {
    "C5": clean.repair_half_day_meter,
    "C6": clean.fill_where_constant,
    "P11": clean.remove_outliers,
    "G2": with_temperature,
    "A4": lambda df: resample.upsample(df, units_of(df), "15m"),
    "A5": lambda df: resample.hourly_to_quarter(df, units_of(df)),
    "F2": fill.forward_fill,
    "F4": fill.interpolate_linear,
    "F6": fill.akima,
    "F9": lambda df: smooth.smoothed_lines(df, 31),
    "F10": curves.duration_curve,
    "F5": stats.numbered,
}


@pytest.mark.parametrize("name", CHAINS)
def test_input_is_read_three_times_at_most(spark, cut, name):
    df, seen = counted(spark, readings(spark))
    CHAINS[name](df).collect()
    assert seen.value <= 3 * 1500


def test_akima_takes_one_sort_and_one_shuffle(spark, profile):
    df = profile([("a", f"2021-01-01 {h:02d}:00", None if h % 3 else h * h) for h in range(24)])
    plan = fill.akima(df, at_most=24)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1


@pytest.mark.parametrize("limit", ["2000000", "4"])
def test_akima_refuses_doubled_stamps_by_name(spark, profile, limit):
    rows = [("a", f"2021-01-01 {h:02d}:00", h) for h in (0, 1, 1, 2, 5, 6, 7, 8, 9)] + [("b", "2021-01-01 00:00", 1)]
    spark.conf.set(SLICE_ROWS_KEY, limit)
    try:
        with pytest.raises(Exception, match="two values of series a at 2021-01-01 01:00"):
            fill.akima(profile(rows)).collect()
        empty = [("a", "2021-01-01 01:00", None), ("a", "2021-01-01 01:00", None), ("a", "2021-01-01 00:00", 1), ("a", "2021-01-01 02:00", 3)]
        assert [r["value"] for r in fill.akima(profile(empty)).orderBy("ts").collect()] == pytest.approx([1, 2, 2, 3])
    finally:
        spark.conf.unset(SLICE_ROWS_KEY)


def test_akima_over_gaps_longer_than_a_slice(spark, profile, cut):
    """Known points lie several slices away on either side."""
    from scipy_free import akima_at

    known = {0: 1.0, 1: 3.0, 2: 2.0, 700: 5.0, 1400: 4.0, 1401: 8.0}
    hours = spark.range(1402).select(
        F.lit("a").alias("series"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"),
        F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)])[F.col("id").cast("int")].alias("value"),
    )
    found = [r["value"] for r in fill.akima(hours).orderBy("ts").collect()]
    expected = akima_at(np.array(list(known)), np.array(list(known.values())), np.arange(1402))
    assert np.allclose(found, expected, atol=1e-9)


def direct(values, window, degree):
    half = window // 2
    wide = np.concatenate([values[half:0:-1], values, values[-2 : -half - 2 : -1]])
    return np.convolve(wide, np.array(smooth.coefficients(window, degree))[::-1], "valid")


@pytest.mark.parametrize(("n", "window", "degree"), [(40, 5, 2), (40, 5, 3), (9, 17, 3), (300, 299, 3), (200, 41, 5), (50, 7, 0), (50, 1, 0), (60, 3, 2)])
@pytest.mark.parametrize("limit", ["2000000", "20"])
def test_moving_moments_equal_the_weighted_sum(spark, n, window, degree, limit):
    spark.conf.set(SLICE_ROWS_KEY, limit)
    try:
        values = np.sin(np.arange(n) / 3) * 100 + np.arange(n) % 7
        rows = [("a", i, float(v)) for i, v in enumerate(values)] + [("b", i, float(i)) for i in range(n)]
        df = spark.createDataFrame(rows, "series string, i long, value double")
        df = df.select("series", F.timestamp_seconds(F.col("i") * 60).cast("timestamp_ntz").alias("ts"), "value")
        out = smooth.smoothed(df, window, degree).orderBy("series", "ts").collect()
    finally:
        spark.conf.unset(SLICE_ROWS_KEY)
    assert len(out) == 2 * n
    assert np.allclose([r["smoothed"] for r in out[:n]], direct(values, window, degree), atol=1e-8)


def test_windows_with_missing_values_are_not_a_number(spark, profile):
    rows = [("a", f"2021-01-01 00:{m:02d}", None if m == 20 else m) for m in range(40)]
    out = [r["smoothed"] for r in smooth.smoothed(profile(rows), 5).orderBy("ts").collect()]
    assert [m for m in range(40) if np.isnan(out[m])] == [18, 19, 20, 21, 22]
    assert np.allclose([v for v in out if not np.isnan(v)][2:16], range(2, 16))
    short = smooth.smoothed(profile(rows[:2]), 5).collect()
    assert [r["smoothed"] for r in short] == [None, None]


def test_wide_windows_cost_what_narrow_ones_do(spark):
    n = 1_000_000
    df = spark.range(n).select(
        F.lit("a").alias("series"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        (F.sin(F.col("id") / 500) * 50 + F.col("id") % 13).alias("value"),
    ).cache()
    df.count()
    seconds = {}
    for window in (31, 31, 10_001):  # the first run compiles
        start = time.perf_counter()
        smooth.smoothed(df, window).write.format("noop").mode("overwrite").save()
        seconds[window] = time.perf_counter() - start
    assert seconds[10_001] < 2 * seconds[31]
    ids = np.arange(n)
    values = np.sin(ids / 500) * 50 + ids % 13
    expected = direct(values, 10_001, 3)
    found = smooth.smoothed(df, 10_001).select("ts", "smoothed").filter("unix_seconds(cast(ts as timestamp)) % 60000 = 0").orderBy("ts").collect()
    df.unpersist()
    assert np.allclose([r["smoothed"] for r in found], expected[::1000], atol=1e-6)
