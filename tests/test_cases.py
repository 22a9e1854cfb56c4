"""Small hand-made cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import texts, times, units as unit_rules
from gridloom.operators import clean, curves, fill, geo, joins, meta, resample, smooth, stats, weather


def values(df, *order):
    return [r["value"] for r in df.orderBy(*order).collect()]


def test_quarter_hours_to_hours(profile, units):
    stamps = [f"2020-02-07 {9 + i // 4:02d}:{i % 4 * 15:02d}" for i in range(9)]
    df = profile([("Vals", t, v) for t, v in zip(stamps, [2, 4, 8, 9, 6, 1, 4, 2, 1])])
    assert values(resample.change_resolution(df, units(Vals="kW"), "1h"), "ts") == [5.75, 3.25, 1.0]


def test_summed_units_are_summed_and_scaled(profile, units):
    df = profile([("e", f"2020-01-01 {h:02d}:00", 4.0) for h in range(6)])
    assert values(resample.change_resolution(df, units(e="kWh"), "1d"), "ts") == [24.0]
    up = resample.change_resolution(df, units(e="kWh"), "15m")
    assert up.count() == 21 and set(values(up, "ts")) == {1.0}
    assert set(values(resample.hourly_to_quarter(df, units(e="kWh")), "ts")) == {1.0}
    assert set(values(resample.hourly_to_quarter(df, units(e="")), "ts")) == {4.0}


def test_mixed_steps_go_both_ways(profile, units):
    fine = [("f", f"2020-01-01 0{h}:{m:02d}", 1.0) for h in range(3) for m in (0, 15, 30, 45)]
    coarse = [("c", f"2020-01-0{d} 00:00", 2.0) for d in (1, 2, 3)]
    out = resample.change_resolution(profile(fine + coarse), units(f="kW", c="kW"), "1h")
    assert out.groupBy("series").count().orderBy("series").collect() == [("c", 49), ("f", 3)]


def test_doubled_times_only_are_an_error(profile, units):
    df = profile([("a", "2020-01-01 00:00", 1), ("a", "2020-01-01 00:00", 2)])
    with pytest.raises(ValueError):
        resample.change_resolution(df, units(a="kW"), "1h")


def test_no_upsampling_to_months(profile, units):
    df = profile([("a", "2020-01-01 00:00", 1), ("a", "2021-01-01 00:00", 2)])
    with pytest.raises(ValueError):
        resample.change_resolution(df, units(a="kW"), "1mo")


def test_preference_order(spark):
    names = ["minute_1", "minute_10", "hourly", "daily", "monthly", "annual"]
    options = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "resolution string, place int")
    got = [r["resolution"] for r in weather.preference_order(options, "hourly").collect()]
    assert got == ["hourly", "minute_10", "minute_1", "daily", "monthly", "annual"]
    with pytest.raises(ValueError):
        weather.preference_order(options, "weekly")


def test_units_by_frequency(spark):
    df = spark.createDataFrame([(0, "kW"), (1, "kWh"), (2, "kWh"), (3, "°C")], "seq long, unit string")
    assert [r["unit"] for r in stats.by_frequency(df, "unit", "seq").collect()] == ["kWh", "kW", "°C"]


def test_leap_day_keeps_its_day(profile):
    df = profile([("a", "2016-02-29 01:30", 1), ("a", "2017-02-28 00:00", 2)])
    got = [str(r["ts"]) for r in curves.split_years(df).orderBy("year").collect()]
    assert got == ["2020-02-29 01:30:00", "2020-02-28 00:00:00"]


def test_curve_by_year_is_padded(profile):
    df = profile([("a", "2016-01-01 00:00", 1), ("a", "2016-01-01 01:00", None), ("a", "2017-01-01 00:00", 3)])
    out = curves.duration_curve_by_year(df)
    assert out.groupBy("year").count().orderBy("year").collect() == [(2016, 8784), (2017, 8784)]
    assert out.filter("value is not null").count() == 2


def test_nulls_stay_out_of_the_curve(profile):
    df = profile([("a", "2016-01-01 00:00", 1), ("a", "2016-01-01 01:00", None), ("a", "2016-01-01 02:00", 3)])
    assert values(curves.duration_curve(df), "rank") == [3.0, 1.0]


def numpy_akima(x, y, at):
    """Akima's method written from the paper, for checking."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) == 2:
        return y[0] + (y[1] - y[0]) / (x[1] - x[0]) * (at - x[0])
    inner = np.diff(y) / np.diff(x)
    m = np.concatenate([[0, 0], inner, [0, 0]])
    m[1] = 2 * m[2] - m[3]
    m[0] = 2 * m[1] - m[2]
    m[-2] = 2 * m[-3] - m[-4]
    m[-1] = 2 * m[-2] - m[-3]
    f1, f2 = np.abs(m[3:] - m[2:-1]), np.abs(m[1:-2] - m[:-3])
    t = (m[3:] + m[:-3]) / 2
    ok = f1 + f2 > 1e-9 * (f1 + f2).max()
    t[ok] = (f1[ok] * m[1:-2][ok] + f2[ok] * m[2:-1][ok]) / (f1 + f2)[ok]
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h, d = np.diff(x)[i], at - x[i]
    s = inner[i]
    out = y[i] + d * (t[i] + d * ((3 * s - 2 * t[i] - t[i + 1]) / h + d * (t[i] + t[i + 1] - 2 * s) / h**2))
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)


@pytest.mark.parametrize("knots", [2, 3, 4, 5, 30])
def test_akima_against_numpy(profile, knots):
    rng = random.Random(knots)
    minutes = sorted(rng.sample(range(10, 1400), knots))
    known = {m: rng.choice([0.0, 5.0, rng.random() * 100]) for m in minutes}
    stamp = lambda m: f"2020-01-01 {m // 60:02d}:{m % 60:02d}"
    df = profile([("a", stamp(m), known.get(m)) for m in range(0, 1440, 1)])
    got = np.array([np.nan if v is None else v for v in values(fill.akima(df), "ts")])
    want = numpy_akima(np.array(minutes) * 60, [known[m] for m in minutes], np.arange(1440) * 60.0)
    want[[i for i in range(1440) if i < minutes[0] or i > minutes[-1]]] = np.nan
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert all(got[m] == known[m] for m in minutes)


@pytest.mark.parametrize("known", [0, 1])
def test_akima_needs_two_values(profile, known):
    df = profile([("a", f"2020-01-01 0{h}:00", 1.0 if h < known else None) for h in range(4)])
    assert values(fill.akima(df), "ts") == [1.0] * known + [None] * (4 - known)


@pytest.mark.parametrize("window,degree,rows", [(3, 2, 5), (5, 3, 7), (11, 3, 40), (9, 2, 5)])
def test_smoothing_against_numpy(profile, window, degree, rows):
    rng = random.Random(rows)
    y = [rng.random() * 50 for _ in range(rows)]
    half = window // 2
    mirrored = np.pad(y, half, mode="reflect")
    fit = [np.polyval(np.polyfit(np.arange(-half, half + 1), mirrored[i : i + window], degree), 0) for i in range(rows)]
    df = profile([("a", f"2020-01-01 00:{i:02d}", v) for i, v in enumerate(y)])
    got = [r["smoothed"] for r in smooth.smoothed(df, window, degree).orderBy("ts").collect()]
    np.testing.assert_allclose(got, fit, atol=1e-9)


def test_smoothing_window_must_be_odd():
    with pytest.raises(ValueError):
        smooth.coefficients(4)


def test_serial_numbers(spark):
    df = spark.createDataFrame([("42370",), ("42370.041667",), ("01.01.2016 00:15",), ("x",)], "t string")
    got = [r[0] for r in df.select(times.parse_time_or_serial(F.col("t"))).collect()]
    assert str(got[0]) == "2016-01-01 00:00:00" and abs(got[1].minute * 60 + got[1].second + got[1].hour * 3600 - 3600) < 1
    assert str(got[2]) == "2016-01-01 00:15:00" and got[3] is None


def test_half_days_across_a_month(profile):
    shown = ["01-31 11:00", "01-31 12:30", "01-31 01:00", "01-31 11:00", "02-01 12:00", "02-01 11:00", "02-01 12:00", "02-01 03:00"]
    true = ["01-31 11:00", "01-31 12:30", "01-31 13:00", "01-31 23:00", "02-01 00:00", "02-01 11:00", "02-01 12:00", "02-01 15:00"]
    df = profile([("a", f"2020-{t}", 1) for t in shown])
    got = [r["ts"].strftime("%m-%d %H:%M") for r in clean.fix_half_days(df).orderBy("seq").collect()]
    assert got == true


def test_times_without_the_pattern_stay(profile):
    df = profile([("a", f"2020-01-01 {h:02d}:00", h) for h in (0, 5, 12, 18)])
    got = clean.fix_half_days(df, only_where_found=True).orderBy("seq").collect()
    assert [r["ts"].hour for r in got] == [0, 5, 12, 18]


def test_doubled_hour_keeps_the_first(profile):
    df = profile([("a", "2021-10-31 02:00", 1), ("a", "2021-10-31 02:00", 2), ("a", "2021-03-28 02:15", 3)])
    assert values(clean.clean_switches(df), "ts") == [1.0]
    assert values(clean.switch_rejects(df), "ts") == [3.0, 2.0]


def test_outliers(profile):
    df = profile([("a", f"2020-01-01 0{h}:00", v) for h, v in enumerate([1, 2, 99, 4, 5])])
    assert values(clean.remove_outliers(df, 50.0), "ts") == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert values(clean.remove_outliers(df), "ts") == [1.0, 2.0, 99.0, 4.0, 5.0]


def test_single_point_has_no_zoom(spark):
    df = spark.createDataFrame([("a", 53.0, 8.0), ("b", 53.0, 8.0)], "name string, latitude double, longitude double")
    row = geo.map_extent(df).first()
    assert row["zoom"] is None and row["lat"] == 53.0


def test_point_table_needs_coordinates(spark):
    with pytest.raises(ValueError):
        geo.points(spark.createDataFrame([("a",)], "Name string"))


def km(a, b):
    (p1, l1), (p2, l2) = [[math.radians(v) for v in p] for p in (a, b)]
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def test_nearest_station_against_brute_force(spark):
    rng = random.Random(1)
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]
    spots += [(200 + i, 89.9, rng.uniform(-180, 180)) for i in range(20)] + [(300, 10.0, 179.99)] + [(400 + i, 50.0, 10.0) for i in range(50)]
    sites = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)] + [(900, 10.0, -179.99), (901, 50.0, 10.01), (902, 50.0, 10.01)]
    # A town with very many stations next to places that have none nearby.
    sites += [(1000 + i, 48.0 + rng.random() / 500, 11.0 + rng.random() / 500) for i in range(600)]
    spots += [(500 + i, 48.0 + rng.uniform(-1, 1), 11.0 + rng.uniform(-1, 1)) for i in range(60)]
    places = spark.createDataFrame(spots, "place_id long, latitude double, longitude double")
    stations = spark.createDataFrame(sites, "station_id long, latitude double, longitude double")
    got = {r["place_id"]: r["station_id"] for r in geo.nearest_station(places, stations, 700.0).collect()}
    want = {}
    for i, *p in spots:
        best = min((km(p, s[1:]), s[0]) for s in sites)
        if best[0] <= 700:
            want[i] = best[1]
    assert got == want


def test_large_lookup_is_salted(spark, monkeypatch):
    monkeypatch.setattr(joins, "is_small", lambda df, rows=0: False)
    left = spark.range(500).selectExpr("id", "if(id % 3 = 0, 0, id) AS k")
    right = spark.range(400).selectExpr("id AS k", "id * 2 AS v")
    out = joins.lookup(left, right, ["k"])
    assert "_salt" in out._jdf.queryExecution().toString()
    assert out.count() == 500 and out.filter("v is null").count() == left.filter("k >= 400").count()


def test_number_text_and_unit_rules(spark):
    df = spark.createDataFrame([(1234567.0,), (123.4,), (-12.34,), (1.234,)], "x double")
    assert [r[0] for r in df.select(texts.number_text(F.col("x"))).collect()] == ["1.234.567", "123", "-12,3", "1,23"]
    us = spark.createDataFrame([(" KW ",), ("kWh",), (None,), ("pct",)], "u string")
    assert [r[0] for r in us.select(unit_rules.in_group(F.col("u"), "mean_all")).collect()] == [True, False, False, True]


def test_obis_name_and_unit(spark):
    df = spark.createDataFrame(
        [("Strombez. 1-1:1.29.0", None), ("Rest", " kW"), ("x 1-1:99.29.0", " A")], "series string, unit string"
    )
    rows = {r["old_series"]: r for r in meta.obis_names(meta.series_meta(df)).collect()}
    first = rows["Strombez. 1-1:1.29.0"]
    assert (first["series"], first["unit"], first["unit_h"], first["obis"]) == ("Bezug (1-1:1.29)", " kWh", " kW", "1-1:1.29")
    assert rows["Rest"]["obis"] is None and rows["x 1-1:99.29.0"]["series"] == "x 1-1:99.29.0"
    assert meta.unknown_obis(df, "series").count() == 1


def test_temperature_between_weather_times(profile, spark):
    df = profile([("a", f"2020-01-01 0{h}:30", h) for h in range(4)])
    seen = profile([("t", f"2020-01-01 0{h}:00", v) for h, v in ((1, 10.0), (3, 30.0))])
    got = [r["temperature"] for r in weather.with_temperature(df, seen).orderBy("ts").collect()]
    # Rows of the common axis: 0:30, 1:00, 1:30, 2:30, 3:00, 3:30. The ends are outside of the weather
    # and take the value of the next profile row.
    assert got == pytest.approx([50 / 3, 50 / 3, 70 / 3, 70 / 3])


def test_large_lookup_stays_off_the_driver(spark, monkeypatch):
    """Neither broadcast nor repeated for each salt; a frequent key is spread, null keys match nothing."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(joins, "FREQUENT_ROWS", 50)
    monkeypatch.setattr(joins.is_small, "__defaults__", (10,))
    left = spark.range(1000).select("id", F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).alias("k"))
    right = spark.range(-1, 600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    for how in ("left", "inner", "left_semi"):
        out = joins.lookup(left, right, ["k"], how)
        want = left.join(right, "k", how)
        assert out.columns == want.columns and sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
        final = out._jdf.queryExecution().executedPlan()
        assert "SortMergeJoin [k" in final.toString()
    frequent = spark.range(2000).select((F.col("id") % 2).alias("k"), "id")
    assert joins.lookup(frequent, right, ["k"], "inner").where("twice = 2 * k").count() == 2000
