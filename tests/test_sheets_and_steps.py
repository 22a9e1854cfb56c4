"""Sheets with odd lines, folders with other headers, hours that are missing, steps per series, sparse stations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import clean, resample, stats, weather
from gridloom.plans import load_profile, meter_folder, results, weather_page
from gridloom.session import SLICE_ROWS_KEY
from gridloom.sources import sheet


def test_bare_title_line_keeps_all_columns(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('Lastgang\n\n→ Einheit →,kWh,"a ""b"", c",°C\n↓ Index ↓,Bedarf,"x, y",T\n01.01.2021 00:00,1,2,3\n01.01.2021 00:15,4\n')
    cells = sheet.read_cells(spark, str(path))
    assert cells.columns == ["seq", "_c0", "_c1", "_c2", "_c3"] and cells.count() == 5
    rows = [tuple(r)[1:] for r in cells.orderBy("seq").collect()]
    assert rows[0] == ("Lastgang", None, None, None) and rows[-1] == ("01.01.2021 00:15", "4", None, None)
    labels = sheet.labels_of(spark, str(path))
    assert labels.titles == ["↓ Index ↓", "Bedarf", "x, y", "T"] and labels.units["T"] == "°C"
    data = load_profile.import_sheet(spark, str(path)).data
    assert {r["series"] for r in data.select("series").distinct().collect()} == {"Bedarf → Arbeit", "Bedarf → Leistung", "x, y", "T"}


def test_empty_sheet_and_doubled_codes_are_refused(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        sheet.read_cells(spark, str(empty))
    twice = tmp_path / "twice.csv"
    twice.write_text("→ Einheit →,kWh,kWh\n↓ Index ↓,A 1-1:1.29.0,B 1-1:1.29.0\n01.01.2021 00:00,1,2\n")
    with pytest.raises(ValueError, match="all stand for"):
        load_profile.import_sheet(spark, str(twice))


def test_order_of_many_part_files(spark, tmp_path):
    for i in (99_999, 100_000, 7):
        (tmp_path / f"part-{i:05d}.csv").write_text("".join(f"{i},{k}\n" for k in range(3)))
    rows = [(r["_c0"], r["_c1"]) for r in sheet.read_cells(spark, str(tmp_path)).orderBy("seq").collect()]
    assert rows == [(str(i), str(k)) for i in (7, 99_999, 100_000) for k in range(3)]


def test_values_come_by_the_header_of_their_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Zeitstempel,P kW,Rest\nt1,1,x\n")
    (tmp_path / "b.csv").write_text("Rest,Q kW,P kW,Zeitstempel\nx,2,3,t2\ny,4\n")
    (tmp_path / "c.csv").write_text("Rest\nz\n")
    (tmp_path / "~$a.csv").write_text("Zeitstempel\nt9\n")
    rows = sheet.read_folder(spark, str(tmp_path), ["Zeitstempel", "kW"])
    assert rows.columns == ["source_file", "seq", "Zeitstempel", "P kW", "Q kW"]
    assert [tuple(r)[2:] for r in rows.orderBy("seq").collect()] == [("t1", "1", None), ("t2", "3", "2"), (None, None, "4")]


def test_empty_hours_are_made_and_filled(profile):
    rows = [("a", f"2021-01-01 0{h}:30", h * h) for h in (1, 2, 3, 6, 7, 8)] + [("b", "2021-01-01 05:00", 2), ("c", "2021-01-01 05:00", None)]
    out = clean.repair_half_day_meter(profile(rows)).orderBy("series", "ts").collect()
    a = [r["value"] for r in out if r["series"] == "a"]
    assert len(a) == 8 and a[:3] == [1, 4, 9] and a[5:] == [36, 49, 64] and 9 < a[3] < a[4] < 36
    assert [(r["series"], r["value"]) for r in out if r["series"] != "a"] == [("b", 2.0), ("c", None)]


@pytest.mark.parametrize("limit", ["2000000", "3"])
def test_each_series_decides_for_itself(spark, profile, units, limit):
    fine = [("f", f"2020-01-01 0{h}:{m:02d}", 1.0) for h in range(3) for m in (0, 15, 30, 45)]
    coarse = [("c", f"2020-01-0{d} 00:00", 24.0) for d in (1, 2, 3)]
    one = [("o", "2020-01-01 07:20", 5.0)]
    spark.conf.set(SLICE_ROWS_KEY, limit)
    try:
        unit = units(f="kWh", c="kWh", o="kWh")
        out = resample.change_resolution(profile(fine + coarse + one), unit, "1h").collect()
        got = {s: sorted({round(r["value"], 9) for r in out if r["series"] == s}) for s in "fco"}
        assert got == {"f": [4.0], "c": [1.0], "o": [5.0]} and len(out) == 3 + 49 + 1
        assert [r["value"] for r in resample.change_resolution(profile(one), unit, "1h").collect()] == [5.0]
        up = resample.upsample(profile(coarse + one), unit, "1h").collect()
        assert [r["value"] for r in up if r["series"] == "o"] == [5.0]
        assert resample.change_resolution(profile(one).limit(0), unit, "1h").count() == 0
    finally:
        spark.conf.unset(SLICE_ROWS_KEY)


def observed(spark):
    """Station 1 is nearest but lacks every fifth day, 2 is complete, 3 has nothing but nulls."""
    days = spark.range(100).select(F.timestamp_seconds(F.col("id") * 86400 + 1_577_836_800).cast("timestamp_ntz").alias("date"), "id")
    rows = days.select(F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)])).alias("station_id"), "date", "id")
    kept = rows.filter((F.col("station_id") != 1) | (F.col("id") % 5 != 0))
    value = F.when(F.col("station_id") != 3, F.col("id") + F.col("station_id") * 1000.0)
    return kept.select("station_id", F.lit("t").alias("parameter"), F.lit("daily").alias("resolution"), "date", value.alias("value"))


STATIONS = [(1, 53.0, 8.0), (2, 53.5, 8.0), (3, 53.0, 8.001)]


def wishes(spark, parameter="t"):
    span = (F.lit("2020-01-11").cast("timestamp_ntz").alias("start"), F.lit("2020-02-09").cast("timestamp_ntz").alias("end"))
    places = spark.createDataFrame([(7, 53.0, 8.0), (8, 20.0, 8.0)], "place_id int, latitude double, longitude double")
    return places.select("*", F.lit(parameter).alias("parameter"), *span)


def test_the_nearest_station_with_enough_values_wins(spark):
    stations = spark.createDataFrame(STATIONS, "station_id int, latitude double, longitude double")
    asked = wishes(spark).withColumn("resolution", F.lit("daily"))
    near = weather.nearest_covering(asked, stations, observed(spark)).collect()
    assert [(r["place_id"], r["station_id"]) for r in near] == [(7, 2)] and 55 < near[0]["distance"] < 56
    loose = weather.nearest_covering(asked, stations, observed(spark), share=0.8).collect()
    assert [(r["place_id"], r["station_id"]) for r in loose] == [(7, 1)]


def test_weather_of_many_requests(spark):
    stations = spark.createDataFrame(STATIONS, "station_id int, latitude double, longitude double")
    unit = spark.createDataFrame([("t", "J/cm²")], "parameter string, unit string").withColumn("unit", F.lit(" J/cm**2"))
    asked = wishes(spark).unionByName(wishes(spark, "none"))
    found = weather_page.collect(asked, stations, observed(spark), unit, "daily")
    status = {(r["place_id"], r["parameter"]): r["status"] for r in found.report.collect()}
    assert status == {(7, "t"): "ok", (8, "t"): "none", (7, "none"): "none", (8, "none"): "none"}
    rows = weather_page.wide(found, ["t", "none"]).orderBy("ts").collect()
    assert len(rows) == 30 and {r["place_id"] for r in rows} == {7} and rows[0]["t"] == pytest.approx(2010 * 2.778) and rows[0]["none"] is None
    hourly = weather_page.collect(asked, stations, observed(spark), unit, "hourly")
    assert hourly.report.filter("status = 'other resolution'").count() == 1 and hourly.values.count() == 29 * 24 + 1


def test_places_share_the_table_of_their_series(spark):
    """What is summed are the rows of the series, not those of the places; places only look them up."""
    stations = spark.createDataFrame(STATIONS, "station_id int, latitude double, longitude double")
    both = observed(spark).unionByName(observed(spark).withColumn("parameter", F.lit("u")).withColumn("value", F.col("value") * 2).filter("day(date) <> 20"))
    one = wishes(spark).filter("place_id = 7")
    places = one.unionByName(one.withColumn("parameter", F.lit("u"))).select(F.explode(F.array(*[F.lit(i) for i in range(40)])).alias("n"), "*").withColumn("place_id", F.when(F.col("n") < 39, F.col("n"))).drop("n")
    places = places.filter("place_id IS NULL OR place_id % 3 > 0 OR parameter = 't'")
    unit = spark.createDataFrame([("t", "°C"), ("u", "°C")], "parameter string, unit string")
    found = weather_page.collect(places, stations, both, unit, "daily")
    out = weather_page.wide(found, ["t", "u"])
    want = found.values.groupBy("place_id", "start", "end", "ts").pivot("parameter", ["t", "u"]).agg(F.first("value"))
    assert out.columns == want.columns and sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    assert out.count() == 40 * 30
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_meters_of_a_folder(spark, tmp_path):
    def clock(h):
        return f"01.02.2021 {(h - 1) % 12 + 1:02d}:00:05"

    (tmp_path / "in").mkdir()
    for name, unit in (("a", "P kW"), ("b", "Q kW")):
        lines = [f"Zeitstempel,Rest,{unit}", *[f"{clock(h)},x,{'n. v.' if h == 5 else h * h}" for h in range(24) if h != 9]]
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join(lines))
    meter_folder.fix_and_export(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["kW"])
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("source_file", "column", "ts").collect()
    a = [r for r in out if r["source_file"] == "a.csv" and r["column"] == "P kW"]
    assert [str(r["ts"])[11:13] for r in a] == [f"{h:02d}" for h in range(24)]
    assert all(abs(r["value"] - h * h) < 1.5 for h, r in enumerate(a)) and a[20]["value"] == 400
    with pytest.raises(ValueError):
        (tmp_path / "other").mkdir()
        (tmp_path / "other" / "x.csv").write_text("P kW\n1\n")
        meter_folder.read_meters(spark, str(tmp_path / "other"), ["kW"])


def test_result_bundle(spark, profile, units, tmp_path):
    df = profile([("p", f"2021-01-{d:02d} {h:02d}:00", 1500.0) for d in (1, 2) for h in range(24)])
    written = results.write(df.select("series", "ts", "value"), units(p=" kW"), str(tmp_path))
    assert written == ["Daten", "Stundenwerte", "Jahresdauerlinie", "Monatswerte", "Format"]
    formats = {(r["sheet"], r["series"]): r["number_format"] for r in spark.read.parquet(str(tmp_path / "Format")).collect()}
    assert formats["Daten", "p"] == '#,##0" kW"' and formats["Monatswerte", "p"] == '#,##0" kWh"'
    assert formats["Jahresdauerlinie", "ts"] == "DD.MM.YYYY hh:mm" and len(formats) == 12


def test_summary_reads_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(100).select(F.lit("a").alias("series"), F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("value"))
    row = stats.summary(df.mapInPandas(count, df.schema)).first()
    assert seen.value == 100 and (row["count"], row["null_count"], row["min"], row["max"]) == (75, 25, 1.0, 99.0)
    assert row["mean"] == pytest.approx(50.0) and row["std"] == pytest.approx(np.std([i for i in range(100) if i % 4], ddof=1))
