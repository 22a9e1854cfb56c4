"""Files in, files out."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.plans import load_profile
from gridloom.sources import kml, sheet, sinks

KML = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>top</name><Point><coordinates>8.5,53.1,0</coordinates></Point></Placemark>
<Folder><Placemark><name>in folder</name><Point><coordinates> 9.0,52.0 </coordinates></Point></Placemark></Folder>
<Document><Folder><Placemark><name>deep</name><Point><coordinates>10,51</coordinates></Point></Placemark></Folder>
<Placemark><name>line</name><LineString><coordinates>8,53 9,54</coordinates></LineString></Placemark></Document></kml>"""
POINTS = [("deep", 51.0, 10.0), ("in folder", 52.0, 9.0), ("top", 53.1, 8.5)]


def test_kml_and_kmz(spark, tmp_path):
    plain, zipped = tmp_path / "a.kml", tmp_path / "b.kmz"
    plain.write_text(KML)
    with zipfile.ZipFile(zipped, "w") as archive:
        archive.writestr("doc.kml", KML)
    for path in (plain, zipped):
        marks = kml.read_placemarks(spark, str(path))
        assert marks.count() == 4
        assert [tuple(r) for r in kml.marked_points(marks).orderBy("name").collect()] == POINTS


def test_files_without_placemarks(spark, tmp_path):
    empty = tmp_path / "c.kml"
    empty.write_text("<kml><Document/></kml>")
    with pytest.raises(ValueError):
        kml.read_placemarks(spark, str(empty))
    with pytest.raises(ValueError):
        kml.read_placemarks(spark, str(tmp_path / "d.txt"))


def sheet_text(rows):
    head = ",,\n→ Einheit →,kWh,°C\n↓ Index ↓,Bedarf,Temperatur\n"
    return head + "".join(f"{t},{a},{b}\n" for t, a, b in rows)


def test_sheet_import(spark, tmp_path):
    stamps = [f"01.01.2021 {h:02d}:{m:02d}" for h in range(3) for m in (0, 15, 30, 45)]
    path = tmp_path / "sheet.csv"
    path.write_text(sheet_text([(t, i, 20.5) for i, t in enumerate(stamps)]))
    profile = load_profile.import_sheet(spark, str(path))
    sums = {r["series"]: (r["n"], r["s"], r["u"]) for r in profile.data.groupBy("series").agg(
        F.count("value").alias("n"), F.sum("value").alias("s"), F.first("unit").alias("u")).collect()}
    assert sums == {
        "Bedarf → Arbeit": (12, 66.0, " kWh"), "Bedarf → Leistung": (12, 264.0, " kW"), "Temperatur": (12, 246.0, " °C"),
    }
    hours = load_profile.hourly(profile)
    assert {r[0] for r in hours.select("series").distinct().collect()} == {"Bedarf", "Temperatur"}
    assert load_profile.monthly(profile).count() == 2 and load_profile.duration_curve(profile).count() == 6


def test_sheet_with_serial_numbers(spark, tmp_path):
    path = tmp_path / "serial.csv"
    path.write_text(sheet_text([(44197 + h / 24, h, 1) for h in range(4)]))
    data = load_profile.import_sheet(spark, str(path)).data
    assert [str(r["ts"])[:16] for r in data.filter("series = 'Bedarf'").orderBy("ts").collect()] == [
        f"2021-01-01 0{h}:00" for h in range(4)
    ]


def test_row_order_over_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    with path.open("w") as out:
        for i in range(400_000):
            out.write(f"{i},{'x' * 20}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        cells = sheet.read_cells(spark, str(path))
        assert cells.rdd.getNumPartitions() > 1
        off = cells.selectExpr("cast(_c0 as long) AS i", "row_number() over (order by seq) - 1 AS n").filter("i <> n")
        assert off.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_marker(spark, tmp_path):
    path = tmp_path / "none.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        load_profile.import_sheet(spark, str(path))


def test_lock_files_are_skipped(spark, tmp_path):
    (tmp_path / "jan.csv").write_text("Zeitstempel,P kW,Rest\n01.01.2020 00:00,1,x\n")
    (tmp_path / "~$jan.csv").write_text("Zeitstempel,P kW,Rest\nbroken,2,y\n")
    rows = sheet.read_folder(spark, str(tmp_path), ["Zeitstempel", "kW"]).collect()
    assert len(rows) == 1 and rows[0]["P kW"] == "1" and "Rest" not in rows[0]


def test_tables_and_simulation_file(spark, tmp_path, profile):
    df = profile([("a", "2021-01-01 00:00", 1.5), ("a", "2021-01-01 01:00", 2.5)])
    assert sinks.write_tables({"Daten": df, "Monatswerte": None}, str(tmp_path)) == ["Daten"]
    assert spark.read.parquet(str(tmp_path / "Daten")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_tables({"Tabelle": df}, str(tmp_path))
    from gridloom.operators import weather

    wide = df.select("ts", F.col("value").alias("humidity"))
    sinks.write_simulation_csv(weather.simulation_hours(wide), str(tmp_path / "sim"))
    text = next((tmp_path / "sim").glob("part-*")).read_text().splitlines()
    assert text[0] == "# Time [s],Hrel [%]" and text[1:4] == ["0,1.5", "3600,2.5", "7200,0.0"] and len(text) == 8761
