"""Placemarks of KML and KMZ files."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACEMARK = "name string, Point struct<coordinates:string>"


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks at any depth: name and point coordinates (null for lines and areas)."""
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(PLACEMARK).load(path)
    return rows.select("name", F.col("Point.coordinates").alias("coordinates"))


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """The same from zipped files; one task per archive, placemarks streamed out of it."""
    import pandas as pd

    def unzip(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("doc.kml") as doc:
                    rows = []
                    for name, point in _placemarks(doc):
                        rows.append((name, point))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["name", "coordinates"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["name", "coordinates"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(unzip, "name string, coordinates string")


def _placemarks(stream):
    for _, node in ElementTree.iterparse(stream):
        if node.tag.rpartition("}")[2] != "Placemark":
            continue
        name = node.find("{*}name")
        point = node.find("{*}Point/{*}coordinates")
        yield (name.text if name is not None else None, point.text if point is not None else None)
        node.clear()


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of a .kml or .kmz file; an error if there are none."""
    if path.endswith(".kmz"):
        marks = read_kmz(spark, path)
    elif path.endswith(".kml"):
        marks = read_kml(spark, path)
    else:
        raise ValueError(f"not a KML or KMZ file: {path}")
    if marks.limit(1).count() == 0:
        raise ValueError(f"no placemarks in {path}")
    return marks


def marked_points(marks: DataFrame) -> DataFrame:
    """Points only; KML writes longitude first."""
    parts = F.split(F.trim("coordinates"), ",")
    return marks.filter(F.col("coordinates").isNotNull()).select(
        "name", F.get(parts, 1).cast("double").alias("latitude"),
        F.get(parts, 0).cast("double").alias("longitude"),
    )
