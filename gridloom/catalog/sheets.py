"""A labelled sheet written from the event table, and the same cells in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog.fixtures import EVENTS, p_events
from gridloom.functions import texts, times
from gridloom.session import scratch_path
from gridloom.sources import sheet

TITLES = ["click", "view", "purchase", "error", "signup 1-1:1.29.0"]
UNITS = ["kWh", "kW", "°C", "m³", None]

_QUARTERS = (
    "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, "
    + ", ".join(
        f"CAST(max(value) FILTER (event_type = '{e}') AS VARCHAR) AS c{i}"
        for i, e in enumerate(EVENTS, 1)
    )
    + " FROM events GROUP BY 1"
)


def _row(kind: str, cells: list[str | None]) -> str:
    listed = ", ".join("NULL" if c is None else f"'{c}'" for c in cells)
    return f"SELECT '{kind}', NULL, {listed}"


SHEET_SQL = (
    f"quarters AS ({_QUARTERS}), sheet AS ("
    "SELECT 'data' AS kind, ts, strftime(ts, '%d.%m.%Y %H:%M') AS c0, c1, c2, c3, c4, c5 FROM quarters "
    "UNION ALL " + _row("title", ["Lastgang", None, None, None, None, None])
    + " UNION ALL " + _row("unit", [texts.UNIT_MARK, *UNITS])
    + " UNION ALL " + _row("head", [texts.INDEX_MARK, *TITLES]) + ")"
)


def quarter_hours(spark: SparkSession, folder: str) -> DataFrame:
    bucket = times.floor_to(F.col("ts"), "15m").alias("ts")
    quarters = p_events(spark, folder).groupBy(bucket).pivot("series", EVENTS)
    return quarters.agg(F.max("value"))


def sheet_path(spark: SparkSession, folder: str) -> str:
    """Write the sheet: three label rows, then the values in time order."""
    columns = ["c0", "c1", "c2", "c3", "c4", "c5"]
    labels = [
        ["Lastgang", None, None, None, None, None],
        [texts.UNIT_MARK, *UNITS],
        [texts.INDEX_MARK, *TITLES],
    ]
    top = spark.createDataFrame(labels, ", ".join(f"{c} string" for c in columns)).coalesce(1)
    wide = quarter_hours(spark, folder).orderBy("ts")
    cells = wide.select(
        times.format_time(F.col("ts")).alias("c0"),
        *[F.col(e).cast("string").alias(f"c{i}") for i, e in enumerate(EVENTS, 1)],
    )
    path = scratch_path(spark, "sheet")
    top.unionByName(cells).write.csv(path)
    return path


def sheet_cells(spark: SparkSession, folder: str) -> DataFrame:
    return sheet.read_cells(spark, sheet_path(spark, folder))
