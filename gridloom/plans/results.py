"""The result tables of a profile with their number formats, as one bundle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import curves, resample, stats
from gridloom.session import stored
from gridloom.sources import sinks


def result_tables(data: DataFrame, units_of: DataFrame) -> dict[str, DataFrame]:
    """``Daten``, ``Stundenwerte``, ``Jahresdauerlinie``, ``Monatswerte`` and ``Format``.

    ``data(series, ts, value)``. Curve and months start from the same hours, which are made once. ``Format`` has
    the number format of each series in each table, from the 95 % quantile there; times have a fixed one.
    """
    hours = stored(resample.hourly_mean(data), "hours")
    tables = {
        "Daten": data.select("series", "ts", "value", F.col("ts").alias("orgidx")),
        "Stundenwerte": hours,
        "Jahresdauerlinie": curves.duration_curve(hours),
        "Monatswerte": resample.monthly_values(hours, units_of),
    }
    return tables | {"Format": format_table(tables, units_of)}


def format_table(tables: dict[str, DataFrame], units_of: DataFrame) -> DataFrame:
    """``(sheet, series, number_format)``: monthly power is written as energy, so each table has its own."""
    parts = []
    for name, df in tables.items():
        formats = stats.export_format(stats.quantile_95(df), units_of, monthly=name == "Monatswerte")
        parts.append(formats.select(F.lit(name).alias("sheet"), "series", "number_format"))
    dates = [(name, column, sinks.DATE_FORMAT) for name in tables for column in sinks.DATE_COLUMNS]
    fixed = units_of.sparkSession.createDataFrame(dates, "sheet string, series string, number_format string")
    return reduce(DataFrame.unionByName, parts).unionByName(fixed)


def write(data: DataFrame, units_of: DataFrame, path: str, fmt: str = "parquet") -> list[str]:
    return sinks.write_tables(result_tables(data, units_of), path, fmt)
