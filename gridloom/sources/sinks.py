"""Sinks: result tables, the simulation weather file, files per source."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Names of the result tables.
SHEETS = ["Daten", "Stundenwerte", "Jahresdauerlinie", "Monatswerte"]
# Columns with times and their format.
DATE_COLUMNS = ["ts", "orgidx"]
DATE_FORMAT = "DD.MM.YYYY hh:mm"


def write_tables(tables: dict[str, DataFrame | None], path: str, fmt: str = "parquet") -> list[str]:
    """One folder per table that exists; returns the names written."""
    unknown = set(tables) - set(SHEETS) - {"Format"}
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    written = []
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
            written.append(name)
    return written


def write_simulation_csv(hours: DataFrame, path: str) -> None:
    """One CSV file of 8760 rows in time order; the first header cell starts with ``# ``."""
    # Fixed size: the hours of one year.
    one = hours.withColumnRenamed("Time [s]", "# Time [s]").coalesce(1)
    # Another comment sign, since a cell that starts with the sign would be quoted.
    one.sortWithinPartitions("# Time [s]").write.mode("overwrite").option("comment", "~").csv(path, header=True)


def write_by_source(df: DataFrame, path: str) -> None:
    """A folder per source file. Rows are spread by source and month, so one large source is
    written by many tasks."""
    spread = df.selectExpr("*", "date_trunc('month', ts) AS _month").repartition("source_file", "_month")
    spread.drop("_month").write.mode("overwrite").partitionBy("source_file").parquet(path)
