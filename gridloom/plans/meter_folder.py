"""From a folder of meter exports to clean hourly files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.operators import clean
from gridloom.sources import sheet, sinks

STAMP = "Zeitstempel"
STAMP_FORMAT = "dd.MM.yyyy HH:mm:ss"
_JOINT = "\x1f"  # between file and column


def read_meters(spark: SparkSession, path: str, wanted: list[str], source: Column | None = None) -> DataFrame:
    """All columns whose name holds a wanted text, long: ``(source_file, column, seq, ts, value)``.

    Times may have seconds or not; a text that is no number becomes null. ``source`` names the meter of a row,
    the path below the folder by default; it may put several files together.
    """
    rows = sheet.read_folder(spark, path, [STAMP, *wanted])
    if STAMP not in rows.columns:
        raise ValueError(f"no file below {path} has a column {STAMP}")
    below = F.substring_index("source_file", path.rstrip("/") + "/", -1)
    columns = [c for c in rows.columns if c not in ("source_file", "seq", STAMP)]
    stamp = F.col(f"`{STAMP}`")
    ts = F.coalesce(times.parse_time(stamp, STAMP_FORMAT), times.parse_time_or_serial(stamp))
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in columns
    ])
    return rows.select((below if source is None else source).alias("source_file"), "seq", ts.alias("ts"), F.inline(cells))


def repaired_hours(meters: DataFrame) -> DataFrame:
    """Clean hourly values ``(source_file, column, ts, value)``: each column of each meter is one series."""
    named = meters.select(F.concat_ws(_JOINT, "source_file", "column").alias("series"), "seq", "ts", "value")
    hours = clean.repair_half_day_meter(named)
    place = lambda k: F.split_part("series", F.lit(_JOINT), F.lit(k))
    return hours.select(place(1).alias("source_file"), place(2).alias("column"), "ts", "value")


def fix_and_export(spark: SparkSession, path: str, out: str, wanted: list[str], source: Column | None = None) -> None:
    """Folder, repair per meter, one folder of hourly values per meter."""
    sinks.write_by_source(repaired_hours(read_meters(spark, path, wanted, source)), out)
