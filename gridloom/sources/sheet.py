"""Tables of labelled sheets in CSV form.

Sheets are read as lines and taken apart line by line, so a short line (a bare title) does not decide how many
columns there are, and the order of rows is that of the lines.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import texts, times, units
from gridloom.operators import clean
from gridloom.operators.joins import lookup
from gridloom.session import stored

ORDER = ["part", "file", "start", "row"]
_QUOTED = r'"(?:[^"\\]|\\.|"")*"'


def file_order() -> Column:
    """Place of a row: number of a numbered part file, file, start of the split in bytes, row of the split.

    A struct of four columns that sorts like the rows stand in the files, whatever their number.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long")
    return F.struct(
        F.coalesce(part, F.lit(0).cast("long")).alias("part"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"),
    )


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines that hold anything, with their place."""
    rows = spark.read.text(path, **options).select(file_order().alias("seq"), F.col("value").alias("line"))
    return rows.filter(F.length("line") > 0)


def _width() -> Column:
    """Cells of a line: separators outside of quotes, and one."""
    return F.regexp_count(F.regexp_replace("line", _QUOTED, ""), F.lit(",")) + 1


def _cells(width: int) -> Column:
    """Cells of a line as a struct of texts; missing ones are null."""
    return F.from_csv("line", ", ".join(f"_c{i} STRING" for i in range(width)))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Sheet without header, every cell as text, rows placed by ``seq``; as wide as its widest line."""
    lines = _lines(spark, path)
    width = lines.agg(F.max(_width())).first()[0]
    if width is None:
        raise ValueError(f"no rows in {path}")
    return lines.select("seq", _cells(width).alias("_cells")).select("seq", "_cells.*")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Table with header; ``Datum`` or index column as time; empty rows and columns dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    for name in ("Datum", texts.INDEX_MARK):
        if name in df.columns:
            df = df.withColumn(name, times.parse_time(F.col(f"`{name}`")))
    return clean.drop_empty_columns(clean.drop_empty_rows(df))


def read_folder(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """All CSV files below a folder but lock files (``~$``); columns whose name holds a wanted text.

    The first line of each file is its header. Values are found by the name in the header of their own file, so
    files may differ in the order and number of columns; what a file does not have is null. Of columns with one
    name in a file the first counts; files without any wanted column are left out. Columns come in the order
    of files and of their place there.
    """
    lines = _lines(spark, path, pathGlobFilter="[!~]*", recursiveFileLookup=True)
    real = lines.withColumn("source_file", F.col("seq.file")).filter(~F.col("source_file").rlike(r"/(~|%7E)(\$|%24)"))
    per_file = real.groupBy("source_file").agg(
        F.max(_width()).alias("width"), F.min(F.struct("seq", "line")).alias("head")
    )
    heads = stored(per_file.select("source_file", "width", F.col("head.seq").alias("_first"), F.col("head.line").alias("line")), "headers")
    width = heads.agg(F.max("width")).first()[0]
    if width is None:
        raise ValueError(f"no rows below {path}")
    names = [f"_cells._c{i}" for i in range(width)]
    titles = (
        heads.select("source_file", "_first", _cells(width).alias("_cells"))
        .select("source_file", "_first", F.posexplode(F.array(*names)).alias("place", "name"))
        .filter(texts.contains_any(F.col("name"), wanted))
        .groupBy("source_file", "name").agg(F.min("place").alias("place"), F.first("_first").alias("_first"))
    )
    # The names of columns make the schema, so they are known to the driver.
    kept = [r["name"] for r in titles.groupBy("name").agg(F.min(F.struct("source_file", "place")).alias("at")).orderBy("at").collect()]
    maps = titles.groupBy("source_file").agg(
        F.first("_first").alias("_first"), F.map_from_entries(F.collect_list(F.struct("name", "place"))).alias("_places")
    )
    rows = lookup(real, maps, ["source_file"], "inner").filter(F.col("seq") > F.col("_first"))
    cells = rows.select("source_file", "seq", "_places", _cells(width).alias("_cells"))
    value = lambda name: F.get(F.array(*names), F.try_element_at("_places", F.lit(name)))
    return cells.select("source_file", "seq", *[value(name).alias(name) for name in kept])


@dataclass(frozen=True)
class Labels:
    """What the label rows of a sheet say: titles, units and the place of the title row."""

    width: int
    place: Row
    titles: list[str | None]
    units: dict[str, str | None]


def labels_of(spark: SparkSession, path: str, mark: str = texts.INDEX_MARK) -> Labels:
    """Width, titles and units of a sheet in one pass over its lines; two lines come to the driver."""
    lines = _lines(spark, path)

    def first_with(cell: str) -> Column:
        holds = F.col("line").rlike(rf'(^|,)"?\Q{cell}\E"?(,|$)')
        return F.min(F.when(holds, F.struct("seq", "line")))

    row = lines.agg(F.max(_width()).alias("width"), first_with(mark).alias("head"), first_with(texts.UNIT_MARK).alias("unit")).first()
    if row["head"] is None:
        raise ValueError(f"marker {mark} not found")
    titles = _parsed(row["head"]["line"])
    at = titles.index(mark)
    found = _parsed(row["unit"]["line"]) if row["unit"] else []
    if at >= len(found) or found[at] != texts.UNIT_MARK:
        found = []
    named = [t or f"_{i}" for i, t in enumerate(titles)]
    cells = dict(zip(named, found + [None] * len(named)))
    return Labels(row["width"], row["head"]["seq"], named, {t: cells[t] for t in named if t != mark})


def _parsed(line: str) -> list[str | None]:
    return [c or None for c in next(csv.reader([line], escapechar="\\"))]


def read_labelled(spark: SparkSession, path: str, labels: Labels) -> DataFrame:
    """Rows below the title row, named by it."""
    lines = _lines(spark, path).filter(F.col("seq") > _place(labels.place))
    cells = lines.select("seq", _cells(labels.width).alias("_cells"))
    return cells.select("seq", *[F.col(f"_cells._c{i}").alias(t) for i, t in enumerate(labels.titles)])


def _place(row: Row) -> Column:
    return F.struct(*[F.lit(row[c]).cast("string" if c == "file" else "long").alias(c) for c in ORDER])


def header_of(cells: DataFrame, mark: str = texts.INDEX_MARK) -> tuple[str, Row, list[str | None]]:
    """(column with the marker, ``seq`` of its row, the row's cells): one row read."""
    names = [c for c in cells.columns if c != "seq"]
    hit = F.lit(False)
    for c in names:
        hit = hit | F.coalesce(F.col(c) == mark, F.lit(False))
    row = cells.filter(hit).orderBy("seq").first()
    if row is None:
        raise ValueError(f"marker {mark} not found")
    column = next(c for c in names if row[c] == mark)
    return column, row["seq"], [row[c] for c in names]


def titled(cells: DataFrame, mark: str = texts.INDEX_MARK) -> DataFrame:
    """Cells with the titles of the marker row as column names; all rows stay."""
    _, _, titles = header_of(cells, mark)
    return cells.toDF("seq", *[t or f"_{i}" for i, t in enumerate(titles)])


def rows_below(named: DataFrame, mark: str = texts.INDEX_MARK) -> DataFrame:
    """Rows after the header row."""
    head = named.filter(F.col(f"`{mark}`") == mark).agg(F.min("seq")).first()[0]
    return named.filter(F.col("seq") > _place(head))


def unit_rows(named: DataFrame, mark: str = texts.INDEX_MARK) -> DataFrame:
    """``(series, unit)`` from the unit row, long."""
    series = [c for c in named.columns if c not in ("seq", mark)]
    row = named.filter(F.col(f"`{mark}`") == texts.UNIT_MARK).limit(1)
    long = row.unpivot([], [f"`{c}`" for c in series], "series", "unit")
    return long.select(F.regexp_replace("series", "`", "").alias("series"), units.spaced_unit(F.col("unit")).alias("unit"))


def typed(below: DataFrame, mark: str = texts.INDEX_MARK) -> DataFrame:
    """Index as time (text or serial number), other cells as single-precision numbers."""
    series = [c for c in below.columns if c not in ("seq", mark)]
    ts = times.parse_time_or_serial(F.col(f"`{mark}`"))
    return below.select("seq", ts.alias("ts"), *[F.col(f"`{c}`").cast("float").alias(c) for c in series])


def long_profile(wide: DataFrame) -> DataFrame:
    """Wide frame to ``(series, seq, ts, value)``, computed in double precision."""
    series = [c for c in wide.columns if c not in ("seq", "ts")]
    doubled = wide.select("seq", "ts", *[F.col(f"`{c}`").cast("double").alias(c) for c in series])
    return doubled.unpivot(["seq", "ts"], [f"`{c}`" for c in series], "series", "value").select(
        F.regexp_replace("series", "`", "").alias("series"), "seq", "ts", "value"
    )


def with_original_time(df: DataFrame) -> DataFrame:
    return df.withColumn("orgidx", F.col("ts"))
