"""Series metadata as a table: ``(series, orig_tit, tit, unit, unit_h, obis)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import obis, texts, units
from gridloom.operators.joins import lookup
from gridloom.operators.stats import step_minutes
from gridloom.session import stored


def series_meta(units_of: DataFrame) -> DataFrame:
    """One row per series from ``(series, unit)``."""
    unit = units.spaced_unit(F.col("unit"))
    return units_of.select(
        "series", original_index_name(F.col("series")).alias("name_orgidx"),
        F.col("series").alias("orig_tit"), F.col("series").alias("tit"),
        unit.alias("unit"), units.hourly_unit(unit).alias("unit_h"),
    )


def original_index_name(series: Column) -> Column:
    """Name of the column with the original times of a series."""
    suffix = f" - {texts.ORIGINAL_INDEX}"
    return F.when(series.contains(suffix), series).otherwise(F.concat(series, F.lit(suffix)))


def with_obis(titles: DataFrame, title: str = "title") -> DataFrame:
    """Add code, quantity, kind, unit and names for titles that hold a known OBIS code."""
    quantities, kinds = obis.catalogue(titles.sparkSession)
    code = obis.code_of(F.col(title))
    quantity, kind = obis.code_parts(code)
    coded = titles.withColumns({"code": code, "obis_quantity": quantity, "obis_kind": kind})
    # Fixed tables of 84 and 46 rows.
    joined = coded.join(F.broadcast(quantities), "obis_quantity", "left").join(
        F.broadcast(kinds), "obis_kind", "left"
    )
    name = F.concat("short_name", F.lit(" ("), "code", F.lit(")"))
    long_name = F.concat(
        "quantity", F.lit(" ["), "obis_unit", F.lit("] - "), "kind", F.lit(" ("), "code", F.lit(")")
    )
    return joined.withColumns(
        {"medium": F.when(F.col("kind").isNotNull(), F.lit(obis.MEDIUM)), "obis_name": name,
         "long_name": long_name}
    )


def known_obis(titles: DataFrame, title: str = "title") -> DataFrame:
    return with_obis(titles, title).filter(F.col("quantity").isNotNull() & F.col("kind").isNotNull())


def unknown_obis(titles: DataFrame, title: str = "title") -> DataFrame:
    """Titles with a code that is not in the catalogue."""
    coded = with_obis(titles, title).filter(F.col("code").isNotNull())
    return coded.filter(F.col("quantity").isNull() | F.col("kind").isNull())


def obis_names(meta: DataFrame) -> DataFrame:
    """Series with an OBIS code in their name take its name; a missing unit is taken from the code."""
    found = with_obis(meta, "series")
    known = F.col("quantity").isNotNull() & F.col("kind").isNotNull()
    unit = F.when(
        known & (F.coalesce(F.length("unit"), F.lit(0)) == 0),
        F.concat(F.lit(" "), F.col("obis_unit")),
    ).otherwise(F.col("unit"))
    name = F.when(known, F.col("obis_name")).otherwise(F.col("series"))
    tit = F.when(known, F.col("obis_name")).otherwise(F.col("tit"))
    return found.select(
        F.col("series").alias("old_series"), name.alias("series"),
        original_index_name(name).alias("name_orgidx"), "orig_tit", tit.alias("tit"),
        unit.alias("unit"), units.hourly_unit(unit).alias("unit_h"),
        F.when(known, F.col("code")).alias("obis"),
    )


def energy_and_power(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Counterparts for 15-minute energy and power series: x4 from energy, /4 from power.

    Series of other steps, with other units or already with a suffix pass unchanged. Adds ``unit``.
    """
    steps = step_minutes(df).select("series", "td_interval")
    unit = F.trim(F.coalesce("unit", F.lit("")))
    suffixed = texts.contains_any(F.col("series"), [texts.ENERGY_SUFFIX, texts.POWER_SUFFIX])
    kind = F.when(unit.isin(units.ENERGY_UNITS), F.lit("Arbeit")).when(
        unit.isin(units.POWER_UNITS), F.lit("Leistung")
    )
    kinds = meta.select("series", "unit").join(steps, "series").select(
        "series", "unit", F.when(~suffixed & (F.col("td_interval") == "15min"), kind).alias("_kind")
    )
    rows = lookup(df, stored(kinds, "kinds"), ["series"])
    return rows.withColumn("_pair", F.explode(_pair())).select(
        F.col("_pair.series").alias("series"), "ts", F.col("_pair.value").alias("value"),
        F.col("_pair.unit").alias("unit"),
    )


def _pair() -> Column:
    """The row itself (renamed) and its counterpart, or only the row."""
    series, value, unit, kind = F.col("series"), F.col("value"), F.col("unit"), F.col("_kind")
    energy = kind == "Arbeit"

    def entry(name, number, of):
        return F.struct(name.alias("series"), number.alias("value"), of.alias("unit"))

    own = F.when(energy, F.concat(series, F.lit(texts.ENERGY_SUFFIX))).otherwise(
        F.concat(series, F.lit(texts.POWER_SUFFIX))
    )
    other = F.when(energy, F.concat(series, F.lit(texts.POWER_SUFFIX))).otherwise(
        F.concat(series, F.lit(texts.ENERGY_SUFFIX))
    )
    counter = entry(
        other, F.when(energy, value * 4).otherwise(value / 4), units.counterpart_unit(unit, kind)
    )
    return F.when(kind.isNull(), F.array(entry(series, value, unit))).otherwise(
        F.array(entry(own, value, unit), counter)
    )


def counterpart_meta(meta: DataFrame) -> DataFrame:
    """Metadata of the counterpart of each energy or power series."""
    unit = F.trim(F.coalesce("unit", F.lit("")))
    kind = F.when(unit.isin(units.ENERGY_UNITS), F.lit("Arbeit")).when(
        unit.isin(units.POWER_UNITS), F.lit("Leistung")
    )
    suffix = F.when(kind == "Arbeit", F.lit(texts.POWER_SUFFIX)).otherwise(F.lit(texts.ENERGY_SUFFIX))
    suffixed = texts.contains_any(F.col("series"), [texts.ENERGY_SUFFIX, texts.POWER_SUFFIX])
    return meta.filter(kind.isNotNull() & ~suffixed).select(
        F.concat("series", suffix).alias("series"), units.counterpart_unit(F.col("unit"), kind).alias("unit")
    )


def copied(meta: DataFrame, names: DataFrame) -> DataFrame:
    """Copies under new names ``(series, new_series)``: own name and titles, the rest from the source."""
    rows = names.join(meta, "series")
    rest = [c for c in meta.columns if c not in ("series", "name_orgidx", "orig_tit", "tit")]
    new = F.col("new_series")
    return rows.select(
        new.alias("series"), original_index_name(new).alias("name_orgidx"),
        new.alias("orig_tit"), new.alias("tit"), *rest,
    )


def with_weather_lines(meta: DataFrame, parameters: DataFrame) -> DataFrame:
    """Metadata with a row per added weather series ``(name_de, unit)``; a line that is there already stays."""
    lines = series_meta(parameters.select(F.col("name_de").alias("series"), "unit"))
    return meta.unionByName(lines.join(meta.select("series"), "series", "left_anti"), allowMissingColumns=True)


def unit_of_series(meta: DataFrame) -> DataFrame:
    return meta.select("series", "unit")


def with_unit(df: DataFrame, meta: DataFrame) -> DataFrame:
    return lookup(df, meta.select("series", "unit"), ["series"])


def shown_units(meta: DataFrame) -> DataFrame:
    """Display unit of each series in the raw, hourly and monthly frame."""
    frames = F.explode(F.array(F.lit("raw"), F.lit("hourly"), F.lit("monthly"))).alias("frame")
    spread = meta.select("series", "unit", "unit_h", frames)
    shown = units.shown_unit(F.col("unit"), F.col("unit_h"), F.col("frame"))
    return spread.select("series", "frame", shown.alias("unit"))
