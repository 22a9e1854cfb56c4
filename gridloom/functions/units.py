"""Unit rules: which units are averaged, hourly units, energy and power counterparts, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units that are always averaged, and units summed only in monthly values.
MEAN_ALWAYS = ["°C", "K", "m³", "m³/h", "pa/m", "Pa/m", "m/s", "%", "pct", "rad", "°"]
SUM_MONTH = ["W", "kW", "MW"]
MEAN_ALL = [*MEAN_ALWAYS, *SUM_MONTH]
ENERGY_UNITS = ["GWh", "MWh", "kWh", "Wh"]
POWER_UNITS = ["GW", "MW", "kW", "W"]
RULES = {"mean_always": MEAN_ALWAYS, "sum_month": SUM_MONTH, "mean_all": MEAN_ALL}

# Fixed value: J/cm² in an hour as W/m².
JOULE_CM2_TO_WATT_M2 = 2.778


def in_group(unit: Column, rule: str) -> Column:
    """True if the unit belongs to the rule's group; a missing unit never does."""
    names = sorted({u.strip().lower() for u in RULES[rule]})
    return F.coalesce(F.lower(F.trim(unit)).isin(names), F.lit(False))


def spaced_unit(unit: Column) -> Column:
    """Trimmed unit with one leading blank; missing or empty stays as it is."""
    return F.when(F.length(unit) > 0, F.concat(F.lit(" "), F.trim(unit))).otherwise(unit)


def hourly_unit(unit: Column) -> Column:
    """Unit without ``h`` at either end."""
    return F.trim(unit, F.lit("h"))


def counterpart_unit(unit: Column, kind: Column) -> Column:
    """Unit of the other kind: energy loses its last character, power gains ``h``."""
    energy = F.coalesce(unit, F.lit(" kWh"))
    power = F.coalesce(unit, F.lit(" kW"))
    return F.when(kind == "Arbeit", F.substring(energy, F.lit(1), F.length(energy) - 1)).otherwise(
        F.concat(power, F.lit("h"))
    )


def shown_unit(unit: Column, unit_h: Column, frame: Column) -> Column:
    """Unit for display by frame: raw data its own, others hourly, monthly power gains ``h``."""
    monthly = F.when(in_group(unit_h, "sum_month"), F.concat(unit_h, F.lit("h"))).otherwise(unit_h)
    return F.when(frame == "raw", unit).when(frame == "monthly", monthly).otherwise(unit_h)


def power_density(value: Column, unit: Column) -> Column:
    """J/cm² to W/m²; other units unchanged."""
    is_joule = F.lower(F.replace(unit, F.lit(" "), F.lit(""))).contains("j/cm**2")
    return F.when(is_joule, value * JOULE_CM2_TO_WATT_M2).otherwise(value)


def number_format(size: Column, unit: Column, *, small: str) -> Column:
    """Number format from a typical size; ``small`` is the format below 10, unit included."""
    quoted = F.concat(F.lit('"'), F.coalesce(unit, F.lit("")), F.lit('"'))
    big = F.abs(size)
    below = F.concat(F.lit(small), quoted) if small == "#,##0.000" else F.concat(
        F.lit(small), F.coalesce(unit, F.lit(""))
    )
    return (
        F.when(big >= 1000, F.concat(F.lit("#,##0"), quoted))
        .when(big >= 100, F.concat(F.lit("#,##0.0"), quoted))
        .when(big >= 10, F.concat(F.lit("#,##0.00"), quoted))
        .otherwise(below)
    )
