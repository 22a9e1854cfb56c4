"""Time columns: parsing, serial numbers, calendar moves. Zone-free; run with session zone UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_FORMAT = "dd.MM.yyyy HH:mm"
OVERLAY_YEAR = 2020  # leap year, so that 29 February keeps its day


def parse_time(text: Column, pattern: str = MINUTE_FORMAT) -> Column:
    """Text as ``dd.MM.yyyy HH:mm`` to a time; null if it does not fit."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def format_time(ts: Column, pattern: str = MINUTE_FORMAT) -> Column:
    return F.date_format(ts, pattern)


def serial_to_time(days: Column) -> Column:
    """Spreadsheet serial number (days since 1899-12-30) to a time, to the microsecond."""
    micros = F.round(days.cast("double") * 86_400_000_000).cast("long")
    return F.timestamp_micros(micros - 2_209_161_600_000_000).cast("timestamp_ntz")


def parse_time_or_serial(text: Column, pattern: str = MINUTE_FORMAT) -> Column:
    """Per cell: the time format first, else a serial number, else null."""
    return F.coalesce(parse_time(text, pattern), serial_to_time(text.try_cast("double")))


def micros(ts: Column) -> Column:
    """Time as whole microseconds since 1970, exact."""
    return F.unix_micros(ts.cast("timestamp"))


def _moved(ts: Column, year: Column, month: Column, day: Column) -> Column:
    second = F.date_part(F.lit("second"), ts)
    return F.make_timestamp_ntz(year, month, day, F.hour(ts), F.minute(ts), second)


def on_overlay_year(ts: Column) -> Column:
    return _moved(ts, F.lit(OVERLAY_YEAR), F.month(ts), F.dayofmonth(ts))


def on_overlay_day(ts: Column) -> Column:
    """Time of day on 2020-01-01."""
    return _moved(ts, F.lit(OVERLAY_YEAR), F.lit(1), F.lit(1))


def on_mid_month(ts: Column) -> Column:
    return _moved(ts, F.year(ts), F.month(ts), F.lit(15))


def start_of_month(ts: Column) -> Column:
    """First day of the month, time of day kept."""
    return _moved(ts, F.year(ts), F.month(ts), F.lit(1))


def end_of_month(ts: Column) -> Column:
    """Last day of the month, time of day kept."""
    return _moved(ts, F.year(ts), F.month(ts), F.dayofmonth(F.last_day(ts)))


def floor_to(ts: Column, step: str) -> Column:
    """Start of the 15m, 1h, 1d or 1mo bucket of a time."""
    if step == "15m":
        size = 15 * 60 * 1_000_000
        return F.timestamp_micros(micros(ts) - F.pmod(micros(ts), F.lit(size))).cast("timestamp_ntz")
    unit = {"1h": "hour", "1d": "day", "1mo": "month"}[step]
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def iso_weekday(ts: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(ts) + 1


def without_zone(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def seconds_of_year(ts: Column, first: Column) -> Column:
    """Seconds since the start of the year of ``first``."""
    start = F.date_trunc("year", first).cast("timestamp_ntz")
    return F.floor((micros(ts) - micros(start)) / 1_000_000).cast("long")


# Step limits in minutes and the weather resolution below each limit.
STEP_RESOLUTIONS = [
    (5, "minute_1"),
    (10, "minute_5"),
    (60, "minute_10"),
    (1440, "hourly"),
    (40320, "daily"),
]


def step_resolution(minutes: Column) -> Column:
    """Weather resolution for a mean step in minutes; monthly from 28 days on."""
    out = F.lit("monthly")
    for limit, name in reversed(STEP_RESOLUTIONS):
        out = F.when(minutes < limit, F.lit(name)).otherwise(out)
    return out
