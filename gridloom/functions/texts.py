"""Text columns: numbers as text, names and suffixes, addresses, listed phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and markers that carry meaning inside series names.
ENERGY_SUFFIX = " → Arbeit"
POWER_SUFFIX = " → Leistung"
SMOOTH_SUFFIX = " geglättet"
ORIGINAL_INDEX = "orgidx"
H_LINE = "hline"
INDEX_MARK = "↓ Index ↓"
UNIT_MARK = "→ Einheit →"

EXCLUDED = {
    "base": [H_LINE, SMOOTH_SUFFIX, ORIGINAL_INDEX],
    "index": [H_LINE, SMOOTH_SUFFIX, ORIGINAL_INDEX, INDEX_MARK],
    "suff_arbeit": [H_LINE, SMOOTH_SUFFIX, ORIGINAL_INDEX, ENERGY_SUFFIX],
}

# Name parts of series that feed into the grid and are shown negative.
FEED_IN = ["Batteriebeladung", "Einsp", "Netzeinsp", "Stromeinsp", "Lieferung", "Stromlieferung"]


def contains_any(text: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


def is_kept(series: Column, exclude: str = "index") -> Column:
    """True for series whose name holds none of the excluded parts."""
    return ~contains_any(series, EXCLUDED[exclude])


def is_feed_in(series: Column) -> Column:
    return contains_any(series, FEED_IN)


def shown_value(series: Column, value: Column) -> Column:
    """Value with the sign used for display: feed-in is negative."""
    return F.when(is_feed_in(series), -value).otherwise(value)


def without_suffix(series: Column) -> Column:
    """Name without the energy or power suffix."""
    plain = F.replace(F.replace(series, F.lit(ENERGY_SUFFIX), F.lit("")), F.lit(POWER_SUFFIX), F.lit(""))
    return F.trim(plain)


def suffix_variants(series: Column) -> Column:
    """The bare name and its two suffixed forms, for matching lines across frames."""
    bare = without_suffix(series)
    return F.array(bare, F.concat(bare, F.lit(ENERGY_SUFFIX)), F.concat(bare, F.lit(POWER_SUFFIX)))


def name_in_year(series: Column, year: Column) -> Column:
    """``x`` to ``x 2017``; an energy or power suffix stays last."""
    out = F.concat_ws(" ", series, year.cast("string"))
    for suffix in (ENERGY_SUFFIX, POWER_SUFFIX):
        head = F.substring_index(series, suffix, 1)
        out = F.when(
            series.contains(suffix), F.concat(head, F.lit(" "), year.cast("string"), F.lit(suffix))
        ).otherwise(out)
    return out


def digits_shown(value: Column) -> Column:
    """Decimal places for display: 2 below 10, 1 below 100, else 0."""
    return F.when(F.abs(value) < 10, 2).when(F.abs(value) < 100, 1).otherwise(0)


def number_text(value: Column, *, group: str = ".", point: str = ",") -> Column:
    """Number as text with three leading digits: 0, 1 or 2 decimals by size, grouped."""
    grouped = (
        F.when(F.abs(value) >= 100, F.format_number(value, 0))
        .when(F.abs(value) >= 10, F.format_number(value, 1))
        .otherwise(F.format_number(value, 2))
    )
    return F.translate(grouped, ",.", group + point)


def normal_address(address: Column) -> Column:
    """Line breaks to commas, runs of blanks to one, no blank before a comma."""
    one_line = F.regexp_replace(F.replace(address, F.lit("\n"), F.lit(", ")), r"\s+", " ")
    return F.regexp_replace(F.replace(one_line, F.lit(" ,"), F.lit(",")), r"\s+", " ")


def phrase_pattern(phrases: list[str]) -> str:
    """One case-insensitive alternation; longer phrases first so that they win over their parts."""
    listed = sorted({p for p in phrases if p}, key=len, reverse=True)
    return "(?i)" + "|".join(re.escape(p) for p in listed)


def remove_phrases(text: Column, phrases: list[str]) -> tuple[Column, Column]:
    """(text without the listed phrases, number of hits)."""
    if not any(phrases):
        return text, F.lit(0)
    pattern = phrase_pattern(phrases)
    return F.regexp_replace(text, pattern, ""), F.regexp_count(text, F.lit(pattern))
