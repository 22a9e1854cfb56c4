"""Joins with a table that has one row per key, safe for keys of any frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import pinned

BROADCAST_ROWS = 100_000
FREQUENT_ROWS = 100_000
SALTS = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if the frame has at most ``rows`` rows; reads no more than that many plus one."""
    return df.limit(rows + 1).count() <= rows


def attach(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a table that is itself aggregated from the data (one row per key).

    Its size is known only at run time, so the choice is left to adaptive execution: it broadcasts
    the right side if it turns out small, and splits a key that is too frequent if not. Counting it
    beforehand would run everything below it twice.
    """
    return left.join(right, on, how)


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join each row of ``left`` with its only match in ``right``.

    A right side of checked size is broadcast. A larger one is shuffled and merged, also where Spark takes its size
    for small. Keys that are too frequent on the left are spread over ``SALTS`` tasks, and only those repeat on the
    right; there are at most as many as ``FREQUENT_ROWS`` goes into the rows of ``left``.
    """
    if is_small(right):
        return left.join(F.broadcast(right), on, how)
    counts = left.na.drop(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    frequent = pinned(counts.filter(F.col("_n") > FREQUENT_ROWS).select(*on, F.lit(True).alias("_frequent")))
    none = F.lit(False)
    for c in on:
        none = none | F.col(f"`{c}`").isNull()  # matches nothing, wherever it goes
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)).cast("int")
    spread = left.join(F.broadcast(frequent), on, "left").withColumn("_salt", F.when(F.col("_frequent") | none, salt).otherwise(0)).drop("_frequent")
    salts = F.when(F.col("_frequent"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(F.broadcast(frequent), on, "left").withColumn("_salt", F.explode(salts)).drop("_frequent")
    return spread.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")
