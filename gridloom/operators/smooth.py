"""Savitzky-Golay smoothing (Anal. Chem. 36, 1964) with mirrored ends."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions import texts
from gridloom.operators.ordered import in_order
from gridloom.session import stored

DEGREE = 3


def coefficients(window: int, degree: int = DEGREE) -> list[float]:
    """Weights of a local polynomial fit at the middle of an odd window."""
    if window % 2 == 0 or window <= degree:
        raise ValueError("the window must be odd and longer than the degree")
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1, dtype=float), degree + 1, increasing=True)
    return [float(c) for c in np.linalg.pinv(powers)[0]]


def polynomial(window: int, degree: int = DEGREE) -> list[float]:
    """The same weights as a polynomial of distance / half window: factors by rising power."""
    if window % 2 == 0 or window <= degree:
        raise ValueError("the window must be odd and longer than the degree")
    half = window // 2
    even = np.arange(0, degree + 1, 2)
    # The weight at distance k is a polynomial in k of even powers: the first row of the inverse normal matrix.
    steps = np.arange(-half, half + 1, dtype=float) / (half or 1)
    sums = np.array([[np.sum(steps ** (a + b)) for b in even] for a in even])
    factors = np.linalg.solve(sums, np.eye(len(even))[0])
    out = [0.0] * (degree + 1)
    for power, factor in zip(even, factors):
        out[power] = float(factor)
    return out


def default_windows(lengths: DataFrame) -> DataFrame:
    """Largest and starting window for the longest series: a third of its rows, and a fifth of that."""
    third = F.floor(F.max("n") / 3).cast("long")
    widest = lengths.agg(third.alias("m")).select((F.col("m") + (F.col("m") % 2 == 0).cast("long")).alias("max_window"))
    fifth = F.floor(F.col("max_window") / 5).cast("long")
    return widest.withColumn("start_window", fifth + (fifth % 2 == 0).cast("long"))


def smoothed(df: DataFrame, window: int, degree: int = DEGREE) -> DataFrame:
    """Add ``smoothed`` per series; at the ends the series is mirrored without repeating the end row.

    The weights are a polynomial of the distance to the middle, so a smoothed value is a sum of moving moments
    of the values. Those come from running sums that start anew every ``window`` rows, with places counted from
    there: a window covers the end of one block and the beginning of the next, so it takes one sum from either.
    The cost is rows x degree, whatever the window, and the numbers stay small.

    A window that holds a null, NaN or infinite value gives NaN. A series needs more rows than half a window,
    else the result is null.
    """
    half = window // 2
    weights = polynomial(window, degree)
    kept = df.filter(texts.is_kept(F.col("series")))
    numbered = in_order(kept, ["series"], ["ts"]).number("_row")
    rows = numbered.largest(F.col("_row"), "_n")
    if numbered.slices:
        rows = rows.over(stored(rows.df, "numbered"))
    names = rows.df.columns
    place, last = F.col("_row") - 1, F.col("_n") - 1
    mirrored = F.array(
        place, F.when((place >= 1) & (place <= half), -place), F.when((place < last) & (place >= last - half), 2 * last - place)
    )
    # Places from 0 in the lengthened series, in blocks of one window.
    spread = rows.df.filter(F.col("_n") > half).withColumn("_at", F.explode(F.filter(mirrored, lambda x: x.isNotNull())))
    value = F.col("value")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    at = F.col("_at") + half
    spread = spread.withColumns({
        "_at": at, "_block": F.floor(at / window), "_u": (at % window - half) / F.lit(float(half or 1)),
        "_y": F.when(bad, F.lit(0.0)).otherwise(value), "_bad": bad.cast("int"), "_own": F.col("_at") == place,
    })
    block = Window.partitionBy("series", "_block")
    sums = {}
    for name, order in (("_from_start", F.asc("_at")), ("_to_end", F.desc("_at"))):
        frame = block.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        moments = [F.sum(F.col("_y") * F.pow("_u", F.lit(k))).over(frame).alias(f"m{k}") for k in range(len(weights))]
        sums[name] = F.struct(*moments, F.sum("_bad").over(frame).alias("bad"))
    summed = spread.withColumns(sums)
    if numbered.slices:
        moved = _by_place(summed, names, half)
    else:
        along = Window.partitionBy("series").orderBy("_at")
        moved = summed.withColumns({
            "_left": F.lag("_to_end", half).over(along), "_right": F.lead("_from_start", half).over(along),
            "_left_block": F.lag("_block", half).over(along),
        }).filter("_own")
    made = moved.withColumn("smoothed", _fitted(weights, window, half))
    out = [c for c in names if c not in ("_row", "_n")]
    short = rows.df.filter(F.col("_n") <= half).withColumn("smoothed", F.lit(None).cast("double"))
    return made.select(*out, "smoothed").unionByName(short.select(*out, "smoothed")).drop(*numbered.slices)


def _by_place(summed: DataFrame, names: list[str], half: int) -> DataFrame:
    """The sums ``half`` rows before and behind each row, sent there by number: no task needs a whole series."""
    empty = F.lit(None).cast(summed.schema["_to_end"].dataType)
    row = F.struct(*[F.col(f"`{c}`") for c in [*names, "_block", "_at"]])
    parts = F.array(
        F.struct(F.col("_at").alias("to"), F.when(F.col("_own"), row).alias("row"), empty.alias("left"), empty.alias("right"), F.lit(None).cast("long").alias("block")),
        F.struct((F.col("_at") + half).alias("to"), F.lit(None).cast(_row_type(summed, [*names, "_block", "_at"])).alias("row"), F.col("_to_end").alias("left"), empty.alias("right"), F.col("_block").alias("block")),
        F.struct((F.col("_at") - half).alias("to"), F.lit(None).cast(_row_type(summed, [*names, "_block", "_at"])).alias("row"), empty.alias("left"), F.col("_from_start").alias("right"), F.lit(None).cast("long").alias("block")),
    )
    sent = summed.select(F.col("series").alias("_series"), F.inline(parts))
    met = sent.groupBy("_series", "to").agg(
        F.first("row", ignorenulls=True).alias("row"), F.first("left", ignorenulls=True).alias("_left"),
        F.first("right", ignorenulls=True).alias("_right"), F.first("block", ignorenulls=True).alias("_left_block"),
    )
    return met.filter("row IS NOT NULL").select("row.*", "_left", "_right", "_left_block")


def _row_type(df: DataFrame, names: list[str]) -> StructType:
    return StructType([df.schema[c] for c in names])


def _fitted(weights: list[float], window: int, half: int) -> Column:
    """Sum of weights times moments, moved from the middles of the two blocks to the middle of the window."""
    unit = float(half or 1)
    middle = F.col("_at")
    whole = F.col("_left_block") * window == middle - half  # the window is the block
    total = F.lit(0.0)
    for p, weight in enumerate(weights):
        if not weight:
            continue
        for side, block in (("_left", F.col("_left_block")), ("_right", F.floor((middle + half) / window))):
            # (t - middle) = (t - centre) + (centre - middle)
            shift = (block * window + half - middle) / F.lit(unit)
            moment = F.lit(0.0)
            for q in range(p + 1):
                moment = moment + math.comb(p, q) * F.pow(shift, F.lit(p - q)) * F.col(side)[f"m{q}"]
            part = weight * moment
            total = total + (F.when(whole, F.lit(0.0)).otherwise(part) if side == "_right" else part)
    bad = F.col("_left.bad") + F.when(whole, F.lit(0)).otherwise(F.col("_right.bad"))
    return F.when(bad > 0, F.lit(float("nan"))).otherwise(total)


def smoothed_lines(df: DataFrame, window: int, degree: int = DEGREE) -> DataFrame:
    """Smoothed values as series of their own, named with the suffix."""
    rows = smoothed(df, window, degree)
    name = F.concat(F.col("series"), F.lit(texts.SMOOTH_SUFFIX))
    return rows.select(name.alias("series"), "ts", F.col("smoothed").alias("value"))
