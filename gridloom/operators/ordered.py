"""Ordered work on groups of any size.

A window over a whole series puts that series into one task. Here a table that holds a group of more than
``slice_rows`` rows is first laid out by ranges of (group, order), about ``slice_rows`` rows each, and the
number of the range is the slice of a row. Windows then run per (group, slice), and what crosses a border is
added from a small table with a row or a few per slice:

* ``near``     looks at most ``reach`` rows away: rows next to a border are computed a second time
               from the few rows around all borders,
* ``fill``     last or next known value: one carried value per slice,
* ``known``    the k-th known points before and after: the outermost known points of each slice,
* ``running``  running sum or row number: one carried total per slice.

The layout is written once and handed on: a chain of steps reads its input three times (group sizes, sample
for the borders, layout), however many steps there are. Rows with equal keys are parted by a hash of the row,
so a value that repeats is cut like any other. Groups below the limit keep the slice -1, and tables without
a larger group get the plain window plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.operators.joins import attach, lookup
from gridloom.session import pinned, slice_rows, stored

# Year 1 counted from 1970, so that slices of times are never negative.
_YEAR_ONE_SECONDS = 62_135_596_800


@dataclass(frozen=True)
class Ordered:
    """Rows of ``df`` in groups ``part``, ascending by ``order``; ``slices`` are the cut columns."""

    df: DataFrame
    part: list[str]
    order: list[str]
    slices: list[str] = field(default_factory=list)

    @property
    def inner(self) -> WindowSpec:
        return Window.partitionBy(*self.part, *self.slices).orderBy(*self.order)

    def over(self, df: DataFrame) -> Ordered:
        """The same order on a frame derived from this one (must keep group and slice columns)."""
        return replace(self, df=df)

    def result(self) -> DataFrame:
        return self.df.drop(*self.slices)

    def near(self, reach: int, build: Callable[[WindowSpec], dict[str, Column]]) -> Ordered:
        """Add columns built from a window whose frames stay within ``reach`` rows."""
        if not self.slices:
            return self.over(self.df.withColumns(build(self.inner)))
        names = self.df.columns
        size = Window.partitionBy(*self.part, *self.slices)
        tagged = self.df.withColumns(
            {"_pos": F.row_number().over(self.inner), "_len": F.count(F.lit(1)).over(size)}
        )
        pos, length = F.col("_pos"), F.col("_len")
        at_cut = (pos <= reach) | (pos > length - reach)
        around = (pos <= 2 * reach) | (pos > length - 2 * reach)
        across = Window.partitionBy(*self.part).orderBy(*self.slices, *self.order)
        inside = tagged.withColumns(build(self.inner)).filter(~at_cut)
        edges = tagged.filter(around).withColumns(build(across)).filter(at_cut)
        out = inside.unionByName(edges).drop("_pos", "_len")
        added = [c for c in out.columns if c not in names]
        return self.over(out.select(*names, *added))

    def fill(self, source: str, out: str, *, forward: bool = True) -> Ordered:
        """Add ``out``: the last (or next) non-null ``source`` seen in order, own row included."""
        # Backward is forward in falling order: a frame that starts at each row and runs to the end
        # would be read anew for every row.
        turn, best = (F.asc, F.max_by) if forward else (F.desc, F.min_by)
        ordered = [turn(c) for c in self.order]
        frame = Window.partitionBy(*self.part, *self.slices).orderBy(*ordered)
        local = F.last(source, ignorenulls=True).over(
            frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        if not self.slices:
            return self.over(self.df.withColumn(out, local))
        key = F.when(F.col(source).isNotNull(), F.struct(*self.order))
        ends = self._cut_rows().groupBy(*self.part, *self.slices).agg(best(source, key).alias("_end"))
        before = (
            Window.partitionBy(*self.part)
            .orderBy(*[turn(c) for c in self.slices])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        filled = self._carried(carry.filter(F.col("_carry").isNotNull()))
        return self.over(filled.withColumn(out, F.coalesce(local, F.col("_carry"))).drop("_carry"))

    def known(self, point: str, reach: int) -> Ordered:
        """Add the known (non-null) values of ``point`` around each row, own row left out.

        ``_before1`` .. are the nearest known ones before the row, ``_after1`` .. those behind it. All come
        from one window; when cut, each slice lends its outermost ``reach`` known points to the others.
        """
        steps = range(1, reach + 1)
        local = self.df.withColumns(_offsets(point, steps, [*self.part, *self.slices], self.order))
        if not self.slices:
            return self.over(local)
        rows = self._cut_rows()
        seen = rows.filter(F.col(point).isNotNull()).select(*self.part, *self.slices, *self.order, point)
        first, last = self.inner, Window.partitionBy(*self.part, *self.slices).orderBy(*[F.desc(c) for c in self.order])
        outer = (
            seen.withColumns({"_first": F.row_number().over(first), "_last": F.row_number().over(last)})
            .filter((F.col("_first") <= reach) | (F.col("_last") <= reach)).drop("_first", "_last")
        )
        # A mark before and one behind each slice; known points stand between them.
        marks = rows.select(*self.part, *self.slices).distinct().withColumn("_mark", F.explode(F.array(F.lit(-1), F.lit(1))))
        placed = outer.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
        found = placed.withColumns(_offsets(point, steps, self.part, [*self.slices, "_mark", *self.order])).filter("_mark <> 0")
        ends = {}
        for k in steps:
            ends[f"_b{k}"] = F.max_by(f"_before{k}", -F.col("_mark"))
            ends[f"_a{k}"] = F.max_by(f"_after{k}", "_mark")
        carry = found.groupBy(*self.part, *self.slices).agg(*[c.alias(n) for n, c in ends.items()])
        joined = self.over(local)._carried(carry.filter(F.col("_b1").isNotNull() | F.col("_a1").isNotNull()))
        out = {}
        for own, lent in (("_before", "_b"), ("_after", "_a")):
            missing = F.lit(0)
            for k in steps:
                missing = missing + F.col(f"{own}{k}").isNotNull().cast("int")
            carried = F.array(*[F.col(f"{lent}{k}") for k in steps])
            for k in steps:
                out[f"{own}{k}"] = F.coalesce(F.col(f"{own}{k}"), F.get(carried, F.lit(k - 1) - missing))
        return self.over(joined.withColumns(out).drop(*ends))

    def running(self, amount: Column, out: str) -> Ordered:
        """Add ``out``: running sum of ``amount`` in order, own row included."""
        frame = self.inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = F.sum(amount).over(frame)
        if not self.slices:
            return self.over(self.df.withColumn(out, local))
        totals = self._cut_rows().groupBy(*self.part, *self.slices).agg(F.sum(amount).alias("_sum"))
        before = (
            Window.partitionBy(*self.part)
            .orderBy(*self.slices)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = totals.withColumn("_carry", F.sum("_sum").over(before)).drop("_sum")
        summed = self._carried(carry.filter(F.col("_carry").isNotNull()))
        total = local + F.coalesce(F.col("_carry"), F.lit(0))
        return self.over(summed.withColumn(out, total).drop("_carry"))

    def number(self, out: str) -> Ordered:
        """Add ``out``: row number from 1."""
        if not self.slices:
            return self.over(self.df.withColumn(out, F.row_number().over(self.inner).cast("long")))
        return self.running(F.lit(1).cast("long"), out)

    def largest(self, amount: Column, out: str) -> Ordered:
        """Add ``out``: the largest ``amount`` of the whole group."""
        if not self.slices:
            return self.over(self.df.withColumn(out, F.max(amount).over(Window.partitionBy(*self.part))))
        tops = self.df.groupBy(*self.part).agg(F.max(amount).alias(out))
        return self.over(attach(self.df, tops, self.part))

    def _cut_rows(self) -> DataFrame:
        return self.df.filter(" OR ".join(f"{c} >= 0" for c in self.slices))

    def _carried(self, carry: DataFrame) -> DataFrame:
        # One row per slice of a cut group: as many as there are ranges. Broadcast if that is small.
        return lookup(self.df, carry, [*self.part, *self.slices])


def _offsets(point: str, steps: range, part: list[str], order: list[str]) -> dict[str, Column]:
    listed = ", ".join(f"`{c}`" for c in part), ", ".join(f"`{c}`" for c in order)
    window = f"(PARTITION BY {listed[0]} ORDER BY {listed[1]})"
    out = {}
    for k in steps:
        out[f"_before{k}"] = F.expr(f"lag(`{point}`, {k}) IGNORE NULLS OVER {window}")
        out[f"_after{k}"] = F.expr(f"lead(`{point}`, {k}) IGNORE NULLS OVER {window}")
    return out


def in_order(
    df: DataFrame | Ordered,
    part: list[str],
    order: list[str],
    *,
    at_most: int | None = None,
    sizes: tuple[int, int] | None = None,
    together: bool = False,
) -> Ordered:
    """Order ``df`` by ``order`` within ``part`` and cut the groups that are too large for a task.

    Rows that are in this order already (``Ordered``) pass as they are. A caller that knows how large a group
    can be passes it in ``at_most`` and saves the count where that is below the limit; one that has counted
    passes ``sizes``, all rows and those of the largest group. With ``together``, rows with equal keys are not parted.
    """
    if isinstance(df, Ordered):
        if (df.part, df.order) != (part, order):
            raise ValueError(f"rows are ordered by {df.part}, {df.order}, not by {part}, {order}")
        return df
    limit = slice_rows(df.sparkSession)
    if at_most is not None and at_most <= limit:
        return Ordered(df, part, order)
    total, top = sizes or group_sizes(df, part)
    if top <= limit:
        return Ordered(df, part, order)
    tie = F.lit(0) if together else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    hashed = df.withColumn("_tie", tie)
    ranges = hashed.repartitionByRange(math.ceil(total / limit), *part, *order, "_tie")
    laid = stored(ranges.withColumn("_range", F.spark_partition_id()).drop("_tie"), "ordered")
    large = pinned(
        laid.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*part, F.lit(True).alias("_cut"))
    )
    number = F.when(F.col("_cut"), F.col("_range")).otherwise(F.lit(-1))
    return Ordered(lookup(laid, large, part).withColumn("_slice", number).drop("_cut", "_range"), part, order, ["_slice"])


def on_time_slices(df: DataFrame, part: list[str], axis: str, seconds: int, top: int) -> Ordered:
    """Rows on an even time grid: slices are spans of ``slice_rows`` steps, so no border has to be looked for.

    ``top`` is the most rows a group can have. The frame is written once if it is cut.
    """
    limit = slice_rows(df.sparkSession)
    if top <= limit:
        return Ordered(df, part, [axis])
    since = F.unix_micros(F.col(axis).cast("timestamp")) / 1_000_000 + _YEAR_ONE_SECONDS
    sliced = df.withColumn("_slice", F.floor(since / (seconds * limit)).cast("long"))
    return Ordered(stored(sliced, "even"), part, [axis], ["_slice"])


def group_sizes(df: DataFrame, part: list[str]) -> tuple[int, int]:
    """Rows in all groups and in the largest one (one pre-aggregated pass, one row to the driver)."""
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("top")).first()
    return row["total"] or 0, row["top"] or 0


def largest_group(df: DataFrame, part: list[str]) -> int:
    """Rows of the largest group, for ``at_most`` where a cheaper frame with the same groups exists."""
    return group_sizes(df, part)[1]
