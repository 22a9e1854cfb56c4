"""Fills and interpolation inside a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.times import micros
from gridloom.operators.ordered import Ordered, in_order


def forward_fill(df: DataFrame | Ordered, out: str = "value") -> DataFrame:
    return _filled(df, out, forward=True)


def backward_fill(df: DataFrame | Ordered, out: str = "value") -> DataFrame:
    return _filled(df, out, forward=False)


def _filled(df: DataFrame | Ordered, out: str, *, forward: bool) -> DataFrame:
    rows = in_order(df, ["series"], ["ts"]).fill("value", "_filled", forward=forward).result()
    return rows.withColumn(out, F.col("_filled")).drop("_filled")


def linear_by_row(rows: Ordered, source: str, out: str) -> Ordered:
    """Straight line over the row number between known values; null outside of them."""
    numbered = rows.number("_row")
    point = F.when(F.col(source).isNotNull(), F.struct(F.col("_row").alias("r"), F.col(source).alias("v")))
    marked = numbered.over(numbered.df.withColumn("_point", point))
    both = marked.fill("_point", "_a").fill("_point", "_b", forward=False)
    a, b = F.col("_a"), F.col("_b")
    share = (F.col("_row") - a["r"]) / F.nullif(b["r"] - a["r"], F.lit(0))
    line = F.coalesce(F.col(source), a["v"] + (b["v"] - a["v"]) * share)
    return both.over(both.df.withColumn(out, line).drop("_row", "_point", "_a", "_b"))


def interpolate_linear(df: DataFrame | Ordered) -> DataFrame:
    rows = linear_by_row(in_order(df, ["series"], ["ts"]), "value", "_line").result()
    return rows.withColumn("value", F.col("_line")).drop("_line")


def akima(
    df: DataFrame | Ordered, part: list[str] | None = None, axis: str = "ts", at_most: int | None = None, *, joint: bool = False
) -> DataFrame:
    """Fill null values by Akima's local cubic (J. ACM 17, 1970); null outside the known values.

    Known values stay. Knots are the known values of each series; a time axis counts in seconds. Two known
    values at one time are refused with the name of the series, or with ``joint`` make one knot, their mean.
    """
    return akima_rows(in_order(df, part or ["series"], [axis], at_most=at_most, together=joint), joint=joint).result()


def akima_rows(rows: Ordered, *, joint: bool = False) -> Ordered:
    """The same for rows in order: three known points on both sides of each row decide its curve, so one window
    finds all that a gap needs, however long it is. With ``joint``, rows of one time must lie in one slice."""
    axis = rows.order[0]
    on_time = "timestamp" in dict(rows.df.dtypes)[axis]
    x = micros(F.col(axis)) if on_time else F.col(axis).cast("double")
    unit = "1e6D" if on_time else "1D"
    names = rows.df.columns
    value = F.expr("if(isnan(value), null, value)")
    known, height = value.isNotNull(), value
    if joint:
        # The first row of a time stands for all of it. Equal values keep their exact height.
        peers = rows.inner.rangeBetween(Window.currentRow, Window.currentRow)
        low, high = F.min(value).over(peers), F.max(value).over(peers)
        height = F.when(low == high, low).otherwise(F.avg(value).over(peers))
        before = F.lag(axis).over(rows.inner)
        known = height.isNotNull() & ~F.coalesce(before == F.col(axis), F.lit(False))
    point = F.when(known, F.struct(x.alias("x"), height.alias("y")))
    near = rows.over(rows.df.withColumns({"value": value, "_x": x, "_point": point})).known("_point", 3)
    # Six points with five slopes around the piece a row lies in; a known row starts its own piece.
    own, gap = F.col("_point"), F.col("_point").isNull()
    before = [F.col(f"_before{k}") for k in (1, 2, 3)]
    after = [F.col(f"_after{k}") for k in (1, 2, 3)]
    left = F.when(gap, before[0]).otherwise(own)
    points = [F.when(gap, before[2]).otherwise(before[1]), F.when(gap, before[1]).otherwise(before[0]), left, *after]
    named = {f"_p{k}": p for k, p in enumerate(points)}
    slopes = {
        f"_s{k}": F.expr(f"(_p{k + 1}.y - _p{k}.y) / (nullif(_p{k + 1}.x - _p{k}.x, 0) / {unit})") for k in range(5)
    }
    series = F.concat_ws(", ", *[F.col(f"`{c}`").cast("string") for c in rows.part])
    doubled = ~gap & (F.col("_before1.x") == F.col("_x"))
    message = F.concat(F.lit("two values of series "), series, F.lit(" at "), F.col(f"`{axis}`").cast("string"), F.lit(": clean doubled times first"))
    checked = near.df.withColumn("value", F.when(doubled, F.raise_error(message).cast("double")).otherwise(F.col("value")))
    curves = checked.withColumns(named).drop(*[f"_{side}{k}" for side in ("before", "after") for k in (1, 2, 3)])
    curves = curves.withColumns(slopes)
    curves = curves.withColumns({
        "_here": F.expr(SLOPES.format(a="_s0", b="_s1", c="_s2", d="_s3")),
        "_there": F.expr(SLOPES.format(a="_s1", b="_s2", c="_s3", d="_s4")),
    })
    weight = F.when(~gap, F.expr("abs(_here.d - _here.c) + abs(_here.b - _here.a)"))
    topped = near.over(curves).largest(weight, "_top")
    start = topped.df.withColumns({"_t0": F.expr(TANGENT.format(m="_here")), "_t1": F.expr(TANGENT.format(m="_there"))})
    curve = F.expr(CUBIC.format(h=f"((_p3.x - _p2.x) / {unit})", d=f"((_x - _p2.x) / {unit})"))
    return topped.over(start.withColumn("value", F.coalesce("value", curve)).select(*names))


# The cubic between two knots, from the slope between them and the tangents at both.
CUBIC = (
    "_p2.y + {d} * (_t0 + {d} * ((3 * _s2 - 2 * _t0 - _t1) / {h} + {d} * (_t0 + _t1 - 2 * _s2) / ({h} * {h})))"
)
# Two slopes before and two after a knot, named from far before (a) to far behind (d). Missing ones
# continue the line of the two next to them; with two knots in all there is only one slope.
SLOPES = """struct(
    coalesce({a}, if({b} is null, 3 * {c} - 2 * {d}, 2 * {b} - {c}), {b}, {c}) AS a,
    coalesce({b}, 2 * {c} - {d}, {c}) AS b,
    coalesce({c}, 2 * {b} - {a}, {b}) AS c,
    coalesce({d}, if({c} is null, 3 * {b} - 2 * {a}, 2 * {c} - {b}), {c}, {b}) AS d)"""
TANGENT = (
    "if(abs({m}.d - {m}.c) + abs({m}.b - {m}.a) > 1e-9D * _top,"
    " (abs({m}.d - {m}.c) * {m}.b + abs({m}.b - {m}.a) * {m}.c)"
    " / nullif(abs({m}.d - {m}.c) + abs({m}.b - {m}.a), 0D), ({m}.d + {m}.a) / 2)"
)
