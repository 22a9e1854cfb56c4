"""Cut groups give the same rows as whole ones."""

from __future__ import annotations

import numpy as np
import pytest
from check import rows_of
from pyspark.sql import functions as F

from gridloom.operators import clean, curves, fill, smooth, stats
from gridloom.operators.ordered import in_order
from gridloom.session import SLICE_ROWS_KEY


@pytest.fixture(scope="module")
def events(spark):
    """One series with a third of all rows, long gaps, repeated values, unevenly spread times."""
    rows = spark.range(900).withColumn("series", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)))
    minute = F.when(F.col("id") < 600, F.col("id")).otherwise(F.col("id") * F.col("id"))
    value = F.when(F.col("id") % 7 < 3, 0.0).otherwise((F.col("id") * 37 % 101).cast("double"))
    return rows.select(
        "series", F.col("id").alias("seq"),
        F.timestamp_seconds(minute * 60 + 1_700_000_000).cast("timestamp_ntz").alias("ts"),
        F.when((F.col("id") % 5 == 2) | F.col("id").between(300, 420), None).otherwise(value).alias("value"),
    ).cache()


JOBS = {
    "forward": fill.forward_fill,
    "backward": fill.backward_fill,
    "linear": fill.interpolate_linear,
    "akima": fill.akima,
    "smooth": lambda df: smooth.smoothed(df.na.fill(1.0, ["value"]), 9),
    "curve": curves.duration_curve,
    "quantile": stats.quantile_95,
    "steps": stats.step_minutes,
    "number": stats.numbered,
    "half_days": clean.fix_half_days,
    "frozen": clean.null_where_constant,
}


@pytest.mark.parametrize("name", JOBS)
@pytest.mark.parametrize("rows", [4, 50])
def test_sliced_equals_whole(spark, events, name, rows):
    def run(limit):
        spark.conf.set(SLICE_ROWS_KEY, str(limit))
        try:
            df = JOBS[name](events)
            numbers = [c for c, t in df.dtypes if t == "double"]
            df = df.withColumns({c: F.round(c, 7) for c in numbers})
            return rows_of(df.columns, [tuple(r) for r in df.collect()])
        finally:
            spark.conf.unset(SLICE_ROWS_KEY)

    assert run(rows) == run(2_000_000)


def test_slices_are_small_and_ordered(spark, events):
    spark.conf.set(SLICE_ROWS_KEY, "40")
    try:
        cut = in_order(events, ["series"], ["ts"])
        sizes = cut.df.filter("series = 'hot'").groupBy("_slice").agg(
            F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")
        ).orderBy("_slice").collect()
    finally:
        spark.conf.unset(SLICE_ROWS_KEY)
    assert len(sizes) >= 7 and max(r["n"] for r in sizes) <= 60
    assert all(x["b"] < y["a"] for x, y in zip(sizes, sizes[1:]))
    assert cut.df.filter("series <> 'hot'").select("_slice").distinct().collect()[0][0] == -1


def test_runs_of_one_value_are_cut_by_time(spark, events):
    spark.conf.set(SLICE_ROWS_KEY, "20")
    try:
        zeros = events.withColumn("_key", F.lit(0.0))
        cut = in_order(zeros, ["series"], ["_key", "ts"])
        largest = cut.df.filter("series = 'hot'").groupBy("_slice").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset(SLICE_ROWS_KEY)
    assert cut.slices == ["_slice"] and largest <= 40


def _doubled(spark):
    """A time every ten minutes; one value, three copies of it or three different ones at a time, in two series."""
    rows = spark.range(240).select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("series"), F.explode(F.sequence(F.lit(0), F.when(F.col("id") % 7 < 4, 2).otherwise(0))).alias("copy"))
    value = (F.col("id") * 37 % 41).cast("double") + F.when(F.col("id") % 7 == 3, F.col("copy").cast("double")).otherwise(0.0)
    value = F.when(F.col("id") % 6 == 5, 50.0 + F.col("copy")).when(F.col("id") % 11 > 0, value)
    ts = F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).cast("timestamp_ntz")
    return rows.select("series", ts.alias("ts"), value.alias("value"), "id").cache()


@pytest.mark.parametrize("limit", ["4", "50", "2000000"])
def test_doubled_times_make_one_knot(spark, limit):
    from scipy_free import akima_at

    rows = _doubled(spark)
    spark.conf.set(SLICE_ROWS_KEY, limit)
    try:
        out = clean.remove_outliers(rows, above=45.0).orderBy("series", "ts").collect()
    finally:
        spark.conf.unset(SLICE_ROWS_KEY)
    kept, given = {}, {}
    for r in rows.filter("series = 'a' AND value <= 45").collect():
        kept.setdefault(r["id"], []).append(r["value"])
    for r in out:
        given.setdefault((r["series"], r["id"]), []).append(r["value"])
    x = sorted(kept)
    mean = {i: sum(kept[i]) / len(kept[i]) for i in x}
    for (_, i), got in given.items():
        if i in kept:
            assert sorted(got) == sorted(kept[i])
        elif x[0] < i < x[-1]:
            assert got == pytest.approx([float(akima_at(np.array(x), np.array([mean[k] for k in x]), np.array([i]))[0])] * len(got), abs=1e-6)
        else:
            assert set(got) == {None}
    assert len(out) == rows.count()


@pytest.mark.parametrize("limit", ["40", "2000000"])
def test_outliers_by_the_default_limit_leave_doubled_times(spark, limit):
    rows = _doubled(spark).na.drop()
    spark.conf.set(SLICE_ROWS_KEY, limit)
    try:
        assert sorted(map(repr, clean.remove_outliers(rows).select(*rows.columns).collect())) == sorted(map(repr, rows.collect()))
    finally:
        spark.conf.unset(SLICE_ROWS_KEY)


@pytest.mark.parametrize("limit", ["40", "2000000"])
def test_frozen_values_of_doubled_times(spark, profile, limit):
    """Two meters in one series: the frozen stretch is filled between the means of both."""
    rows = [("a", f"2021-01-01 {h:02d}:00", v) for h in range(20) for v in ((7.0,) if 8 <= h < 12 else (2.0 * h, 2.0 * h + 1))]
    spark.conf.set(SLICE_ROWS_KEY, limit)
    try:
        out = clean.fill_where_constant(profile(rows).drop("seq")).orderBy("ts", "value").collect()
    finally:
        spark.conf.unset(SLICE_ROWS_KEY)
    assert len(out) == len(rows) and all(r["value"] is not None for r in out)
    assert [r["value"] for r in out[:3]] == [0.0, 1.0, 2.0] and out[16]["value"] == 7.0 and 7.0 < out[18]["value"] < 24.5
