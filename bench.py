"""Time the named queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridloom.catalog import load
from gridloom.session import SLICE_ROWS_KEY

HEADLINE = [
    "a1_hourly_mean", "a2_monthly_values", "a3_downsample_hour", "a4_upsample_quarter_hour",
    "a7_quantile_nearest", "a11_step_minutes", "c2_first_of_duplicates", "c4_half_day_clock",
    "c5_half_day_meter", "c6_frozen_values", "f2_forward_fill", "f4_linear_by_row", "f6_akima",
    "f7_savitzky_golay", "f10_duration_curve", "f11_duration_curve_by_year", "g2_profile_with_temperature",
    "g3_combined_parameters", "g6_nearest_station_with_data", "g7_coordinates_of_addresses",
    "g10_obis_lookup", "j18_listed_phrases", "m3_energy_and_power", "m8_split_years", "s2_sheet_import",
]
#: The same query with series that are cut into ranges of so many rows; named with the suffix.
CUT, CUT_ROWS = "@cut", "5000"
HEADLINE_CUT = [f"f6_akima{CUT}", f"f10_duration_curve{CUT}"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = load()[0]
    wanted = sys.argv[1:] or HEADLINE + HEADLINE_CUT
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # warm up
    seconds = {}
    for name in wanted:
        if name.endswith(CUT):
            spark.conf.set(SLICE_ROWS_KEY, CUT_ROWS)
        start = time.perf_counter()
        run[name.removesuffix(CUT)](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.conf.unset(SLICE_ROWS_KEY)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
