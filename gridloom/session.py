"""Session settings the library reads: slice size, checkpoint folder, scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SLICE_ROWS_KEY = "gridloom.slice.rows"
SLICE_ROWS = 2_000_000


def slice_rows(spark: SparkSession) -> int:
    """Rows of one group that a single task may order; larger groups are cut into slices."""
    return int(spark.conf.get(SLICE_ROWS_KEY, str(SLICE_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, reachable by every executor."""
    return f"{shared_folder(spark).rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: its plan is not run again, executors may go."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small constant table as VALUES, known to the optimizer with its size."""

    def literal(x):
        if x is None:
            return "CAST(NULL AS STRING)"
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)

    listed = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({columns})")


def pinned(df: DataFrame) -> DataFrame:
    """Fix the content of a small table that must not change between two reads of a plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
