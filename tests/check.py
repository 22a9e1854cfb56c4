"""Run the named queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        value = float(value)
        return repr(0.0 if value == 0 else value)
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = sorted(tuple(_plain(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], plain


def kind(name: str) -> str:
    """Kind of a column type of either engine."""
    name = name.lower()
    for found, starts in {
        "whole": ("bigint", "int", "hugeint", "smallint", "tinyint", "ubigint", "uinteger", "long", "number"),
        "decimal": ("decimal",), "float": ("double", "float", "real"), "text": ("string", "varchar", "str"),
        "time": ("timestamp", "datetime"), "day": ("date",), "bool": ("bool",),
    }.items():
        if name.startswith(starts):
            return found
    return name


def differences(df, con, sql: str) -> str | None:
    result = con.execute(sql)
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    kinds = {d[0]: kind(d[1].lower() if isinstance(d[1], str) else str(d[1])) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    other = {n: (t, kinds[n]) for n, t in df.dtypes if n in kinds and kinds[n] not in (kind(t), '"null"')}
    if other:
        return f"types {other}"
    found = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if expected[0] != found[0]:
        return f"columns {found[0]} expected {expected[0]}"
    if len(expected[1]) != len(found[1]):
        return f"{len(found[1])} rows, expected {len(expected[1])}"
    bad = [(a, b) for a, b in zip(found[1], expected[1]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(folder: str, wanted: list[str]) -> None:
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    from gridloom.catalog import load

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import os

    if os.environ.get("CHECK_SLICE_ROWS"):
        spark.conf.set("gridloom.slice.rows", os.environ["CHECK_SLICE_ROWS"])
    queries, oracles = load()
    con = connect(folder)
    failed = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                problem = differences(df, con, oracles[name])
            else:
                problem = None if df.count() else "no rows"
            kinds = {n: t for n, t in df.dtypes}
        except Exception as error:  # noqa: BLE001
            problem, kinds = f"{type(error).__name__}: {str(error)[:700]}", {}
        failed += problem is not None
        state = "ok" if problem is None else "BAD"
        print(f"{state} {name} {time.time() - start:.2f}s {'' if name in oracles else 'rows only'} {problem or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
