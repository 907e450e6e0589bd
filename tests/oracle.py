"""Run registered queries beside their SQL twins: ``python -m tests.oracle <folder> [key ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def spark_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("headroom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Integer columns with NULLs in the one form both readers can have: floats."""
    for name in frame.columns:
        if pd.api.types.is_extension_array_dtype(frame[name].dtype) and frame[name].dtype.kind in "iuf":
            frame[name] = frame[name].astype("float64")
    return frame


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = plain(frame[sorted(frame.columns)].copy())
    for name in frame.columns:
        kind = frame[name].dtype.kind
        if kind in "iub":
            frame[name] = frame[name].astype("int64")
        elif kind == "f":
            frame[name] = frame[name].astype("float64") + 0.0
        else:
            frame[name] = frame[name].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when the two results are equal as sets of rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if len(got) == 0:
        return "no rows"
    got, want = plain(got), plain(want)
    kinds = {c: (got[c].dtype, want[c].dtype) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind}
    if kinds:
        return f"types {kinds}"
    a, b = canonical(got), canonical(want)
    for name in a.columns:
        unequal = ~((a[name] == b[name]) | (a[name].isna() & b[name].isna()))
        if unequal.any():
            i = unequal.idxmax()
            return f"{name}: {int(unequal.sum())} rows differ, first\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return None


def check(
    spark: SparkSession, con, folder: str, key: str, queries, twins, inspect=None
) -> tuple[str | None, int, float, float]:
    started = time.time()
    frame = queries[key](spark, folder)
    got = frame.toPandas()
    spark_s = time.time() - started
    if inspect:
        inspect(frame)
    if key not in twins:
        return (None if len(got) else "no rows"), len(got), spark_s, 0.0
    started = time.time()
    want = con.execute(twins[key]).df()
    return differences(got, want), len(got), spark_s, time.time() - started


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    folder, keys = sys.argv[1], sys.argv[2:]
    queries, twins = entry.queries(), entry.oracle_sql()
    spark, con = spark_session(), connect(folder)
    failed = 0
    for key in keys or queries:
        try:
            problem, rows, spark_s, sql_s = check(spark, con, folder, key, queries, twins)
        except Exception as error:  # noqa: BLE001
            problem, rows, spark_s, sql_s = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0.0, 0.0
        mark = "FAIL" if problem else ("ok" if key in twins else "rows")
        failed += bool(problem)
        print(f"{mark:5}{key:28}{rows:8} rows  spark {spark_s:6.2f}s  sql {sql_s:6.2f}s", flush=True)
        if problem:
            print("     ", problem, flush=True)
    print("failed:", failed, "of", len(keys or queries), "twins:", len(twins))
    return failed


if __name__ == "__main__":
    sys.exit(main())
