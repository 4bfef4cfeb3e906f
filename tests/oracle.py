"""Run registered queries on Spark and their SQL twins on DuckDB and compare the rows.

    python tests/oracle.py [name-prefix ...]     (ORACLE_SF_DIR sets the data folder, ORACLE_PLAIN=1 takes
                                                  a session with Spark's own defaults)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NaT or value is pd.NA:
        return ""
    if isinstance(value, (bool, np.bool_)):
        return f"b{bool(value)}"
    if isinstance(value, (int, np.integer)):
        return f"n{float(value)!r}"
    if isinstance(value, (float, np.floating)):
        return f"n{float(value) + 0.0!r}"
    if isinstance(value, pd.Timestamp):
        return f"t{value.tz_localize(None) if value.tzinfo else value}"
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{_cell(v)}" for k, v in value.items()) + "}"
    return f"s{value}"


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(zip(*[[_cell(v) for v in frame[n]] for n in names])) if len(frame) else []


def compare(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str:
    """Empty text when both hold the same columns and rows."""
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(duck_frame.columns)}"
    a, b = rows(spark_frame), rows(duck_frame)
    if len(a) != len(b):
        return f"row count {len(a)} vs {len(b)}"
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(off)} rows differ, first {off[0]}" if off else ""


def main(prefixes: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from galleryspark.session import build_session

    if os.environ.get("ORACLE_PLAIN"):  # a session without any of our settings
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = build_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, twins, bad = connect(), oracle_sql(), 0
    for name, query in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            got = query(spark, SF_DIR).toPandas()
            took = time.time() - start
            start = time.time()
            message = compare(got, con.execute(twins[name]).df()) if name in twins else "rows-only"
            note = f"{message or 'ok'}  ({len(got)} rows, spark {took:.1f}s, duckdb {time.time() - start:.1f}s)"
        except Exception as error:  # noqa: BLE001 - report and go on
            message, note = "error", f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += message not in ("", "rows-only")
        print(f"{'--' if message == 'rows-only' else 'OK' if not message else 'XX'} {name}: {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
