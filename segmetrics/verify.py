"""Compare a Spark result with its DuckDB oracle (names, rows, values).

Mirrors the driver's check: column names compared as a set, row counts,
and an order-insensitive comparison of the rows. Doubles are compared after
rounding to ``digits`` decimals (``None``: bit-exact); everything else exactly.
"""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duckdb_views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """An in-process DuckDB connection with the test tables as views."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v + 0.0 if digits is None else round(v, digits) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item(), digits)
    return v


def _rows(cols: list[str], rows: list[tuple], digits: int) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return Counter(tuple(_norm(r[i], digits) for i in order) for r in rows)


def compare(spark_df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection, digits: int | None = 9) -> dict:
    """Report ``{columns_match, rows_spark, rows_oracle, values_match, ...}``."""
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    o_cols = [d[0] for d in rel.description]
    o_rows = rel.fetchall()
    report = {
        "columns_match": sorted(c.lower() for c in s_cols) == sorted(c.lower() for c in o_cols),
        "rows_spark": len(s_rows),
        "rows_oracle": len(o_rows),
    }
    if report["columns_match"]:
        a, b = _rows(s_cols, s_rows, digits), _rows(o_cols, o_rows, digits)
        report["values_match"] = a == b
        if a != b:
            report["only_spark"] = list((a - b).elements())[:5]
            report["only_oracle"] = list((b - a).elements())[:5]
    else:
        report["values_match"] = False
        report["spark_columns"], report["oracle_columns"] = s_cols, o_cols
    report["ok"] = report["columns_match"] and report["values_match"] and len(s_rows) == len(o_rows)
    return report
