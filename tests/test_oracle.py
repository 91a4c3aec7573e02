"""Every registered query equals its DuckDB oracle (the driver's gate).

Runs on sf0.001 by default; ``SEGMETRICS_ORACLE_SF=/root/testdata/sf0.01``
runs the driver's scale.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE
from segmetrics.verify import compare

QUERIES = entry.queries()
SQL = entry.oracle_sql()


def test_every_query_has_an_oracle_or_is_listed():
    without = sorted(set(QUERIES) - set(SQL))
    assert set(SQL) <= set(QUERIES)
    # Only operators that are not expressible as one SQL statement may lack one.
    assert without == sorted(entry.NON_SQL_QUERIES), without


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    report = compare(QUERIES[key](spark, SF_ORACLE), SQL[key], duck)
    assert report["ok"], report


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "DAILY_TIME_KEY",
        "DWELLING_SEGMENT",
        "kids_bucket",
        "customer_count",
        "total_households",
        "penetration_rate",
    ]
    assert df.count() > 0
