from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from segmetrics.session import local_session  # noqa: E402
from segmetrics.sources.fixture import household_fixture  # noqa: E402
from segmetrics.sources.schema import HOUSEHOLD_SCHEMA  # noqa: E402
from segmetrics.verify import duckdb_views  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("SEGMETRICS_ORACLE_SF", SF_SMALL)

CUR = dt.date(2025, 3, 31)
PRI = dt.date(2024, 3, 31)
OLD = dt.date(2023, 3, 31)


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus="*", app="segmetrics-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def hh(spark):
    """The derived household table at sf0.001, cached for the session."""
    df = household_fixture(spark, SF_SMALL).cache()
    df.count()
    yield df
    df.unpersist()


@pytest.fixture(scope="session")
def duck():
    con = duckdb_views(SF_ORACLE)
    yield con
    con.close()


def rows(spark, records: list[dict]):
    """A household DataFrame from a few literal rows; missing columns are NULL."""
    full = [{f.name: r.get(f.name) for f in HOUSEHOLD_SCHEMA.fields} for r in records]
    return spark.createDataFrame(full, schema=HOUSEHOLD_SCHEMA)
