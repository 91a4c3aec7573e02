"""Spark vs. the DuckDB oracle on random household tables full of edge cases.

The fixture follows fixed arithmetic; these tables draw every column from
small value sets that hit the bucket edges (0.25, 0.4, 0.6, 1, 2, 3), ties,
zero and NULL households, flags of 2, negative keys and NULLs everywhere.
The same rows go to Spark and to DuckDB (as ``hh``), and every statement
must agree bit for bit.
"""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from conftest import CUR, OLD, PRI
from segmetrics.oracle import WORKBENCH_BODIES
from segmetrics.plans.catalog import CUTS, QUERIES
from segmetrics.plans.workbench import penetration_workbench
from segmetrics.sources.schema import HOUSEHOLD_SCHEMA

SNAPS = (CUR, PRI)

CHOICES = {
    "DAILY_TIME_KEY": [CUR, PRI, OLD, dt.date(2025, 4, 1)],
    "CENSUS_BLOCK_GROUP": [None, "000000000001", "000000000002", "000000000003", "000000000004"],
    "DWELLING_SEGMENT": [None, "APARTMENT", "HOUSE", "MOBILE"],
    "BULK_FLG": [None, 0, 1, 2],
    "CUSTOMER_KEY": [None, -1, 0, 5, 1234],
    "CUSTOMER_FLAG": [None, 0, 1, 2],
    "TOTAL_HOUSEHOLDS": [None, 0, 5, 10],
    "TOTAL_FAMILIES": [None, 0, 2, 3, 4, 5, 6, 12],
    "CHILDREN_PER_HH": [None, -0.5, 0.0, 0.99, 1.0, 1.5, 2.0, 2.99, 3.0, 7.5],
    "PERC_OWNER_OCCUPIED": [None, 0.0, 0.2, 0.25, 0.5, 0.74, 0.75, 1.0],
    "TOTAL_FAMILIES_W_CHILDREN": [None, 0, 1, 2, 3],
    "TOTAL_FAMILIES_WO_CHILDREN": [None, 0, 1, 2, 3],
    "TOTAL_IN_LABOR_FORCE": [None, 0, 1, 2, 3],
    "TOTAL_NOT_IN_LABOR_FORCE": [None, 0, 1, 2, 3],
    "TRANSPORTATION_DRIVE_ALONE": [None, 0, 1, 2, 3],
    "TRANSPORTATION_CARPOOL": [None, 0, 1, 2, 3],
    "TRANSPORTATION_WORK_FROM_HOME": [None, 0, 1, 2, 3],
    "PERC_HH_W_CHILDREN": [None, 0.0, 0.1, 0.5, 1.0],
}


def _draw(rng: np.random.Generator, field, n: int) -> list:
    if field.name in CHOICES:
        opts = CHOICES[field.name]
    elif field.dataType.simpleString() == "double":
        opts = [None, 0.0, 0.5, 1.25]
    else:
        opts = [None, 0, 1, 7]
    return [opts[i] for i in rng.integers(0, len(opts), n)]


def random_table(seed: int, n: int = 400) -> pa.Table:
    rng = np.random.default_rng(seed)
    arrow_types = {"date": pa.date32(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(),
                   "double": pa.float64()}
    cols = {f.name: pa.array(_draw(rng, f, n), type=arrow_types[f.dataType.simpleString()])
            for f in HOUSEHOLD_SCHEMA.fields}
    return pa.table(cols)


def _bag(cols: list[str], rows) -> list:
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    norm = [tuple(None if r[i] is None else r[i] for i in order) for r in rows]
    return sorted(norm, key=repr)


@pytest.fixture(scope="module", params=[7, 2024])
def tables(request, spark):
    table = random_table(request.param)
    con = duckdb.connect()
    con.register("hh", table)
    df = spark.createDataFrame(table.to_pylist(), schema=HOUSEHOLD_SCHEMA).cache()
    yield df, con
    df.unpersist()
    con.close()


@pytest.mark.parametrize("key", list(QUERIES))
def test_statement_matches_oracle_on_random_rows(tables, key):
    df, con = tables
    got = QUERIES[key](df, SNAPS)
    rel = con.execute(WORKBENCH_BODIES[key])
    want_cols = [d[0] for d in rel.description]
    assert sorted(c.lower() for c in got.columns) == sorted(c.lower() for c in want_cols)
    assert _bag(got.columns, [tuple(r) for r in got.collect()]) == _bag(want_cols, rel.fetchall())


def test_workbench_matches_direct_on_random_rows(tables):
    df, _ = tables
    rolled = penetration_workbench(df, SNAPS)
    for spec in CUTS:
        a = sorted(map(tuple, rolled[spec.key].collect()), key=repr)
        b = sorted(map(tuple, spec.run(df, SNAPS).collect()), key=repr)
        assert a == b, spec.key
