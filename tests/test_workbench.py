"""The aggregate-once workbench gives exactly the 27 direct cuts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import CUR, PRI
from segmetrics.plans.catalog import CUTS, CUTS_BY_KEY
from segmetrics.plans.workbench import penetration_workbench, rollup, segment_cube, stacked_rollup

SNAPS = (CUR, PRI)


@pytest.fixture(scope="module")
def workbench(hh):
    return penetration_workbench(hh, SNAPS)


@pytest.mark.parametrize("spec", CUTS, ids=lambda c: c.key)
def test_rollup_equals_direct(hh, workbench, spec):
    direct = spec.run(hh, SNAPS)
    rolled = workbench[spec.key]
    assert rolled.columns == direct.columns
    assert rolled.dtypes == direct.dtypes
    assert rolled.collect() == direct.collect() if spec.order_by else sorted(
        map(tuple, rolled.collect()), key=repr
    ) == sorted(map(tuple, direct.collect()), key=repr)


def test_cube_is_small_and_complete(hh):
    cube = segment_cube(hh, SNAPS)
    rows = hh.where(F.col("DAILY_TIME_KEY").isin(list(SNAPS))).count()
    assert cube.agg(F.sum("_hh")).first()[0] == rows
    assert cube.count() < rows


def test_stacked_rollup_equals_each_rollup(hh):
    cube = segment_cube(hh, SNAPS).cache()
    stacked = stacked_rollup(cube, CUTS, [c.key for c in CUTS]).cache()
    for spec in CUTS:
        cols = [d.column for d in spec.dims]
        m = spec.measures
        want = sorted(
            (
                (*[None if r[c] is None else str(r[c]) for c in cols], *([None] if len(cols) == 1 else []),
                 r["DAILY_TIME_KEY"], r[m.households], r[m.customers], r[m.penetration])
                for r in rollup(cube, spec).collect()
            ),
            key=repr,
        )
        got = sorted(
            (tuple(r)[1:] for r in stacked.where(F.col("tag") == spec.key).collect()),
            key=repr,
        )
        assert got == want, spec.key
