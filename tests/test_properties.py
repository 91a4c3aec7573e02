"""Invariants of the cuts on the sf0.001 fixture, and mutations they must catch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import CUR, PRI
from segmetrics.functions.dimensions import row_guard
from segmetrics.functions.measures import key_gt_0
from segmetrics.operators.blocks import block_bulk_status, demographic_pull
from segmetrics.operators.penetration import Measures, penetration_by
from segmetrics.plans.catalog import CUTS, CUTS_BY_KEY, QUERIES

SNAPS = (CUR, PRI)
DATES = "DAILY_TIME_KEY IN (DATE '2025-03-31', DATE '2024-03-31')"

# Row filters of the single cuts, written as SQL independently of the catalog.
SINGLE_FILTERS = {
    "cut_dwelling": "DWELLING_SEGMENT IS NOT NULL",
    "cut_bulk": "TRUE",
    "cut_kids": "CHILDREN_PER_HH IS NOT NULL",
    "cut_family_mix": "TOTAL_HOUSEHOLDS <> 0",
    "cut_ownership": "PERC_OWNER_OCCUPIED IS NOT NULL",
    "cut_kids_group": "TOTAL_HOUSEHOLDS <> 0 AND TOTAL_FAMILIES_WO_CHILDREN IS NOT NULL "
    "AND TOTAL_FAMILIES_W_CHILDREN IS NOT NULL",
    "cut_labor": "TOTAL_HOUSEHOLDS <> 0 AND TOTAL_IN_LABOR_FORCE IS NOT NULL AND TOTAL_NOT_IN_LABOR_FORCE IS NOT NULL",
    "cut_transport": "TOTAL_HOUSEHOLDS <> 0 AND TRANSPORTATION_DRIVE_ALONE IS NOT NULL "
    "AND TRANSPORTATION_CARPOOL IS NOT NULL AND TRANSPORTATION_WORK_FROM_HOME IS NOT NULL",
}


def _hh_col(spec):
    return spec.measures.households


@pytest.mark.parametrize("key", sorted(SINGLE_FILTERS))
def test_buckets_partition_the_guarded_rows(hh, key):
    spec = CUTS_BY_KEY[key]
    total = spec.run(hh, SNAPS).agg(F.sum(_hh_col(spec))).first()[0]
    expected = hh.where(DATES).where(SINGLE_FILTERS[key]).count()
    assert total == expected


@pytest.mark.parametrize("spec", [c for c in CUTS if len(c.dims) == 2], ids=lambda c: c.key)
def test_xtab_margins_equal_guarded_single_cuts(hh, spec):
    xtab = spec.run(hh, SNAPS)
    for keep in spec.dims:
        margin = (
            xtab.groupBy(keep.column, "DAILY_TIME_KEY")
            .agg(F.sum(spec.measures.households).alias("h"), F.sum(spec.measures.customers).alias("c"))
        )
        single = penetration_by(hh, [keep], SNAPS, guard=row_guard(spec.guard_list), measures=Measures("h", "c"))
        a = sorted((tuple(r) for r in margin.collect()), key=repr)
        b = sorted((tuple(r)[:4] for r in single.collect()), key=repr)
        assert a == b


@pytest.mark.parametrize("spec", CUTS, ids=lambda c: c.key)
def test_counts_and_rate_bounds(hh, spec):
    m = spec.measures
    df = spec.run(hh, SNAPS)
    bad = df.where(
        (F.col(m.customers) < 0)
        | (F.col(m.customers) > F.col(m.households))
        | (F.col(m.households) < 1)
        | ~F.col(m.penetration).between(0.0, 1.0)
    )
    assert bad.count() == 0
    assert df.count() > 0


def test_block_bulk_totals_equal_rows_with_block(hh):
    out = QUERIES["cut_block_bulk"](hh, SNAPS)
    total = out.agg(F.sum("total_households")).first()[0]
    assert total == hh.where(DATES).where("CENSUS_BLOCK_GROUP IS NOT NULL").count()


def test_mutation_date_filter_before_block_status_changes_result(hh):
    full = {tuple(r) for r in block_bulk_status(hh).collect()}
    early = {tuple(r) for r in block_bulk_status(hh.where(DATES)).collect()}
    assert full != early


def test_mutation_customer_tests_differ(hh):
    flag = QUERIES["demographic_pull"](hh, SNAPS).agg(F.sum("num_customers")).first()[0]
    by_flag = hh.where(DATES).where("CUSTOMER_FLAG = 1").count()
    by_key = hh.where(DATES).where(key_gt_0()).count()
    assert flag == by_key != by_flag


def test_mutation_family_guard_on_single_cut(hh):
    spec = CUTS_BY_KEY["cut_family_mix"]
    loose = spec.run(hh, SNAPS).agg(F.sum("total_households")).first()[0]
    strict = hh.where(DATES).where("TOTAL_HOUSEHOLDS <> 0 AND TOTAL_FAMILIES IS NOT NULL").count()
    assert loose > strict


def test_mutation_pull_with_date_has_more_rows(hh):
    pull = demographic_pull(hh, SNAPS).count()
    dated = hh.where(DATES).select("DAILY_TIME_KEY", *demographic_pull(hh, SNAPS).columns[:55]).distinct().count()
    assert dated > pull


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_empty_input_gives_no_rows(hh, key):
    assert QUERIES[key](hh.where(F.lit(False)), SNAPS).count() == 0
    assert QUERIES[key](hh, ("1999-01-01", "1999-01-02")).count() == 0
