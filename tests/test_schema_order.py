"""Output names, order, types and sort order of the 29 queries."""

from __future__ import annotations

import pytest

from conftest import CUR, PRI
from segmetrics.plans.catalog import QUERIES
from segmetrics.sources.schema import DEMOGRAPHIC_PULL_COLUMNS, HOME_VALUE_COLUMNS

D = "DAILY_TIME_KEY"
A = ["customer_count", "total_households", "penetration_rate"]
B = ["total_households", "customers", "penetration_rate"]
X = ["household_count", "customer_count", "penetration_rate"]

XTABS = {
    "xtab_dwelling_ownership": ("DWELLING_SEGMENT", "ownership_bucket"),
    "xtab_dwelling_family": ("DWELLING_SEGMENT", "household_mix"),
    "xtab_kids_ownership": ("kids_bucket", "ownership_bucket"),
    "xtab_kids_family": ("kids_bucket", "household_mix"),
    "xtab_ownership_family": ("ownership_bucket", "household_mix"),
    "xtab_dwelling_kids_group": ("DWELLING_SEGMENT", "kids_group"),
    "xtab_ownership_kids_group": ("ownership_bucket", "kids_group"),
    "xtab_dwelling_labor": ("DWELLING_SEGMENT", "labor_group"),
    "xtab_kids_labor": ("kids_bucket", "labor_group"),
    "xtab_ownership_labor": ("ownership_bucket", "labor_group"),
    "xtab_labor_family": ("labor_group", "household_mix"),
    "xtab_labor_kids_group": ("labor_group", "kids_group"),
    "xtab_dwelling_transport": ("DWELLING_SEGMENT", "transport_group"),
    "xtab_kids_transport": ("kids_bucket", "transport_group"),
    "xtab_ownership_transport": ("ownership_bucket", "transport_group"),
    "xtab_family_transport": ("household_mix", "transport_group"),
    "xtab_kids_group_transport": ("kids_group", "transport_group"),
}

# (columns in order, sort keys or None)
EXPECTED: dict[str, tuple[list[str], list[str] | None]] = {
    "block_group_summary": (
        [D, "CENSUS_BLOCK_GROUP", "hhs", "num_customers", "PERC_HH_W_CHILDREN", "perc_hh_wo_children",
         "bulk_hhs", "penetration", "bulk_pct", "apartment_count", "house_count", *HOME_VALUE_COLUMNS],
        ["CENSUS_BLOCK_GROUP", D],
    ),
    "cut_dwelling": (["DWELLING_SEGMENT", D, *A], None),
    "cut_bulk": ([D, "BULK_FLG", *A], None),
    "cut_block_bulk": (["block_bulk_status", D, *A], None),
    "cut_kids": ([D, "kids_bucket", *A], [D, "kids_bucket"]),
    "cut_family_mix": (["household_mix", D, *B], ["household_mix", D]),
    "cut_ownership": ([D, "ownership_bucket", "total_hhs", "customer_count", "penetration_rate"],
                      [D, "ownership_bucket"]),
    "cut_kids_group": (["kids_group", D, *B], ["kids_group", D]),
    "cut_labor": (["labor_group", D, *B], ["labor_group", D]),
    "cut_transport": (["transport_group", D, *B], ["transport_group", D]),
    "xtab_dwelling_kids": ([D, "DWELLING_SEGMENT", "kids_bucket", *A], [D, "DWELLING_SEGMENT", "kids_bucket"]),
    **{k: ([a, b, D, *X], [a, b, D]) for k, (a, b) in XTABS.items()},
    "demographic_pull": ([*DEMOGRAPHIC_PULL_COLUMNS, "hhs", "num_customers", "penetration"], None),
}


def test_all_29_declared():
    assert len(QUERIES) == 29
    assert set(QUERIES) == set(EXPECTED)


@pytest.fixture(scope="module")
def results(hh):
    return {k: q(hh, (CUR, PRI)) for k, q in QUERIES.items()}


@pytest.mark.parametrize("key", sorted(EXPECTED))
def test_columns_and_types(results, key):
    df = results[key]
    cols, _ = EXPECTED[key]
    assert df.columns == cols
    types = dict(df.dtypes)
    for c in cols:
        if c in ("hhs", "num_customers", "bulk_hhs", "apartment_count", "house_count") or c.endswith(
            ("_count", "total_households", "total_hhs", "customers")
        ):
            assert types[c] == "bigint", (c, types[c])
        if c in ("penetration_rate", "penetration", "bulk_pct", "perc_hh_wo_children"):
            assert types[c] == "double", (c, types[c])
    if D in cols:
        assert types[D] == "date"


def _sort_key(v):
    # ascending, NULLs last
    return (v is None, v)


@pytest.mark.parametrize("key", sorted(k for k, (_, s) in EXPECTED.items() if s))
def test_sorted_nulls_last(results, key):
    _, keys = EXPECTED[key]
    got = [tuple(r[k] for k in keys) for r in results[key].collect()]
    assert got == sorted(got, key=lambda t: tuple(_sort_key(v) for v in t))


def test_null_block_sorts_last_in_summary(results):
    got = results["block_group_summary"].collect()
    blocks = [r["CENSUS_BLOCK_GROUP"] for r in got]
    assert None in blocks
    first_null = blocks.index(None)
    assert all(b is None for b in blocks[first_null:])


def test_null_dwelling_sorts_last_within_date(results):
    got = [(r[D], r["DWELLING_SEGMENT"]) for r in results["xtab_dwelling_kids"].collect()]
    for day in {d for d, _ in got}:
        dwell = [w for d, w in got if d == day]
        assert None in dwell and dwell[-1] is None


def test_pull_has_no_date_and_merges_unchanged_blocks(results):
    pull = results["demographic_pull"]
    assert D not in pull.columns
    # Blocks whose population differs between the snapshots appear twice.
    twice = pull.groupBy("CENSUS_BLOCK_GROUP").count().where("count > 1").count()
    once = pull.groupBy("CENSUS_BLOCK_GROUP").count().where("count = 1").count()
    assert twice > 0 and once > 0
