"""Label tables: one case per branch, boundary, NULL and tie (FIXTURES.md §2).

Each case runs the real query declaration on literal rows; ``None`` as the
expected label means the query's row filter drops the row.
"""

from __future__ import annotations

import pytest

from conftest import CUR, OLD, PRI, rows
from segmetrics.operators.blocks import block_bulk_status, cut_block_bulk
from segmetrics.plans.catalog import CUTS_BY_KEY

SNAPS = (CUR, PRI)


def label_of(spark, key: str, record: dict):
    """Run cut ``key`` on one household row; return its label or None if dropped."""
    spec = CUTS_BY_KEY[key]
    base = {"DAILY_TIME_KEY": CUR, "CUSTOMER_FLAG": 1, "TOTAL_HOUSEHOLDS": 10}
    out = spec.run(rows(spark, [{**base, **record}]), SNAPS).collect()
    if not out:
        return None
    assert len(out) == 1
    return out[0][spec.dims[-1].column]


@pytest.mark.parametrize(
    "children, label",
    [(-0.5, "no_kids"), (0.0, "no_kids"), (0.99, "no_kids"), (1.0, "low_kids"), (1.99, "low_kids"),
     (2.0, "med_kids"), (2.99, "med_kids"), (3.0, "high_kids"), (None, None)],
)
def test_kids_bucket(spark, children, label):
    assert label_of(spark, "cut_kids", {"CHILDREN_PER_HH": children}) == label


@pytest.mark.parametrize(
    "owner, label",
    [(0.0, "low_ownership"), (0.25, "mid_low_ownership"), (0.5, "mid_high_ownership"),
     (0.75, "high_ownership"), (1.0, "high_ownership"), (-0.1, "low_ownership"), (None, None)],
)
def test_ownership_bucket(spark, owner, label):
    assert label_of(spark, "cut_ownership", {"PERC_OWNER_OCCUPIED": owner}) == label


@pytest.mark.parametrize(
    "families, households, single, crossed",
    [(6, 10, "family_dominant", "family_dominant"), (4, 10, "non_family_dominant", "non_family_dominant"),
     (5, 10, "even_split", "even_split"), (0, 10, "non_family_dominant", "non_family_dominant"),
     (12, 10, "family_dominant", "family_dominant"), (5, 0, None, None), (5, None, None, None),
     (None, 10, "even_split", None)],
)
def test_household_mix(spark, families, households, single, crossed):
    rec = {"TOTAL_FAMILIES": families, "TOTAL_HOUSEHOLDS": households, "DWELLING_SEGMENT": "HOUSE"}
    assert label_of(spark, "cut_family_mix", rec) == single
    assert label_of(spark, "xtab_dwelling_family", rec) == crossed


@pytest.mark.parametrize(
    "without, with_, households, label",
    [(5, 3, 10, "Less Kids"), (3, 5, 10, "More Kids"), (4, 4, 10, "More Kids"), (None, 4, 10, None),
     (4, None, 10, None), (5, 3, 0, None), (5, 3, None, None)],
)
def test_kids_group(spark, without, with_, households, label):
    rec = {"TOTAL_FAMILIES_WO_CHILDREN": without, "TOTAL_FAMILIES_W_CHILDREN": with_, "TOTAL_HOUSEHOLDS": households}
    assert label_of(spark, "cut_kids_group", rec) == label


@pytest.mark.parametrize(
    "inside, outside, households, label",
    [(5, 3, 10, "Labor Majority"), (3, 5, 10, "Labor Minority"), (4, 4, 10, "Equal"), (None, 4, 10, None),
     (4, None, 10, None), (5, 3, 0, None), (5, 3, None, None)],
)
def test_labor_group(spark, inside, outside, households, label):
    rec = {"TOTAL_IN_LABOR_FORCE": inside, "TOTAL_NOT_IN_LABOR_FORCE": outside, "TOTAL_HOUSEHOLDS": households}
    assert label_of(spark, "cut_labor", rec) == label


@pytest.mark.parametrize(
    "drive, carpool, wfh, label",
    [(5, 1, 1, "Drive Alone Majority"), (1, 5, 1, "Carpool Majority"), (1, 1, 5, "WFH Majority"),
     (5, 5, 1, "Other"), (1, 5, 5, "Other"), (0, 0, 0, "Other"), (2, 2, 2, "Other"), (None, 1, 1, None),
     (1, None, 1, None), (1, 1, None, None)],
)
def test_transport_group(spark, drive, carpool, wfh, label):
    rec = {"TRANSPORTATION_DRIVE_ALONE": drive, "TRANSPORTATION_CARPOOL": carpool,
           "TRANSPORTATION_WORK_FROM_HOME": wfh}
    assert label_of(spark, "cut_transport", rec) == label


def test_transport_needs_households(spark):
    rec = {"TRANSPORTATION_DRIVE_ALONE": 5, "TRANSPORTATION_CARPOOL": 1, "TRANSPORTATION_WORK_FROM_HOME": 1,
           "TOTAL_HOUSEHOLDS": 0}
    assert label_of(spark, "cut_transport", rec) is None


@pytest.mark.parametrize(
    "flags, status",
    [((0, 1), "has_bulk"), ((0, 0), "no_bulk"), ((None, None), "no_bulk"), ((None, 1), "has_bulk"),
     ((0, 2), "no_bulk")],
)
def test_block_bulk_status(spark, flags, status):
    recs = [{"CENSUS_BLOCK_GROUP": "000000000001", "BULK_FLG": f, "DAILY_TIME_KEY": d}
            for f, d in zip(flags, (CUR, PRI))]
    got = block_bulk_status(rows(spark, recs)).collect()
    assert [(r["CENSUS_BLOCK_GROUP"], r["block_bulk_status"]) for r in got] == [("000000000001", status)]


def test_block_bulk_uses_history_outside_snapshots(spark):
    recs = [
        {"CENSUS_BLOCK_GROUP": "A", "BULK_FLG": 0, "DAILY_TIME_KEY": CUR, "CUSTOMER_FLAG": 1},
        {"CENSUS_BLOCK_GROUP": "A", "BULK_FLG": 1, "DAILY_TIME_KEY": OLD, "CUSTOMER_FLAG": 1},
        {"CENSUS_BLOCK_GROUP": None, "BULK_FLG": 1, "DAILY_TIME_KEY": CUR, "CUSTOMER_FLAG": 1},
    ]
    got = cut_block_bulk(rows(spark, recs), SNAPS).collect()
    assert [(r["block_bulk_status"], r["total_households"]) for r in got] == [("has_bulk", 1)]


@pytest.mark.parametrize("flag, counted", [(1, 1), (0, 0), (2, 0), (None, 0)])
def test_customer_flag(spark, flag, counted):
    out = CUTS_BY_KEY["cut_bulk"].run(rows(spark, [{"DAILY_TIME_KEY": CUR, "CUSTOMER_FLAG": flag}]), SNAPS)
    assert out.collect()[0]["customer_count"] == counted


def test_bulk_flag_groups_keep_null(spark):
    recs = [{"DAILY_TIME_KEY": CUR, "BULK_FLG": f, "CUSTOMER_FLAG": 1} for f in (1, 0, None)]
    out = CUTS_BY_KEY["cut_bulk"].run(rows(spark, recs), SNAPS).collect()
    assert sorted((r["BULK_FLG"] is None, r["BULK_FLG"]) for r in out) == [(False, 0), (False, 1), (True, None)]


def test_dwelling_null_dropped_in_cut_kept_in_xtab(spark):
    recs = [{"DAILY_TIME_KEY": CUR, "DWELLING_SEGMENT": d, "CHILDREN_PER_HH": 1.0, "CUSTOMER_FLAG": 1}
            for d in ("APARTMENT", "MOBILE", None)]
    df = rows(spark, recs)
    cut = {r["DWELLING_SEGMENT"] for r in CUTS_BY_KEY["cut_dwelling"].run(df, SNAPS).collect()}
    xtab = {r["DWELLING_SEGMENT"] for r in CUTS_BY_KEY["xtab_dwelling_kids"].run(df, SNAPS).collect()}
    assert cut == {"APARTMENT", "MOBILE"}
    assert xtab == {"APARTMENT", "MOBILE", None}


def test_other_dates_are_ignored(spark):
    recs = [{"DAILY_TIME_KEY": d, "DWELLING_SEGMENT": "HOUSE", "CUSTOMER_FLAG": 1} for d in (CUR, PRI, OLD)]
    out = CUTS_BY_KEY["cut_dwelling"].run(rows(spark, recs), SNAPS).collect()
    assert sorted(r["DAILY_TIME_KEY"] for r in out) == [PRI, CUR]
