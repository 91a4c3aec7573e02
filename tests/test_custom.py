"""Any dimension through the long form, the comparison, the ranking and the interactions."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import CUR, PRI
from segmetrics.functions.dimensions import BLOCK_BULK, DWELLING_DIM, FAMILY_MIX, KIDS, custom_dimension
from segmetrics.functions.measures import key_gt_0
from segmetrics.operators.compare import all_interactions, cut_spec, interactions_by, long_by, spread_ranking, yoy_change
from segmetrics.plans.analyses import AGE_DECADE, ANALYSES
from segmetrics.plans.catalog import BLOCK_BULK_DWELLING
from segmetrics.plans.workbench import penetration_workbench, segment_cube, stacked_cuts
from segmetrics.sources.household import read_household_history, write_household_history

SNAPS = (CUR, PRI)


@pytest.fixture(scope="module")
def table(spark, hh, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    path = str(tmp_path_factory.mktemp("hh") / "household_daily_history")
    write_household_history(hh.drop("HOUSEHOLD_ROW_ID"), path)
    return read_household_history(spark, path)


@pytest.fixture(scope="module")
def hh_pd(hh):
    frame = hh.select("DAILY_TIME_KEY", "MEDIAN_HH_AGE", "CHILDREN_PER_HH", "CUSTOMER_KEY", "CUSTOMER_FLAG", "DWELLING_SEGMENT").toPandas()
    return frame[frame.DAILY_TIME_KEY.isin(SNAPS)]


def scans(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in line]


OLD = custom_dimension("old", lambda: F.when(F.col("MEDIAN_HH_AGE") >= 60, "old").otherwise("young"), guard=lambda: F.col("CHILDREN_PER_HH") > 1)


def test_guarded_custom_dimension_in_the_long_form(hh, hh_pd):
    rows = long_by(hh, SNAPS, [OLD, KIDS], customer=key_gt_0()).where("dimension = 'old'").collect()
    kept = hh_pd[hh_pd.CHILDREN_PER_HH > 1]
    want = kept.assign(bucket=kept.MEDIAN_HH_AGE.ge(60).map({True: "old", False: "young"}), c=kept.CUSTOMER_KEY.gt(0)).groupby(["bucket", "DAILY_TIME_KEY"]).c.agg(["count", "sum"])
    assert {(r["bucket"], r["DAILY_TIME_KEY"]): (r["households"], r["customers"]) for r in rows} == {k: tuple(v) for k, v in want.iterrows()}
    assert all(r["penetration_rate"] == r["customers"] / r["households"] for r in rows)


def test_custom_interactions_use_the_cross_tabs_own_margins(hh, hh_pd):
    got = interactions_by(hh, SNAPS, [(OLD, DWELLING_DIM)]).collect()
    kept = hh_pd[(hh_pd.CHILDREN_PER_HH > 1) & hh_pd.DWELLING_SEGMENT.notna()]
    kept = kept.assign(a=kept.MEDIAN_HH_AGE.ge(60).map({True: "old", False: "young"}), c=kept.CUSTOMER_FLAG.eq(1))
    rate = lambda *keys: kept.groupby([*keys, "DAILY_TIME_KEY"]).c.mean()
    ab, a, b, every = rate("a", "DWELLING_SEGMENT"), rate("a"), rate("DWELLING_SEGMENT"), rate()
    assert len(got) == len(ab)
    for r in got:
        x, y, d = r["bucket_a"], r["bucket_b"], r["DAILY_TIME_KEY"]
        assert r["interaction"] == pytest.approx(ab[x, y, d] - (a[x, d] + b[y, d] - every[d]), abs=1e-12)


def test_comparison_and_ranking_take_the_custom_long_form(hh):
    long = long_by(hh, SNAPS, [OLD, AGE_DECADE])
    change = yoy_change(long, ["dimension", "bucket"], CUR, PRI).collect()
    assert {r["dimension"] for r in change} == {"old", "age_decade"} and all(r["penetration_change"] is not None for r in change if r["dimension"] == "old")
    ranks = spread_ranking(long).collect()
    assert sorted(r["spread_rank"] for r in ranks if r["DAILY_TIME_KEY"] == CUR) == [1, 2]


def test_equal_sets_and_replaced_guards(hh):
    """Two cuts may share a grouping set; a cut's own guard list replaces the dimensions' named ones."""
    specs = [cut_spec(KIDS), cut_spec(KIDS), cut_spec(FAMILY_MIX, guards=("households_nonzero",)), cut_spec(FAMILY_MIX)]
    rows = stacked_cuts(hh, SNAPS, specs, ["one", "two", "loose", "strict"]).collect()
    by_tag = {t: {(r["bucket_a"], r["DAILY_TIME_KEY"]): r["households"] for r in rows if r["tag"] == t} for t in ("one", "two", "loose", "strict")}
    assert by_tag["one"] == by_tag["two"] and len(by_tag["one"]) == 8
    assert sum(by_tag["loose"].values()) > sum(by_tag["strict"].values())
    with pytest.raises(ValueError, match="one or two"):
        stacked_cuts(hh, SNAPS, [cut_spec(KIDS, DWELLING_DIM, FAMILY_MIX)], ["three"])


@pytest.mark.parametrize("key", ["custom_long", "custom_yoy", "custom_ranking"])
def test_custom_queries_scan_two_partitions_once(table, key):
    (scan,) = scans(ANALYSES[key](table, SNAPS))
    assert "PartitionFilters: [isnotnull(DAILY_TIME_KEY" in scan or "PartitionFilters: [DAILY_TIME_KEY" in scan


def test_custom_interactions_scan_two_partitions_once(table):
    df = interactions_by(table, SNAPS, [(AGE_DECADE, KIDS), (DWELLING_DIM, AGE_DECADE)])
    (scan,) = scans(df)
    assert "PartitionFilters: [isnotnull(DAILY_TIME_KEY" in scan or "PartitionFilters: [DAILY_TIME_KEY" in scan


def test_labels_are_aggregated_before_the_sets_are_expanded(table):
    text = all_interactions(table, SNAPS)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in text.splitlines() if "Expand" in line or "HashAggregate" in line or "FileScan" in line]
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    # Two aggregates (final and partial) stand between the expanded rows and the scan.
    assert scan - expand == 3


def test_block_status_beside_a_household_label(hh):
    got = {(r["block_bulk_status"], r["DWELLING_SEGMENT"], r["DAILY_TIME_KEY"]): (r["household_count"], r["customer_count"]) for r in BLOCK_BULK_DWELLING.run(hh, SNAPS).collect()}
    frame = hh.select("DAILY_TIME_KEY", "CENSUS_BLOCK_GROUP", "BULK_FLG", "DWELLING_SEGMENT", "CUSTOMER_FLAG").toPandas()
    top = frame.groupby("CENSUS_BLOCK_GROUP").BULK_FLG.max().eq(1).map({True: "has_bulk", False: "no_bulk"})
    kept = frame[frame.DAILY_TIME_KEY.isin(SNAPS) & frame.CENSUS_BLOCK_GROUP.notna() & frame.DWELLING_SEGMENT.notna()]
    kept = kept.assign(status=kept.CENSUS_BLOCK_GROUP.map(top), c=kept.CUSTOMER_FLAG.eq(1))
    want = kept.groupby(["status", "DWELLING_SEGMENT", "DAILY_TIME_KEY"]).c.agg(["count", "sum"])
    assert got == {k: tuple(v) for k, v in want.iterrows()} and len(got) == 12


def test_block_status_pair_reads_two_columns_of_the_history(table):
    found = scans(BLOCK_BULK_DWELLING.run(table, SNAPS))
    whole = [s for s in found if "PartitionFilters: []" in s]
    assert len(found) == 2 and len(whole) == 1
    assert "ReadSchema: struct<CENSUS_BLOCK_GROUP:string,BULK_FLG:int>" in whole[0]


def test_block_status_pair_in_the_workbench_and_in_the_stack(hh):
    direct = {tuple(r) for r in BLOCK_BULK_DWELLING.run(hh, SNAPS).collect()}
    cuts = penetration_workbench(hh, SNAPS, specs=[BLOCK_BULK_DWELLING])
    assert {tuple(r) for r in cuts["xtab_block_bulk_dwelling"].collect()} == direct
    stacked = stacked_cuts(hh, SNAPS, [BLOCK_BULK_DWELLING, cut_spec(KIDS)], ["pair", "kids"])
    assert {(r["bucket_a"], r["bucket_b"], r["DAILY_TIME_KEY"], r["households"], r["customers"], r["penetration_rate"]) for r in stacked.where("tag = 'pair'").collect()} == direct


def test_custom_block_pair(hh):
    rows = interactions_by(hh, SNAPS, [(BLOCK_BULK, OLD)]).collect()
    assert {r["cross_tab"] for r in rows} == {"block_bulk_old"} and {r["bucket_a"] for r in rows} == {"has_bulk", "no_bulk"}


def test_cube_counts_the_given_customers(hh, hh_pd):
    cube = segment_cube(hh, SNAPS, specs=[cut_spec(KIDS)], customer=key_gt_0())
    assert cube.agg(F.sum("_cc")).first()[0] == int(pd.Series(hh_pd.CUSTOMER_KEY).gt(0).sum())
