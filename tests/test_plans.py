"""Physical plans on a date-partitioned fact table: pruning, pushdown, no UDF."""

from __future__ import annotations

import pytest

from conftest import CUR, PRI
from segmetrics.operators.blocks import block_bulk_status
from segmetrics.plans.catalog import QUERIES
from segmetrics.sources.household import read_household_history, write_household_history

SNAPS = (CUR, PRI)


@pytest.fixture(scope="module")
def table(spark, hh, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    path = str(tmp_path_factory.mktemp("hh") / "household_daily_history")
    write_household_history(hh.drop("HOUSEHOLD_ROW_ID"), path)
    return read_household_history(spark, path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan parquet" in line]


def test_partitioned_round_trip(table, hh):
    assert table.count() == hh.count()
    assert sorted(r[0] for r in table.select("DAILY_TIME_KEY").distinct().collect()) == sorted(
        r[0] for r in hh.select("DAILY_TIME_KEY").distinct().collect()
    )


@pytest.mark.parametrize("key", sorted(set(QUERIES) - {"cut_block_bulk"}))
def test_snapshot_filter_prunes_partitions(table, key):
    (scan,) = scans(plan(QUERIES[key](table, SNAPS)))
    assert "PartitionFilters: [isnotnull(DAILY_TIME_KEY" in scan or "PartitionFilters: [DAILY_TIME_KEY" in scan


def test_block_status_reads_full_history_only_block_and_flag(table):
    (scan,) = scans(plan(block_bulk_status(table)))
    assert "PartitionFilters: []" in scan
    assert "ReadSchema: struct<CENSUS_BLOCK_GROUP:string,BULK_FLG:int>" in scan


def test_block_bulk_cut_prunes_snapshots_and_joins_block_grain(table):
    text = plan(QUERIES["cut_block_bulk"](table, SNAPS))
    household_scans = [s for s in scans(text) if "household_daily_history" in s]
    # The snapshots, pruned, and the history for the block status.
    assert len(household_scans) == 2 and sum("PartitionFilters: []" in s for s in household_scans) == 1
    # Both join inputs are aggregates keyed by the block group.
    assert "keys=[CENSUS_BLOCK_GROUP" in text or "Keys [1]: [CENSUS_BLOCK_GROUP" in text


def test_dwelling_cut_reads_two_columns(table):
    (scan,) = scans(plan(QUERIES["cut_dwelling"](table, SNAPS)))
    assert "ReadSchema: struct<DWELLING_SEGMENT:string,CUSTOMER_FLAG:int>" in scan
    assert "IsNotNull(DWELLING_SEGMENT)" in scan


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_udf_and_partial_aggregation(table, key):
    text = plan(QUERIES[key](table, SNAPS))
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text and "BatchEvalPython" not in text
    assert "partial_" in text or "HashAggregate" in text


@pytest.mark.parametrize("key", ["cut_transport", "xtab_kids_group_transport"])
def test_guards_pushed_to_scan(table, key):
    (scan,) = scans(plan(QUERIES[key](table, SNAPS)))
    for col in ("TRANSPORTATION_DRIVE_ALONE", "TRANSPORTATION_CARPOOL", "TRANSPORTATION_WORK_FROM_HOME"):
        assert f"IsNotNull({col})" in scan
    assert "Not(EqualTo(TOTAL_HOUSEHOLDS,0))" in scan


def test_all_interactions_and_narrow_workbench_leave_the_history_alone(table):
    from segmetrics.operators.compare import CROSS_TABS, all_interactions
    from segmetrics.plans.workbench import segment_cube

    for df in (all_interactions(table, SNAPS), segment_cube(table, SNAPS, specs=CROSS_TABS)):
        (scan,) = scans(plan(df))
        assert "PartitionFilters: []" not in scan and "BULK_FLG" not in scan
